"""Format-preserving pseudonyms for personal data, by a keyed Feistel network.

Validated card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4 addresses, phone
numbers with a ``+`` and dates from 1900 to 2099 become other valid values of the same format: ten
Feistel rounds with a keyed SHA-256 permute the value's index within its domain, so equal values get
equal pseudonyms in all documents and different values of a format different ones.  Mail addresses
and hexadecimal secrets, which have no such domain, become keyed digests in their shape.  What fails
validation, other dates and phone numbers without a country code stay as they are.  DataFrame
functions only.

A slash date is read month first where that is a date, else day first; those that can only be read
day first are permuted among themselves (by day up to 28, and by length of the month for later days).

The key is a string or a column.  A string shows in the plan, so only a public key should be given
that way; ``key_from`` reads a secret one from a file when the query runs.

Defined cases: null texts stay null, texts without a match stay equal; all copies of a row change
alike; an empty table gives an empty result; other columns pass through, whatever their names, but
for one named like ``count``, which is replaced.  A number and its separators keep their lay-out.  A
mail domain has at most 127 labels of at most 63 characters; longer ones are not taken for one, so
texts of any length are matched in bounded depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents, fresh

#: Stands in for the deployment's secret in tests and in the registered query.
DEMO_KEY = "barline-demo-key"
ROUNDS = 10

EDGE_L, EDGE_R = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,125}\.\p{L}{2,63}"
SECRET = EDGE_L + r"(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,64}" + EDGE_R
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_SIZED = "|".join(
    f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items()
)
#: The country's length decides where an IBAN ends; other countries' are taken as far as they go.
IBAN = EDGE_L + r"(?=[A-Z]{2}[0-9]{2})(?:(?:" + _SIZED + ")" + EDGE_R + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + EDGE_R + ")"
PHONE = (
    r"(?<![\p{L}\p{N}_+])\+(?:[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-]?[0-9]{3,4}"
    r"|[0-9]{1,3}(?<sep>[ .-])[0-9]{2,4}(?:\k<sep>[0-9]{2,8}){1,3}|[0-9]{8,15})" + EDGE_R + r"(?!\.[0-9])"
)
SSN = r"(?<![\p{L}\p{N}_-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])"
CARD = EDGE_L + r"(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})" + EDGE_R
#: An ISO date may go on with a time.
DATE = r"(?<![\p{L}\p{N}_./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?=[Tt][0-9]{2}(?::?[0-9]{2}|$|[^\p{L}\p{N}_]))|(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}_/-]))"
IPV4 = r"(?<![\p{L}\p{N}_.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}_])(?!\.[0-9])"
KINDS = (EMAIL, SECRET, IBAN, PHONE, SSN, DATE, IPV4)
ANY = "|".join((CARD, *KINDS))
#: The days of 1900 to 2099.
FIRST_YEAR, YEARS, DATE_SIDES = 1900, 200, (17, 4297)
LONG_MONTHS, SHORT_MONTHS = (1, 3, 5, 7, 8, 10, 12), (4, 6, 9, 11)


def _prf(key: str | Column, kind: str, n: Column, value: Column) -> Column:
    """60 bits of a keyed digest."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), value.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str | Column, kind: str, a: Column, b: Column, side_a: Column, side_b: Column) -> Column:
    """Keyed permutation of ``[0, side_a) x [0, side_b)``: struct(a, b)."""
    add = lambda x, y, side, n: F.pmod(x + F.pmod(_prf(key, kind, n, y), side), side)

    def step(s: Column, n: Column) -> Column:
        even = n % 2 == 0
        return F.struct(
            F.when(even, add(s["a"], s["b"], side_a, n)).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(add(s["b"], s["a"], side_b, n)).alias("b"),
        )

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str | Column, kind: str, digits: Column) -> Column:
    """A string of 2 to 36 digits -> another of that length."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    out = feistel(key, kind, F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), _power(half), _power(rest))
    return _let(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""

    def step(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(s["out"], F.when(is_digit, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + is_digit.cast("int")).alias("i"))

    return F.aggregate(F.split(template, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])


def card(key: str | Column, m: Column) -> Column:
    d = _digits(m)

    def checked(body: Column) -> Column:
        return F.concat(body, F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda x: x.cast("string")), lambda x: _luhn(F.concat(body, x))), F.lit(0)))

    return _fill(m, _let(permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1)), checked))


def _mod97(s: Column) -> Column:
    """Remainder of letters (A = 10 ...) and digits read as one number."""
    step = lambda acc, c: F.when(c == "", acc).when(c.rlike("^[0-9]$"), (acc * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def iban_valid(m: Column) -> Column:
    s = F.replace(m, F.lit(" "))
    return F.length(s).between(15, 34) & (_mod97(F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))) == 1)


def iban(key: str | Column, m: Column) -> Column:
    """Digits of the account part are permuted, letters stay, the check digits are made anew."""
    bare = F.replace(m, F.lit(" "))
    body = F.substring(bare, F.lit(5), F.length(bare))
    own = _digits(body)
    fresh = F.when(F.length(own) >= 2, _fill(body, permute_digits(key, "iban", own))).otherwise(body)

    def checked(b: Column) -> Column:
        check = 98 - _mod97(F.concat(b, F.substring(bare, 1, 2), F.lit("00")))
        return F.concat(F.lpad(check.cast("string"), 2, "0"), b)

    def spaced(s: Column) -> Column:
        step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).when(c == "", c).otherwise(F.substring(s, acc["i"], F.lit(1)))).alias("out"), (acc["i"] + (~c.isin(" ", "")).cast("int")).alias("i"))
        return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda acc: acc["out"])

    return _let(_let(fresh, checked), lambda s: spaced(F.concat(F.substring(bare, 1, 2), s)))


def _number(m: Column, at: int, n: int) -> Column:
    return F.substring(m, at, n).cast("long")


def ssn_valid(m: Column) -> Column:
    return ~m.rlike("^(000|666|9)|-00-|-0000$")


def ssn(key: str | Column, m: Column) -> Column:
    area = _number(m, 1, 3)
    index = area - 1 - (area > 666).cast("long")
    out = feistel(key, "ssn", index * 99 + _number(m, 5, 2) - 1, _number(m, 8, 4) - 1, F.lit(898 * 99), F.lit(9999))

    def shown(s: Column) -> Column:
        i = F.floor(s["a"] / 99) + 1
        return F.format_string("%03d-%02d-%04d", i + (i >= 666).cast("long"), s["a"] % 99 + 1, s["b"] + 1)

    return _let(out, shown)


def _octets(m: Column) -> Column:
    return F.transform(F.split(m, r"\."), lambda x: x.cast("long"))


def ipv4(key: str | Column, m: Column) -> Column:
    o = _octets(m)
    out = feistel(key, "ipv4", F.get(o, F.lit(0)) * 256 + F.get(o, F.lit(1)), F.get(o, F.lit(2)) * 256 + F.get(o, F.lit(3)), F.lit(65536), F.lit(65536))
    byte = lambda x, k: (F.floor(x / 256) if k else x % 256).cast("string")
    return _let(out, lambda s: F.concat_ws(".", byte(s["a"], 1), byte(s["a"], 0), byte(s["b"], 1), byte(s["b"], 0)))


def phone(key: str | Column, m: Column) -> Column:
    """The country code, up to the first separator or three digits, stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}?(?=[ .(-])|^\+[0-9]", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _fill(rest, permute_digits(key, "phone", _digits(rest))))


#: Regular form, date pattern.
DATE_FORMS = ((r"^[0-9]{4}-", "yyyy-MM-dd"), (r"/", "MM/dd/yyyy"), (r"\.", "dd.MM.yyyy"))


def _days(m: Column, form: str) -> Column:
    """Days since the first of the range; null for other dates and what is none."""
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    return F.when(F.year(day).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), F.datediff(day, F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1))))


def _day_first(key: str | Column, m: Column) -> Column:
    """dd/MM/yyyy with a day over 12, among those of its class: up to the 28th, or the later days of
    months with 31, 30 and 29 days."""
    d, mo, y = _number(m, 1, 2), _number(m, 4, 2), _number(m, 7, 4)
    year = y - FIRST_YEAR

    def shown(day: Column, month: Column, y: Column) -> Column:
        return F.format_string("%02d/%02d/%04d", day, month, y)

    def late(kind: str, months: tuple[int, ...], days: int) -> Column:
        named = F.array(*map(F.lit, months))
        out = feistel(key, kind, year, (F.array_position(named, mo.cast("int")) - 1) * days + d - 29, F.lit(YEARS), F.lit(days * len(months)))
        return _let(out, lambda s: shown(s["b"] % days + 29, F.get(named, F.floor(s["b"] / days).cast("int")).cast("long"), s["a"] + FIRST_YEAR))

    early = feistel(key, "day-first", year * 12 + mo - 1, d - 13, F.lit(YEARS * 12), F.lit(16))
    leap = F.floor((y - 1904) / 4)
    leaped = feistel(key, "leap-day", F.floor(leap / 7), leap % 7, F.lit(7), F.lit(7))
    return (
        F.when(d <= 28, _let(early, lambda s: shown(s["b"] + 13, s["a"] % 12 + 1, F.floor(s["a"] / 12) + FIRST_YEAR)))
        .when(mo == 2, _let(leaped, lambda s: shown(F.lit(29).cast("long"), F.lit(2).cast("long"), 1904 + 4 * (s["a"] * 7 + s["b"]))))
        .when(mo.isin(*LONG_MONTHS), late("long-month", LONG_MONTHS, 3))
        .otherwise(late("short-month", SHORT_MONTHS, 2))
    )


def date(key: str | Column, m: Column) -> Column:
    """Null if it is no date of the range."""
    side_a, side_b = DATE_SIDES

    def made(n: Column, form: str) -> Column:
        out = feistel(key, "date", F.floor(n / side_b), n % side_b, F.lit(side_a), F.lit(side_b))
        return F.date_format(F.date_add(F.make_date(F.lit(FIRST_YEAR), F.lit(1), F.lit(1)), _let(out, lambda s: (s["a"] * side_b + s["b"]).cast("int"))), form)

    out = F.when(_days(F.when(m.rlike("/"), m), "dd/MM/yyyy").isNotNull(), _day_first(key, m))
    for pattern, form in DATE_FORMS:
        n = _days(F.when(m.rlike(pattern), m), form)
        out = F.when(n.isNotNull(), made(n, form)).otherwise(out)
    return out


def _cased(m: Column, out: Column) -> Column:
    return F.when(m.eqNullSafe(F.upper(m)), F.upper(out)).otherwise(out)


def email(key: str | Column, m: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return _cased(m, F.concat(F.lit("u"), F.substring(digest, 1, 16), F.lit("@example.invalid")))


def secret(key: str | Column, m: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("secret"), F.lower(m)).cast("binary"), 256)
    return _cased(m, F.substring(digest, F.lit(1), F.length(m)))


def pseudonym(key: str | Column, m: Column) -> Column:
    """The match's pseudonym, or the match itself if it isn't valid."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    ip = whole(IPV4) & F.forall(_octets(m), lambda x: x <= 255)
    return (
        F.when(m.contains("@"), email(key, m))
        .when(whole(IBAN) & iban_valid(m), iban(key, m))
        .when(whole(CARD), F.when(_luhn(_digits(m)), card(key, m)).otherwise(m))
        .when(whole(SECRET), secret(key, m))
        .when(whole(PHONE), F.when(F.length(_digits(m)).between(8, 15), phone(key, m)).otherwise(m))
        .when(whole(SSN), F.when(ssn_valid(m), ssn(key, m)).otherwise(m))
        .when(ip, ipv4(key, m))
        .when(whole(DATE), F.coalesce(date(key, m), m))
        .otherwise(m)
    )


def key_from(spark: SparkSession, path: str) -> Column:
    """A key that is read from the first line of a file when the query runs; no plan shows it."""
    return spark.read.text(path).limit(1).scalar()


def pseudonymise(df: DataFrame, key: str | Column, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text`` replaced; ``count`` names a column for how many were."""
    columns = list(df.columns)
    own, found, made = (fresh(df, n) for n in ("key", "found", "made"))
    if isinstance(key, Column):
        df, key = df.withColumn(own, key), F.col(own)
    t = F.col(text)
    df = df.withColumn(found, F.when(t.rlike("[@0-9]"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    df = df.withColumn(made, F.when(F.size(found) > 0, F.transform(found, lambda m: pseudonym(key, m))))
    parts = F.zip_with(F.split(t, ANY, -1), made, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
    if count:
        changed = F.size(F.filter(F.zip_with(found, made, lambda a, b: a != b), lambda x: x))
        df = df.withColumn(count, F.coalesce(F.when(F.col(made).isNotNull(), changed), F.lit(0)).cast("long"))
    df = df.withColumn(text, F.when(F.col(made).isNull(), t).otherwise(F.array_join(parts, "")))
    return df.select(*columns, *([count] if count and count not in columns else []))


def query(spark: SparkSession, sf_dir: str, key: str = DEMO_KEY) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), key, count="n_replaced")
