"""Where a value ends, long texts, permutations of dates, the key, and a plain Python version."""

import collections
import datetime as dt
import hashlib

import pytest
import regex

from barline.llm import pii

IBANS = [
    ("ES9121000418450200051332", " BIC CAIXESBBXXX"),
    ("AT611904300234573201", " 12 items"),
    ("BE68539007547034", " 2024"),
    ("BE68 5390 0754 7034", " EUR"),
    ("NO9386011117947", " A1"),
    ("GB29 NWBK 6016 1331 9268 19", " 7 X"),
]


def made(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["n"]) for r in pii.pseudonymise(df, "k", count="n").orderBy("doc_id").collect()]


def test_ibans_before_further_tokens(spark):
    """The token behind an IBAN stays and the IBAN's pseudonym is that of the IBAN alone."""
    alone = made(spark, [i for i, _ in IBANS])
    for (iban, tail), (out, n), (want, _) in zip(IBANS, made(spark, [i + t for i, t in IBANS]), alone):
        assert n == 1 and out == want + tail and want != iban
        bare = want.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


@pytest.mark.parametrize("time", ["T00:00:00Z", "T0930", "t23:59:59.5+02:00", "T12"])
def test_dates_before_times(spark, time):
    (out, n), (want, _), (other, m) = made(spark, ["born 1984-03-02" + time, "born 1984-03-02", "id 1984-03-02Task 1984-03-02T1x"])
    assert n == 1 and out == want + time and want != "born 1984-03-02"
    assert m == 0 and other == "id 1984-03-02Task 1984-03-02T1x"


@pytest.mark.parametrize("domain", ["b." * 4000 + "com", "b." * 50_000 + "com", "b" * 100_000 + ".com", "-" * 100_000, "b.c-" * 25_000])
def test_long_texts_are_matched_in_bounded_depth(spark, domain):
    (out, n), (many, m) = made(spark, ["x a@" + domain + " a@b.de", "a@" * 50_000 + "b.de " + "1" * 100_000 + " 1.2.3." * 10_000 + "AB12 " * 20_000])
    assert "a@b.de" not in out and n >= 1 and m >= 1


def test_every_date_of_a_form_has_its_own(spark):
    days = [dt.date(1900, 1, 1) + dt.timedelta(days=k) for k in range(73_049)]
    assert days[-1] == dt.date(2099, 12, 31)
    for form in ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%d.%m.%Y"):
        texts = sorted({d.strftime(form) for d in days if form != "%d/%m/%Y" or d.day > 12})
        got = [t for t, _ in made(spark, texts)]
        assert sorted(got) == texts and sum(a == b for a, b in zip(got, texts)) < 60
    both = sorted({d.strftime(f) for d in days for f in ("%m/%d/%Y", "%d/%m/%Y")})
    assert sorted(t for t, _ in made(spark, both)) == both
    assert made(spark, ["31.12.1899", "01/01/2100", "2021-02-29", "31/11/2020"]) == [("31.12.1899", 0), ("01/01/2100", 0), ("2021-02-29", 0), ("31/11/2020", 0)]


def test_key_from_a_file_shows_in_no_plan(spark, tmp_path, capsys):
    (tmp_path / "key").write_text("very-secret\n")
    text = "4111111111111111 a@b.de 2020-01-02 13/02/2021 10.0.0.1 123-45-6789 +49 30 1234567 GB29NWBK60161331926819"
    df = spark.createDataFrame([(1, text, "mine")], "doc_id int, text string, __key string")
    hidden = pii.pseudonymise(df, pii.key_from(spark, str(tmp_path / "key")))
    assert hidden.collect() == pii.pseudonymise(df, "very-secret").collect() and hidden.columns == df.columns
    hidden.explain("extended")
    assert "very-secret" not in capsys.readouterr().out


# a plain version of all kinds


class Twin:
    def __init__(self, key):
        self.key = key
        self.any = regex.compile(pii.ANY.replace("\\k<sep>", "(?P=sep)"))
        self.whole = {k: regex.compile(getattr(pii, k).replace("\\k<sep>", "(?P=sep)")) for k in ("IBAN", "CARD", "SECRET", "PHONE", "SSN", "IPV4", "DATE")}

    def feistel(self, kind, a, b, side_a, side_b):
        for n in range(pii.ROUNDS):
            f = int(hashlib.sha256(f"{self.key}|{kind}|{n}|{a if n % 2 else b}".encode()).hexdigest()[:15], 16)
            a, b = (a, (b + f) % side_b) if n % 2 else ((a + f) % side_a, b)
        return a, b

    def digits(self, kind, d):
        h = len(d) // 2
        a, b = self.feistel(kind, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
        return f"{a:0{h}d}{b:0{len(d) - h}d}"

    @staticmethod
    def fill(template, digits):
        d = iter(digits)
        return "".join(next(d) if c in "0123456789" else c for c in template)

    @staticmethod
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    @staticmethod
    def mod97(s):
        return int("".join(str(int(c, 36)) for c in s)) % 97

    def date(self, m):
        for form in ("%Y-%m-%d",) if m[4] == "-" else ("%m/%d/%Y", "%d/%m/%Y") if "/" in m else ("%d.%m.%Y",):
            try:
                d = dt.datetime.strptime(m, form).date()
            except ValueError:
                continue
            if not 1900 <= d.year < 2100:
                return m
            if form != "%d/%m/%Y":
                a, b = self.feistel("date", *divmod((d - dt.date(1900, 1, 1)).days, 4297), 17, 4297)
                return (dt.date(1900, 1, 1) + dt.timedelta(days=a * 4297 + b)).strftime(form)
            y = d.year - 1900
            if d.day <= 28:
                a, b = self.feistel("day-first", y * 12 + d.month - 1, d.day - 13, 2400, 16)
                return f"{b + 13:02d}/{a % 12 + 1:02d}/{a // 12 + 1900}"
            if d.month == 2:
                a, b = self.feistel("leap-day", *divmod((d.year - 1904) // 4, 7), 7, 7)
                return f"29/02/{1904 + 4 * (7 * a + b)}"
            kind, months, n = ("long-month", pii.LONG_MONTHS, 3) if d.month in pii.LONG_MONTHS else ("short-month", pii.SHORT_MONTHS, 2)
            a, b = self.feistel(kind, y, months.index(d.month) * n + d.day - 29, 200, n * len(months))
            return f"{b % n + 29:02d}/{months[b // n]:02d}/{a + 1900}"
        return m

    def one(self, m):
        whole = {k for k, p in self.whole.items() if p.fullmatch(m)}
        d = "".join(c for c in m if c in "0123456789")
        cased = (lambda s: s.upper()) if m == m.upper() else (lambda s: s)
        if "@" in m:
            return cased(f"u{hashlib.sha256(f'{self.key}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid")
        bare = m.replace(" ", "")
        if "IBAN" in whole and 15 <= len(bare) <= 34 and self.mod97(bare[4:] + bare[:4]) == 1:
            body, own = bare[4:], "".join(c for c in bare[4:] if c in "0123456789")
            body = self.fill(body, self.digits("iban", own)) if len(own) > 1 else body
            out = iter(f"{bare[:2]}{98 - self.mod97(body + bare[:2] + '00'):02d}{body}")
            return "".join(c if c == " " else next(out) for c in m)
        if "CARD" in whole:
            if not self.luhn(d):
                return m
            body = self.digits("card", d[:-1])
            return self.fill(m, body + next(c for c in "0123456789" if self.luhn(body + c)))
        if "SECRET" in whole:
            return cased(hashlib.sha256(f"{self.key}|secret|{m.lower()}".encode()).hexdigest()[: len(m)])
        if "PHONE" in whole:
            if not 8 <= len(d) <= 15:
                return m
            code = regex.match(r"\+[0-9]{1,3}?(?=[ .(-])|\+[0-9]", m)[0]
            rest = m[len(code) :]
            return code + self.fill(rest, self.digits("phone", "".join(c for c in rest if c in "0123456789")))
        if "SSN" in whole:
            if regex.search("^(000|666|9)|-00-|-0000$", m):
                return m
            area = int(m[:3])
            a, b = self.feistel("ssn", (area - 1 - (area > 666)) * 99 + int(m[4:6]) - 1, int(m[7:]) - 1, 898 * 99, 9999)
            i = a // 99 + 1
            return f"{i + (i >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
        if "IPV4" in whole:
            o = [int(x) for x in m.split(".")]
            if max(o) <= 255:
                a, b = self.feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
                return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
        return self.date(m) if "DATE" in whole else m

    def __call__(self, text):
        return self.any.sub(lambda m: self.one(m[0]), text)


VALUES = [
    "GB82 WEST 1234 5698 7654 32; 123-45-6789 000-12-3456 666-11-2222 667-11-2222 899-99-9999",
    "4111 1111 1111 1111 378282246310005 3782 822463 10005 4111111111111112 10.0.0.1 255.255.255.255 256.1.1.1",
    "+1 (017) 555-7713 +49 30 1234567 +4930123456 +999 a.b@c.de A.B@C.DE x@y 04DBEBAB91AB85687D33EEAAF9AC699E1188F962",
    "29/02/2000 31/12/1999 30/04/2010 13/01/1950 02/13/1950 31.12.2099 1900-01-01T10:00 2000-02-30 29/02/1904",
]


def test_all_kinds_by_a_plain_version(spark, sf_dir):
    twin, seen = Twin(pii.DEMO_KEY), collections.Counter()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.query(spark, sf_dir).collect():
        assert r["text"] == twin(texts[r["doc_id"]])
        seen[r["n_replaced"] > 0] += 1
    assert seen[True] > 5
    key = Twin("k")
    assert [t for t, _ in made(spark, [*VALUES, *(i + t for i, t in IBANS)])] == [key(t) for t in [*VALUES, *(i + t for i, t in IBANS)]]
