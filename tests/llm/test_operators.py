"""Each operator against brute force, an exact round trip or held-out accuracy, and its edge cases."""

import collections
import hashlib
import os
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from barline.llm import classifier, language, mixing, pieces, pii, quality_rules, registry, simhash, suffix_dedup, token_count, weighted_sampling
from tests import oracle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(30_000))
    texts = [None, "", " \n\t", "x", "a b", "Ünï çödé  ▁ text\r\n", "same words here again " * 40, "same words here again " * 40, long, "<|endoftext|> a <s> <0x41>", "a" * 5000, "4111111111111111 on 2020-01-01"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "s", None) for i, t in enumerate(texts)]
    rows += [(7, texts[7], "en", "s", 1), (7, texts[7], "en", "s", 1), (None, "no id " * 20, None, None, None), (None, None, None, None, None)]
    root = tmp_path_factory.mktemp("odd")
    dirs = {}
    for name, part in (("odd", rows), ("empty", [])):
        d = str(root / name)
        spark.createDataFrame(part, DOCS).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0)] if part else [], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        dirs[name] = d
    return dirs, rows


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n.startswith("op")])
def test_edge_cases(spark, odd, name):
    dirs, rows = odd
    assert registry.QUERIES[name](spark, dirs["empty"]).count() == 0
    got = registry.QUERIES[name](spark, dirs["odd"])
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(spark, oracle.connect(sf_dir), sf_dir, registry.QUERIES[name], registry.SQL[name])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_edge_cases_equal_sql(spark, odd, name):
    d = odd[0]["odd"]
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{d}/documents.parquet/*.parquet' WHERE doc_id <> 7 AND doc_id IS NOT NULL")
    query = registry.QUERIES[name]
    module = {"op2_quality_rules": quality_rules, "op6_source_mixing": mixing}[name]
    keep, module.documents = module.documents, lambda s, p: s.read.parquet(f"{p}/documents.parquet").where("doc_id <> 7")
    try:
        oracle.same(spark, con, d, query, registry.SQL[name])
    finally:
        module.documents = keep


# 1: pseudonyms


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def permuted(key, kind, digits):
    half = len(digits) // 2
    side = (10**half, 10 ** (len(digits) - half))
    s = [int(digits[:half]), int(digits[half:])]
    for n in range(pii.ROUNDS):
        a, b = (0, 1) if n % 2 == 0 else (1, 0)
        f = int(hashlib.sha256(f"{key}|{kind}|{n}|{s[b]}".encode()).hexdigest()[:15], 16)
        s[a] = (s[a] + f) % side[a]
    return f"{s[0]:0{half}d}{s[1]:0{len(digits) - half}d}"


def masked(spark, *texts, key="k"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [(r["text"], r["n"]) for r in pii.pseudonymise(df, key, count="n").orderBy("doc_id").collect()]


def test_cards_are_permuted_within_their_format(spark):
    rng = random.Random(1)
    cards = []
    while len(cards) < 60:
        c = "".join(rng.choices("0123456789", k=16))
        if luhn(c):
            cards.append(c)
    got = [t for t, _ in masked(spark, *cards)]
    assert len(set(got)) == 60 and all(luhn(g) and len(g) == 16 for g in got)
    assert [g[:-1] for g in got] == [permuted("k", "card", c[:-1]) for c in cards]
    (spaced, n), (bad, m) = masked(spark, f"{cards[0][:4]} {cards[0][4:8]} {cards[0][8:12]} {cards[0][12:]}", "4111111111111112")
    assert spaced.replace(" ", "") == got[0] and n == 1 and bad == "4111111111111112" and m == 0


def test_other_kinds(spark):
    text = 'GB82 WEST 1234 5698 7654 32; 123-45-6789 000-12-3456; 10.0.0.1 999.1.1.1; +1 (017) 555-7713 190.137.223.204; a.b@c.de A.B@C.DE; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    (out, n), (again, _), (other, _) = *masked(spark, text, "x " + text), masked(spark, text, key="k2")[0]
    for secret in ("WEST 1234 5698", "123-45-6789", "10.0.0.1;", "555-7713", "190.137", "a.b@c.de", "A.B@C.DE", "04dbebab"):
        assert secret not in out
    assert n == 8 and again == "x " + out and other != out and "000-12-3456" in out and "999.1.1.1" in out
    iban = out.split(";")[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[4:8] == "WEST"
    assert masked(spark, None, "", "plain") == [(None, 0), ("", 0), ("plain", 0)]


# 2: quality rules


def test_cascade_order_never_changes_the_verdict(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = quality_rules.default_rules()
    stats = quality_rules.base_stats(df)
    verdicts = [sorted(r[0] for r in stats.where(quality_rules.verdict(order).isNull()).select("doc_id").collect()) for order in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1] == sorted(r[0] for r in quality_rules.keep(df).select("doc_id").collect())
    assert {r.name for r, _ in quality_rules.plan_cascade(df, rules)} == {r.name for r in rules}


def test_later_rules_count_only_what_is_left(spark):
    """A rule that rejects what an earlier one has rejected comes last, however much it rejects by itself."""
    df = spark.createDataFrame([(i, "w " * i) for i in range(200)], "doc_id long, text string")
    n = F.col("n_words")
    rules = [quality_rules.Rule("under_90", n < 90), quality_rules.Rule("over_190", n > 190), quality_rules.Rule("under_100", n < 100)]
    order = [(r.name, rate) for r, rate in quality_rules.plan_cascade(df, rules)]
    assert order[-1][0] == "under_90" and order[-1][1] == 0 or order[0][0] == "under_90"
    kept = quality_rules.keep(df, rules)
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(100, 191)) and kept.columns == df.columns


def test_repeat_words_by_brute_force(spark, docs):
    def brute(text):
        w = words(text)
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})

    texts = [*docs["text"], "a b c a b c", "a a a a", "a b", "x y z " * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = [r[0] for r in quality_rules.base_stats(df).orderBy("doc_id").select("n_repeat_words").collect()]
    assert got == [brute(t) for t in texts]


def test_clean_labelled_documents_are_kept(spark, sf_dir):
    kept = quality_rules.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed")
    assert kept.where("kept <> (quality = 1)").count() == 0


# 3: classifier


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    x, w, v = rng.random((3, 12)), rng.normal(size=12), rng.normal(size=(12, 4))
    slow = [0.3 + a @ w + sum(v[i] @ v[j] * a[i] * a[j] for i in range(12) for j in range(i + 1, 12)) for a in x]
    np.testing.assert_allclose(classifier.FactorMachine(0.3, w, v).logit(x), slow)


def test_training_rows_are_one_of_each_id(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i}", i) for i in range(5000)] + [(None, "x", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] * 3, "doc_id long, quality int")
    x, y = classifier.training_rows(docs, labels, F.lit(True), "quality", most=40)
    assert x.shape == (40, classifier.WIDTH) and set(y) == {0.0, 1.0}


def test_metadata_is_a_feature():
    a, b, c = (classifier.features("some text", m) for m in ((10,), (100_000,), (None,)))
    meta = slice(classifier.WIDTH - classifier.BINS, None)
    assert not (a[meta] == b[meta]).all() and not c[meta].any() and (a[: meta.start] == c[: meta.start]).all()


def test_classifier_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    r = classifier.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (r["predicted"] == r["quality"]).mean() > 0.9
    assert r[r.quality == 1].score.min() > r[r.quality == 0].score.mean()


# 4: weighted sampling


@pytest.mark.parametrize("n, most, rounds", [(300, 3, 200), (300, 5000, 150), (20_000, 2, 40), (3, 4, 300)])
def test_collision_rate_is_generalised_jaccard(n, most, rounds):
    """Few and many terms, light and heavy weights: no bias, and the spread of independent samples."""
    rng = np.random.default_rng(5)
    term = rng.integers(0, 1 << 64, n, np.uint64)
    errors, spread = [], []
    for k in range(rounds):
        a, b = rng.integers(0, most + 1, n).astype(np.float32), rng.integers(0, most + 1, n).astype(np.float32)
        a[0] = b[0] = max(1, a[0])
        if k % 2:  # weights that differ a little
            b = np.where(rng.random(n) < 0.8, a, b)
        t = term * np.uint64(2 * k + 1)
        j = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append(weighted_sampling.likeness(weighted_sampling.signature(t[a > 0], a[a > 0]), weighted_sampling.signature(t[b > 0], b[b > 0])) - j)
        spread.append(j * (1 - j) / weighted_sampling.SAMPLES)
    se = np.sqrt(np.mean(spread))
    assert abs(np.mean(errors)) < 4 * se / np.sqrt(rounds) and np.std(errors) < 1.35 * se


def test_fingerprints_by_brute_force(spark, sf_dir, docs):
    got = weighted_sampling.query(spark, sf_dir).toPandas().set_index("doc_id")
    text = dict(zip(docs.doc_id, docs.text))
    ids = sorted(text, reverse=True)
    assert sorted(got.index) == sorted(ids)
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        half = len(text[i]) // 2
        e = text[i][: len(text[i]) - half] + text[nxt][:half]
        r = got.loc[i]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest() and r.n_chars == len(text[i])
        a, b, c = (weighted_sampling.sign(t) for t in (text[i], e, text[nxt]))
        assert (r.near_edited, r.near_next) == (float((a == b).mean()), float((a == c).mean()))
        assert r.fingerprint == weighted_sampling.shown(a) and r.edited_fingerprint == weighted_sampling.shown(b)


@pytest.mark.parametrize("n_ranges", [1, 3, 40])
def test_next_rows_over_any_ranges(spark, n_ranges):
    rows = [(i if i % 3 else None, f"t{i % 5} word " * (i % 4)) for i in range(25)] + [(7, f"same id {i}") for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]], r[1]))
    want = [(i, hashlib.sha256(weighted_sampling.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order)]
    got = [(r["doc_id"], r["edited_sha256"]) for r in weighted_sampling.with_next(df, n_ranges).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_n_chars_and_edited_texts_by_sql(spark, sf_dir):
    sql = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
      e AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
      SELECT doc_id, n AS n_chars, sha256(substr(t, 1, n - n // 2) || substr(nxt, 1, n // 2)) AS edited_sha256 FROM e"""
    oracle.same(spark, oracle.connect(sf_dir), sf_dir, lambda s, d: weighted_sampling.query(s, d).select("doc_id", "n_chars", "edited_sha256"), sql)


# 5: token counts


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return token_count.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


ODD_PARTS = [" ", "  ", "    ", "▁", "\n", "\t", "a", "th", "ing", "é", "ß", "中", "　", "😀", "\x00", "0", "12", "<s>", "<0x41>", "</s>", "the", " ", "…", "'", "\xa0", "ﬁ", "Ａ", "é", "\r\n", " " * 20, "<|endoftext|>", "<|endof", "text|>", "'re", "'r", "\x85", "​"]


def test_counts_equal_the_library(vocabulary, docs):
    rng = random.Random(2)
    whole, split = token_count.OverlapCounter(vocabulary), token_count.OverlapCounter(vocabulary, chunk=60, overlap=4)
    split.checked = True
    texts = [*docs["text"][:60], *("".join(rng.choices(ODD_PARTS, k=rng.randint(0, 120))) for _ in range(1500)), "x" * 3000, " " * 500, "ab " * 400]
    for t in texts:
        want = len(whole.library.encode(t, add_special_tokens=False))
        assert whole.count(t) == want and split.count(t) == want


def test_scripts_below_the_sure_limit(vocabulary):
    c = token_count.OverlapCounter(vocabulary)
    for i in range(0, 0x500, 32):
        t = "".join(f"a{chr(k)}a1{chr(k)}1 {chr(k)}\n {chr(k)}{chr(k)}" for k in range(i, i + 32))
        assert c.count(t) == c.plain(t)


# 6: mixing


def test_targets_by_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 5, "d": 300, None: 77, "e": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_plan(df).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(sizes)
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s] + 1e-9}
        for s in over or free:
            target[s] = 2 * sizes[s] if over else left * weight[s] / w
        if not over:
            break
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    assert got == pytest.approx(target)


def test_copies_follow_rates_and_salted_join_agrees(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = lambda: sorted(map(tuple, mixing.mix(df).select("doc_id", "copies").collect()))
    first = rows()
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert rows() == first and {c for _, c in first} <= {0, 1, 2}
    assert mixing.emit(mixing.mix(df), df.columns).count() == sum(c for _, c in first)


# 7: suffix arrays


def brute_repeats(texts, n):
    seen = collections.Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        on = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                on[i : i + n] = True
        out.append(on)
    return out


def test_coverage_of_maximal_repeats():
    rng = random.Random(4)
    for trial in range(60):
        parts = [bytes(rng.choices(b"ab" if trial % 2 else b"abc", k=rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        got = [np.zeros(len(p), bool) for p in parts]
        for p, a, b in suffix_dedup.covered_runs(parts, 6):
            got[p][a:b] = True
        assert all((g == w).all() for g, w in zip(got, brute_repeats(parts, 6)))


def test_a_part_that_ends_hides_no_longer_repeat():
    """The second part ends where the repeat of the first and the last goes on, and the third begins as that does."""
    parts = [b"1HELLO-ma", b"2HELLO-", b"mb", b"3HELLO-mc"]
    assert suffix_dedup.covered_runs(parts, 6) == [(0, 1, 8), (1, 1, 7), (3, 1, 8)]
    assert (7, [1, 19]) in [(n, sorted(s)) for n, s in suffix_dedup.maximal_repeats(parts, 6)]
    rng = random.Random(8)
    for _ in range(400):
        parts = [bytes(rng.choices(b"abcd", k=rng.randint(0, 9))) for _ in range(40)]
        got = [np.zeros(len(p), bool) for p in parts]
        for p, a, b in suffix_dedup.covered_runs(parts, 4):
            got[p][a:b] = True
        assert all((g == w).all() for g, w in zip(got, brute_repeats(parts, 4)))


def test_maximal_repeats_report_all_occurrences():
    parts = [b"xxHELLO-WORLDyy", b"HELLO-WORLDzz", b"qHELLO-WORLq"]
    found = {(n, tuple(sorted(s))) for n, s in suffix_dedup.maximal_repeats(parts, 8)}
    assert (11, (2, 15)) in found and (10, (2, 15, 29)) in found


@pytest.mark.parametrize("max_kinds", [suffix_dedup.MAX_KINDS, 3, 1])
def test_removal_by_brute_force(spark, docs, max_kinds, monkeypatch):
    if max_kinds < 4:  # hot anchors too
        monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 0)
        monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh ", k=700))
    texts = [*docs["text"][:120], *(f"{k} {passage} {k}" * (1 + k % 2) for k in range(8)), passage[:399], passage[:400], "ha " * 400, "", "é" * 300, "é" * 300]
    raw = [t.encode() for t in texts]
    ids = [*range(len(texts) - 2), 0, None]
    df = spark.createDataFrame(list(zip(range(len(texts)) if max_kinds == 3 else ids, texts)), "doc_id long, text string")
    got = collections.Counter((bytes(r["kept"]), r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(df, max_kinds).collect())
    want = []
    for t, on in zip(raw, brute_repeats(raw, 400)):
        runs = int(on[:1].sum() + (on[1:] & ~on[:-1]).sum())
        want.append((bytes(np.frombuffer(t, np.uint8)[~on]), len(t), int(on.sum()), runs))
    assert got == collections.Counter(want)


def test_whole_suffix_query_by_brute_force(spark):
    """All documents of sf0.01: every 400-byte string is counted by its SHA-256."""
    d = "/root/testdata/sf0.01"
    raw = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    digest = lambda t, i: hashlib.sha256(t[i : i + 400]).digest()[:12]
    seen = collections.Counter(digest(t, i) for t in raw.values() for i in range(len(t) - 399))
    for r in suffix_dedup.query(spark, d).collect():
        t = raw[r["doc_id"]]
        edge = np.zeros(len(t) + 401, np.int64)
        for i in range(len(t) - 399):
            if seen[digest(t, i)] > 1:
                edge[i] += 1
                edge[i + 400] -= 1
        on = np.cumsum(edge)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~on])
        runs = int(on[:1].sum() + (on[1:] & ~on[:-1]).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(t), int(on.sum()), runs, hashlib.sha256(kept).hexdigest())
        assert r["text"].encode().replace("�".encode(), b"") == kept.decode("utf-8", "ignore").replace("�", "").encode()


# 8: SentencePiece


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return pieces.PrefixEncoder(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")), 5000, 5000)


def test_ids_equal_the_library(encoder, docs):
    rng = random.Random(7)
    texts = [*docs["text"], *("".join(rng.choices(ODD_PARTS, k=rng.randint(0, 25))) for _ in range(6000))]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x17F), rng.randint(0x400, 0x4FF), rng.randint(0x4E00, 0x9FFF)])) for _ in range(20)) for _ in range(2000)]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == encoder.library.encode(t)
    assert all(encoder.decode(encoder.encode(t)) == t for t in docs["text"])


# 9: SimHash


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps, radius=2):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    wide = np.array([[f >> 64 * k & (1 << 64) - 1 for k in range(4)] for f in fps], np.uint64)
    for i in range(len(ids)):
        for j in np.nonzero(np.bitwise_count(wide[: i + 1] ^ wide[i]).sum(1) <= radius)[0].tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(ids)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def test_components_by_brute_force(spark, sf_dir, docs):
    got = simhash.query(spark, sf_dir).orderBy("doc_id").collect()
    fps = [plain_fingerprint(t) for t in docs["text"]]
    assert [int(r["fingerprint"], 16) for r in got] == fps
    assert [r["component_id"] for r in got] == brute_components(list(docs.doc_id), fps)


def test_crowded_blocks_lose_no_link(spark):
    rng = np.random.default_rng(9)
    near = rng.integers(0, 1 << 64, 5, np.uint64)
    fps = {int(n) for n in near}
    for _ in range(400):
        f = int(rng.choice(near))
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            f ^= 1 << int(b)
        fps.add(f)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for chunk in (10, 4096):
        roots = {r["node"] % (1 << 64): r["root"] for r in simhash.components(simhash.links(df, chunk=chunk)).collect()}
        want = brute_components(list(range(len(fps))), fps)
        label = {f: roots.get(f, f) for f in fps}
        assert len(set(zip(want, (label[f] for f in fps)))) == len(set(want)) == len({label[f] for f in fps})


def test_similar_documents_are_linked(spark):
    """Every pair with a Jaccard similarity of 0.8 or more is linked, and no pair under 0.5."""
    d = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    group = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(spark.read.parquet(f"{d}/documents.parquet")).collect()}
    grams = {}
    for r in rows:
        w = words(r["text"].lower())
        grams[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    close, members = 0, collections.defaultdict(list)
    for i in grams:
        members[group[i]].append(i)
        for j in grams:
            if j < i and len(grams[i] & grams[j]) >= 0.8 * len(grams[i] | grams[j]):
                close += 1
                assert group[i] == group[j]
    assert close > 20
    for g in members.values():
        assert all(max(len(grams[i] & grams[j]) / len(grams[i] | grams[j]) for j in g if j != i) > 0.5 for i in g if len(g) > 1)


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (1, text), (1, text), (2, text + " tail"), (5, "other words entirely"), (None, text)]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(1) == 1 and 3 not in ids and 5 in ids and ids.count(None) == 1


# 10: language


def greedy(samples, text):
    """Phrases by trying ever longer strings."""
    hay = ["".join(chr(c) for c in language.code_points(s)) for s in samples]
    sym, n, at = "".join(chr(c) for c in language.code_points(text)), 0, 0
    while at < len(sym):
        k = 0
        while at + k < len(sym) and any(sym[at : at + k + 1] in h for h in hay):
            k += 1
        n, at = n + 1, at + max(1, k)
    return n


@pytest.mark.parametrize("block", [1, 2, 7, 256])
@pytest.mark.parametrize("few", [0, 4, 1 << 30])
def test_phrases_by_greedy_parsing(block, few, monkeypatch):
    monkeypatch.setattr(language, "FEW", few)
    rng = random.Random(11)
    samples = {"a": ("the cat sat on the mat", "a dog", "aaaaa"), "b": ("el gato se sienta", "ñandú"), "c": ("".join(rng.choices("ab ", k=400)), "".join(rng.choices("abc", k=50)))}
    parser = language.CrossParser(samples)
    texts = ["the dog sat", "el gato on the mat", "zzz qqq", "x", "thet hecat sa", "ñu дом 中文", "a" * 3001, "the cat " * 400]
    texts += ["".join(rng.choices("abcdet ", k=rng.randint(1, 2500))) for _ in range(12)]
    points = [language.code_points(t) for t in texts]
    for k, lang in enumerate("abc"):
        got = parser.phrases(k, np.concatenate(points), np.cumsum([len(p) for p in points]), block)
        assert got.tolist() == [greedy(samples[lang], t) for t in texts]


def test_whole_language_query_by_brute_force(spark, sf_dir):
    """Every prediction from the phrases of the whole text, sought in the joined samples."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    samples = language.labelled_samples(df, language.fold(F.col("doc_id"), 4) != 2)
    hay = {k: "\x01".join("".join(map(chr, language.code_points(t))) for t in v) for k, v in samples.items()}
    bits = {k: np.log2(sum(len(language.code_points(t)) for t in v)) for k, v in samples.items()}

    def phrases(h, s):
        n, at = 0, 0
        while at < len(s):
            k = 1
            while at + k < len(s) and s[at : at + k + 1] in h:
                k += 1
            n, at = n + 1, at + k
        return n

    text = {r["doc_id"]: r["text"] for r in df.collect()}
    got = {r["doc_id"]: r for r in language.query(spark, sf_dir).collect()}
    for i in sorted(text)[:60]:
        s = "".join(map(chr, language.code_points(text[i] or "")))[:20_000]
        if not s.strip("\0") or len(s) == 20_000:
            continue
        cost = {k: phrases(h, s) * bits[k] for k, h in hay.items()}
        assert got[i]["lang_pred"] == min(sorted(cost), key=cost.get)


def test_samples_are_whole_and_bounded(spark):
    rows = [(i, f"word{'abc'[i % 3] * 3} " * 30, "xy"[i % 2]) for i in range(400)] + [(7, "again and again", "x")] * 500 + [(None, "no id", "x"), (900, "z" * 700_000, "z"), (901, "z" * 500_000, "z"), (902, "1 2 3", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.labelled_samples(df, language.fold(F.col("doc_id"), 4) != 2)
    texts = {r[1] for r in rows}
    assert set(got) <= {"x", "y", "z"} and {"x", "y"} <= set(got)
    assert all(t in texts for v in got.values() for t in v) and all(len(v) <= language.SAMPLE_DOCS for v in got.values())
    assert all(sum(map(len, got[k])) <= language.SAMPLE_CHARS for k in "xy") and len(got.get("z", ())) <= 1


def test_language_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    r = language.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
