"""The pipeline's near-dedup stage against the true Jaccard similarity of shingle sets."""

import collections
import random

import numpy as np

from barline.llm import simhash

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def groups(spark, texts):
    found = simhash.similar_components(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    return {r["doc_id"]: r["component_id"] for r in found}


def true_groups(sets):
    """Components over all pairs of 0.8 or more, by an inverted index of shingles."""
    root, holders = list(range(len(sets))), collections.defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = collections.Counter(j for g in s for j in holders[g])
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            holders[g].append(i)
    return [find(i) for i in range(len(sets))]


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_run_of_a_word_in_one_copy_hides_no_near_copy(spark):
    rng, texts = random.Random(1), []
    for n, run in ((1000, 30), (1000, 30), (5000, 100)):
        w = prose(rng, n)
        texts += [" ".join(w), " ".join(w[: n // 2] + ["-"] * run + w[n // 2 :])]
        assert jaccard(*map(grams, texts[-2:])) > 0.9
    assert groups(spark, texts) == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4}


def test_run_of_a_word_joins_no_unrelated_documents(spark):
    rng = random.Random(2)
    texts = [" ".join(prose(rng, n) + ["-"] * run) for n, run in ((1000, 130), (1000, 130), (5000, 300), (5000, 300))]
    assert groups(spark, texts) == {i: i for i in range(4)}


def test_groups_by_true_jaccard(spark, monkeypatch):
    """At sf0.01 and over near copies on both sides of 0.8; also in small chunks and with shuffled texts."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    texts, rng = [r["text"] for r in rows if r["text"] and r["text"].split()], random.Random(3)
    for edits in range(2, 22):
        w = prose(rng, 400)
        texts.append(" ".join(w))
        for _ in range(2):
            v = list(w)
            for at in rng.sample(range(400), edits):
                v[at] = "edited"
            texts.append(" ".join(v))
    want = dict(enumerate(true_groups([grams(t) for t in texts])))
    assert 60 < sum(i != g for i, g in want.items())
    assert groups(spark, texts) == want
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    monkeypatch.setattr(simhash.verified, "__defaults__", (500,))
    assert groups(spark, texts) == want


def test_documents_kept_with_shuffled_texts(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(prose(rng, 60)) for _ in range(40)]
    df = spark.createDataFrame([*enumerate(texts * 2), (None, texts[0])], SCHEMA)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    kept = [r["doc_id"] for r in simhash.deduplicate(df).collect()]
    assert kept.count(None) == 1 and sorted(i for i in kept if i is not None) == list(range(40))


def test_exact_links_of_small_sets():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 64, 5, np.uint64))
        assert simhash.exact_links([a, a[:4]], 0.8).tolist() == [0, 0]
        assert simhash.exact_links([a, a[:3]], 0.8).tolist() == [0, 1]
