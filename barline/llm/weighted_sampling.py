"""Document fingerprints by consistent weighted sampling.

Terms are five-word shingles (a shorter text is one term) weighted by their counts.  Each of the
``SAMPLES`` samples draws two Gamma(2, 1) variates and a uniform per term, from four hashes of term
and sample number of their own, and keeps the term and quantised weight that minimise
``ln c - r (t + 1 - beta)`` with ``t = floor(ln w / r + beta)``.  Two texts keep the same one with
the probability of their generalised Jaccard similarity, so the share of equal samples estimates it,
with a standard deviation of at most 1 / (2 sqrt(SAMPLES)), that is 0.0625.

Each document also meets the next one by descending id.  Rows are dealt out by ranges of id and a
hash of the text, about ``RANGE_BYTES`` in each, and sorted in their tasks, so a text moves once.
The first and the last row of each range are handed on, and a second, small step pairs the ends of
neighbouring ranges.

Defined cases: null texts count as empty; texts without a word have the fingerprint of no term
(all zero), equal to each other and unlike any other; null ids come last; rows that repeat an id
are ordered by a hash of the text, then the text, and keep a row each; a lone row is its own next;
an empty table gives an empty result.  Other columns of the input don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.common import documents, durable

SAMPLES = 64
SHINGLE = 5
#: Terms that are sampled at once.
SLICE = 512
RANGE_BYTES = 32 << 20
MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
SALT = np.random.default_rng(4).integers(0, 1 << 32, (4, SAMPLES, 1), np.uint32)
ROUND = [np.uint32(x) for x in (0x7FEB352D, 0x846CA68B)]
HALF = np.uint32(0xFFFF)


def terms(text: str, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit term hashes and their weights."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.float32)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    t = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        t = (t ^ h[j : len(h) - k + 1 + j]) * MIX[j % 4]
        t ^= t >> np.uint64(29)
    t, count = np.unique(t, return_counts=True)
    return t, count.astype(np.float32)


def _bits(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    z = x ^ salt
    z *= ROUND[0]
    z ^= z >> np.uint32(15)
    z *= ROUND[1]
    z ^= z >> np.uint32(16)
    return z


def _unit(z: np.ndarray) -> np.ndarray:
    """The bits as uniforms in (0, 1)."""
    u = (z >> np.uint32(8)).view(np.int32).astype(np.float32)
    u += np.float32(0.5)
    u *= np.float32(2.0**-24)
    return u


def _minus_log(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A Gamma(2, 1) variate of two uniforms."""
    u *= v
    np.log(u, out=u)
    return np.negative(u, out=u)


def _least(term: np.ndarray, log_weight: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Per sample the least order among the terms and a 32-bit name of its term and t.

    ``log_weight`` is None where all weights are 1: then t is 0.
    """
    lo, hi = term.astype(np.uint32), (term >> np.uint64(32)).astype(np.uint32)
    x, y = lo ^ (hi * ROUND[1]), hi ^ (lo * ROUND[0])
    # r may be coarse: two uniforms of 16 bits; what orders the terms is finer
    z = _bits(x, SALT[0])
    halves = [h.view(np.int32).astype(np.float32) for h in (z & HALF, z >> np.uint32(16))]
    for h in halves:
        h += np.float32(0.5)
        h *= np.float32(2.0**-16)
    r = _minus_log(*halves)
    c = _minus_log(_unit(_bits(y, SALT[1])), _unit(_bits(x, SALT[2])))
    beta = _unit(_bits(y, SALT[3]))
    t = None if log_weight is None else np.floor(log_weight / r + beta)
    np.subtract(1 if t is None else t + 1, beta, out=beta)
    r *= beta
    order = np.log(c, out=c)
    order -= r
    at = order.argmin(1)
    k = np.arange(SAMPLES)
    steps = np.zeros(SAMPLES, np.int32) if t is None else t[k, at].astype(np.int32)
    return order[k, at], (hi[at] ^ (lo[at] * ROUND[1])) + steps.view(np.uint32) * np.uint32(0x9E3779B1)


def signature(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The 16-bit name of each sample; all zero without a term."""
    if not len(term):
        return np.zeros(SAMPLES, np.uint16)
    best, name = np.full(SAMPLES, np.inf, np.float32), np.zeros(SAMPLES, np.uint32)
    single = weight == 1
    for part, logs in ((term[single], None), (term[~single], np.log(weight[~single]))):
        for at in range(0, len(part), SLICE):
            order, named = _least(part[at : at + SLICE], None if logs is None else logs[at : at + SLICE])
            less = order < best
            best[less], name[less] = order[less], named[less]
    return np.maximum(((name * ROUND[0]) >> np.uint32(16)).astype(np.uint16), np.uint16(1))


def sign(text: str | None) -> np.ndarray:
    return signature(*terms(text or ""))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def shown(s: np.ndarray) -> str:
    return s.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, fingerprint (hex of ``SAMPLES`` 16-bit names)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shown(sign(t.as_py())) for t in b.column(1)], pa.string())], ["doc_id", "fingerprint"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
#: An end of a range is a row of its own: number of the range, 0 (first) or 1 (last), id and text.
ENDS = "part int, end int, end_id long, end_text string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
ARROW = pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in f"{SCHEMA}, {ENDS}".split(", ")])


def compared(i: int | None, text: str, own: np.ndarray, following: str, next_: np.ndarray) -> dict:
    new = edited(text, following)
    e = sign(new)
    return dict(zip(NAMES, (i, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), shown(own), shown(e), likeness(own, e), likeness(own, next_))))


def with_next(df: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(doc_id, text) rows -> fingerprints of text and edited text, compared along descending ids."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if n_ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    place = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(n_ranges, *place).sortWithinPartitions(*place, "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = None  # (id, text, signature) of the row that waits for its next
        for b in batches:
            for at in range(0, b.num_rows, 256):
                out = []
                for i, text in zip(*(c.slice(at, 256).to_pylist() for c in b.columns)):
                    sig = sign(text)
                    out.append(compared(*held, text, sig) if held else {"part": part, "end": 0, "end_id": i, "end_text": text})
                    held = (i, text, sig)
                yield pa.RecordBatch.from_pylist(out, ARROW)
        if held:
            yield pa.RecordBatch.from_pylist([{"part": part, "end": 1, "end_id": held[0], "end_text": held[1]}], ARROW)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text, following in zip(*(c.to_pylist() for c in b.columns)):
                yield pa.RecordBatch.from_pylist([compared(i, text, sign(text), following, sign(following))], pa.schema(list(ARROW)[: len(NAMES)]))

    done = durable(dealt.mapInArrow(run, f"{SCHEMA}, {ENDS}"), "sampling-ranges")
    ends = done.where("part is not null")
    first = ends.where("end = 0").select(F.col("part").alias("p2"), F.col("end_text").alias("following"))
    # one row per range; the last range goes on with the first
    order = ends.where("end = 0").select("part").withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy())))
    tails = ends.where("end = 1").select("part", "end_id", "end_text").join(order, "part")
    paired = tails.join(first, F.col("to") == F.col("p2")).select("end_id", "end_text", "following").mapInArrow(pair, SCHEMA)
    return done.where("part is null").select(*NAMES).unionByName(paired)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(documents(spark, sf_dir))
