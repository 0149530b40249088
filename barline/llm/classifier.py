"""Quality classifier: a factorisation machine.

Features are hashed lower-case words (shares of the text), binned structure statistics and metadata
(the numeric columns ``META``, binned on a logarithmic scale).  The score is the logistic of ``w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2
x_i^2)``: all pairs interact through low-rank factors in time linear in the features.

Bound: the machine is fitted by Adam on the driver on at most ``TRAIN_ROWS`` labelled rows, chosen
by hash of the id, one of each id; of these only the features are gathered.  Scores read whole texts.

Defined cases: null texts count as empty, and empty texts are scored from their statistics; several
labels of one document are averaged; without any labelled row all scores are 0.5; repeated rows get
equal scores; an empty table gives an empty result.  A row with a null id is not learned
from and not held out.  Null or missing metadata sets no bin.  Other columns of the input don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents

TRAIN_ROWS = 3_000
HASHES = 2_048
RANK = 8
BINS = 12
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
UPPER, LOWER, DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
STATS = 11
#: Columns beside the text that tell of a document.
META = ("n_chars",)
WIDTH = HASHES + (STATS + len(META)) * BINS


def features(text: str | None, meta: tuple = ()) -> np.ndarray:
    """Dense vector: word shares (square roots), then one bin set per statistic and metadata column."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    n, size = len(words), max(1, len(raw))
    h = np.fromiter(map(crc32, words), np.int64, n)
    x = np.zeros(WIDTH, np.float32)
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, byte[UPPER].sum() + byte[LOWER].sum())
    lines = [s for s in raw.split(b"\n") if s.strip()]
    if n:
        x[:HASHES] = np.sqrt(np.bincount(h % HASHES, minlength=HASHES) / n)
    windows = len(np.unique((h[:-2] * 1_000_003 + h[1:-1]) * 1_000_003 + h[2:])) / (n - 2) if n > 2 else 1.0
    stats = (
        np.log1p(n) / 12,
        byte[UPPER].sum() / letters,
        4 * byte[SYMBOLS].sum() / size,
        8 * byte[33] / size,
        4 * byte[DIGIT].sum() / size,
        8 * byte[10] / size,
        1 - len(set(lines)) / max(1, len(lines)),
        1 - windows,
        float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        len(set(words)) / max(1, n),
        (size - byte[32]) / max(1, n) / 16,
    )
    told = [np.log1p(abs(m)) / 20 if m is not None and m == m else None for m in meta]
    for i, s in enumerate((*stats, *told)):  # piecewise linear: a value shares itself between two bins
        if s is None:
            continue
        at = min(max(s, 0.0), 1.0) ** 0.5 * (BINS - 1)
        lo = min(int(at), BINS - 2)
        x[HASHES + i * BINS + lo] = 1 - (at - lo)
        x[HASHES + i * BINS + lo + 1] = at - lo
    return x


class FactorMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v, self.v2 = w0, w, v, v * v

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.w0 + x @ self.w + 0.5 * ((x @ self.v) ** 2 - (x * x) @ self.v2).sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.02, decay: float = 1e-5, seed: int = 7) -> FactorMachine:
    rng = np.random.default_rng(seed)
    prior = np.clip(y.mean(), 0.01, 0.99)
    p = [np.array(np.log(prior / (1 - prior)), np.float32), np.zeros(x.shape[1], np.float32), rng.normal(0, 0.02, (x.shape[1], RANK)).astype(np.float32)]
    m, s, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            xb, yb = x[order[at : at + batch]], y[order[at : at + batch]]
            e = ((FactorMachine(*p).score(xb) - yb) / len(yb)).astype(np.float32)
            xv = xb @ p[2]
            g = [e.sum(), xb.T @ e + decay * p[1], xb.T @ (e[:, None] * xv) - ((xb * xb).T @ e)[:, None] * p[2] + decay * p[2]]
            step += 1
            lr = rate * (1 - epoch / epochs)
            for a, b, c, d in zip(p, g, m, s):
                c += 0.1 * (b - c)
                d += 0.001 * (b * b - d)
                a -= lr * (c / (1 - 0.9**step)) / (np.sqrt(d / (1 - 0.999**step)) + 1e-8)
    return FactorMachine(float(p[0]), p[1], p[2])


def _told(df: DataFrame) -> list[Column]:
    return [(F.col(m) if m in df.columns else F.lit(None)).cast("double").alias(m) for m in META]


def _rows(b: pa.RecordBatch, at: int) -> Iterator[tuple[str | None, tuple]]:
    """Text and metadata of a batch whose text is column ``at``."""
    meta = [b.column(at + 1 + k).to_pylist() for k in range(len(META))]
    return ((t.as_py(), m) for t, m in zip(b.column(at), zip(*meta)))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, label: str, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled rows that ``learn`` allows."""
    y = labels.where(learn & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = F.struct(F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"), *_told(docs))
    near = docs.select("doc_id", one.alias("d")).join(F.broadcast(chosen), "doc_id")
    rows = near.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("d").alias("d")).select("doc_id", "y", "d.text", *(f"d.{m}" for m in META))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs = [features(t, m).tobytes() for t, m in _rows(b, 2)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(xs, pa.binary())], ["doc_id", "y", "x"])

    got = sorted((r["doc_id"], bytes(r["x"]), r["y"]) for r in rows.mapInArrow(run, "doc_id long, y double, x binary").collect())
    x = np.frombuffer(b"".join(g[1] for g in got), np.float32).reshape(-1, WIDTH)
    return x, np.array([g[2] for g in got], np.float32)


def score(df: DataFrame, machine: FactorMachine | None) -> DataFrame:
    """(doc_id, text) -> doc_id, score."""
    sent = df.sparkSession.sparkContext.broadcast((machine.w0, machine.w, machine.v) if machine else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = FactorMachine(*sent.value) if sent.value else None
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = own.score(np.stack([features(t, m) for t, m in _rows(part, 1)])).astype(np.float64) if own else np.full(part.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 256), pa.array(s)], ["doc_id", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string"), *_told(df)).mapInArrow(run, f"doc_id {kind}, score double")


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> FactorMachine | None:
    x, y = training_rows(docs, labels, learn, label)
    return fit(x, y) if len(y) else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    machine = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != HELD_OUT)
    scored = score(docs, machine)
    return scored.select("doc_id", F.coalesce(fold == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
