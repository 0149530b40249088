"""SimHash near-dedup by bit-sliced comparison.

Fingerprints of equal value are one class.  Classes that agree on two of four 16-bit blocks (any
pair within two differing bits does) meet in a block; there the fingerprints stand as vertical bit
planes of 64 lanes, distances of a query to all lanes are added up by carry-save counters, and a
(query, block) pair is dropped once every lane exceeds the radius.  Blocks beyond ``CHUNK`` members
are dealt out as pairs of chunks.  A block hands on one star edge per linked member, never pairs,
and components are closed by distributed label passing.

``near_duplicates`` links fingerprints of three-word shingles within two bits.  ``deduplicate`` serves
near copies by the exact Jaccard similarity of five-word shingle sets; documents meet by shared least
shingles, and 256-bit fingerprints, compared the same way, only keep distant ones apart.

Defined cases: null and blank texts have no word and fingerprint zero, linked like any other;
repeated rows and ids keep a row each; the component of rows whose reachable ids are all null is
null; an empty table gives an empty result.  ``deduplicate`` passes all columns of its input through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents, durable, scratch

SEED = 42
RADIUS = 2
SHINGLE = 3
#: Members of one block that meet in one task; larger blocks become pairs of chunks.
CHUNK = 4096
#: Shingles whose bits are unpacked at once.
SLICE = 1 << 15
LANES = 64


def fingerprint(text: str | None, n: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all ``n``-word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-n])).tolist()
    stops = (ends[n - 1 :] - 1).tolist()
    digest, total, set_bits = xxhash.xxh64_intdigest, len(starts), np.zeros(64, np.int64)
    for at in range(0, total, SLICE):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : at + SLICE], stops[at : at + SLICE])), np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.nonzero(2 * set_bits > total)[0].astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def close_pairs(fps: np.ndarray, first: np.ndarray, size: np.ndarray, radius: int = RADIUS, budget: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), j < i, of fingerprints within ``radius`` in the same group.

    ``fps`` (rows of 64-bit words) holds the groups one after the other; group g is
    ``first[g] : first[g] + size[g]``.
    """
    blocks_of = -(-size // LANES)
    block_first = np.concatenate([f + LANES * np.arange(k) for f, k in zip(first, blocks_of)]) if len(first) else np.zeros(0, np.int64)
    block_group = np.repeat(np.arange(len(first)), blocks_of)
    width = np.minimum(LANES, first[block_group] + size[block_group] - block_first)
    padded = np.concatenate((fps, np.zeros((LANES, fps.shape[1]), np.uint64)))
    planes = np.empty((64 * fps.shape[1], len(block_first)), np.uint64)
    weight = np.uint64(1) << np.arange(LANES, dtype=np.uint64)
    for word in range(fps.shape[1]):
        lanes = padded[block_first[:, None] + np.arange(LANES), word]
        for p in range(64):
            planes[64 * word + p] = (((lanes >> np.uint64(p)) & np.uint64(1)) * weight).sum(1, dtype=np.uint64)
    alive = np.where(width == LANES, ~np.uint64(0), (np.uint64(1) << (width % LANES).astype(np.uint64)) - np.uint64(1))
    # a query meets the blocks of its group up to its own
    for at in range(0, len(block_first), max(1, budget // LANES)):
        mine = np.arange(at, min(len(block_first), at + max(1, budget // LANES)))
        start_block = np.concatenate(([0], np.cumsum(blocks_of)))[block_group[mine]]
        reach = mine - start_block + 1
        b = np.concatenate([np.arange(s, s + r) for s, r in zip(start_block, reach)])
        owner = np.repeat(mine, reach)
        for lo in range(0, len(b), max(1, budget // LANES)):
            bb, oo = b[lo : lo + max(1, budget // LANES)], owner[lo : lo + max(1, budget // LANES)]
            q = (block_first[oo][:, None] + np.arange(LANES)).ravel()
            blk = np.repeat(bb, LANES)
            real = (np.arange(LANES) < width[oo][:, None]).ravel()
            yield from _compare(fps, planes, alive, block_first, q[real], blk[real], radius)


def _compare(fps, planes, alive, block_first, q, blk, radius):
    counters = [np.zeros(len(q), np.uint64) for _ in range(max(1, (radius + 1).bit_length()))]
    over = ~alive[blk]
    one = np.uint64(1)
    for p in range(len(planes)):
        x = planes[p][blk] ^ (np.uint64(0) - ((fps[q, p >> 6] >> np.uint64(p & 63)) & one))
        for k in range(len(counters)):
            counters[k], x = counters[k] ^ x, counters[k] & x
        over |= x
        if p % 8 == 7:
            gone = over.copy()
            for r in range(radius + 1, 1 << len(counters)):
                hit = ~np.uint64(0)
                for k, c in enumerate(counters):
                    hit = hit & (c if r >> k & 1 else ~c)
                gone |= hit
            over = gone
            keep = gone != ~np.uint64(0)
            if not keep.all():
                q, blk, over = q[keep], blk[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(q):
                return
    bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    i, j = q[row], block_first[blk[row]] + lane
    yield i[j < i], j[j < i]


def merge(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union by smaller index, all pairs at once until nothing changes."""
    while len(i):
        a, b = parent[i], parent[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        if not (open_ := lo != hi).any():
            return
        np.minimum.at(parent, hi[open_], lo[open_])
        while (up := parent[parent]).tolist() != parent.tolist() if len(parent) < 64 else not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        i, j = i[open_], j[open_]


def _stars(radius: int, most: int = 1 << 16):
    """mapInArrow body: rows (key, lo, hi, node, fingerprint words) sorted by group -> star edges (a, b)."""

    def solve(node: np.ndarray, fps: np.ndarray, cut: np.ndarray) -> pa.RecordBatch | None:
        first, size = cut[:-1], np.diff(cut)
        several = size > 1
        parent = np.arange(len(fps))
        for i, j in close_pairs(fps, first[several], size[several], radius):
            merge(parent, i, j)
        linked = np.nonzero(parent != np.arange(len(fps)))[0]
        if not len(linked):
            return None
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def flush(everything: bool):
            nonlocal held, rows
            t = np.concatenate(held, axis=1) if held else np.zeros((5, 0), np.int64)
            edge = np.nonzero((t[:3, 1:] != t[:3, :-1]).any(0))[0] + 1
            cut = np.concatenate(([0], edge, [t.shape[1]])) if everything else np.concatenate(([0], edge))
            end = cut[-1]
            held, rows = [t[:, end:]], t.shape[1] - end
            return solve(t[3, :end], np.ascontiguousarray(t[4:, :end].T).view(np.uint64), cut) if end else None

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(b.num_columns)]))
            rows += b.num_rows
            if rows >= most and (out := flush(False)) is not None:
                yield out
        if (out := flush(True)) is not None:
            yield out

    return run


def links(classes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Distinct ``fp`` rows -> star edges (a, b) that span every link within ``radius`` <= 2."""
    if not 0 <= radius <= 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    part = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(a, b) for a in range(4) for b in range(a + 1, 4)]
    keys = [(F.lit(n) * F.lit(1 << 32) + part[a] * F.lit(1 << 16) + part[b]) for n, (a, b) in enumerate(pairs)]
    keyed = classes.select(F.explode(F.array(*keys)).alias("key"), F.col("fp").alias("node"), F.col("fp").alias("w0"))
    return meet(keyed, radius, chunk)


def meet(keyed: DataFrame, radius: int, chunk: int = CHUNK) -> DataFrame:
    """(key, node, w0, ...) rows -> star edges (a, b) over all pairs of a key within ``radius``.

    Keys beyond ``chunk`` rows are dealt out as pairs of chunks, so none meets in one task.
    """
    words = [c for c in keyed.columns if c not in ("key", "node")]
    hot = durable(keyed.groupBy("key").count().where(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "simhash-hot")
    if hot.isEmpty():
        dealt = keyed.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", *words)
    else:
        n, c = F.coalesce("n", F.lit(1)), F.pmod(F.xxhash64("node"), F.coalesce("n", F.lit(1))).cast("int")
        dealt = keyed.join(hot, "key", "left").select("key", "node", *words, c.alias("c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("other"))
        dealt = dealt.select("key", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "node", *words)
    dealt = dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return dealt.mapInArrow(_stars(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Undirected (a, b) edges -> (node, root): the smallest node each node reaches.

    Each pass takes the smallest label among neighbours (combined before the shuffle), then the
    label's own label; passes end when no label moves.
    """
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    label = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "cc-labels")
    while True:
        near = both.join(label, both["b"] == label["node"]).groupBy(both["a"].alias("v")).agg(F.min("root").alias("m"))
        step = label.join(near, label["node"] == near["v"]).select("node", F.least("root", "m").alias("r"), F.col("root").alias("old"))
        up = step.select(F.col("node").alias("p"), F.col("r").alias("pr"))
        moved = step.join(up, step["r"] == up["p"]).select("node", F.col("pr").alias("root"), (F.col("pr") != F.col("old")).alias("moved"))
        moved = durable(moved, "cc-labels")
        if not moved.where("moved").limit(1).count():
            return moved.select("node", "root")
        label = moved.select("node", "root")


def near_duplicates(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) rows -> doc_id, fp (long), component_id: the smallest doc_id reachable."""
    rows = durable(fingerprints(df), "simhash-rows")
    with scratch(df.sparkSession):
        by_class = _fingerprint_components(rows, radius)
    return rows.join(by_class, rows["fp"] == by_class["__fp"]).select("doc_id", "fp", "component_id")


def _fingerprint_components(rows: DataFrame, radius: int) -> DataFrame:
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = components(links(classes, radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return durable(rooted.join(least, "root").select(F.col("fp").alias("__fp"), "component_id"), "simhash-components", keep=True)


#: Up to so many ids are broadcast (8 bytes each, or 16 with their group).
BROADCAST_IDS = 2_000_000
#: For similarity: five-word shingles, a 256-bit fingerprint, and as many least shingles as meeting keys.
WIDE_SHINGLE, WIDE_WORDS, WIDE_KEYS, SIMILARITY = 5, 4, 8, 0.8
KEY_MIX = np.random.default_rng(17).integers(1, 1 << 63, WIDE_KEYS, np.uint64) * np.uint64(2) + np.uint64(1)
WORD_MIX = np.random.default_rng(18).integers(1, 1 << 63, WIDE_WORDS, np.uint64)
#: Shingles of one group that meet in one task; larger groups become pairs of chunks.
SET_CHUNK = 500_000
#: Groups up to this size compare all their fingerprints at once.
SMALL_GROUP = 256


def loose_radius(similarity: float) -> int:
    """Prefilter: differing bits at this similarity of the least favourable small sets, plus five deviations."""
    p = max(np.arccos(2 * similarity / (1 + similarity)) / np.pi, (1 - similarity) * 15 / 16)
    n = 64 * WIDE_WORDS
    return int(n * p + 5 * np.sqrt(n * p * (1 - p)))


def shingle_set(text: str | None, n: int = WIDE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    k = min(n, len(words))
    starts, stops = np.concatenate(([0], ends[: len(words) - k])).tolist(), (ends[k - 1 :] - 1).tolist()
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(starts)))


def majority(h: np.ndarray) -> np.ndarray:
    """256 majority bits of distinct hashes as four words."""
    set_bits = np.zeros(64 * WIDE_WORDS, np.int64)
    for at in range(0, len(h), SLICE):
        x = h[at : at + SLICE, None] ^ WORD_MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        set_bits += np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * set_bits > len(h)).view(np.uint64)


def wide_fingerprint(text: str | None, n: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """256 majority bits over the distinct shingles as four words, and for each key their least mixed hash."""
    return _sketch(shingle_set(text, n))


def _sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.zeros(WIDE_WORDS, np.uint64), np.zeros(WIDE_KEYS, np.uint64)
    mixed = (h * m for m in KEY_MIX)
    return majority(h), np.array([(x ^ (x >> np.uint64(31))).min() for x in mixed], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``similarity``."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(a) < similarity * len(b):
        return len(b) == 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= similarity * (len(a) + len(b) - both)


def exact_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Each set's least linked one, over all links of ``similarity`` within the loose radius.

    Pairs that earlier links join need no check; the nearest fingerprints are checked first.
    """
    fps = np.stack([majority(s) for s in sets])
    n, parent = np.array([len(s) for s in sets]), np.arange(len(sets))
    if len(sets) <= SMALL_GROUP:
        pairs = [np.nonzero(np.tril(np.bitwise_count(fps[:, None] ^ fps).sum(2) <= loose_radius(similarity), -1))]
    else:
        pairs = close_pairs(fps, np.array([0]), np.array([len(sets)]), loose_radius(similarity))
    for i, j in pairs:
        fit = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        i, j = i[fit], j[fit]
        order = np.argsort(np.bitwise_count(fps[i] ^ fps[j]).sum(1), kind="stable")
        i, j, many = i[order], j[order], 64
        while len(i):
            open_ = parent[i] != parent[j]
            i, j = i[open_], j[open_]
            ok = np.fromiter((similar(sets[a], sets[b], similarity) for a, b in zip(i[:many].tolist(), j[:many].tolist())), bool, min(many, len(i)))
            merge(parent, i[:many][ok], j[:many][ok])
            i, j, many = i[many:], j[many:], min(2 * many, 1 << 16)
    return parent


def by_ids(ids: DataFrame, column: str, body) -> DataFrame:
    """``body(ids)``, which joins ids to texts: they are broadcast up to ``BROADCAST_IDS`` of them;
    beyond that the texts are shuffled by id, once, whatever the number."""
    return body(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge"))


def verified(df: DataFrame, loose: DataFrame, similarity: float, chunk: int = SET_CHUNK) -> DataFrame:
    """Star edges (a, b) over all pairs of a loose group (node, root) with this Jaccard similarity.

    Shingle sets are made anew from the texts of the groups' members and meet by group; groups
    beyond ``chunk`` shingles are dealt out as pairs of chunks.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                c = b.slice(at, 64)
                sets = [shingle_set(t.as_py()) for t in c.column(2)]
                shown = pa.array([s.tobytes() for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array([len(s) for s in sets], pa.int64()), shown], ["node", "root", "n", "shingles"])

    def members(ids: DataFrame) -> DataFrame:
        texts = df.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
        return texts.join(ids, "node").select("node", "root", "text").mapInArrow(make, "node long, root long, n long, shingles binary")

    def solve(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch | None:
        parent = exact_links([s for _, s in held], similarity) if len(held) > 1 else np.arange(len(held))
        node = np.array([v for v, _ in held], np.int64)
        linked = np.nonzero(parent != np.arange(len(held)))[0]
        if len(linked):
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], ["a", "b"])
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for b in batches:
            for *key, node, shingles in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4)):
                if key != group:
                    if (out := solve(held)) is not None:
                        yield out
                    held, group = [], key
                held.append((node, np.frombuffer(shingles.as_py(), np.uint64)))
        if (out := solve(held)) is not None:
            yield out

    sets = durable(by_ids(loose, "node", members), "simhash-sets")
    n = F.greatest(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
    groups = durable(sets.groupBy("root").agg(F.sum("n").alias("n")).where(F.col("n") > chunk).select("root", n.alias("parts")), "simhash-set-hot")
    if groups.isEmpty():
        dealt = sets.select("root", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "node", "shingles")
    else:
        parts = F.coalesce("parts", F.lit(1))
        c = F.pmod(F.xxhash64("node"), parts).cast("int")
        dealt = sets.join(groups, "root", "left").select("root", "node", "shingles", c.alias("c"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        dealt = dealt.select("root", F.least("c", "other").alias("lo"), F.greatest("c", "other").alias("hi"), "node", "shingles")
    dealt = dealt.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "node")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def similar_components(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, text) rows -> doc_id, component_id by Jaccard similarity of five-word shingle sets.

    Equal sets are one class, by a 128-bit digest.  Classes that share one of eight least shingles
    meet (at similarity 0.8 all but 3 in a million pairs do); those within the loose radius form
    groups, in which the exact similarity decides.  Rows with a null id are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py()) for t in b.column(1)]
            found = [_sketch(s) for s in sets]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            w = np.stack([f for f, _ in found]).view(np.int64) if found else np.zeros((0, WIDE_WORDS), np.int64)
            k = pa.array([x.view(np.int64) for _, x in found], pa.list_(pa.int64()))
            columns = [b.column(0).cast(pa.int64()), *(pa.array(digests[:, j]) for j in range(2)), *(pa.array(w[:, j]) for j in range(WIDE_WORDS)), k]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *digest, *words, "keys"])

    digest, words = ["d0", "d1"], [f"w{j}" for j in range(WIDE_WORDS)]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in digest + words) + ", keys array<long>"
    df = df.where("doc_id is not null")
    rows = durable(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema), "simhash-wide")
    classes = rows.groupBy(*digest).agg(F.min("doc_id").alias("node"), *(F.first(w).alias(w) for w in words), F.min("keys").alias("keys"))
    classes = durable(classes, "simhash-wide-classes")
    keyed = classes.select(F.posexplode("keys").alias("j", "k"), "node", *words).select(F.xxhash64("j", "k").alias("key"), "node", *words)
    loose = components(meet(keyed, loose_radius(similarity)))
    roots = components(verified(df, loose, similarity))
    of = classes.join(roots.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").select(*(F.col(d).alias(f"c_{d}") for d in digest), F.coalesce("root", "node").alias("component_id"))
    of = durable(of, "simhash-wide-roots")
    same = [F.col(d) == F.col(f"c_{d}") for d in digest]
    return rows.join(of, same).select("doc_id", "component_id")


def deduplicate(df: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of ``df`` (doc_id, text, ...) per group of similar documents: that of the smallest doc_id.

    Rows that repeat an id are one document.  Rows with a null id all stay.
    """
    with scratch(df.sparkSession):
        found = durable(similar_components(df, similarity), "simhash-found", keep=True)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()

    kept = by_ids(copies, "doc_id", lambda ids: df.join(ids, "doc_id", "left_anti").select(*df.columns))
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
