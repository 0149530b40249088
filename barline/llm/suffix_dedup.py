"""Exact removal of repeated byte strings through enhanced suffix arrays.

Every 400-byte window has an anchor: its least hashed 32-byte gram, the leftmost of equals.  Equal
windows have equal anchors, so windows meet by anchor and no other pair needs a look.  The windows
of one anchor occurrence are a run of starts; the bytes they span are a segment.

1. Segments are named by hashes (the anchor's and XXH3 of the bytes, 128 bits together), combined
   within each batch and counted.  Segments of one name are one kind.  Rows of an anchor that is
   ``hot`` are dealt out by the segment's hash too, so no task gets all of them.
2. Of each kind that isn't alone two occurrences are fetched (one, if there is one), and a suffix
   array is built over the segments of many anchors.  Runs of suffixes with a common prefix of 400
   bytes whose left neighbours differ are scanned with a stack; each common-prefix interval with
   diverse left extension is a maximal repeat with all its occurrences.  What is found in a kind's
   first occurrence holds for the kind's others.  So a kind found twice, whole copies included, is
   compared byte by byte between two of its occurrences; further ones rest on the 128 bits.
3. Anchors with more than ``MAX_KINDS`` kinds don't meet in one task: their segments are taken apart
   into blocks of ``BLOCK`` windows that meet by the bytes all windows of a block hold, and go
   through suffix arrays in the same way.  Blocks that more than ``MAX_KINDS`` kinds share all but a
   few bytes of are taken apart into single windows; two occurrences of each window found twice then
   go through a suffix array of their own.

Bytes are covered by what was found in 2 and 3, judged on the input.  The text is shuffled by id
once to fetch segments and once for the final cut.

Defined cases: null texts count as empty; texts under 400 bytes lose nothing; repeated rows, with
or without equal ids, are documents of their own and lose what they share; an empty table gives an
empty result.  Other columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.common import documents, durable, scratch

LENGTH = 400
GRAM = 32
#: Kinds of segment of one anchor that meet in one suffix array.
MAX_KINDS = 600
BLOCK = 16
#: An anchor is hot from this many rows on, or from this part of all rows: at most a million are.
HOT_ROWS, HOT_PART, HOT_SAMPLE = 4_000, 1_000_000, 16
#: Bytes of text that are hashed, and of segments that are sorted, at once.
SLICE = 1 << 18
SORTED = 1 << 18
#: A segment has at most as many windows as a window has grams.
LONGEST = 2 * LENGTH - GRAM
#: Ends a part in a suffix array; no UTF-8 text holds it.
END = b"\xff"

_rng = np.random.default_rng(20)
BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
BASE = int(_rng.integers(1 << 32, 1 << 63, dtype=np.uint64)) | 5

#: Low bits of a gram's hash that give way to its place, so that the leftmost of equals is least.
PLACE = np.uint64((1 << 24) - 1)


class Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, SLICE + 2 * LENGTH)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)))) for base in (BASE, pow(BASE, -1, 1 << 64)))


POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Hashes:
    """Polynomial hashes of short substrings of ``data`` from prefix sums."""

    def __init__(self, data: np.ndarray):
        POWERS.reach(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * POWERS.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * POWERS.down[start])


def named(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of substrings."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(x) - width + 1
    full = np.concatenate((x, np.full(-len(x) % width, x[-1])))
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor over documents that end at ``ends``.

    Returns document, first start in ``data``, number of starts, anchor hash and segment hash.
    """
    begins = np.concatenate(([0], ends[:-1]))
    if len(data) < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    h = Hashes(data)
    p = np.arange(len(data) - gram + 1)
    g = h.of(p, p + gram)
    least = sliding_least((g & ~PLACE) | p.astype(np.uint64), length - gram + 1)
    anchor = (least & PLACE).astype(np.int64)
    i = np.arange(len(anchor))
    doc = np.repeat(np.arange(len(ends)), ends - begins)[: len(anchor)]
    valid = i + length <= ends[doc]
    new = valid & np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]))
    first = np.nonzero(new)[0]
    last = np.nonzero(valid & np.concatenate((new[1:] | ~valid[1:], [True])))[0]
    return doc[first], first, last - first + 1, g[anchor[first]], named(data.tobytes(), first, last + length)


def anchors(docs: DataFrame) -> DataFrame:
    """(id, t, text) -> a row per segment: id, t, start, own, anchor, h."""
    names = ["id", "t", "start", "own", "anchor", "h"]

    def rows(ids, ts, starts, data, ends):
        d, first, own, a, h = segments(data, ends)
        begin = np.concatenate(([0], ends[:-1]))
        cols = [ids[d], ts[d], starts[d] + first - begin[d], own, a.view(np.int64), h.view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list[tuple[int, int, int, bytes]] = []
            size = 0
            for i, t, text in zip(b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                for at in range(0, max(1, len(raw) - LENGTH + 1), SLICE):  # windows that start in one slice
                    part = raw[at : at + SLICE + LENGTH - 1]
                    held.append((i, t, at, part))
                    size += len(part)
                    if size >= SLICE:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

    def flush(held):
        ids, ts, at, parts = zip(*held)
        data = np.frombuffer(b"".join(parts), np.uint8)
        return rows(np.array(ids, np.int64), np.array(ts, np.int64), np.array(at, np.int64), data, np.cumsum([len(p) for p in parts]))

    return docs.select("id", "t", "text").mapInArrow(run, "id long, t long, start long, own long, anchor long, h long")


class SuffixArray:
    """Suffixes of ``parts`` that have ``length`` bytes or more within their part, in order, by prefix tripling.

    ``END`` follows each part, so suffixes that agree beyond a part's end are equally long: else one cut
    short could stand between two that share more than it has.
    """

    LEVELS = (8, 24, 72, 216)

    def __init__(self, parts: list[bytes], length: int):
        self.data = np.frombuffer(b"".join(p + END for p in parts), np.uint8)
        n = len(self.data)
        size = np.array([len(p) for p in parts], np.int64)
        if n >> 21 or size.max(initial=0) > LONGEST:
            raise ValueError(f"a suffix array takes under 2 MB in parts of at most {LONGEST} bytes")
        if np.count_nonzero(self.data == END[0]) > len(parts):
            raise ValueError("parts are UTF-8, without the byte 255")
        self.part_end = np.cumsum(size + 1) - 1
        self.part = np.repeat(np.arange(len(parts)), size + 1)
        self.left_of = self.part_end[self.part] - np.arange(n)  # bytes up to the part's end
        wide = np.concatenate((self.data, np.zeros(8, np.uint8))).astype(np.uint64)
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | wide[j : j + n]
        at, self.ranks = np.arange(n), []
        for level in self.LEVELS:
            rank, _ = self._dense(key)
            self.ranks.append(np.concatenate((rank, np.zeros(1024, np.int32))))
            if level == self.LEVELS[-1]:
                at = np.nonzero(self.left_of >= length)[0]
            key = self._three(self.ranks[-1], at, level)
        rank, _ = self._dense(key)  # 648 bytes; the rank 216 bytes before the longest part's end does the rest
        self.order = at[np.argsort((rank.astype(np.int64) << 32) | self.ranks[-1][at + LONGEST - 216])]

    @staticmethod
    def _three(rank: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        return (rank[at].astype(np.int64) << 42) | (rank[at + level].astype(np.int64) << 21) | rank[at + 2 * level]

    @staticmethod
    def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = 1 + np.concatenate(([0], np.cumsum(s[1:] != s[:-1], dtype=np.int32)))[: len(key)]
        return rank, order

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes, within their parts."""
        most = np.minimum(self.left_of[a], self.left_of[b])
        n = np.zeros(len(a), np.int64)
        top = len(self.data)
        for level, rank in zip(self.LEVELS[::-1], self.ranks[::-1]):
            for _ in range(3 if level == self.LEVELS[-1] else 2):
                n += level * (rank[np.minimum(a + n, top)] == rank[np.minimum(b + n, top)])
        wide = np.concatenate((self.data, np.zeros(1024, np.uint8)))
        going = np.ones(len(a), bool)
        for _ in range(7):
            going &= wide[a + n] == wide[b + n]
            n += going
        return np.minimum(n, most)


def maximal_repeats(parts: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, list[int]]]:
    """(length, starts in the joined parts) of each maximal repeat of at least ``length`` bytes.

    Repeats stay within a part; a part's start counts as a left extension of its own.
    """
    sa = SuffixArray(parts, length)
    s = sa.order
    if len(s) < 2:
        return
    shared = sa.common(s[:-1], s[1:])
    begins = np.concatenate(([0], sa.part_end[:-1] + 1))
    starts = s - sa.part[s]  # without the ends between parts
    left = np.where(s == begins[sa.part[s]], 256 + s, sa.data[s - 1].astype(np.int64))
    joined = np.concatenate(([False], shared >= length, [False]))
    first = np.nonzero(joined[1:] & ~joined[:-1])[0]
    last = np.nonzero(joined[:-1] & ~joined[1:])[0]
    if not len(first):
        return
    bounds = np.stack((first, last + 1), 1).ravel()
    grown = np.append(left, left[-1])
    diverse = np.minimum.reduceat(grown, bounds)[::2] != np.maximum.reduceat(grown, bounds)[::2]
    for lo, hi in zip(first[diverse].tolist(), last[diverse].tolist()):
        yield from _intervals(starts[lo : hi + 1].tolist(), shared[lo:hi].tolist(), left[lo : hi + 1].tolist(), length)


def _intervals(s: list[int], shared: list[int], left: list[int], length: int) -> Iterator[tuple[int, list[int]]]:
    """Stack scan of one run: the intervals whose suffixes differ to the left.

    A stack entry is [common length, first suffix, left extension or None once diverse].
    """
    stack = [[length - 1, 0, left[0]]]
    fresh = left[0]
    for i, h in enumerate([*shared, length - 1]):
        first, ext = i, fresh
        while stack[-1][0] > h:
            n, first, own = stack.pop()
            ext = own if own == ext else None
            if ext is None:
                yield n, s[first : i + 1]
        if stack[-1][0] == h:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == ext else None
        else:
            stack.append([h, first, ext])
        fresh = left[i + 1] if i + 1 < len(left) else None


def covered_runs(parts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(part, from, to) of the bytes that maximal repeats cover, as runs."""
    size = np.array([len(p) for p in parts], np.int64)
    begins = np.concatenate(([0], np.cumsum(size)))
    edge = np.zeros(begins[-1] + 1, np.int64)
    for n, starts in maximal_repeats(parts, length):
        at = np.array(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + n, -1)
    on = np.cumsum(edge[:-1]) > 0
    part = np.repeat(np.arange(len(parts)), size)
    if not on.any():
        return []
    change = np.concatenate(([True], (on[1:] != on[:-1]) | (part[1:] != part[:-1]), [True]))
    cut = np.nonzero(change)[0]
    live = on[cut[:-1]]
    a, b = cut[:-1][live], cut[1:][live]
    own = part[a]
    return list(zip(own.tolist(), (a - begins[own]).tolist(), (b - begins[own]).tolist()))


FOUND = "anchor long, h long, rep int, id long, t long, start long, from long, to long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (group, anchor, h, rep, id, t, start, bytes), sorted by group -> what is covered, as ``FOUND``."""
    held: list[tuple] = []
    size, before = 0, None
    schema = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32()}[f.split()[1]]) for f in FOUND.split(", ")])

    def solve():
        found = covered_runs([h[-1] for h in held])
        out = [(*held[p][1:-1], held[p][6] + a, held[p][6] + b) for p, a, b in found]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(schema), schema.types)], schema=schema)

    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in range(8))):
            if size >= SORTED and row[0] != before:
                yield solve()
                held, size = [], 0
            held.append(row)
            size += len(row[-1])
            before = row[0]
    if held:
        yield solve()


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: segment rows -> per (anchor, h) of a batch its first row with the number of all but
    the last, and its last row."""
    for b in batches:
        cols = {n: b.column(n).to_numpy() for n in ("anchor", "h", "id", "t", "start", "own")}
        order = np.lexsort((cols["h"], cols["anchor"]))
        a, h = cols["anchor"][order], cols["h"][order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1]))) if len(a) else np.zeros(0, bool)
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(a)))
        last = (first + n - 1)[n > 1]
        shown = np.concatenate((order[first], order[last]))
        yield pa.RecordBatch.from_arrays([pa.array(c[shown]) for c in cols.values()] + [pa.array(np.concatenate((np.maximum(1, n - 1), np.ones(len(last), np.int64))))], [*cols, "n"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (n, id, t, start, bytes) -> a row per block: core, h, n, id, t, segment's start, start, windows.

    Blocks are cut at fixed distances from the anchor, so equal windows lie in equal blocks; ``core``
    hashes the bytes that all windows of a full block share, ``h`` those of the block.
    """
    for b in batches:
        out = []
        for count, i, t, start, raw in zip(*(b.column(c).to_pylist() for c in range(5))):
            h = Hashes(np.frombuffer(raw, np.uint8))
            n, q = len(raw) - LENGTH + 1, np.arange(LENGTH - GRAM + 1)
            anchor = int(((h.of(q, q + GRAM) & ~PLACE) | q.astype(np.uint64)).argmin())
            near = np.arange((anchor - n + 1) // BLOCK if anchor >= n - 1 else 0, anchor // BLOCK + 1) * BLOCK
            cores = named(raw, np.maximum(0, anchor - near), np.minimum(len(raw), anchor - near + LENGTH - BLOCK + 1)).view(np.int64)
            lo, hi = np.maximum(0, anchor - near - BLOCK + 1), np.minimum(n, anchor - near + 1)
            own = named(raw, lo, hi + LENGTH - 1).view(np.int64)
            out += [(c, k, count, i, t, start, start + x, y - x) for c, k, x, y in zip(cores.tolist(), own.tolist(), lo.tolist(), hi.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 8)], ["core", "h", "n", "id", "t", "seg", "start", "own"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (core, n, id, t, segment's start, start, bytes) of blocks -> the same with the windows' hashes."""
    for b in batches:
        w = []
        for raw in b.column(6).to_pylist():
            p = np.arange(len(raw) - LENGTH + 1)
            w.append(named(raw, p, p + LENGTH).view(np.int64))
        yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(w, pa.list_(pa.int64()))], ["core", "n", "id", "t", "seg", "start", "w"])


def _places(alone: Column) -> Column:
    """A kind with one occurrence is its own place (rep -1); else two stand for it (0 and 1)."""
    first = [F.struct(F.lit(r).alias("rep"), F.col(c).alias("p")) for r, c in ((-1, "one"), (0, "one"), (1, "two"))]
    return F.explode(F.when(alone, F.array(first[0])).otherwise(F.array(*first[1:]))).alias("r")


def _spread(found: DataFrame, same: DataFrame) -> DataFrame:
    """What ``same`` (as ``FOUND``) holds for all rows (anchor, h, id, t, start) of its kinds."""
    alone = same.where("rep = -1").select("id", "t", "from", "to")
    rest = same.where("rep = 0").select("anchor", "h", (F.col("from") - F.col("start")).alias("lo"), (F.col("to") - F.col("start")).alias("hi"))
    return alone.union(found.join(rest, ["anchor", "h"]).select("id", "t", (F.col("start") + F.col("lo")).alias("from"), (F.col("start") + F.col("hi")).alias("to")))


def hot_coverage(segs: DataFrame, max_kinds: int) -> DataFrame:
    """(n, id, t, start, raw), a row per kind -> (id, t, from, to) for kinds with n = 1 at least."""
    segs = durable(segs, "suffix-hot").select("n", "id", "t", F.col("start").alias("seg"), "raw")
    blocks = segs.select("n", "id", "t", "seg", "raw").mapInArrow(_blocks, "core long, h long, n long, id long, t long, seg long, start long, own long")
    blocks = durable(blocks, "suffix-blocks")
    place = F.struct("id", "t", "seg", "start", "own")
    kinds = blocks.groupBy("core", "h").agg(F.count("*").alias("c"), F.min(place).alias("one"), F.max(place).alias("two"))
    kinds = durable(kinds, "suffix-block-kinds")
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"))
    raw = F.substring("raw", (F.col("start") - F.col("seg") + 1).cast("int"), (F.col("own") + (LENGTH - 1)).cast("int")).alias("raw")
    text = segs.select("id", "t", "seg", "raw")

    few = kinds.join(cores.where(F.col("kinds") <= max_kinds), "core").where("c > 1 or kinds > 1").select("core", "h", _places(F.col("c") == 1)).select("core", "h", "r.rep", "r.p.*")
    few = text.join(few, ["id", "t", "seg"]).select(F.col("core").alias("anchor"), "h", "rep", "id", "t", "start", raw)
    same = few.repartition("anchor").sortWithinPartitions("anchor").select("anchor", *few.columns).mapInArrow(_compare, FOUND)
    found = blocks.where("n = 1").select(F.col("core").alias("anchor"), "h", "id", "t", "start")
    out = _spread(found, durable(same, "suffix-block-found"))
    crowded = cores.where(F.col("kinds") > max_kinds).select("core")
    if crowded.isEmpty():
        return out

    # blocks of too many kinds share all but a few bytes: their single windows meet
    open_ = text.join(blocks.join(crowded, "core", "left_semi"), ["id", "t", "seg"]).select("core", "n", "id", "t", "seg", "start", raw)
    open_ = open_.mapInArrow(_windows, "core long, n long, id long, t long, seg long, start long, w array<long>").select("core", "n", "id", "t", "seg", "start", F.posexplode("w").alias("k", "w"))
    open_ = durable(open_.withColumn("start", F.col("start") + F.col("k")).drop("k"), "suffix-windows")
    twice = open_.groupBy("core", "w").agg(F.count("*").alias("c"), F.min(place_ := F.struct("id", "t", "seg", "start")).alias("one"), F.max(place_).alias("two")).where("c > 1")
    pairs = twice.select(F.col("core").alias("anchor"), F.col("w").alias("h"), _places(F.lit(False))).select("anchor", "h", "r.rep", "r.p.*")
    raw = F.substring("raw", (F.col("start") - F.col("seg") + 1).cast("int"), F.lit(LENGTH)).alias("raw")
    pairs = text.join(pairs, ["id", "t", "seg"]).select("anchor", "h", "rep", "id", "t", "start", raw)
    sure = pairs.repartition("anchor", "h").sortWithinPartitions("anchor", "h").select("h", *pairs.columns).mapInArrow(_compare, FOUND)
    return out.union(_spread(open_.where("n = 1").select(F.col("core").alias("anchor"), F.col("w").alias("h"), "id", "t", "start"), durable(sure, "suffix-sure")))


def hot_anchors(found: DataFrame) -> DataFrame:
    """Anchors with many rows, about a million at most, so they may be broadcast at any size.

    They are told by one row in ``HOT_SAMPLE``; only the dealing depends on them, never the result.
    """
    most = max(HOT_ROWS, found.count() // HOT_PART) / HOT_SAMPLE
    counts = found.select(F.col("anchor").alias("a")).sample(False, 1 / HOT_SAMPLE, 5).groupBy("a").count()
    return durable(counts.where(F.col("count") > most).select("a"), "suffix-hot-anchors")


def coverage(docs: DataFrame, max_kinds: int = MAX_KINDS, unique: bool = False) -> DataFrame:
    """(id, t, text) -> (id, t, ranges): byte ranges (from, to) that hold a string found elsewhere.

    ``unique`` tells that no two rows share id and t.  Only this table stays of those written here.
    """
    with scratch(docs.sparkSession):
        found = _ranges(docs, max_kinds, unique)
        return durable(found.groupBy("id", "t").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("ranges")), "suffix-cover", keep=True)


def _ranges(docs: DataFrame, max_kinds: int, unique: bool) -> DataFrame:
    key = ["anchor", "h"]
    found = durable(anchors(docs), "suffix-anchors")
    hot = hot_anchors(found)
    rows = found.mapInArrow(_combine, "anchor long, h long, id long, t long, start long, own long, n long")
    rows = rows.join(F.broadcast(hot), rows["anchor"] == hot["a"], "left").withColumn("salt", F.when(F.col("a").isNotNull(), F.col("h").bitwiseOR(F.lit(1))).otherwise(0)).drop("a")
    place = F.struct("id", "t", "start", "own")
    kinds = rows.repartition("anchor", "salt").groupBy("anchor", "salt", "h").agg(F.sum("n").alias("n"), F.min(place).alias("one"), F.max(place).alias("two"))
    kinds = kinds.withColumn("kinds", F.count("*").over(Window.partitionBy("anchor", "salt"))).where("n > 1 or kinds > 1 or salt <> 0")
    kinds = durable(kinds, "suffix-kinds")
    of_hot = kinds.where("salt <> 0").groupBy(F.col("anchor").alias("a")).agg(F.count("*").alias("of_hot"))
    kinds = kinds.join(F.broadcast(durable(of_hot, "suffix-hot-kinds")), F.col("anchor") == F.col("a"), "left").withColumn("kinds", F.coalesce("of_hot", "kinds"))
    kinds = kinds.where("n > 1 or kinds > 1").withColumn("many", F.col("kinds") > max_kinds)
    wanted = kinds.select(*key, "many", _places(F.col("n") == 1)).select(*key, "many", "r.rep", "r.p.*")
    bare = docs.select(F.col("id").alias("i2"), F.col("t").alias("t2"), "text")
    bare = bare if unique else bare.dropDuplicates(["i2", "t2"])
    raw = F.substring(F.col("text").cast("binary"), (F.col("start") + 1).cast("int"), (F.col("own") + (LENGTH - 1)).cast("int"))
    segs = bare.join(wanted, (F.col("i2") == F.col("id")) & (F.col("t2") == F.col("t"))).select(*key, "many", "rep", "id", "t", "start", raw.alias("raw"))
    some_many = not kinds.where("many").isEmpty()
    if some_many:
        segs = durable(segs, "suffix-segments")
    # of a crowded anchor only the occurrences of one kind meet here
    meet = segs.where("not many or rep >= 0").withColumn("side", F.when(F.col("many"), F.col("h")).otherwise(0))
    same = meet.repartition("anchor", "side").sortWithinPartitions("anchor", "side").select(F.when(F.col("many"), F.col("side")).otherwise(F.col("anchor")), *key, "rep", "id", "t", "start", "raw").mapInArrow(_compare, FOUND)
    out = _spread(found, durable(same, "suffix-found"))
    if some_many:
        n = F.when(F.col("rep") == -1, 1).otherwise(2).cast("long")
        out = out.union(hot_coverage(segs.where("many and rep <= 0").select(n.alias("n"), "id", "t", "start", "raw"), max_kinds))
    return out


def cut(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of ``raw``, bytes removed and number of removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for a, b in sorted(ranges):
        if a > at or not runs:
            kept.append(raw[at:a])
            runs += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def prepared(df: DataFrame) -> tuple[DataFrame, bool]:
    """(id, t, text), and whether ids are unique: else t is a hash of the text, so rows of one id and t are equal."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ids = F.col("doc_id").cast("long")
    unique = df.groupBy(ids.alias("i")).count().where("i is null or count > 1").isEmpty()
    t = F.lit(0).cast("long") if unique else F.xxhash64(text)
    return df.select(F.coalesce(ids, F.lit(-(1 << 63))).alias("id"), t.alias("t"), text.alias("text")), unique


def remove_repeats(df: DataFrame, max_kinds: int = MAX_KINDS) -> DataFrame:
    """(doc_id, text) -> doc_id, kept (binary), n_bytes, n_removed, n_spans."""
    docs, unique = prepared(df)
    joined = docs.join(coverage(docs, max_kinds, unique), ["id", "t"], "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                out = []
                for i, text, ranges in zip(*(b.column(c).slice(at, 64).to_pylist() for c in range(3))):
                    raw = text.encode("utf-8", "surrogatepass")
                    kept, removed, runs = cut(raw, [(r["from"], r["to"]) for r in ranges or []])
                    out.append((None if i == -(1 << 63) else i, kept, len(raw), removed, runs))
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and ``text``: what is left, with bytes that a cut took apart as U+FFFD."""
    left = remove_repeats(documents(spark, sf_dir))
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
