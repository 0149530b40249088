"""Language identification by cross-parsing entropy.

Each language's labelled sample becomes a suffix automaton.  A text is cut greedily, from its start
to its end, into the longest phrases that each automaton holds; phrases times log2 of the sample's
length are the bits it takes, and the language with the fewest bits wins (ties: the first by code
point).  Letters are lower-cased; a run of anything else is one blank.  Every letter is a symbol of
its own; a letter that a sample lacks is a phrase by itself in that language.

The transitions of an automaton lie displaced over each other in one table (a state is its offset,
a cell names its owner), so memory follows the transitions, not states times letters.

Texts are parsed in blocks side by side, so that NumPy steps many symbols at once.  Each block is
first parsed as if a phrase began with it.  Then the state in which the block before ends is carried
into it, and the parse is repaired from there until a phrase begins where one is known to begin;
blocks are repaired anew while the state carried into them changes.  The outcome is the one parse
of the whole text.

Bounds: per language at most ``SAMPLE_DOCS`` labelled documents, in the order of a hash of the id,
each whole, as long as they add up to ``SAMPLE_CHARS`` characters for all languages together (a
longer one is passed over; if none fits, the shortest is taken).  Prediction reads whole texts.
The samples, not the tables, are sent to the workers.

Defined cases: ``und`` with score 0 for null texts and texts without a letter, and for all texts if
no labelled row can be learned from; repeated rows get equal predictions; an empty table gives an
empty result.  A row with a null id is not learned from and not held out.  Other columns of the
input don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.common import documents

SAMPLE_DOCS = 60
SAMPLE_CHARS = 400_000
#: Symbols of a block, and of the texts that are parsed at once (but for a longer text, which is parsed alone).
BLOCK = 256
AT_ONCE = 1 << 20
#: Blocks that are repaired one by one.
FEW = 16
#: Above the offset of any state.
OWNED_INT = 1 << 32
OWNED = np.uint64(OWNED_INT)
BLANK, ABSENT = 0, 1
FOLDS, HELD_OUT = 4, 2


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


@lru_cache(1)
def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-cased code points with every run of non-letters as one 0."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    cp = np.where(letter_table()[cp], cp, 0)
    return cp[np.concatenate(([True], (cp[1:] != 0) | (cp[:-1] != 0)))] if len(cp) else cp


def suffix_automaton(texts: list[list[int]]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``texts``; none runs from one text into the next."""
    go: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    for text in texts:
        last = 0
        for c in text:
            known = c in go[last]  # then the string so far is in an earlier text
            p, cur = last, last
            if not known:
                cur = len(go)
                go.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p >= 0 and c not in go[p]:
                    go[p][c] = cur
                    p = link[p]
            if p < 0:
                last = cur
                continue
            q = go[p][c]
            if length[p] + 1 != length[q]:
                twin = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            if not known:
                link[cur] = q
            last = q if known else cur
    return go


def displaced(go: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """One table of the transitions: the cell at (offset of a state) + symbol holds owner << 32 | offset of the next state.

    States have different offsets, the root 0.  Empty cells and the root's have no owner, so a step
    that isn't owned begins a phrase; the second array tells the state after a phrase's first symbol.
    """
    fan = np.fromiter(map(len, go), np.int64, len(go))
    size = int(fan.sum() + 2 * len(go) + 4 * width)
    taken, based = bytearray(size), bytearray(size)  # cells and offsets in use
    offset = np.zeros(len(go), np.int64)
    low = 1
    for s in [0, *(1 + np.argsort(-fan[1:], kind="stable")).tolist()]:
        symbols = list(go[s])
        if len(symbols) < 2 and s:
            break
        at, tries = (low, 0) if s else (0, 0)
        while based[at] or any(taken[at + c] for c in symbols):
            at, tries = at + 1, tries + 1
            if at + 2 * width > len(taken):
                taken.extend(bytes(len(taken)))
                based.extend(bytes(len(based)))
        if tries > 40:
            low = at
        based[at] = 1
        for c in symbols:
            taken[at + c] = 1
        offset[s] = at
    # states with one transition or none go to the places left, all of a symbol at once
    only = np.fromiter((next(iter(g)) if len(g) == 1 else -1 for g in go), np.int64, len(go))
    only[0] = -2
    cells, places = np.frombuffer(taken, np.uint8).copy(), np.frombuffer(based, np.uint8).copy()
    for c in [*np.unique(only[only >= 0]).tolist(), -1]:
        who = np.nonzero((only == c) & (fan == (c >= 0)))[0]
        free = places[: len(places) - width] == 0
        if c >= 0:
            free &= cells[c : c + len(free)] == 0
        at = np.nonzero(free)[0][: len(who)]
        if len(at) < len(who):
            more = np.arange(len(who) - len(at)) + len(places)
            at = np.concatenate((at, more))
            cells, places = (np.concatenate((x, np.zeros(len(more) + width, np.uint8))) for x in (cells, places))
        places[at] = 1
        if c >= 0:
            cells[at + c] = 1
        offset[who] = at
    table = np.full(int(offset.max()) + width, -1, np.int64)
    fan[0] = 0
    owner = np.repeat(np.arange(len(go)), fan)
    symbol = np.fromiter((c for g in go[1:] for c in g), np.int64, len(owner))
    to = np.fromiter((t for g in go[1:] for t in g.values()), np.int64, len(owner))
    table[offset[owner] + symbol] = (offset[owner] << 32) | offset[to]
    fresh = np.zeros(width, np.int64)
    for c, t in go[0].items():
        fresh[c] = offset[t]
    return table, fresh


class CrossParser:
    def __init__(self, samples: dict[str, tuple[str, ...]]):
        self.langs = sorted(samples)
        self.symbol, self.tables, self.bits = [], [], []
        for k in self.langs:
            points = [code_points(s) for s in samples[k]]
            seen = np.unique(np.concatenate([np.zeros(1, np.uint32), *points]))
            symbol = np.full(0x110000, ABSENT, np.int32)
            symbol[seen[1:]] = np.arange(2, 1 + len(seen))
            symbol[0] = BLANK
            self.symbol.append(symbol)
            self.tables.append(displaced(suffix_automaton([symbol[p].tolist() for p in points]), 2 + len(seen)))
            self.bits.append(np.log2(max(2, sum(map(len, points)))))

    def phrases(self, k: int, points: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Phrases of each text in language ``k``; text i ends before ``ends[i]``."""
        (table, fresh), text = self.tables[k], self.symbol[k].take(points)
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        per = -(-(ends - begins) // block)
        owner = np.repeat(np.arange(len(ends)), per)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        first = begins[owner] + block * nth
        size = np.minimum(block, ends[owner] - first)

        # every block from the root, the longest first
        order = np.argsort(-size, kind="stable")
        at, sized, state = first[order], -size[order], np.zeros(len(order), np.int64)
        new, leave = np.zeros((block, len(order)), bool), np.zeros(len(order), np.int64)
        for t in range(block):
            m = int(np.searchsorted(sized, -t))
            if m < len(state):
                leave[order[m : len(state)]] = state[m:]
                state = state[:m]
            if not m:
                break
            c = text.take(at[:m] + t)
            cell = table.take(state + c) ^ (state << 32)
            hit = cell.view(np.uint64) < OWNED
            new[t, :m] = ~hit
            state = np.where(hit, cell, fresh.take(c))
        leave[order[: len(state)]] = state
        known = np.empty_like(new.T)
        known[order] = new.T
        later = known.sum(1)  # phrases of a block once the parse agrees with that from the root
        own, extra, enter = leave.copy(), np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)

        todo = np.nonzero(nth > 0)[0]
        enter[todo] = leave[todo - 1]
        while len(todo):
            if len(todo) < FEW:
                self._mend(todo.tolist(), table, fresh, text, known, nth, first, size, own, leave, enter, later, extra)
                break
            now = own[todo]
            extra[todo] = 0
            later[todo] = known[todo].sum(1)
            who = np.nonzero(enter[todo] > 0)[0]
            lane, state = todo[who], enter[todo[who]]
            at, to = first[lane], size[lane]
            passed = np.zeros(len(lane), np.int64)
            t = 0
            while len(lane):
                c = text.take(at + t)
                cell = table.take(state + c) ^ (state << 32)
                hit = cell.view(np.uint64) < OWNED
                there = known[lane, t]
                met = ~hit & there
                passed += there
                extra[lane] += ~hit & ~met
                state = np.where(hit, cell, fresh.take(c))
                t += 1
                over = met | (to == t)
                if over.any():
                    end = over & ~met
                    now[who[end]] = state[end]
                    later[lane[over]] -= passed[over] - met[over]
                    keep = ~over
                    lane, who, state, at, to, passed = (x[keep] for x in (lane, who, state, at, to, passed))
            moved = todo[now != leave[todo]] + 1
            leave[todo] = now
            todo = moved[moved < len(nth)]
            todo = todo[nth[todo] > 0]
            enter[todo] = leave[todo - 1]
        return np.bincount(owner, later + extra, len(ends)).astype(np.int64)

    @staticmethod
    def _mend(todo, table, fresh, text, known, nth, first, size, own, leave, enter, later, extra) -> None:
        """Repairs few blocks one after the other, each as far as the change reaches."""
        cells, roots, symbols = memoryview(table), memoryview(fresh), memoryview(text)
        done = -1
        for b in todo:
            while b > done:
                at, state, own_starts = int(first[b]), int(enter[b]), known[b].tolist()
                now, extra[b], later[b], done = own[b], 0, sum(own_starts), b
                if state:
                    count, passed = 0, 0
                    for t in range(int(size[b])):
                        c = symbols[at + t]
                        cell = cells[state + c]
                        if cell >> 32 == state:
                            state = cell & (OWNED_INT - 1)
                        else:
                            if own_starts[t]:
                                break
                            state = roots[c]
                            count += 1
                        passed += own_starts[t]
                    else:
                        now = state
                    extra[b] = count
                    later[b] -= passed
                moved = now != leave[b]
                leave[b] = now
                b += 1
                if not moved or b == len(nth) or not nth[b]:
                    break
                enter[b] = now

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        points = [code_points(t or "") for t in texts]
        has = [bool((p != 0).any()) for p in points]
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held: list[int] = []
        size = 0
        for i, h in enumerate(has):
            if h:
                held.append(i)
                size += len(points[i])
            if held and (size >= AT_ONCE or i == len(has) - 1):
                self._solve(held, [points[j] for j in held], out)
                held, size = [], 0
        if held:
            self._solve(held, [points[j] for j in held], out)
        return out

    def _solve(self, at: list[int], points: list[np.ndarray], out: list) -> None:
        flat, ends = np.concatenate(points), np.cumsum([len(p) for p in points])
        bits = np.stack([self.phrases(k, flat, ends) * self.bits[k] for k in range(len(self.langs))])
        best = bits.argmin(0)
        score = 1 / np.exp2(-np.minimum(bits - bits.min(0), 1000)).sum(0)
        for i, b, s in zip(at, best, score):
            out[i] = (self.langs[b], float(s))


@lru_cache(2)
def _parser(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> CrossParser:
    return CrossParser(dict(samples))


def labelled_samples(df: DataFrame, learn: Column) -> dict[str, tuple[str, ...]]:
    """Whole texts per language within the bounds; ``learn`` says which rows may be used."""
    rows = df.where(learn & F.col("lang").isNotNull()).withColumn("draw", F.xxhash64("doc_id"))
    langs = rows.agg(F.countDistinct("lang")).first()[0]
    if not langs:
        return {}
    most = SAMPLE_CHARS // langs
    rows = rows.where(F.col("text").rlike(r"\p{L}")).withColumn("n", F.length("text"))
    # those that fit come first, by the draw, then the others, the shortest first
    place = [F.col("n") > most, F.when(F.col("n") > most, F.col("n")), "draw"]
    best = rows.select("lang", "draw", "n").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*place)))
    best = best.where(F.col("k") <= SAMPLE_DOCS).select("lang", "draw").distinct()
    # ids may repeat, so the rows are ranked once more
    near = rows.join(F.broadcast(best), ["lang", "draw"]).select("lang", "draw", "n", "text")
    near = near.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*place, "text"))).where(F.col("k") <= SAMPLE_DOCS)
    near = near.withColumn("sum", F.sum("n").over(Window.partitionBy("lang").orderBy("k"))).where((F.col("k") == 1) | (F.col("sum") <= most))
    out: dict[str, list[str]] = {}
    for r in near.select("lang", "text").orderBy("lang", "k").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return {k: tuple(v) for k, v in out.items()}


def identify(df: DataFrame, samples: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, text) -> doc_id, lang_pred, score."""
    sent = df.sparkSession.sparkContext.broadcast(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                texts = b.column(1).slice(at, 500).to_pylist()
                found = _parser(sent.value).predict(texts) if sent.value else [("und", 0.0)] * len(texts)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), pa.array([x for x, _ in found]), pa.array([s for _, s in found])], ["doc_id", "lang_pred", "score"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    samples = labelled_samples(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    found = identify(docs, samples)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
