"""SentencePiece BPE encoding by a prefix table, and decoding.

For each prefix of a text there is one token that its encoding ends with.  An Aho-Corasick automaton
over the pieces names the tokens that end at a place; the one to store is the token whose
predecessor, the stored token of the prefix before it, is pair-compatible with it: encoding the two
pieces' joined string gives just these two again.  Following the table from the end backwards gives
the ids.  Merges never cross the start of a run of spaces nor an unknown character, so texts are
cut there and the units' ids are kept in a bounded cache.

The model file is read once on the driver and sent to the workers (under 1 MB).  Models with a
normaliser, user-defined or unused pieces are refused.

Defined cases: a null text counts as empty (the end id alone); repeated rows get equal results; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents

SPACE = "▁"
CACHED_UNITS = 300_000
CACHED_PAIRS = 500_000


class PrefixEncoder:
    def __init__(self, model: bytes, cached_units: int = CACHED_UNITS, cached_pairs: int = CACHED_PAIRS):
        import ahocorasick
        import sentencepiece as spm

        sp = self.library = spm.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        if sp.normalize(" a  éＡ ") != f"{SPACE}{SPACE}a{SPACE}{SPACE}éＡ{SPACE}" or any(sp.is_unused(i) for i in range(n)):
            raise ValueError("a model without normaliser and unused pieces is needed")
        special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)]
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte):
            raise ValueError("a model with byte pieces is needed")
        self.end = sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.width = list(map(len, self.piece))
        self.id_of = {p: i for i, p in enumerate(self.piece) if i not in set(special)}
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.known = {p for p in self.id_of if len(p) == 1}
        if any(SPACE in p.lstrip(SPACE) or not self.known.issuperset(p) for p in self.id_of):
            raise ValueError("a piece crosses the start of a word or has a character without a piece")
        self.matches = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.matches.add_word(p, (i, len(p)))
        self.matches.make_automaton()
        self.unknown = re.compile(f"([^{''.join(map(re.escape, sorted(self.known)))}])")
        self.cut_lines = "\n" not in self.known
        # Each cache has two generations: a full young one becomes the old one, whose entries come back when met.
        self.units: dict[str, tuple[int, ...]] = {}
        self.old_units: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.old_pairs: dict[int, bool] = {}
        self.most_units, self.most_pairs = cached_units, cached_pairs
        self.size = n

    def merged(self, text: str) -> list[str]:
        """Merging by definition: the best score first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        key = a * self.size + b
        if len(self.pairs) >= self.most_pairs:
            self.old_pairs, self.pairs = self.pairs, {}
        fits = self.old_pairs.get(key)
        if fits is None:
            fits = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        self.pairs[key] = fits
        return fits

    def _known_part(self, part: str) -> list[int]:
        last = [-1] * (len(part) + 1)
        pairs, size = self.pairs, self.size
        for at, (token, width) in self.matches.iter(part):
            end = at + 1
            if last[end] < 0:
                if end == width:
                    last[end] = token
                elif (before := last[end - width]) >= 0:
                    fits = pairs.get(before * size + token)
                    if fits is None:
                        fits = self.compatible(before, token)
                    if fits:
                        last[end] = token
        ids, at = [], len(part)
        while at:
            ids.append(last[at])
            at -= self.width[last[at]]
        return ids[::-1]

    def _unit(self, unit: str) -> tuple[int, ...]:
        if self.known.issuperset(unit):
            return tuple(self._known_part(unit))
        ids: list[int] = []
        for k, part in enumerate(self.unknown.split(unit)):
            if k % 2:
                ids += [self.byte[b] for b in part.encode()]
            elif part:
                ids += self._known_part(part)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        """Ids of the text, without the end id."""
        if not text:
            return []
        if self.cut_lines:
            keys = text.replace("\n", " \n").split(" ")
        if not self.cut_lines or "" in keys or SPACE in text:
            keys = re.findall(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*", SPACE + text.replace(" ", SPACE)) if self.cut_lines else re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))
        units = self.units
        fresh = set(keys).difference(units)
        if len(units) + len(fresh) > self.most_units:
            self.old_units, self.units = units, {}
            units, fresh = self.units, set(keys)
        old = self.old_units
        for k in fresh:
            ids = old.get(k)
            units[k] = self._unit(k if k[:1] in (SPACE, "\n") else SPACE + k) if ids is None else ids
        return list(chain.from_iterable(map(units.__getitem__, keys)))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def encode_decode(df: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) -> doc_id, ids (with the end id) and decoded."""
    return _mapped(df, model, "ids array<int>, decoded string", lambda e, ids, out: (ids, out), [pa.list_(pa.int32()), pa.string()], ["ids", "decoded"])


def digests(df: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens and the digests of ids and decoded text."""
    names: list[str] = []

    def shown(encoder: PrefixEncoder, ids: list[int], out: str):
        if not names:
            names.extend(map(str, range(encoder.size)))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return len(ids), sha(" ".join(map(names.__getitem__, ids))), sha(out)

    return _mapped(df, model, "n_tokens long, ids_sha256 string, decoded_sha256 string", shown, [pa.int64(), pa.string(), pa.string()], ["n_tokens", "ids_sha256", "decoded_sha256"])


def _mapped(df, model, schema, shown, kinds, names):
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or PrefixEncoder(sent.value)
            for at in range(0, b.num_rows, 1000):
                rows = []
                for x in b.column(1).slice(at, 1000):
                    ids = [*encoder.encode(x.as_py() or ""), encoder.end]
                    rows.append(shown(encoder, ids, encoder.decode(ids)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1000), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], ["doc_id", *names])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, {schema}")


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), read_model(public_tokenizers.path("piece_bpe_32k.model")))
