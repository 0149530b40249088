"""Token counts of a byte-level BPE vocabulary by overlap resynchronisation.

Texts beyond ``chunk`` bytes are encoded in overlapping chunks with byte offsets.  Two neighbours
are spliced at a token boundary that both encodings show and that is proven stable: a white-space
byte after a visible ASCII byte.  No pre-token of this vocabulary holds white space after anything
else, so such a place is a boundary of the whole text too, and what stands left or right of it is
encoded alike in either chunk.  If the overlap has no such place it is widened, in the end to the
whole left chunk, which then grows.  Memory is bounded by the chunk but for texts without any
white space, whose chunk has to grow with them.

The vocabulary file (tokenizers JSON) is read once on the driver and sent to the workers (a few
MB).  The workers encode with tiktoken built from the same merges, which is some five times faster;
texts with code points from U+0500 on, where the two libraries' Unicode tables may differ, go
through tokenizers itself, and each worker compares both on its first text.

Defined cases: a null text counts as empty (0 tokens); strings of special tokens inside a text
count as one token each, as is the library's default; repeated rows get equal counts; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm.common import documents

CHUNK = 32_768
OVERLAP = 256
LIMIT = 512
#: Fixed value: the published pre-token pattern of this kind of vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FIRST_UNSURE = re.compile("[Ԁ-\U0010ffff]")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that such files use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class OverlapCounter:
    def __init__(self, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(vocabulary)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError("a byte-level BPE vocabulary without normaliser is needed")
        byte_of = byte_alphabet()
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in special}
        self.library = Tokenizer.from_str(vocabulary)
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.width = np.zeros(max(model["vocab"].values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.width[i] = len(piece)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.chunk, self.overlap, self.checked = chunk, overlap, False

    def plain(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False))

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.checked:
            self.checked = True
            head = text[:2000]
            if not FIRST_UNSURE.search(head) and self.plain(head) != self.count(head):
                raise RuntimeError("the two libraries disagree")
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(self._part(p) for p in parts if p)

    def _ends(self, raw: bytes, start: int, end: int) -> np.ndarray:
        """Byte offsets after each token of ``raw[start:end]``."""
        text = raw[start:end].decode()
        if FIRST_UNSURE.search(text):
            at = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
            return start + np.array([at[e] for _, e in self.library.encode(text, add_special_tokens=False).offsets], np.int64)
        return start + np.cumsum(self.width[self.fast.encode_ordinary(text)])

    def _part(self, text: str) -> int:
        if len(text) <= self.chunk // 4 or len(raw := text.encode()) <= self.chunk:
            return self.plain(text) if FIRST_UNSURE.search(text) else len(self.fast.encode_ordinary(text))

        def whole(i: int) -> int:
            while i < len(raw) and raw[i] & 0xC0 == 0x80:
                i += 1
            return min(i, len(raw))

        total, start, end = 0, 0, whole(self.chunk)
        left = self._ends(raw, start, end)
        while end < len(raw):
            overlap, cut = self.overlap, None
            while cut is None:
                again = max(start, end - overlap)
                while raw[again] & 0xC0 == 0x80:
                    again -= 1
                stop = whole(again + max(self.chunk, 2 * overlap))
                right = self._ends(raw, again, stop)
                both = np.intersect1d(left[(left > again) & (left < end)], right)
                cut = next((int(p) for p in both[::-1] if raw[p] in b" \t\n\r\x0b\x0c" and 0x21 <= raw[p - 1] <= 0x7E), None)
                if cut is None and again <= start:  # nothing proven in all of the left chunk: it takes the right one's place
                    cut = start
                overlap *= 2
            total += int(np.searchsorted(left, cut, side="right")) if cut > start else 0
            left, start, end = right[np.searchsorted(right, cut, side="right") :], cut, stop
        return total + len(left)


def count_tokens(df: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_tokens."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for b in batches:
            counter = counter or OverlapCounter(sent.value, chunk, overlap)
            texts = [x.as_py() or "" for x in b.column(1)]
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n_bytes, pa.array([counter.count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(documents(spark, sf_dir), read_vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
