"""Corpus pipeline: quality rules, near-dedup, pseudonyms, source mixing, SentencePiece encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame over everything its predecessor kept.  ``run`` writes every stage but the last as Parquet
in the shared folder and hands the reread table on; only the last of them stays there.

1. ``quality_rules``: documents that a rule rejects go.
2. ``near_dedup``: of each group of documents whose sets of five-word shingles are similar (Jaccard
   0.8 or more) the one with the smallest id stays.
3. ``pseudonyms``: personal data in texts gets format-preserving pseudonyms.
4. ``source_mixing``: each document comes as often as its source's repetition rate says.
5. ``encode``: one row per emitted document with token count and digests of ids and decoded text.

Null texts fail the quality rules; the other defined cases are those of the operators.  Stages ignore
columns that ``documents`` hasn't.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barline.llm import mixing, pieces, pii, quality_rules, simhash
from barline.llm.common import documents, durable, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null, empty and blank texts go, repeated rows share a verdict."""
    return quality_rules.keep(docs.select(*COLUMNS))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of near copies; rows of one id are one document, rows without an id all stay."""
    return simhash.deduplicate(docs.select(*COLUMNS))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; null texts stay null, equal values stay equal."""
    return pii.pseudonymise(docs.select(*COLUMNS), pii.DEMO_KEY)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; a null source is one of its own, a null text has size 0."""
    return mixing.emit(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text, a row per emitted document; a null text is empty."""
    import public_tokenizers

    return pieces.digests(docs, pieces.read_model(public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("pseudonyms", pseudonyms),
    ("source_mixing", source_mixing),
    ("encode", encode),
]
#: Fingerprints, keyed permutations and encodings have no SQL form; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *early, (name, stage), (_, last) = STAGES
    with scratch(spark):
        for n, f in early:
            with scratch(spark):
                docs = durable(f(spark, docs, sf_dir), f"pipeline-{n}", keep=True)
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return last(spark, docs, sf_dir)
