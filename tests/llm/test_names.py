"""Extra columns with clashing names: every name that an operator or its query adds or uses inside."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barline.llm import classifier, language, mixing, pieces, pii, quality_rules, registry, simhash, suffix_dedup, token_count, weighted_sampling

SOURCES = Path(quality_rules.__file__).parent.glob("*.py")
#: All words in quotes that could be a column, from the operators' source.
NAMES = sorted({n for f in SOURCES for n in re.findall(r'"(_{0,2}[a-z][a-z0-9_]*)"', f.read_text())} | {"held_out", "predicted", "taken", "component_id", "near_next"})
BASE = ["doc_id", "text", "lang", "source", "n_chars"]
EXTRA = [n for n in NAMES if n not in BASE]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    root = tmp_path_factory.mktemp("clash")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    extra = [F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in EXTRA]
    for name, df in (("plain", docs), ("extra", docs.select(*reversed(extra), *BASE))):
        df.write.parquet(str(root / name / "documents.parquet"))
        spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(str(root / name / "labels.parquet"))
    return str(root / "plain"), str(root / "extra")


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_ignore_extra_columns(spark, tables, name):
    plain, extra = (registry.QUERIES[name](spark, d) for d in tables)
    assert plain.columns == extra.columns and rows(plain) == rows(extra)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_ignore_extra_columns(spark, tables, k):
    plain, extra = (corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{d}/documents.parquet"), d) for d in tables)
    assert plain.columns == extra.columns and rows(plain) == rows(extra)


THROUGH = {
    "pseudonymise": (lambda df: pii.pseudonymise(df, "k"), set()),
    "pseudonymise, counted": (lambda df: pii.pseudonymise(df, "k", count="size"), {"size"}),
    "pseudonymise, key column": (lambda df: pii.pseudonymise(df, F.concat(F.lit("k"), F.lit("")), count="n_new"), {"n_new"}),
    "keep": (quality_rules.keep, set()),
    "assess": (quality_rules.assess, {*quality_rules.BASE, "base_failed", "rejected_by", "kept"}),
    "deduplicate": (simhash.deduplicate, set()),
    "mix": (mixing.mix, {"size", "source_size", "target", "copies"}),
}


@pytest.mark.parametrize("name", THROUGH)
def test_operators_pass_other_columns_through(spark, tables, name):
    """A caller's columns come back unchanged, but for those that the operator says it replaces."""
    operator, made = THROUGH[name]
    plain, extra = (operator(spark.read.parquet(f"{d}/documents.parquet")) for d in tables)
    assert rows(plain.select(*sorted(plain.columns))) == rows(extra.select(*sorted(plain.columns)))
    held = [n for n in EXTRA if n not in made]
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in extra.select("doc_id", *held).collect() for n in held)


def test_salted_mix_and_emit_pass_other_columns_through(spark, tables, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    held = [n for n in EXTRA if n not in ("size", "source_size", "target", "copies")]
    out = mixing.emit(mixing.mix(spark.read.parquet(f"{tables[1]}/documents.parquet")), ["doc_id", *held])
    assert all(r[n] == f"{n}:{r['doc_id']}" for r in out.collect() for n in held)


def test_operators_with_results_of_their_own_ignore_extra_columns(spark, tables):
    import public_tokenizers

    model = pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    vocabulary = token_count.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    operators = [
        lambda df: classifier.score(df, None),
        weighted_sampling.fingerprints,
        lambda df: weighted_sampling.with_next(df, 3),
        lambda df: token_count.count_tokens(df, vocabulary),
        suffix_dedup.remove_repeats,
        lambda df: pieces.digests(df, model),
        simhash.near_duplicates,
        simhash.similar_components,
        lambda df: language.identify(df, {"en": ("the cat",), "fr": ("le chat",)}),
    ]
    for operator in operators:
        plain, extra = (operator(spark.read.parquet(f"{d}/documents.parquet")) for d in tables)
        assert plain.columns == extra.columns and rows(plain) == rows(extra)
