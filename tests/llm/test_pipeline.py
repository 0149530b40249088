"""The corpus pipeline against a plain Python version."""

import hashlib

import corpus_pipeline
from barline.llm import mixing, pieces, pii, quality_rules
from tests.llm.test_near_dedup import grams, true_groups
from tests.llm.test_operators import words


def test_pipeline_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    flagged = {r["doc_id"]: r["kept"] for r in quality_rules.query(spark, sf_dir).collect()}
    left = {r["doc_id"]: r for r in docs.collect() if flagged[r["doc_id"]]}
    ids = sorted(left)
    roots = true_groups([grams(left[i]["text"]) for i in ids])
    ids = [i for k, (i, r) in enumerate(zip(ids, roots)) if k == r]
    kept = spark.createDataFrame([left[i] for i in ids], docs.schema)
    texts = {r["doc_id"]: (r["text"], r["source"]) for r in pii.pseudonymise(kept, pii.DEMO_KEY).collect()}
    sizes = spark.createDataFrame([(s, len(words(t))) for t, s in texts.values()], "source string, size long")
    rate = {r["source"]: r["target"] / r["source_size"] for r in mixing.source_plan(sizes).collect()}
    import public_tokenizers

    library = pieces.PrefixEncoder(pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))).library
    want = []
    for i, (t, s) in texts.items():
        u = int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        ids_ = [*library.encode(t), library.eos_id()]
        row = (i, len(ids_), hashlib.sha256(" ".join(map(str, ids_)).encode()).hexdigest(), hashlib.sha256(library.decode(ids_).encode()).hexdigest())
        want += [row] * (int(rate[s]) + (u < rate[s] - int(rate[s])))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(want)


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("size", docs["n_chars"]).withColumn("kept", docs["n_chars"] > 0), sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
