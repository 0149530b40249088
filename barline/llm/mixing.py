"""Mixing sources to target weights.

Words are summed per source, a capped share-out turns weights into targets and repetition
rates, and each document is emitted ``floor(rate)`` times plus one more time when a hash-seeded
uniform of its id falls below the fraction.  DataFrame functions only.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
that repeat a ``doc_id`` share its draw; a null ``doc_id`` draws as the empty id; an empty table
gives an empty result.  A column of the input named like an output column is replaced, all others
pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.llm.common import documents, durable, fresh, n_words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
#: Sources up to this count are broadcast (a few dozen bytes each); beyond it the join is salted.
BROADCAST_SOURCES = 20_000
SALTS = 64


def source_plan(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, size) rows -> one row per source: source_size, weight, target.

    Capped proportional sharing: with sources ordered by cap / weight, all before the first whose
    cap lies above the level ``(total - caps so far) / weights left`` stop at their cap and the
    rest get ``weight * level``, which is where resharing the excess again and again ends.
    The windows run over the aggregated table of one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    ladder = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", ladder.cast("double")).withColumn("cap", F.col("source_size").cast("double") * max_repeat)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(share))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    open_level = F.when(F.col("cap") / F.col("weight") > F.col("level"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))
    per = per.withColumn("at_level", F.min(open_level).over(everything)["level"])
    target = F.when(F.col("at_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("at_level")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A reproducible number in [0, 1) from 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(df: DataFrame, seed: str = "mix:", weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``df`` (doc_id, text, source, ...) plus size, source_size, target and copies (int)."""
    df = df.drop("size", "source_size", "target", "copies")
    named, salt, salt2 = (fresh(df, n) for n in ("source", "salt", "salt2"))
    sized = df.withColumn("size", n_words_of(F.col("text")))
    plan = durable(source_plan(sized.select("source", "size"), weights, share, max_repeat), "mix-sources")
    plan = plan.select(F.col("source").alias(named), "source_size", "target")
    if plan.count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan[named]), "left")
    else:
        salted = sized.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        plan = plan.withColumn(salt2, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(plan, salted["source"].eqNullSafe(plan[named]) & (F.col(salt) == F.col(salt2)), "left").drop(salt, salt2)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (uniform(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("int")
    return joined.drop(named).withColumn("copies", copies.cast("int"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each document ``copies`` times, with ``columns`` only."""
    n = fresh(mixed, "n")
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias(n)).drop(n)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, ([5.0, 2.0, 1.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
         2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size,
         least(cap, w * (SELECT min_by(level, cap / w) FROM l WHERE cap / w > level)) AS target FROM l
)
SELECT d.doc_id, d.size, t.source_size, t.target,
       d.size * (floor(t.target / t.source_size)::BIGINT
         + CASE WHEN ('0x' || substr(md5('mix:' || d.doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE
                     < t.target / t.source_size - floor(t.target / t.source_size) THEN 1 ELSE 0 END) AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
