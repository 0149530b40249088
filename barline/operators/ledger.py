"""The prediction ledger: append with dedup, grading and the track record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.sources.tables import sessions

KEY = ["ticker", "as_of", "horizon_days"]
SCHEMA = (
    "model_version string, ticker string, as_of date, horizon_days int, price double, p_up double, direction string, confidence string, base double, p_ml double, "
    "tech double, news_company double, news_market double, news_politics double, range_low double, range_high double, weights map<string,double>, logged_at string"
)


def first_logged(df: DataFrame) -> DataFrame:
    """One record per (ticker, as_of, horizon): the first logged wins."""
    rest = [c for c in df.columns if c not in [*KEY, "logged_at"]]
    return df.groupBy(*KEY).agg(F.min_by(F.struct("logged_at", *rest), "logged_at").alias("r")).select(*KEY, "r.*")


def new_records(df: DataFrame, existing: DataFrame) -> DataFrame:
    return first_logged(df).join(existing.select(*KEY), KEY, "left_anti")


def append(df: DataFrame, path: str, read_only: bool = False) -> None:
    """Appends what the JSON-lines ledger at ``path`` lacks; a read-only writer does nothing.

    The ledger has a folder per day; only those of the batch's days are read (and lines outside such
    folders).  Two writers at once may both append a record; ``records`` shows the first logged one.
    """
    if not read_only:
        spark = df.sparkSession
        day = F.to_date("as_of")
        # one row per day of the batch, whatever its size
        days = [r[0] for r in df.select(day).distinct().collect()]
        folders = [f"{path}/day={'__HIVE_DEFAULT_PARTITION__' if d is None else d}" for d in days]
        as_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = as_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        old = [x for x in [*folders, f"{path}/*.json"] if fs.globStatus(as_path(x))]
        fresh = new_records(df, read(spark, *old)) if old else first_logged(df)
        fresh.withColumn("day", day).write.mode("append").partitionBy("day").json(path)


def read(spark, *paths: str) -> DataFrame:
    """All lines as logged; corrupt lines are skipped."""
    return spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(list(paths))


def records(spark, path: str) -> DataFrame:
    """One record per key, the first logged one, however many writers there were."""
    return first_logged(read(spark, path))


def resolve(records: DataFrame, bars: DataFrame, horizons=(5, 21)) -> DataFrame:
    """Adds resolved_on, realized_pct, end_price, outcome_up, correct and in_band; null while pending."""
    w = Window.partitionBy("ticker").orderBy("dt")
    ahead = F.array(*(F.struct(F.lit(h).alias("h"), F.lead("dt", h).over(w).alias("d"), F.lead("close", h).over(w).alias("c")) for h in horizons))
    b = sessions(bars).withColumn("ahead", ahead).select("ticker", F.col("dt").alias("as_of"), F.explode("ahead").alias("x"), F.col("close").alias("spot"))
    b = b.select("ticker", "as_of", F.col("x.h").alias("horizon_days"), F.col("x.d").alias("resolved_on"), F.col("x.c").alias("end"), "spot")
    j = records.join(b, KEY, "left")
    realized = F.col("end") / F.col("spot") - 1
    up = realized > 0
    return j.select(
        *records.columns,
        "resolved_on",
        F.round(realized * 100, 2).alias("realized_pct"),
        F.round("end", 4).alias("end_price"),
        up.alias("outcome_up"),
        ((F.col("direction") == "up") == up).alias("correct"),
        (F.col("end") >= F.col("range_low")) .alias("__lo"),
        (F.col("end") <= F.col("range_high")).alias("__hi"),
    ).withColumn("in_band", F.col("__lo") & F.col("__hi")).drop("__lo", "__hi")


def _rate(c):
    return F.avg(F.col(c).cast("int"))


def track_record(graded: DataFrame) -> DataFrame:
    done = F.col("outcome_up").isNotNull()
    y = F.col("outcome_up").cast("int")
    return graded.agg(
        F.count("*").alias("logged"),
        F.count_if(done).alias("resolved"),
        F.count_if(~done).alias("pending"),
        F.min("as_of").alias("since"),
        _rate("correct").alias("hit_rate"),
        _rate("outcome_up").alias("always_up"),
        F.avg(F.pow(F.col("p_up") - y, 2)).alias("brier"),
        F.avg(F.when(F.col("base").isNotNull(), F.pow(F.col("base") - y, 2))).alias("brier_drift"),
    )


def by_confidence(graded: DataFrame) -> DataFrame:
    return graded.where("correct is not null").groupBy("confidence").agg(F.count("*").alias("n"), _rate("correct").alias("hit_rate"))


def range_coverage(graded: DataFrame) -> DataFrame:
    return graded.where("in_band is not null").agg(F.count("*").alias("n"), _rate("in_band").alias("coverage"))


def recent(graded: DataFrame, k: int = 30) -> DataFrame:
    """The ``k`` records resolved last; the limit is the feature."""
    return graded.where("correct is not null").orderBy(F.desc("resolved_on"), "ticker", "as_of").limit(k)
