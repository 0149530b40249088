"""Scans: bars, articles, earnings, tone, ledger and events from the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.windows import finite, lag


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(bars: DataFrame) -> DataFrame:
    """Adds i, the session's position within its ticker, and n, the ticker's sessions."""
    w = Window.partitionBy("ticker")
    return bars.withColumn("i", F.row_number().over(w.orderBy("dt")) - 1).withColumn("n", F.count("*").over(w))


def clean_bars(bars: DataFrame) -> DataFrame:
    """Rows with a positive finite close; other NaN and infinite values become null."""
    for c in ("open", "high", "low", "close", "volume"):
        bars = bars.withColumn(c, finite(F.col(c).cast("double")))
    return bars.where("close > 0")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: line items by return flag and day, price = extended price / quantity."""
    li = table(spark, sf_dir, "lineitem")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    px = li.select(F.col("l_returnflag").alias("ticker"), F.col("l_shipdate").cast("date").alias("dt"), F.try_divide("l_extendedprice", "l_quantity").alias("px"), key.alias("k"), "l_quantity")
    day = px.groupBy("ticker", "dt").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume")
    )
    return clean_bars(day)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles from documents; ``published`` is in epoch seconds, null when undated."""
    d = table(spark, sf_dir, "documents")
    category = F.create_map(*(F.lit(x) for p in (("en", "business"), ("fr", "politics"), ("de", "world"), ("es", "company")) for x in p))
    published = F.when(F.col("doc_id") % 17 != 0, F.lit(1704067200) + (F.col("doc_id") * 37) % 720 * 3600)
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.substring("text", 1, 120).alias("title"),
        F.substring("text", 121, 300).alias("summary"),
        "source",
        category[F.col("lang")].alias("category"),
        published.alias("published"),
    )


TICKER_OF_STATUS = {"F": "A", "O": "R", "P": "N"}


def _ticker(c: str):
    return F.create_map(*(F.lit(x) for p in TICKER_OF_STATUS.items() for x in p))[F.col(c)]


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    surprise = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", (F.col("o_totalprice") - 250000) / 10000)
    return o.select("o_orderkey", _ticker("o_orderstatus").alias("ticker"), F.col("o_orderdate").cast("date").alias("event_date"), surprise.alias("surprise_pct"))


def tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tone; days without orders are real gaps.  Summed as decimals, so order does not matter."""
    o = table(spark, sf_dir, "orders")
    value = (F.col("o_totalprice").cast("decimal(18,2)") - 250000) / F.lit(100000)
    grouped = o.groupBy(_ticker("o_orderstatus").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt"))
    return grouped.agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)") - 250000).cast("double") / F.count("*") / 100000).alias("tone"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction ledger over every fifth session, with later duplicates of every 25th."""
    i = F.col("i")
    b = sessions(bars(spark, sf_dir)).where((i % 5 == 0) & (i >= 60))
    p = 0.5 + ((i.cast("long") * 7919) % 41 - 20) / 100
    band = lambda x: F.when(i % 11 != 0, F.col("close") * x)
    base = 0.5 + ((i.cast("long") * 104729) % 21 - 10) / 100
    rows = b.select(
        "ticker",
        F.col("dt").alias("as_of"),
        F.lit(5).alias("horizon_days"),
        p.alias("p_up"),
        base.alias("base"),
        F.when(i % 7 != 0, 0.5 + ((i.cast("long") * 31) % 31 - 15) / 100).alias("p_ml"),
        (((i.cast("long") * 17) % 21 - 10) / 10).alias("tech"),
        (((i.cast("long") * 13) % 21 - 10) / 10).alias("news_company"),
        F.when(i % 3 != 0, ((i.cast("long") * 11) % 21 - 10) / 10).alias("news_market"),
        (((i.cast("long") * 19) % 21 - 10) / 10).alias("news_politics"),
        band(0.9).alias("range_low"),
        band(1.1).alias("range_high"),
        F.when(F.abs(p - 0.5) >= 0.1 - 1e-9, "high").when(F.abs(p - 0.5) >= 0.05 - 1e-9, "medium").otherwise("low").alias("confidence"),
        F.when(p >= 0.5, "up").otherwise("down").alias("direction"),
        F.array(F.lit(1), F.when(i % 25 == 0, F.lit(2))).alias("versions"),
    )
    rows = rows.withColumn("logged_at", F.explode(F.filter("versions", lambda x: x.isNotNull())))
    again = F.col("logged_at") == 2
    return rows.drop("versions").withColumn("p_up", F.when(again, 1 - F.col("p_up")).otherwise(F.col("p_up")))


def weekly_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, wk, close): extended price over quantity by brand and week."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(part, li["l_partkey"] == part["p_partkey"])
    cents = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    wk = F.date_trunc("week", F.col("l_shipdate").cast("date")).cast("date")
    return j.groupBy(F.col("p_brand").alias("name"), wk.alias("wk")).agg((cents / F.sum("l_quantity")).alias("close"))


def last_rows(df: DataFrame, k: int = 1) -> DataFrame:
    """The last ``k`` sessions of each ticker."""
    return df.where(F.col("i") >= F.col("n") - k)


def quote(bars_: DataFrame) -> DataFrame:
    """Last price, change to the close before (itself for a lone row) and date."""
    q = last_rows(sessions(bars_).withColumn("prev", F.coalesce(lag("close"), F.col("close"))))
    change = F.col("close") - F.col("prev")
    return q.select("ticker", F.col("dt").alias("as_of"), F.col("close").alias("price"), F.round(change, 4).alias("change"), F.round(100 * F.try_divide(change, F.col("prev")), 3).alias("change_pct"))


def mini_quote(bars_: DataFrame) -> DataFrame:
    q = quote(bars_)
    pct = F.round(100 * F.try_divide(F.col("raw"), F.col("price") - F.col("raw")), 2)
    return q.withColumn("raw", F.col("change")).select("ticker", F.round("price", 2).alias("price"), pct.alias("change_pct"))


def search(part: DataFrame, text: str, k: int = 8) -> DataFrame:
    """Up to ``k`` instruments whose name holds ``text``; the limit is the feature."""
    hit = F.lower("p_name").contains(text.lower()) & (F.trim("p_name") != "")
    return part.where(hit).orderBy("p_partkey").limit(k).select("p_partkey", F.coalesce("p_name", F.lit("")).alias("name"), F.col("p_brand").alias("exchange"), F.col("p_type").alias("type"))
