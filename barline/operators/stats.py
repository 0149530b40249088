"""Evaluation statistics: bootstraps, AUC, weight grid and pooled summaries.

Random draws come from md5 of seed and position, so reruns and other engines give equal numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import draw, magnitude, placed, sigmoid

GRID = [round(-0.60 + 0.02 * k, 2) for k in range(61)]
#: Clusters up to this count are broadcast as one row each.
BROADCAST_CLUSTERS = 100_000


def interval(df: DataFrame, value: str) -> DataFrame:
    return df.agg(F.percentile(value, 0.025).alias("lo"), F.percentile(value, 0.975).alias("hi"), F.avg((F.col(value) <= 0).cast("int")).alias("below"), F.avg((F.col(value) >= 0).cast("int")).alias("above"))


#: Places of a series that one task of ``circular_blocks`` sums up.
CHUNK = 1 << 16


def circular_blocks(series: DataFrame, block: int, draws: int, seed: str) -> DataFrame:
    """(key, pos, value) -> (b, key, total): per draw the sum over circular blocks, cut at n values.

    Every place (from 0, by pos, then value) knows its sum over a whole block and over the last, shorter
    one; a draw looks one of them up per block, so it costs n / block rows.  Places come from counts per
    range of pos, sums are made in chunks of places and draws in slices, however long one key's series is.
    """
    kind = dict(series.dtypes)["pos"]
    day = F.unix_date(F.col("pos").cast("date")) if kind in ("date", "timestamp") else F.col("pos").cast("long")
    df = series.withColumn("range", F.floor(day / 4096))
    per = df.groupBy("key", "range").agg(F.count("*").alias("c"))
    w = Window.partitionBy("key").orderBy("range")
    upto = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")
    every = F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    starts = per.select("key", "range", upto.alias("before"), every.alias("n"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("key", "range").orderBy("pos", "value")) - 1
    v = df.join(starts, ["key", "range"]).select("key", "n", "value", at.alias("at"))
    # the series goes on at its start; each chunk sees the block - 1 places after its end
    again = F.when(F.col("at") < block - 1, F.col("at") + F.col("n"))
    v = v.withColumn("at", F.explode(F.array_compact(F.array("at", again))))
    size = max(CHUNK, block)
    home = F.floor(F.col("at") / size)
    v = v.withColumn("chunk", F.explode(F.array_distinct(F.array(home, F.greatest(F.lit(0), F.floor((F.col("at") - (block - 1)) / size))))))
    ahead = F.collect_list("value").over(Window.partitionBy("key", "chunk").orderBy("at").rowsBetween(0, block - 1))
    v = v.withColumn("ahead", ahead).where((F.col("chunk") == home) & (F.col("at") < F.col("n")))
    blocks = F.ceil(F.col("n") / block)
    total = lambda k: F.aggregate(F.slice("ahead", F.lit(1), k.cast("int")), F.lit(0.0), lambda s, x: s + x)
    sums = v.select("key", F.col("at").alias("start"), total(F.least(F.lit(block), F.col("n"))).alias("whole"), total(F.col("n") - (blocks - 1) * block).alias("cut"))
    keys = per.groupBy("key").agg(F.sum("c").alias("n")).withColumn("blocks", blocks)
    # (key, draw, slice of blocks) are dealt evenly before blocks are written out
    rows = keys.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("blocks") - 1) / CHUNK))))
    rows = rows.repartition("key", "b", "part")
    rows = rows.withColumn("blk", F.explode(F.sequence(F.col("part") * CHUNK, F.least(F.col("blocks"), (F.col("part") + 1) * CHUNK) - 1)))
    start = F.pmod(draw(F.lit(seed), F.col("key"), F.col("b"), F.col("blk")), F.col("n"))
    met = rows.select("key", "b", start.alias("start"), (F.col("blk") == F.col("blocks") - 1).alias("ends")).join(sums, ["key", "start"])
    return met.groupBy("b", "key").agg(F.sum(F.when(F.col("ends"), F.col("cut")).otherwise(F.col("whole"))).alias("total"))


def edge_bootstrap(graded: DataFrame, block: int, draws: int = 3000, seed: str = "edge") -> DataFrame:
    """Edge over always-up with its block-bootstrap interval and two-sided p."""
    d = graded.where("correct is not null").select(F.col("ticker").alias("key"), F.col("as_of").alias("pos"), (F.col("correct").cast("int") - F.col("outcome_up").cast("int")).cast("double").alias("value"))
    obs = d.agg(F.avg("value").alias("edge"), F.count("*").alias("n"))
    edges = circular_blocks(d, block, draws, seed).groupBy("b").agg(F.sum("total").alias("t")).crossJoin(F.broadcast(obs))
    ci = interval(edges.select((F.col("t") / F.col("n")).alias("e")), "e")
    return obs.crossJoin(F.broadcast(ci)).select("edge", "lo", "hi", F.least(F.lit(1.0), 2 * F.least("below", "above")).alias("p"))


def series_bootstrap(series: DataFrame, block: int = 1, draws: int = 5000, seed: str = "series") -> DataFrame:
    """Interval of a mean of (pos, value) rows."""
    d = series.select(F.lit("all").alias("key"), "pos", "value")
    n = d.agg(F.count("*").alias("n"))
    means = circular_blocks(d, block, draws, seed).crossJoin(F.broadcast(n)).select((F.col("total") / F.col("n")).alias("m"))
    return interval(means, "m").select("lo", "hi")


def cluster_bootstrap(partials: DataFrame, draws: int, seed: str, value: Column) -> DataFrame:
    """(key, n, s, ...) partial sums per cluster -> interval of ``value`` over resampled clusters.

    Only partial sums are resampled, never rows.
    """
    sums = [c for c in partials.columns if c != "key"]
    ranked = partials.withColumn("at", F.row_number().over(Window.orderBy("key")) - 1)
    k = ranked.agg(F.count("*").alias("k"))
    picks = partials.sparkSession.range(draws).withColumnRenamed("id", "b").crossJoin(F.broadcast(k))
    picks = picks.withColumn("slot", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    picks = picks.withColumn("at", F.pmod(draw(F.lit(seed), F.col("b"), F.col("slot")), F.col("k")).cast("int"))
    if partials.count() <= BROADCAST_CLUSTERS:
        ranked = F.broadcast(ranked)
    drawn = picks.join(ranked, "at").groupBy("b").agg(*(F.sum(c).alias(c) for c in sums))
    return interval(drawn.select(value.alias("x")), "x").select("lo", "hi")


def auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Rank AUC with mid-ranks, from counts per distinct score; null if a class is empty."""
    per = df.where(F.col(score).isNotNull() & F.col(y).isNotNull()).groupBy(score).agg(F.sum(F.col(y).cast("int")).alias("p"), F.count("*").alias("c"))
    # scores may be as many as rows: ranks count whole buckets of scores first, then within one
    per = per.withColumn("__bucket", magnitude(F.col(score).cast("double")))
    earlier = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = per.groupBy("__bucket").agg(F.sum(F.col("c") - F.col("p")).alias("__q"))
    per = per.join(buckets.select("__bucket", earlier(Window.orderBy("__bucket"), "__q").alias("__before")), "__bucket")
    below = F.col("__before") + earlier(Window.partitionBy("__bucket").orderBy(score), F.col("c") - F.col("p"))
    per = per.withColumn("q", F.col("c") - F.col("p")).withColumn("u", F.col("p") * (below + F.col("q") / 2))
    return per.agg(F.sum("c").alias("n"), F.try_divide(F.sum("u"), F.sum("p").cast("double") * F.sum("q")).alias("auc"))


def brier_grid(rows: DataFrame) -> DataFrame:
    """(logit_price, news, outcome_up) -> Brier score per news weight of the grid."""
    p = sigmoid(F.col("logit_price") + F.col("w") * F.col("news"))
    y = F.col("outcome_up").cast("int")
    return rows.withColumn("w", F.explode(F.array(*map(F.lit, GRID)))).groupBy("w").agg(F.avg(F.pow(p - y, 2)).alias("brier"))


def best_weight(grid: DataFrame) -> DataFrame:
    return grid.agg(F.min(F.struct("brier", "w")).alias("x")).select("x.w", "x.brier")


def delta_brier_partials(rows: DataFrame, w: float) -> DataFrame:
    y = F.col("outcome_up").cast("int")
    gap = F.pow(sigmoid(F.col("logit_price") + w * F.col("news")) - y, 2) - F.pow(sigmoid(F.col("logit_price")) - y, 2)
    return rows.groupBy(F.col("ticker").alias("key")).agg(F.count("*").alias("n"), F.sum(gap).alias("s"))


def news_evaluation(rows: DataFrame, w: float) -> DataFrame:
    y = F.col("outcome_up").cast("int")
    p0, p1 = sigmoid(F.col("logit_price")), sigmoid(F.col("logit_price") + w * F.col("news"))
    hit = lambda p: F.avg(((p >= 0.5) == F.col("outcome_up")).cast("int"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.pow(p0 - y, 2)).alias("brier_price"), F.avg(F.pow(p1 - y, 2)).alias("brier_news"), hit(p0).alias("acc_price"), hit(p1).alias("acc_news"), F.avg(y).alias("always_up"))


def pooled_summary(graded: DataFrame, *keys: str) -> DataFrame:
    d = graded.where("correct is not null")
    up, sure = F.col("p_up") >= 0.5, F.abs(F.col("p_up") - 0.5) >= 0.10 - 1e-9
    rate = lambda c, when=None: F.avg(F.when(when, F.col(c).cast("int")) if when is not None else F.col(c).cast("int"))
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate("correct").alias("accuracy"),
        rate("outcome_up").alias("always_up"),
        F.avg(F.when(up, F.col("realized_pct"))).alias("ret_up"),
        F.avg(F.when(~up, F.col("realized_pct"))).alias("ret_down"),
        F.count_if(sure).alias("sure_n"),
        rate("correct", sure).alias("sure_accuracy"),
        rate("outcome_up", sure).alias("sure_always_up"),
        F.min("as_of").alias("first"),
        F.max("as_of").alias("last"),
    )


def shuffled_control(graded: DataFrame, seed: str = "shuffle") -> DataFrame:
    """Accuracy against hash-permuted outcomes and what is expected of it.

    Rows in order of ticker and day pair up with the rows of equal place in md5 order.
    """
    d = graded.where("correct is not null").select("ticker", "as_of", (F.col("p_up") >= 0.5).alias("up"), "outcome_up")
    key = F.md5(F.concat_ws(":", F.lit(seed), "ticker", F.col("as_of").cast("string")).cast("binary"))
    left = placed(d, "r", F.col("ticker"), "as_of").select("r", "up")
    right = placed(d.withColumn("key", key), "r", F.substring("key", 1, 3), "key").select("r", F.col("outcome_up").alias("other"))
    p, u = F.avg(F.col("up").cast("int")), F.avg(F.col("other").cast("int"))
    out = left.join(right, "r").agg(F.avg((F.col("up") == F.col("other")).cast("int")).alias("accuracy"), (p * u + (1 - p) * (1 - u)).alias("expected"))
    return out.withColumn("ok", F.abs(F.col("accuracy") - F.col("expected")) < 0.03)
