"""Cross-sectional signals: ranking per date, long and short legs and spread statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_NAMES, MIN_REBALANCES, COST_BPS = 10, 20, 10.0
#: kind: (sign, recent offset, far offset) in sessions.
KINDS = {"str1w": (-1, 0, 5), "str1m": (-1, 0, 21), "mom12_1": (1, 21, 252)}


def aligned(closes: DataFrame) -> DataFrame:
    """(name, wk, close) -> (name, i, n_dates, lp): i counts the dates that any name has, n_dates is their number."""
    w = Window.orderBy("wk")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dates = closes.select("wk").distinct().withColumns({"i": F.row_number().over(w) - 1, "n_dates": F.count("*").over(every)})
    return closes.where("close > 0").join(dates, "wk").select("name", "i", "n_dates", F.log("close").alias("lp"))


def legs(closes: DataFrame, sign: int, near: int, far: int, hold: int, start: int | None = None) -> DataFrame:
    """(i, name, sig, fwd, leg): leg 1 for the top fifth, -1 for the bottom fifth, at each rebalance.

    Rebalances every ``hold`` dates from ``start`` on, with at least ten names.
    """
    start = far if start is None else start
    w = Window.partitionBy("name").orderBy("i")
    off = lambda k: F.max("lp").over(w.rangeBetween(k, k))
    m = aligned(closes).withColumns({"lp_exit": off(hold), "lp_near": off(-near), "lp_far": off(-far)})
    at = m.where((F.col("i") >= start) & ((F.col("i") - start) % hold == 0) & (F.col("i") < F.col("n_dates") - hold))
    j = at.where("lp_exit is not null and lp_near is not null and lp_far is not null").select("i", "name", (sign * (F.col("lp_near") - F.col("lp_far"))).alias("sig"), (F.col("lp_exit") - F.col("lp")).alias("fwd"))
    w = Window.partitionBy("i")
    j = j.withColumn("names", F.count("*").over(w)).where(F.col("names") >= MIN_NAMES).withColumn("rank", F.row_number().over(w.orderBy("sig", "name")))
    q = F.greatest(F.lit(1), F.floor(F.col("names") / 5))
    leg = F.when(F.col("rank") <= q, -1).when(F.col("rank") > F.col("names") - q, 1).otherwise(0)
    return j.withColumn("leg", leg).select("i", "name", "sig", "fwd", "leg")


def spreads(legs_: DataFrame) -> DataFrame:
    mean = lambda k: F.avg(F.when(F.col("leg") == k, F.col("fwd")))
    return legs_.groupBy("i").agg(mean(1).alias("long_r"), mean(-1).alias("short_r")).withColumn("spread", F.col("long_r") - F.col("short_r"))


def spread_stats(spread: DataFrame, hold: int, per_year: float = 252.0, least: int = MIN_REBALANCES) -> DataFrame:
    """Mean, annualised Sharpe ratio gross and net, hit rate and halves; no row under ``least`` rebalances."""
    cost = 4 * COST_BPS / 1e4
    w = Window.orderBy("i")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = spread.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(every)})
    sd = F.stddev_samp("spread")
    sharpe = lambda mu: F.when(sd > 0, mu / sd * math.sqrt(per_year / hold)).otherwise(0.0)
    half = F.floor(F.col("n") / 2)
    out = d.agg(
        F.count("*").alias("n_rebal"),
        (F.avg("spread") * 100).alias("gross_mean_pct"),
        sharpe(F.avg("spread")).alias("gross_sharpe"),
        ((F.avg("spread") - cost) * 100).alias("net_mean_pct"),
        sharpe(F.avg("spread") - cost).alias("net_sharpe"),
        F.avg((F.col("spread") > 0).cast("int")).alias("hit_rate"),
        (F.avg(F.when(F.col("r") <= half, F.col("spread"))) * 100).alias("half1_pct"),
        (F.avg(F.when(F.col("r") > half, F.col("spread"))) * 100).alias("half2_pct"),
        (F.avg("long_r") * 100).alias("mean_long_pct"),
        (F.avg("short_r") * 100).alias("mean_short_pct"),
    )
    return out.where(F.col("n_rebal") >= least)
