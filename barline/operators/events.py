"""Earnings events: as-of alignment, the post-earnings tilt and its study."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.config import PEAD_CLIP, PEAD_COEF, PEAD_MEAN, PEAD_SESSIONS, PEAD_STD, PEAD_Z_CLIP
from barline.functions.windows import clip
from barline.sources.tables import sessions

COST_BPS = 10.0
DRIFT = 21


def forward_asof(events: DataFrame, bars: DataFrame, *carry: str) -> DataFrame:
    """Adds to each event the first session on or after event_date: its ``carry`` columns.

    Both sides are laid along the ticker's dates and the next session is carried back, so the work
    is one sort per ticker, whatever the number of events.
    """
    cols = [f for f in events.columns if f != "ticker"]
    e = events.select("ticker", F.col("event_date").alias("__d"), F.lit(1).alias("__event"), F.struct(*cols).alias("__e"), F.lit(None).cast(bars.select(F.struct(*carry).alias("x")).schema["x"].dataType).alias("__b"))
    b = bars.select("ticker", F.col("dt").alias("__d"), F.lit(0).alias("__event"), F.lit(None).cast(e.schema["__e"].dataType).alias("__e"), F.struct(*carry).alias("__b"))
    w = Window.partitionBy("ticker").orderBy(F.col("__d").desc(), "__event").rowsBetween(Window.unboundedPreceding, 0)
    out = e.unionByName(b).withColumn("__b", F.last("__b", ignorenulls=True).over(w)).where("__event = 1")
    return out.select("ticker", "__e.*", *(F.col(f"__b.{c}").alias(c) for c in carry))


def next_earnings(events: DataFrame, today: Column) -> DataFrame:
    """The earliest date from today on, else the first one listed."""
    return events.groupBy("ticker").agg(F.coalesce(F.min(F.when(F.col("event_date") >= today, F.col("event_date"))), F.min_by("event_date", "o_orderkey")).alias("next_date"))


def recent_earnings(events: DataFrame, bars: DataFrame, k: int = 8) -> DataFrame:
    """Of the ``k`` latest reports, the one with a surprise that lies fewest sessions back."""
    w = Window.partitionBy("ticker").orderBy(F.col("event_date").desc(), "o_orderkey")
    listed = events.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)
    at = forward_asof(listed.where("surprise_pct is not null"), sessions(bars), "i", "n").where("i is not null")
    at = at.withColumn("sessions_ago", F.col("n") - 1 - F.col("i"))
    best = at.groupBy("ticker").agg(F.min(F.struct("sessions_ago", "pos", "event_date", "surprise_pct")).alias("b"))
    return best.select("ticker", F.col("b.event_date").alias("event_date"), F.round("b.surprise_pct", 2).alias("surprise_pct"), F.col("b.sessions_ago").alias("sessions_ago"))


def pead_tilt(recent: DataFrame, h: int) -> DataFrame:
    """Logit tilt for horizons beyond a week, fading over ten sessions; 0 otherwise."""
    if h <= 5:
        return recent.withColumn("active", F.lit(False)).withColumn("tilt", F.lit(0.0))
    decay = 1 - F.col("sessions_ago") / PEAD_SESSIONS
    z = clip((clip(F.col("surprise_pct"), -PEAD_CLIP, PEAD_CLIP) - PEAD_MEAN) / PEAD_STD, -PEAD_Z_CLIP, PEAD_Z_CLIP)
    return recent.withColumn("active", decay > 0).withColumn("tilt", F.when(decay > 0, PEAD_COEF * z * decay).otherwise(0.0))


def pead_events(events: DataFrame, bars: DataFrame, h: int = DRIFT) -> DataFrame:
    """(ticker, event_date, surprise_pct, reaction, drift): reaction over the two sessions around the
    report, drift over the h sessions after."""
    w = Window.partitionBy("ticker").orderBy("dt")
    b = sessions(bars).withColumns({"pre": F.lag("close").over(w), "entry": F.lead("close").over(w), "exit": F.lead("close", 1 + h).over(w)})
    at = forward_asof(events, b, "i", "n", "pre", "entry", "exit").where((F.col("i") > 1) & (F.col("i") + 1 + h < F.col("n")))
    return at.select("o_orderkey", "ticker", "event_date", "surprise_pct", (F.col("entry") / F.col("pre") - 1).alias("reaction"), (F.col("exit") / F.col("entry") - 1).alias("drift"))


def signed(study: DataFrame, signal: str) -> DataFrame:
    d = study.where(F.col(signal).isNotNull() & F.col("drift").isNotNull() & (F.col(signal) != 0))
    return d.withColumn("signed", F.signum(signal) * F.col("drift"))


def grade(study: DataFrame, signal: str) -> DataFrame:
    """Hit rate, long-short spread gross and net, signed drift and its halves about the median date."""
    d = signed(study, signal).withColumn("day", F.unix_date("event_date"))
    half = d.agg(F.percentile("day", 0.5).alias("half"))
    d = d.crossJoin(F.broadcast(half))
    spread = F.avg(F.when(F.col(signal) > 0, F.col("drift"))) - F.avg(F.when(F.col(signal) < 0, F.col("drift")))
    return d.agg(
        F.count("*").alias("n"),
        F.avg((F.signum(signal) == F.signum("drift")).cast("int")).alias("hit_rate"),
        spread.alias("long_short"),
        (spread - 2 * COST_BPS / 1e4).alias("net"),
        F.avg("signed").alias("mean_signed"),
        F.avg(F.when(F.col("day") < F.col("half"), F.col("signed"))).alias("half1"),
        F.avg(F.when(F.col("day") >= F.col("half"), F.col("signed"))).alias("half2"),
    )
