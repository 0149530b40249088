"""Bracket and fill statistics of order levels, and the trade plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.config import COST_BPS, FILL, HOLDER_TARGET_ATR, MIN_SAMPLES, PULLBACK_ATR, SCAN, STOP_ATR, TARGET_ATR
from barline.functions.windows import by_ticker, lead


#: mode: target in average true ranges.
MODES = {"buy": TARGET_ATR, "hold": HOLDER_TARGET_ATR}


def _ahead(ind: DataFrame, scan: int) -> DataFrame:
    """Adds what the next ``scan`` sessions bring: ``ahead`` (high and low of each) and the close at their end."""
    return ind.withColumns({"ahead": F.collect_list(F.struct("high", "low")).over(by_ticker().rowsBetween(1, scan)), "exit": lead("close", scan)})


def _outcome(target_mult: float, stop_mult: float, scan: int) -> Column:
    """Of a row with ``ahead``: outcome, at_stop, at_target, ret and hold as one struct."""
    target, stop = F.col("close") + target_mult * F.col("atr14"), F.col("close") - stop_mult * F.col("atr14")
    first = lambda hit: F.nullif(F.array_position(F.transform("ahead", hit), True), F.lit(0))
    hits = F.struct(first(lambda x: x["low"] <= stop).alias("s"), first(lambda x: x["high"] >= target).alias("t"))
    far = F.lit(scan + 1)

    def graded(x: Column) -> Column:
        s, t = F.coalesce(x["s"], far), F.coalesce(x["t"], far)
        won, lost = t < s, (s <= t) & (s < far)
        ret = F.when(won, target).when(lost, stop).otherwise(F.col("exit")) / F.col("close") - 1
        outcome = F.when(won, 1).when(lost, -1).otherwise(0)
        return F.struct(outcome.alias("outcome"), x["s"].alias("at_stop"), x["t"].alias("at_target"), ret.alias("ret"), (F.col("exit") / F.col("close") - 1).alias("hold"))

    return F.get(F.transform(F.array(hits), graded), F.lit(0))


def _begun(scan: int) -> Column:
    """Starts that count: the last one with all its sessions is left out, as the surveyed definition does."""
    return (F.col("i") < F.col("n") - scan - 1) & (F.col("atr14") > 0)


def outcomes(ind: DataFrame, target_mult: float, stop_mult: float = STOP_ATR, scan: int = SCAN) -> DataFrame:
    """First level touched within ``scan`` sessions of each start: outcome 1, -1 or 0, sessions and returns.

    A session that touches both levels counts as the stop.
    """
    rest = [c for c in ind.columns if c not in ("outcome", "at_stop", "at_target", "ret", "hold")]
    return _ahead(ind, scan).where(_begun(scan)).withColumn("__o", _outcome(target_mult, stop_mult, scan)).select(*rest, "__o.*")


def _pct(c: Column, of: Column) -> Column:
    return F.round(100 * F.try_divide(F.count_if(of & c), F.count_if(of)), 1)


def _bracket(o: Column, of: Column) -> list[Column]:
    """Aggregates over outcome structs ``o`` where ``of`` holds."""
    won, lost = o["outcome"] == 1, o["outcome"] == -1
    mean = lambda k: F.avg(F.when(of, o[k]))
    edge = mean("ret") - mean("hold")
    return [
        F.count_if(of).alias("sample_n"),
        _pct(won, of).alias("target_first_pct"),
        _pct(lost, of).alias("stop_first_pct"),
        _pct(o["outcome"] == 0, of).alias("neither_pct"),
        F.percentile(F.when(of & won, o["at_target"]), 0.5).cast("int").alias("median_sessions_to_target"),
        _pct(won & (o["at_target"] <= 10), of).alias("target_within_10_pct"),
        F.round(100 * mean("ret"), 3).alias("gross_expectancy_pct"),
        F.round(100 * mean("hold"), 3).alias("buy_hold_pct"),
        F.round(100 * edge, 3).alias("level_edge_pct"),
        F.round(100 * (edge - 2 * COST_BPS / 1e4), 3).alias("net_level_edge_pct"),
    ]


def bracket_stats(ind: DataFrame, target_mult: float = TARGET_ATR, stop_mult: float = STOP_ATR) -> DataFrame:
    """Per ticker; tickers with under 60 starts have no row."""
    o = _ahead(ind, SCAN).where(_begun(SCAN)).select("ticker", _outcome(target_mult, stop_mult, SCAN).alias("o"))
    return o.groupBy("ticker").agg(*_bracket(F.col("o"), F.lit(True))).where(F.col("sample_n") >= MIN_SAMPLES)


def _filled(pullback: float) -> Column:
    return F.col("least") <= F.col("close") - pullback * F.col("atr14")


def _least(within: int) -> Column:
    return F.min("low").over(by_ticker().rowsBetween(1, within))


def _fill(of: Column, pullback: float) -> Column:
    return F.when(F.count_if(of) >= MIN_SAMPLES, _pct(_filled(pullback), of)).alias("entry_fill_pct")


def fill_stats(ind: DataFrame, pullback: float = PULLBACK_ATR, within: int = FILL) -> DataFrame:
    """Share of starts whose limit below the close was filled within some sessions; null under 60 starts."""
    return ind.withColumn("least", _least(within)).where(_begun(within)).groupBy("ticker").agg(_fill(F.lit(True), pullback))


def plan_facts(ind: DataFrame, *keep: str) -> DataFrame:
    """One row per ticker: price, atr, entry_fill_pct, bracket statistics of both modes and the last session's ``keep``.

    One pass over the sessions: the window of coming sessions serves both modes and the fills.
    """
    df = _ahead(ind, SCAN).withColumn("least", _least(FILL))
    of = _begun(SCAN)
    df = df.withColumns({f"__{m}": F.when(of, _outcome(k, STOP_ATR, SCAN)) for m, k in MODES.items()})
    last = F.max(F.when(F.col("i") == F.col("n") - 1, F.struct(F.col("close").alias("price"), F.col("atr14").alias("atr"), *keep)))
    names = {}
    for m in MODES:
        names[m] = [c.alias(f"__{m}_{k}") for k, c in enumerate(_bracket(F.col(f"__{m}"), of))]
    labels = ["sample_n", "target_first_pct", "stop_first_pct", "neither_pct", "median_sessions_to_target", "target_within_10_pct", "gross_expectancy_pct", "buy_hold_pct", "level_edge_pct", "net_level_edge_pct"]
    per = df.groupBy("ticker").agg(last.alias("__last"), _fill(_begun(FILL), PULLBACK_ATR), *(c for cs in names.values() for c in cs))
    packed = [F.struct(*(F.col(f"__{m}_{k}").alias(n) for k, n in enumerate(labels)), F.lit(mult).alias("mult")).alias(m) for m, mult in MODES.items()]
    return per.select("ticker", "__last.*", "entry_fill_pct", *packed)


def trade_plan(facts: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per ticker of ``plan_facts`` with p_up: a buy bracket if p_up >= 0.5, else a holder's one.

    Tickers without a positive range or with under 60 starts have no row.
    """
    buys = F.col("p_up") >= 0.5
    j = facts.where("atr > 0").select("ticker", "price", "atr", "entry_fill_pct", F.when(buys, "buy").otherwise("hold").alias("mode"), F.when(buys, F.col("buy")).otherwise(F.col("hold")).alias("x"))
    j = j.select("ticker", "price", "atr", "entry_fill_pct", "mode", "x.*").where(F.col("sample_n") >= MIN_SAMPLES)
    j = j.join(ranges.select("ticker", F.col("high").alias("stretch_target")), "ticker", "left")
    days = F.bround(F.nullif(F.col("median_sessions_to_target"), F.lit(0)) * 7 / 5).cast("int")
    p, a = F.col("price"), F.col("atr")
    return j.select(
        "ticker",
        "mode",
        F.round(p, 2).alias("price"),
        F.round(a, 2).alias("atr"),
        F.round(p - PULLBACK_ATR * a, 2).alias("entry_pullback"),
        "entry_fill_pct",
        F.round(p + F.col("mult") * a, 2).alias("target"),
        F.round(p - STOP_ATR * a, 2).alias("stop"),
        "stretch_target",
        F.round(100 * STOP_ATR * a / p, 2).alias("risk_pct"),
        F.round(100 * F.col("mult") * a / p, 2).alias("reward_pct"),
        (F.col("mult") / STOP_ATR).alias("risk_reward"),
        "median_sessions_to_target",
        days.alias("median_calendar_days"),
        "sample_n",
        "target_first_pct",
        "stop_first_pct",
        "neither_pct",
        "target_within_10_pct",
        "net_level_edge_pct",
    )
