"""The full assessment of all tickers in one DataFrame, and its JSON payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.config import HALF_LIFE_COMPANY, HALF_LIFE_MACRO, HORIZONS, PRIOR_WEIGHTS
from barline.functions.windows import clip, logit, sigmoid
from barline.operators import events, news, planner, signals, volatility
from barline.operators.indicators import base_rate, indicators


def horizon_days(key: str | None) -> int:
    return HORIZONS.get(key or "", 5)


def macro_scores(scored: DataFrame, now: Column) -> DataFrame:
    """One row: market and politics sentiment, global to all tickers."""
    side = F.when(F.col("category") == "business", "market").when(F.col("category").isin("politics", "world"), "politics")
    per = news.aggregate_sentiment(scored.withColumn("side", side).where("side is not null"), now, HALF_LIFE_MACRO, "side")
    pick = lambda k: F.coalesce(F.max(F.when(F.col("side") == k, F.col("score"))), F.lit(0.0))
    return per.agg(pick("market").alias("news_market"), pick("politics").alias("news_politics"))


def assess(bars: DataFrame, scored: DataFrame, company: DataFrame, earnings: DataFrame, now: Column, h: int = 5, model: DataFrame | None = None, weights: dict[str, float] = PRIOR_WEIGHTS) -> DataFrame:
    """One row per ticker: price blend, news and earnings tilts, confidence, range and order plan.

    ``scored`` are macro articles with sentiment, ``company`` those matched to a ticker; ``model``
    is an optional frame of ``model.price_model``.
    """
    ind = base_rate(signals.signals(indicators(bars)), h).withColumn("base", F.coalesce("base_at", F.lit(0.5)))
    kept = ("dt", "base", "tech", "signals")
    df = planner.plan_facts(signals.explained(ind), *kept).withColumnRenamed("dt", "as_of")
    if model is None:
        df = df.withColumns({k: F.lit(None).cast("double") for k in ("p_ml", "hit_rate", "baseline", "effective_n")})
    else:
        df = df.join(model.select("ticker", "p_ml", "hit_rate", "baseline", "effective_n"), "ticker", "left")
    own = news.aggregate_sentiment(company, now, HALF_LIFE_COMPANY, "ticker").select("ticker", F.col("score").alias("news_company"))
    df = df.join(own, "ticker", "left").fillna({"news_company": 0.0}).crossJoin(F.broadcast(macro_scores(scored, now)))
    if h > 5:
        df = df.join(events.pead_tilt(events.recent_earnings(earnings, bars), h).select("ticker", "tilt"), "ticker", "left")
    else:
        df = df.withColumn("tilt", F.lit(0.0))
    x = logit(signals.blend(F.col("base"), F.col("tech"), F.col("p_ml"), weights)) + F.coalesce("tilt", F.lit(0.0))
    for k in ("news_company", "news_market", "news_politics"):
        x += weights[k] * F.col(k)
    df = df.withColumn("p_up", clip(sigmoid(x), 0.05, 0.95))
    df = df.withColumn("confidence", signals.confidence(F.col("p_up"), F.col("hit_rate"), F.col("baseline"), F.col("effective_n")))
    ranges = volatility.expected_range(bars, h)
    plan = planner.trade_plan(df, ranges)
    nested = lambda f, name: f.select("ticker", F.struct(*(c for c in f.columns if c != "ticker")).alias(name))
    facts = ("atr", "entry_fill_pct", *planner.MODES)
    return df.drop(*facts).join(nested(ranges, "expected_range"), "ticker", "left").join(nested(plan, "trade_plan"), "ticker", "left").withColumn("direction", F.when(F.col("p_up") >= 0.5, "up").otherwise("down")).withColumn("horizon_days", F.lit(h))


def payload(assessed: DataFrame) -> DataFrame:
    """(ticker, json)."""
    return assessed.select("ticker", F.to_json(F.struct(*assessed.columns)).alias("json"))


def cards(assessed: DataFrame, quotes: DataFrame) -> DataFrame:
    """One short card per ticker of ``assess``, with the quote's change; plan is null where there is none."""
    c, plan = F.col, F.col("trade_plan")
    taken = {"mode": "mode", "buy_at": "entry_pullback", "sell_at": "target", "stop_at": "stop", "sessions": "median_sessions_to_target", "sell_odds_pct": "target_first_pct"}
    return assessed.join(quotes.select("ticker", "change_pct"), "ticker", "left").select(
        "ticker",
        "price",
        "change_pct",
        "direction",
        F.round("p_up", 3).alias("prob_up"),
        "confidence",
        signals.trails(c("hit_rate"), c("baseline"), c("effective_n")).alias("caveat_flag"),
        F.round("base", 3).alias("drift"),
        F.round("tech", 3).alias("tech_score"),
        c("news_company").alias("news_score"),
        F.when(plan.isNotNull(), F.struct(*(plan[k].alias(name) for name, k in taken.items()))).alias("plan"),
    )


def ledger_rows(assessed: DataFrame, version: str, logged_at: Column) -> DataFrame:
    """The records to log, weekly horizon only."""
    r4, r3 = (lambda c: F.round(c, 4)), (lambda c: F.round(c, 3))
    w = F.create_map(*(F.lit(x) for p in PRIOR_WEIGHTS.items() for x in p))
    return assessed.where("horizon_days = 5").select(
        F.lit(version).alias("model_version"), "ticker", "as_of", "horizon_days", "price", r4("p_up").alias("p_up"), "direction", "confidence", r3("base").alias("base"), "p_ml", r3("tech").alias("tech"),
        "news_company", "news_market", "news_politics", F.col("expected_range.low").alias("range_low"), F.col("expected_range.high").alias("range_high"), w.alias("weights"), logged_at.cast("string").alias("logged_at"),
    )
