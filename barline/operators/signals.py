"""Rule signals, their composite, the price blend, confidence and the screener."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.config import CONFIDENCE_HIGH, CONFIDENCE_MEDIUM, PRIOR_WEIGHTS
from barline.functions.windows import clip, lag, logit, ratio, sigmoid
from barline.operators.indicators import base_rate, indicators
from barline.sources.tables import last_rows

RULES = (("Trend", "s_trend", 1.2), ("Momentum (1 month)", "s_momentum", 1.0), ("RSI (14)", "s_rsi", 1.0), ("MACD", "s_macd", 1.0), ("Bollinger bands", "s_bollinger", 0.7), ("Stochastic", "s_stochastic", 0.6), ("Volume", "s_volume", 0.6))


def _side(c: Column, yes: float, no: float) -> Column:
    return F.when(c, yes).otherwise(no)


def signals(ind: DataFrame) -> DataFrame:
    """Adds a score column per rule, null where its inputs are, and tech, their weighted mean.

    Scores are rounded to two places before the mean.
    """
    c = F.col
    df = ind.withColumns({"r21": ratio("close", lag("close", 21)) - 1, "__hist": lag("macd_hist")})
    df = df.withColumn("r21", F.when(c("i") >= 22, c("r21")))
    long_term = F.when(c("sma200").isNull(), 0.0).otherwise(_side(c("sma50") > c("sma200"), 0.5, -0.5))
    rising = F.coalesce(c("macd_hist") > c("__hist"), F.lit(False))
    made = {
        "s_trend": F.when(c("sma50").isNotNull(), _side(c("close") > c("sma50"), 0.5, -0.5) + long_term),
        "s_momentum": clip(c("r21") * 8, -1.0, 1.0),
        "s_rsi": F.when(c("rsi14") <= 30, 0.7).when(c("rsi14") >= 70, -0.7).when(c("rsi14").isNotNull(), (c("rsi14") - 50) / 50 * 0.3),
        "s_macd": F.when(c("macd_hist").isNotNull() & (c("i") >= 1), F.when(c("macd_hist") > 0, _side(rising, 0.6, 0.2)).otherwise(_side(rising, -0.2, -0.6))),
        "s_bollinger": F.when(c("bb_pctb") > 1, -0.5).when(c("bb_pctb") < 0, 0.5).when(c("bb_pctb").isNotNull(), 0.0),
        "s_stochastic": F.when(c("stoch_k") <= 20, 0.5).when(c("stoch_k") >= 80, -0.5).when(c("stoch_k").isNotNull(), 0.0),
        "s_volume": F.when(c("vol_ratio").isNotNull() & c("ret1").isNotNull(), F.when(c("vol_ratio") >= 1.4, _side(c("ret1") > 0, 0.4, -0.4)).otherwise(0.0)),
    }
    made["s_momentum"] = F.when(c("r21").isNotNull(), made["s_momentum"])
    df = df.withColumns({k: F.round(v, 2) for k, v in made.items()})
    total, weight = F.lit(0.0), F.lit(0.0)
    for _, k, w in RULES:
        total += F.coalesce(c(k), F.lit(0.0)) * w
        weight += F.when(c(k).isNotNull(), w).otherwise(0.0)
    return df.withColumn("tech", F.coalesce(clip(F.try_divide(total, weight), -1.0, 1.0), F.lit(0.0))).drop("__hist")


def explained(scored: DataFrame) -> DataFrame:
    """Adds signals: array of (name, score, text, weight), present rules only."""
    c = F.col
    trend = F.concat_ws(
        "; ",
        F.concat(F.lit("price "), _side(c("close") > c("sma50"), "above", "below"), F.lit(" its 50-day average")),
        F.when(c("sma200").isNotNull(), _side(c("sma50") > c("sma200"), "50-day above 200-day (long-term uptrend)", "50-day below 200-day (long-term downtrend)")),
    )
    state = lambda v, lo, hi, names: F.when(v <= lo, names[0]).when(v >= hi, names[1]).otherwise(names[2])
    # The wording has to equal the surveyed one.
    text = {
        "s_trend": trend,
        "s_momentum": F.format_string("%+.1f%% over the last 21 sessions", c("r21") * 100),
        "s_rsi": F.concat(F.format_string("RSI %.0f — ", c("rsi14")), state(c("rsi14"), 30, 70, ("oversold; rebounds often follow", "overbought; pullback risk", "neutral zone"))),
        "s_macd": F.concat(F.lit("histogram "), F.when(c("s_macd") == 0.6, "bullish and strengthening").when(c("s_macd") == 0.2, "bullish but fading").when(c("s_macd") == -0.2, "bearish but improving").otherwise("bearish and weakening")),
        "s_bollinger": F.when(c("s_bollinger") < 0, "closed above the upper band — stretched").when(c("s_bollinger") > 0, "closed below the lower band — stretched down").otherwise(F.format_string("inside the bands (%%B %.2f)", c("bb_pctb"))),
        "s_stochastic": F.concat(F.format_string("%%K %.0f — ", c("stoch_k")), state(c("stoch_k"), 20, 80, ("oversold", "overbought", "neutral"))),
        "s_volume": F.when(c("s_volume") > 0, F.format_string("%.1f× average volume on an up day (accumulation)", c("vol_ratio")))
        .when(c("s_volume") < 0, F.format_string("%.1f× average volume on a down day (distribution)", c("vol_ratio")))
        .otherwise(F.format_string("volume near its recent average (%.1f×)", c("vol_ratio"))),
    }
    parts = [F.when(c(k).isNotNull(), F.struct(F.lit(name).alias("name"), c(k).alias("score"), text[k].alias("text"), F.lit(w).alias("weight"))) for name, k, w in RULES]
    return scored.withColumn("signals", F.filter(F.array(*parts), lambda x: x.isNotNull()))


def blend(base: Column, tech: Column, p_ml: Column | None = None, weights: dict[str, float] = PRIOR_WEIGHTS) -> Column:
    """Drift anchor plus the model's and the rules' tilts, as a probability."""
    x = logit(base)
    if p_ml is not None:
        x += F.coalesce(weights["k_ml"] * (logit(p_ml) - logit(base)), F.lit(0.0))
    return sigmoid(x + weights["tech"] * tech)


def trails(hit: Column, baseline: Column, effective_n: Column) -> Column:
    """Whether the holdout trails always-up by more than one standard error; false without a holdout."""
    return F.coalesce(hit < baseline - F.sqrt(0.25 / effective_n), F.lit(False))


def confidence(p: Column, hit: Column | None = None, baseline: Column | None = None, effective_n: Column | None = None) -> Column:
    """high / medium / low by distance from one half; low if the holdout trails."""
    edge = F.abs(p - 0.5)
    tier = F.when(edge >= CONFIDENCE_HIGH, "high").when(edge >= CONFIDENCE_MEDIUM, "medium").otherwise("low")
    if hit is None:
        return tier
    return F.when(trails(hit, baseline, effective_n), "low").otherwise(tier)


def price_only(bars: DataFrame, h: int = 5) -> DataFrame:
    """Every session with base, tech and p_up by frozen weights, without the fitted model."""
    df = base_rate(signals(indicators(bars)), h).withColumn("base", F.coalesce("base_at", F.lit(0.5)))
    df = df.withColumn("p_up", clip(blend(F.col("base"), F.col("tech")), 0.05, 0.95))
    return df.withColumn("confidence", confidence(F.col("p_up")))


TIER_RANK = {"high": 0, "medium": 1, "low": 2}


def screener(bars: DataFrame, h: int = 5) -> DataFrame:
    """One row per ticker: the last session, ordered by confidence tier, then by distance from one half."""
    df = last_rows(price_only(bars, h))
    rank = F.create_map(*(F.lit(x) for p in TIER_RANK.items() for x in p))[F.col("confidence")]
    out = df.select("ticker", F.col("dt").alias("as_of"), F.col("close").alias("price"), "base", "tech", "p_up", "confidence", F.when(F.col("p_up") >= 0.5, "up").otherwise("down").alias("direction"), rank.alias("tier"))
    return out.orderBy("tier", F.abs(F.col("p_up") - 0.5).desc(), "ticker").drop("tier")
