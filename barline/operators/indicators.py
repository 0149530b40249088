"""Technical indicators over (ticker, dt, open, high, low, close, volume) bars.

Windowed columns are window expressions of one shared window.  The exponential averages are
recursions along a ticker's history; they run once per ticker in a grouped map, in time and memory
linear in one history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from barline.config import FEATURES
from barline.functions.windows import by_ticker, finite, full, lag, ratio

RECURSIVE = ("ema12", "ema26", "macd_line", "macd_signal", "macd_hist", "rsi14", "atr14")


def smooth(x: np.ndarray, alpha: float) -> np.ndarray:
    """Exponential average seeded by the first value; leading NaN stay."""
    out, y = np.full(len(x), np.nan), None
    for k, v in enumerate(x.tolist()):
        if v == v:
            y = v if y is None else (1 - alpha) * y + alpha * v
        if y is not None:
            out[k] = y
    return out


def recursive_columns(df: DataFrame) -> DataFrame:
    """Adds the exponential averages and what is made of them; needs ``__tr`` and ``__delta``."""
    schema = StructType([*df.schema.fields, *(StructField(c, DoubleType()) for c in RECURSIVE)])

    def per_ticker(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("dt")
        close, delta = pdf["close"].to_numpy(float), pdf["__delta"].to_numpy(float)
        fast, slow = smooth(close, 2 / 13), smooth(close, 2 / 27)
        line = fast - slow
        signal = smooth(line, 2 / 10)
        gain, loss = smooth(np.maximum(delta, 0.0), 1 / 14), smooth(np.maximum(-delta, 0.0), 1 / 14)
        with np.errstate(divide="ignore", invalid="ignore"):
            rsi = np.where(loss == 0, np.nan, 100 - 100 / (1 + gain / loss))
        atr = smooth(pdf["__tr"].to_numpy(float), 1 / 14)
        new = pd.DataFrame(dict(zip(RECURSIVE, (fast, slow, line, signal, line - signal, rsi, atr))), index=pdf.index)
        return pd.concat([pdf, new], axis=1)

    out = df.groupBy("ticker").applyInPandas(per_ticker, schema)
    return out.withColumns({c: finite(F.col(c)) for c in RECURSIVE})


def indicators(bars: DataFrame) -> DataFrame:
    """Adds ret1, sma20/50/200, rsi14, macd_*, bb_*, atr14, stoch_k, vol21, vol_ratio, i and n."""
    from barline.sources.tables import sessions

    before = lag("close")
    df = sessions(bars)
    df = df.withColumns(
        {
            "ret1": ratio("close", before) - 1,
            "__delta": F.col("close") - before,
            "__tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)),
            **{f"sma{k}": full(F.avg, "close", k) for k in (20, 50, 200)},
            "__sd": full(F.stddev_samp, "close", 20),
            "__lo": full(F.min, "low", 14),
            "__hi": full(F.max, "high", 14),
            "vol_ratio": ratio(full(F.avg, "volume", 5), full(F.avg, "volume", 21)),
        }
    )
    df = df.withColumns(
        {
            "vol21": full(F.stddev_samp, "ret1", 21),
            "bb_mid": F.col("sma20"),
            "bb_up": F.col("sma20") + 2 * F.col("__sd"),
            "bb_lo": F.col("sma20") - 2 * F.col("__sd"),
            "stoch_k": 100 * ratio(F.col("close") - F.col("__lo"), F.col("__hi") - F.col("__lo")),
        }
    )
    df = df.withColumn("bb_pctb", ratio(F.col("close") - F.col("bb_lo"), F.col("bb_up") - F.col("bb_lo")))
    df = df.withColumn("bb_bw", ratio(F.col("bb_up") - F.col("bb_lo"), F.col("bb_mid")))
    return recursive_columns(df).drop("__delta", "__tr", "__sd", "__lo", "__hi")


def features(ind: DataFrame) -> DataFrame:
    """Adds the fourteen model features as f_<name>; complete says that none is missing."""
    c = F.col("close")
    made = {
        "ret1": F.col("ret1"),
        **{f"ret{k}": ratio(c, lag("close", k)) - 1 for k in (5, 10, 21)},
        "rsi14": F.col("rsi14") / 100,
        "macd_hist_n": ratio("macd_hist", c),
        "dist_sma20": ratio(c, F.col("sma20")) - 1,
        "dist_sma50": ratio(c, F.col("sma50")) - 1,
        "stoch_k": F.col("stoch_k") / 100,
        "atr_n": ratio("atr14", c),
    }
    out = ind.withColumns({f"f_{k}": made.get(k, F.col(k)) for k in FEATURES})
    whole = F.lit(True)
    for k in FEATURES:
        whole &= F.col(f"f_{k}").isNotNull()
    return out.withColumn("complete", whole)


def base_rate(df: DataFrame, h: int, name: str = "base_at") -> DataFrame:
    """Share of resolved h-session outcomes that were up; null before 30 are resolved."""
    up = (F.col("close") > lag("close", h)).cast("int")
    df = df.withColumn("__up", up)
    share = F.avg("__up").over(by_ticker().rowsBetween(-(10**9), 0))
    return df.withColumn(name, F.when(F.col("i") >= h + 29, share)).drop("__up")


def forward(df: DataFrame, h: int) -> DataFrame:
    """Adds fwd_return and outcome_up (a flat close is down) over h sessions; null while unresolved."""
    ahead = F.lead("close", h).over(by_ticker())
    return df.withColumn("fwd_return", ratio(ahead, F.col("close")) - 1).withColumn("outcome_up", ahead > F.col("close"))
