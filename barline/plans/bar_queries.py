"""Queries over bars: quotes, indicators, signals, volatility and order levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.config import FEATURES
from barline.operators import indicators as ind
from barline.operators import planner, signals, volatility
from barline.plans import sql
from barline.sources import tables as src

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = text
        return f

    return add


def shown(df: DataFrame, **places: int) -> DataFrame:
    """ticker, dt and the named columns rounded, for comparison across engines."""
    return df.select("ticker", "dt", *(F.round(F.col(c), k).alias(c) for c, k in places.items()))


def rounded(**places: int) -> str:
    return ", ".join(f"round({c}, {k}) AS {c}" for c, k in places.items())


def indicator_query(name: str, **places: int) -> None:
    query(name, sql.select(sql.IND, f"SELECT ticker, dt, {rounded(**places)} FROM ind"))(lambda s, d: shown(ind.indicators(src.bars(s, d)), **places))


query("bars_daily", sql.select(sql.BARS, 'SELECT ticker, dt, open, high, low, "close", volume FROM bars'))(lambda s, d: src.bars(s, d))

query(
    "long_bars",
    sql.select(sql.BARS, 'SELECT ticker, dt, "close" FROM ix WHERE n >= 400'),
)(lambda s, d: src.sessions(src.bars(s, d)).where("n >= 400").select("ticker", "dt", "close"))

_Q = 'q AS (SELECT *, coalesce(lag("close") OVER (PARTITION BY ticker ORDER BY dt), "close") AS prev FROM ix)'
query(
    "quote_last",
    sql.select(f"{sql.BARS}, {_Q}", 'SELECT ticker, dt AS as_of, "close" AS price, round("close" - prev, 4) AS change, round(100 * (("close" - prev) / prev), 3) AS change_pct FROM q WHERE i = n - 1'),
)(lambda s, d: src.quote(src.bars(s, d)))
query(
    "mini_quote",
    sql.select(f"{sql.BARS}, {_Q}", 'SELECT ticker, round("close", 2) AS price, round(100 * (round("close" - prev, 4) / ("close" - round("close" - prev, 4))), 2) AS change_pct FROM q WHERE i = n - 1'),
)(lambda s, d: src.mini_quote(src.bars(s, d)))
query(
    "symbol_search",
    "SELECT p_partkey, coalesce(p_name, '') AS name, p_brand AS exchange, p_type AS type FROM part WHERE contains(lower(p_name), 'bolt') AND trim(p_name) <> '' ORDER BY p_partkey LIMIT 8",
)(lambda s, d: src.search(src.table(s, d, "part"), "Bolt"))
query(
    "instrument_dimension",
    "SELECT c_custkey, c_name, coalesce(n_name, '') AS country, coalesce(r_name, '') AS zone FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)(
    lambda s, d: src.table(s, d, "customer")
    .join(src.table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    .join(src.table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    .select("c_custkey", "c_name", F.coalesce("n_name", F.lit("")).alias("country"), F.coalesce("r_name", F.lit("")).alias("zone"))
)
_TAIL = {"sma20": 4, "sma50": 4, "rsi14": 4, "bb_up": 4, "bb_lo": 4, "macd_hist": 4}
query("history_tail", sql.select(sql.IND, f'SELECT ticker, dt, "close", {rounded(**_TAIL)} FROM ind WHERE i >= n - 260'))(
    lambda s, d: src.last_rows(ind.indicators(src.bars(s, d)), 260).select("ticker", "dt", "close", *(F.round(c, k).alias(c) for c, k in _TAIL.items()))
)

indicator_query("sma", sma20=4, sma50=4, sma200=4)
indicator_query("ema", ema12=6, ema26=6)
indicator_query("macd", macd_line=6, macd_signal=6, macd_hist=6)
indicator_query("rsi", rsi14=6)
indicator_query("bollinger", bb_mid=4, bb_up=4, bb_lo=4, bb_pctb=6, bb_bw=6)
indicator_query("atr", atr14=6)
indicator_query("stochastic", stoch_k=6)
indicator_query("vol21_volratio", vol21=8, vol_ratio=8)
_W = "OVER (PARTITION BY ticker ORDER BY dt)"
query(
    "ret_k",
    sql.select(sql.BARS, f'SELECT ticker, dt, {", ".join(f"""round("close" / lag("close", {k}) {_W} - 1, 9) AS ret{k}""" for k in (1, 5, 10, 21))} FROM ix'),
)(lambda s, d: (lambda f: f.select("ticker", "dt", *(F.round(F.try_divide("close", F.lag("close", k).over(ind.by_ticker())) - 1, 9).alias(f"ret{k}") for k in (1, 5, 10, 21))))(src.sessions(src.bars(s, d))))
query("feature_frame", sql.select(sql.FEAT, f"SELECT ticker, dt, {', '.join(f'round(f_{k}, 6) AS {k}' for k in FEATURES)} FROM fc"))(
    lambda s, d: ind.features(ind.indicators(src.bars(s, d))).select("ticker", "dt", *(F.round(f"f_{k}", 6).alias(k) for k in FEATURES))
)
query("complete_rows", sql.select(sql.FEAT, f"SELECT ticker, dt FROM (SELECT *, lead(\"close\", 5) {_W} AS ahead FROM fc) WHERE complete AND ahead IS NOT NULL"))(
    lambda s, d: ind.forward(ind.features(ind.indicators(src.bars(s, d))), 5).where("complete and outcome_up is not null").select("ticker", "dt")
)
for _h in (5, 21):
    query(f"base_rate_{_h}", sql.select(sql.BARS + sql.base("ix", _h), "SELECT ticker, dt, round(base_at, 9) AS base_at FROM based"))(
        lambda s, d, h=_h: shown(ind.base_rate(src.sessions(src.bars(s, d)), h), base_at=9)
    )
query(
    "forward_labels",
    sql.select(sql.BARS, f'SELECT ticker, dt, round(lead("close", 5) {_W} / "close" - 1, 9) AS fwd_return, lead("close", 5) {_W} > "close" AS outcome_up FROM ix'),
)(lambda s, d: ind.forward(src.bars(s, d), 5).select("ticker", "dt", F.round("fwd_return", 9).alias("fwd_return"), "outcome_up"))

_S = {k: 2 for _, k, _w in signals.RULES}
query("tech_signals", sql.select(sql.SIG, f"SELECT ticker, dt, {rounded(**_S)} FROM rated"))(lambda s, d: shown(signals.price_only(src.bars(s, d)), **_S))
query("tech_composite", sql.select(sql.SIG, "SELECT ticker, dt, round(tech, 6) AS tech FROM rated"))(lambda s, d: shown(signals.price_only(src.bars(s, d)), tech=6))
query(
    "signal_texts",
    sql.select(
        sql.SIG,
        """, long AS (
  SELECT ticker, 'Trend' AS name, s_trend AS score, 1.2::DOUBLE AS weight, 'price ' || CASE WHEN "close" > sma50 THEN 'above' ELSE 'below' END || ' its 50-day average'
    || CASE WHEN sma200 IS NULL THEN '' WHEN sma50 > sma200 THEN '; 50-day above 200-day (long-term uptrend)' ELSE '; 50-day below 200-day (long-term downtrend)' END AS text FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'Momentum (1 month)', s_momentum, 1.0, printf('%+.1f%% over the last 21 sessions', r21 * 100) FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'RSI (14)', s_rsi, 1.0, printf('RSI %.0f — ', rsi14) || CASE WHEN rsi14 <= 30 THEN 'oversold; rebounds often follow' WHEN rsi14 >= 70 THEN 'overbought; pullback risk' ELSE 'neutral zone' END FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'MACD', s_macd, 1.0, 'histogram ' || CASE s_macd WHEN 0.6 THEN 'bullish and strengthening' WHEN 0.2 THEN 'bullish but fading' WHEN -0.2 THEN 'bearish but improving' ELSE 'bearish and weakening' END FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'Bollinger bands', s_bollinger, 0.7, CASE WHEN s_bollinger < 0 THEN 'closed above the upper band — stretched' WHEN s_bollinger > 0 THEN 'closed below the lower band — stretched down' ELSE printf('inside the bands (%%B %.2f)', bb_pctb) END FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'Stochastic', s_stochastic, 0.6, printf('%%K %.0f — ', stoch_k) || CASE WHEN stoch_k <= 20 THEN 'oversold' WHEN stoch_k >= 80 THEN 'overbought' ELSE 'neutral' END FROM rated WHERE i = n - 1
  UNION ALL SELECT ticker, 'Volume', s_volume, 0.6, CASE WHEN s_volume > 0 THEN printf('%.1f× average volume on an up day (accumulation)', vol_ratio) WHEN s_volume < 0 THEN printf('%.1f× average volume on a down day (distribution)', vol_ratio) ELSE printf('volume near its recent average (%.1f×)', vol_ratio) END FROM rated WHERE i = n - 1
) SELECT * FROM long WHERE score IS NOT NULL""",
    ),
)(lambda s, d: signals.explained(src.last_rows(signals.price_only(src.bars(s, d)))).select("ticker", F.inline("signals")))
query("blend_price_priors", sql.select(sql.SIG, "SELECT ticker, dt, round(p_up, 6) AS p_up FROM rated"))(lambda s, d: shown(signals.price_only(src.bars(s, d)), p_up=6))
query("confidence_tier", sql.select(sql.SIG, "SELECT ticker, confidence, count(*) AS n FROM rated GROUP BY ALL"))(
    lambda s, d: signals.price_only(src.bars(s, d)).groupBy("ticker", "confidence").agg(F.count("*").alias("n"))
)
query(
    "screener",
    sql.select(sql.SIG, "SELECT ticker, dt AS as_of, \"close\" AS price, round(base, 6) AS base, round(tech, 6) AS tech, round(p_up, 6) AS p_up, confidence, CASE WHEN p_up >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM rated WHERE i = n - 1"),
)(lambda s, d: signals.screener(src.bars(s, d)).withColumns({c: F.round(c, 6) for c in ("base", "tech", "p_up")}))

_VOL = (
    sql.BARS
    + f""", lr AS (SELECT *, ln("close" / lag("close") {_W}) AS r FROM ix),
vs AS (SELECT ticker, max_by("close", i) AS spot, var_samp(r) FILTER (i <= 21) AS var0, max(n) AS n FROM lr GROUP BY ticker),
rv AS (SELECT ticker, 21::BIGINT AS i, var0 AS v FROM vs UNION ALL SELECT rv.ticker, lr.i, 0.97::DOUBLE * v + (1 - 0.97::DOUBLE) * r * r FROM rv JOIN lr ON lr.ticker = rv.ticker AND lr.i = rv.i + 1),
sg AS (SELECT vs.ticker, spot, sqrt(v) AS s FROM vs JOIN rv ON rv.ticker = vs.ticker AND rv.i = vs.n - 1)"""
)
query("ewma_vol", sql.select(_VOL, "SELECT ticker, spot, round(s, 8) AS sigma_d FROM sg"))(lambda s, d: volatility.ewma_vol(src.bars(s, d)).withColumn("sigma_d", F.round("sigma_d", 8)))


def _range_sql(h: int) -> str:
    lo, hi = volatility.quantiles_for(h)
    e = f"SELECT ticker, spot, s, spot * exp({lo!r}::DOUBLE * (s * sqrt({h}))) AS lo, spot * exp({hi!r}::DOUBLE * (s * sqrt({h}))) AS hi FROM sg"
    return sql.select(_VOL + f", e AS ({e})", "SELECT ticker, round(lo, 2) AS low, round(hi, 2) AS high, round((hi - lo) / 2 / spot * 100, 2) AS pct, round(s * sqrt(252) * 100, 1) AS sigma_annual_pct FROM e")


for _h in (5, 13, 21):
    query(f"expected_range_{_h}", _range_sql(_h))(lambda s, d, h=_h: volatility.expected_range(src.bars(s, d), h))


def _outcome_sql(mult: float, source: str = "ind", tag: str = "") -> str:
    j = " ".join(f"WHEN l{k} <= stop THEN {-k} WHEN h{k} >= target THEN {k}" for k in range(1, 21))
    leads = ", ".join(f"lead(low, {k}) {_W} AS l{k}, lead(high, {k}) {_W} AS h{k}" for k in range(1, 21))
    return f""", la{tag} AS (SELECT *, "close" + {mult}::DOUBLE * atr14 AS target, "close" - 1.0::DOUBLE * atr14 AS stop, lead("close", 20) {_W} AS xit, {leads} FROM {source}),
oc{tag} AS (SELECT *, CASE {j} ELSE 0 END AS o FROM la{tag} WHERE i < n - 21 AND atr14 > 0),
rt{tag} AS (SELECT *, CASE WHEN o > 0 THEN target WHEN o < 0 THEN stop ELSE xit END / "close" - 1 AS ret, xit / "close" - 1 AS hold FROM oc{tag}),
bs{tag} AS (SELECT ticker, count(*) AS sample_n, round(100 * (count_if(o > 0) / count(*)), 1) AS target_first_pct, round(100 * (count_if(o < 0) / count(*)), 1) AS stop_first_pct,
  round(100 * (count_if(o = 0) / count(*)), 1) AS neither_pct, CAST(trunc(quantile_cont(o::DOUBLE, 0.5) FILTER (o > 0)) AS INT) AS median_sessions_to_target,
  round(100 * (count_if(o BETWEEN 1 AND 10) / count(*)), 1) AS target_within_10_pct, round(100 * avg(ret), 3) AS gross_expectancy_pct, round(100 * avg(hold), 3) AS buy_hold_pct,
  round(100 * (avg(ret) - avg(hold)), 3) AS level_edge_pct, round(100 * (avg(ret) - avg(hold) - 2 * 5.0::DOUBLE / 1e4), 3) AS net_level_edge_pct FROM rt{tag} GROUP BY ticker HAVING count(*) >= 60)"""


_FILL = f""", fl AS (SELECT *, min(low) OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS least FROM ind),
fs AS (SELECT ticker, CASE WHEN count(*) >= 60 THEN round(100 * (count_if(least <= "close" - 0.6::DOUBLE * atr14) / count(*)), 1) END AS entry_fill_pct FROM fl WHERE i < n - 6 AND atr14 > 0 GROUP BY ticker)"""
query("bracket_stats", sql.select(sql.IND + _outcome_sql(1.5), "SELECT * FROM bs"))(lambda s, d: planner.bracket_stats(ind.indicators(src.bars(s, d))))
query("fill_stats", sql.select(sql.IND + _FILL, "SELECT * FROM fs"))(lambda s, d: planner.fill_stats(ind.indicators(src.bars(s, d))))
query(
    "trade_plan",
    sql.select(
        sql.SIG + _outcome_sql(1.5, tag="b") + _outcome_sql(1.0, tag="h") + _FILL + ", " + _VOL.removeprefix(sql.BARS).lstrip(", \n"),
        """, now AS (SELECT ticker, "close" AS price, atr14 AS atr, CASE WHEN p_up >= 0.5 THEN 'buy' ELSE 'hold' END AS mode FROM rated WHERE i = n - 1 AND atr14 > 0),
st AS (SELECT *, 'buy' AS mode, 1.5::DOUBLE AS mult FROM bsb UNION ALL SELECT *, 'hold', 1.0 FROM bsh)
SELECT ticker, mode, round(price, 2) AS price, round(atr, 2) AS atr, round(price - 0.6::DOUBLE * atr, 2) AS entry_pullback, entry_fill_pct, round(price + mult * atr, 2) AS target,
  round(price - 1.0::DOUBLE * atr, 2) AS stop, round(spot * exp(1.2937::DOUBLE * (s * sqrt(5))), 2) AS stretch_target, round(100 * 1.0::DOUBLE * atr / price, 2) AS risk_pct,
  round(100 * mult * atr / price, 2) AS reward_pct, mult / 1.0 AS risk_reward, median_sessions_to_target,
  CAST(round_even(nullif(median_sessions_to_target, 0) * 7 / 5, 0) AS INT) AS median_calendar_days,
  sample_n, target_first_pct, stop_first_pct, neither_pct, target_within_10_pct, net_level_edge_pct
FROM now JOIN st USING (ticker, mode) LEFT JOIN fs USING (ticker) LEFT JOIN sg USING (ticker)""",
    ),
)(lambda s, d: (lambda b: planner.trade_plan(planner.plan_facts(signals.price_only(b), "p_up"), volatility.expected_range(b, 5)))(src.bars(s, d)))

# The volatility study.
_STUDY = (
    _VOL.split(",\nvs AS")[0]
    + f""",
sf AS (SELECT *, ln(lead("close", 5) {_W} / "close") AS fwd,
  CASE WHEN count(r) OVER wl = 21 THEN stddev_samp(r) OVER wl END AS s21 FROM lr WINDOW wl AS (PARTITION BY ticker ORDER BY dt ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
sd0 AS (SELECT ticker, 20::BIGINT AS i, var_samp(r) FILTER (i BETWEEN 1 AND 20) AS v FROM lr GROUP BY ticker),
sv AS (SELECT * FROM sd0 UNION ALL SELECT sv.ticker, b.i, 0.97::DOUBLE * v + (1 - 0.97::DOUBLE) * a.r * a.r FROM sv JOIN lr a ON a.ticker = sv.ticker AND a.i = sv.i JOIN lr b ON b.ticker = sv.ticker AND b.i = sv.i + 1),
rows_r AS (SELECT 'rolling21' AS method, ticker, i, s21 * sqrt(5) AS sig, fwd FROM sf),
rows_e AS (SELECT 'ewma97' AS method, sf.ticker, sf.i, sqrt(v) * sqrt(5) AS sig, fwd FROM sf JOIN sv ON sv.ticker = sf.ticker AND sv.i = sf.i AND sv.i > 20),
st AS (SELECT *, fwd / sig AS z FROM (SELECT * FROM rows_r UNION ALL SELECT * FROM rows_e) WHERE i >= 60 AND sig > 0 AND fwd IS NOT NULL)"""
)


def _study(s, d) -> DataFrame:
    b = src.bars(s, d)
    parts = [volatility.study_rows(b, m).withColumn("method", F.lit(m)) for m in ("rolling21", "ewma97")]
    return parts[0].unionByName(parts[1])


#: Even tickers by ordinal tune, odd ones validate.
_PARTS = ", od AS (SELECT ticker, (row_number() OVER (ORDER BY ticker) - 1) % 2 = 0 AS tunes FROM (SELECT DISTINCT ticker FROM ix)), tune AS (SELECT st.* FROM st JOIN od USING (ticker) WHERE tunes), valid AS (SELECT st.* FROM st JOIN od USING (ticker) WHERE NOT tunes)"
query("vol_study_quantiles", sql.select(_STUDY + _PARTS, "SELECT method, count(*) AS n, round(quantile_cont(z, 0.1), 6) AS qlo, round(quantile_cont(z, 0.9), 6) AS qhi FROM tune GROUP BY method"))(
    lambda s, d: (lambda r: volatility.fit_quantiles(r, "method").join(r.groupBy("method").agg(F.count("*").alias("n")), "method").select("method", "n", F.round("qlo", 6).alias("qlo"), F.round("qhi", 6).alias("qhi")))(
        volatility.by_parity(_study(s, d), src.bars(s, d)).where("tunes")
    )
)


def _vol_regimes(s, d):
    g = volatility.validated(volatility.by_parity(_study(s, d), src.bars(s, d)), "method")
    return g.groupBy("method", "regime").agg(F.count("*").alias("n"), F.round(F.avg("inside"), 6).alias("coverage"), F.round(F.avg("width"), 4).alias("width"))


query(
    "vol_study_regimes",
    sql.select(
        _STUDY + _PARTS,
        """, q AS (SELECT method, quantile_cont(z, 0.1) AS qlo, quantile_cont(z, 0.9) AS qhi FROM tune GROUP BY method),
e AS (SELECT method, quantile_cont(sig, 1.0::DOUBLE / 3) AS e1, quantile_cont(sig, 2.0::DOUBLE / 3) AS e2 FROM valid GROUP BY method),
g AS (SELECT valid.method, (sig >= e1)::INT + (sig >= e2)::INT AS regime, (fwd BETWEEN qlo * sig AND qhi * sig)::INT::DOUBLE AS inside, ((exp(qhi * sig) - 1) - (exp(qlo * sig) - 1)) * 100 AS width
  FROM valid JOIN q USING (method) JOIN e USING (method))
SELECT method, regime, count(*) AS n, round(avg(inside), 6) AS coverage, round(avg(width), 4) AS width FROM g GROUP BY ALL""",
    ),
)(_vol_regimes)
query(
    "vol_loo",
    sql.select(
        _STUDY,
        """, s1 AS (SELECT * FROM st WHERE method = 'ewma97'), held AS (SELECT DISTINCT ticker AS held FROM s1),
q AS (SELECT held, quantile_cont(z, 0.1) AS qlo, quantile_cont(z, 0.9) AS qhi FROM s1 JOIN held ON s1.ticker <> held.held GROUP BY held)
SELECT ticker, round(avg((fwd BETWEEN qlo * sig AND qhi * sig)::INT), 6) AS coverage FROM s1 JOIN q ON q.held = s1.ticker GROUP BY ticker""",
    ),
)(lambda s, d: volatility.leave_one_out(volatility.study_rows(src.bars(s, d), "ewma97")).withColumn("coverage", F.round("coverage", 6)))
