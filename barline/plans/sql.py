"""Common table expressions of the oracle SQL (DuckDB)."""

from __future__ import annotations

BARS = """
px AS (
  SELECT l_returnflag AS ticker, CAST(l_shipdate AS DATE) AS dt, l_extendedprice / l_quantity AS px, l_quantity,
         row(l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem
), bars AS (
  SELECT ticker, dt, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS "close", sum(l_quantity) AS volume
  FROM px GROUP BY ticker, dt
), ix AS (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars
)"""


def _full(agg: str, col: str, k: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) {w} = {k} THEN {agg}({col}) {w} END"


_T = "OVER (PARTITION BY ticker ORDER BY dt)"

IND = (
    BARS
    + f""", step AS (
  SELECT *, "close" / lag("close") {_T} - 1 AS ret1, "close" - lag("close") {_T} AS delta,
         greatest(high - low, abs(high - lag("close") {_T}), abs(low - lag("close") {_T})) AS tr FROM ix
), rec AS (
  SELECT ticker, i, "close" AS ema12, "close" AS ema26, 0.0::DOUBLE AS macd_line, 0.0::DOUBLE AS macd_signal,
         NULL::DOUBLE AS gain, NULL::DOUBLE AS loss, tr AS atr14 FROM step WHERE i = 0
  UNION ALL
  SELECT ticker, i, e12, e26, e12 - e26, (1 - 2.0::DOUBLE / 10) * macd_signal + 2.0::DOUBLE / 10 * (e12 - e26), gain, loss, atr14 FROM (
    SELECT s.ticker, s.i, r.macd_signal, (1 - 2.0::DOUBLE / 13) * r.ema12 + 2.0::DOUBLE / 13 * s."close" AS e12, (1 - 2.0::DOUBLE / 27) * r.ema26 + 2.0::DOUBLE / 27 * s."close" AS e26,
           CASE WHEN r.gain IS NULL THEN greatest(s.delta, 0) ELSE (1 - 1.0::DOUBLE / 14) * r.gain + 1.0::DOUBLE / 14 * greatest(s.delta, 0) END AS gain,
           CASE WHEN r.loss IS NULL THEN greatest(-s.delta, 0) ELSE (1 - 1.0::DOUBLE / 14) * r.loss + 1.0::DOUBLE / 14 * greatest(-s.delta, 0) END AS loss,
           (1 - 1.0::DOUBLE / 14) * r.atr14 + 1.0::DOUBLE / 14 * s.tr AS atr14
    FROM rec r JOIN step s ON s.ticker = r.ticker AND s.i = r.i + 1)
), win AS (
  SELECT *, {_full('avg', '"close"', 20)} AS sma20, {_full('avg', '"close"', 50)} AS sma50, {_full('avg', '"close"', 200)} AS sma200,
         {_full('stddev_samp', '"close"', 20)} AS sd, {_full('min', 'low', 14)} AS lo, {_full('max', 'high', 14)} AS hi,
         {_full('stddev_samp', 'ret1', 21)} AS vol21,
         {_full('avg', 'volume', 5)} / nullif({_full('avg', 'volume', 21)}, 0) AS vol_ratio FROM step
), ind AS (
  SELECT win.*, ema12, ema26, macd_line, macd_signal, macd_line - macd_signal AS macd_hist, atr14,
         100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi14, sma20 AS bb_mid, sma20 + 2 * sd AS bb_up, sma20 - 2 * sd AS bb_lo,
         100 * (("close" - lo) / nullif(hi - lo, 0)) AS stoch_k,
         ("close" - (sma20 - 2 * sd)) / nullif((sma20 + 2 * sd) - (sma20 - 2 * sd), 0) AS bb_pctb,
         ((sma20 + 2 * sd) - (sma20 - 2 * sd)) / nullif(sma20, 0) AS bb_bw
  FROM win JOIN rec USING (ticker, i)
)"""
)

FEAT = (
    IND
    + f""", feat AS (
  SELECT *, ret1 AS f_ret1, "close" / lag("close", 5) {_T} - 1 AS f_ret5, "close" / lag("close", 10) {_T} - 1 AS f_ret10, "close" / lag("close", 21) {_T} - 1 AS f_ret21,
         rsi14 / 100 AS f_rsi14, macd_hist / "close" AS f_macd_hist_n, "close" / sma20 - 1 AS f_dist_sma20, "close" / sma50 - 1 AS f_dist_sma50,
         bb_pctb AS f_bb_pctb, bb_bw AS f_bb_bw, vol21 AS f_vol21, vol_ratio AS f_vol_ratio, stoch_k / 100 AS f_stoch_k, atr14 / "close" AS f_atr_n FROM ind
), fc AS (
  SELECT *, f_ret1 IS NOT NULL AND f_ret5 IS NOT NULL AND f_ret10 IS NOT NULL AND f_ret21 IS NOT NULL AND f_rsi14 IS NOT NULL AND f_macd_hist_n IS NOT NULL
            AND f_dist_sma20 IS NOT NULL AND f_dist_sma50 IS NOT NULL AND f_bb_pctb IS NOT NULL AND f_bb_bw IS NOT NULL AND f_vol21 IS NOT NULL
            AND f_vol_ratio IS NOT NULL AND f_stoch_k IS NOT NULL AND f_atr_n IS NOT NULL AS complete FROM feat
)"""
)


def base(src: str, h: int) -> str:
    """CTE ``based``: base_at over ``src``."""
    return f""", up_{h} AS (SELECT *, CAST("close" > lag("close", {h}) {_T} AS INT) AS up FROM {src}),
based AS (SELECT *, CASE WHEN i >= {h + 29} THEN avg(up) OVER (PARTITION BY ticker ORDER BY dt ROWS UNBOUNDED PRECEDING) END AS base_at FROM up_{h})"""


SIG = (
    IND
    + base("ind", 5)
    + f""", lagged AS (
  SELECT *, CASE WHEN i >= 22 THEN "close" / lag("close", 21) {_T} - 1 END AS r21, coalesce(macd_hist > lag(macd_hist) {_T}, false) AS rising FROM based
), scored AS (
  SELECT *,
    CASE WHEN sma50 IS NOT NULL THEN CASE WHEN "close" > sma50 THEN 0.5 ELSE -0.5 END + CASE WHEN sma200 IS NULL THEN 0 WHEN sma50 > sma200 THEN 0.5 ELSE -0.5 END END::DOUBLE AS s_trend,
    round(greatest(-1, least(1, CASE WHEN r21 IS NOT NULL THEN r21 * 8 END)), 2)::DOUBLE AS m0,
    round(CASE WHEN rsi14 <= 30 THEN 0.7::DOUBLE WHEN rsi14 >= 70 THEN -0.7::DOUBLE ELSE (rsi14 - 50) / 50 * 0.3::DOUBLE END, 2) AS s_rsi,
    CASE WHEN macd_hist IS NOT NULL AND i >= 1 THEN CASE WHEN macd_hist > 0 THEN CASE WHEN rising THEN 0.6 ELSE 0.2 END ELSE CASE WHEN rising THEN -0.2 ELSE -0.6 END END END::DOUBLE AS s_macd,
    CASE WHEN bb_pctb > 1 THEN -0.5 WHEN bb_pctb < 0 THEN 0.5 WHEN bb_pctb IS NOT NULL THEN 0 END::DOUBLE AS s_bollinger,
    CASE WHEN stoch_k <= 20 THEN 0.5 WHEN stoch_k >= 80 THEN -0.5 WHEN stoch_k IS NOT NULL THEN 0 END::DOUBLE AS s_stochastic,
    CASE WHEN vol_ratio IS NOT NULL AND ret1 IS NOT NULL THEN CASE WHEN vol_ratio >= 1.4 THEN CASE WHEN ret1 > 0 THEN 0.4 ELSE -0.4 END ELSE 0 END END::DOUBLE AS s_volume
  FROM lagged
), wsum AS (
  SELECT *, CASE WHEN r21 IS NOT NULL THEN m0 END AS s_momentum FROM scored
), teched AS (
  SELECT *, coalesce(greatest(-1, least(1,
    (coalesce(s_trend, 0) * 1.2::DOUBLE + coalesce(s_momentum, 0) * 1.0::DOUBLE + coalesce(s_rsi, 0) * 1.0::DOUBLE + coalesce(s_macd, 0) * 1.0::DOUBLE
     + coalesce(s_bollinger, 0) * 0.7::DOUBLE + coalesce(s_stochastic, 0) * 0.6::DOUBLE + coalesce(s_volume, 0) * 0.6::DOUBLE)
    / nullif(CASE WHEN s_trend IS NULL THEN 0 ELSE 1.2::DOUBLE END + CASE WHEN s_momentum IS NULL THEN 0 ELSE 1.0::DOUBLE END + CASE WHEN s_rsi IS NULL THEN 0 ELSE 1.0::DOUBLE END
      + CASE WHEN s_macd IS NULL THEN 0 ELSE 1.0::DOUBLE END + CASE WHEN s_bollinger IS NULL THEN 0 ELSE 0.7::DOUBLE END
      + CASE WHEN s_stochastic IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN s_volume IS NULL THEN 0 ELSE 0.6::DOUBLE END, 0))), 0)::DOUBLE AS tech,
    coalesce(base_at, 0.5)::DOUBLE AS base FROM wsum
), blended AS (
  SELECT *, greatest(0.05::DOUBLE, least(0.95::DOUBLE, 1 / (1 + exp(-(ln(greatest(0.03::DOUBLE, least(0.97::DOUBLE, base)) / (1 - greatest(0.03::DOUBLE, least(0.97::DOUBLE, base)))) + 0.1::DOUBLE * tech))))) AS p_up FROM teched
), rated AS (
  SELECT *, CASE WHEN abs(p_up - 0.5) >= 0.10 THEN 'high' WHEN abs(p_up - 0.5) >= 0.05 THEN 'medium' ELSE 'low' END AS confidence FROM blended
)"""
)


def select(ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{body}"
