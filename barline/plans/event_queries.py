"""Queries over earnings, the ledger, statistics, the cross-section, fitted models and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import assess, crosssection, events, ledger, learner, model, news, stats
from barline.operators.indicators import base_rate
from barline.plans import sql
from barline.plans import text_queries as tq
from barline.plans.text_queries import NEWS_ROWS, news_rows, scored_articles
from barline.sources import tables as src
from barline.streaming import streams

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None):
    def add(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = text
        return f

    return add


def rounded(df, **places):
    return df.withColumns({c: F.round(c, k) for c, k in places.items()})


def sql_rounded(cols: list[str], **places: int) -> str:
    return ", ".join(f"round({c}, {places[c]}) AS {c}" if c in places else c for c in cols)


EARN = """er AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'R' WHEN 'P' THEN 'N' END AS ticker, CAST(o_orderdate AS DATE) AS event_date,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN (o_totalprice - 250000) / 10000 END AS surprise_pct FROM orders
)"""
query(
    "next_earnings",
    f"WITH {EARN} SELECT ticker, coalesce(min(event_date) FILTER (event_date >= DATE '2001-06-01'), arg_min(event_date, o_orderkey)) AS next_date FROM er GROUP BY ticker",
)(lambda s, d: events.next_earnings(src.earnings(s, d), F.lit("2001-06-01").cast("date")))
_RECENT = f"""{sql.BARS}, {EARN}, l8 AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, o_orderkey) AS pos FROM er),
rc AS (SELECT ev.ticker, ev.event_date, ev.surprise_pct, ev.pos, ix.n - 1 - ix.i AS sessions_ago FROM (SELECT * FROM l8 WHERE pos <= 8 AND surprise_pct IS NOT NULL) ev ASOF JOIN ix ON ev.ticker = ix.ticker AND ev.event_date <= ix.dt),
best AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY sessions_ago, pos) AS k FROM rc),
recent AS (SELECT ticker, event_date, round(surprise_pct, 2) AS surprise_pct, sessions_ago FROM best WHERE k = 1)"""
query("recent_earnings", sql.select(_RECENT, "SELECT * FROM recent"))(lambda s, d: events.recent_earnings(src.earnings(s, d), src.bars(s, d)))
query(
    "pead_tilt",
    sql.select(
        _RECENT,
        "SELECT *, 1 - sessions_ago / 10 > 0 AS active, round(CASE WHEN 1 - sessions_ago / 10 > 0 THEN 0.085::DOUBLE * greatest(-3, least(3, (greatest(-20, least(20, surprise_pct)) - 5.3387::DOUBLE) / 8.7637::DOUBLE)) * (1 - sessions_ago / 10) ELSE 0 END::DOUBLE, 6) AS tilt FROM recent",
    ),
)(lambda s, d: rounded(events.pead_tilt(events.recent_earnings(src.earnings(s, d), src.bars(s, d)), 21), tilt=6))
query("forward_asof", sql.select(f"{sql.BARS}, {EARN}", 'SELECT o_orderkey, ev.ticker, event_date, ix.dt AS session, CAST(ix.i AS INT) AS i FROM er ev ASOF LEFT JOIN ix ON ev.ticker = ix.ticker AND ev.event_date <= ix.dt'))(
    lambda s, d: events.forward_asof(src.earnings(s, d), src.sessions(src.bars(s, d)), "dt", "i").select("o_orderkey", "ticker", "event_date", F.col("dt").alias("session"), "i")
)
_PEAD = f"""{sql.BARS}, {EARN}, pb AS (SELECT *, lag("close") OVER w AS pre, lead("close") OVER w AS entry, lead("close", 22) OVER w AS xit FROM ix WINDOW w AS (PARTITION BY ticker ORDER BY dt)),
pe AS (SELECT o_orderkey, ev.ticker, event_date, surprise_pct, entry / pre - 1 AS reaction, xit / entry - 1 AS drift FROM er ev ASOF JOIN pb ON ev.ticker = pb.ticker AND ev.event_date <= pb.dt WHERE pb.i > 1 AND pb.i + 22 < pb.n)"""
query("pead_events", sql.select(_PEAD, "SELECT o_orderkey, ticker, event_date, surprise_pct, round(reaction, 9) AS reaction, round(drift, 9) AS drift FROM pe"))(
    lambda s, d: rounded(events.pead_events(src.earnings(s, d), src.bars(s, d)), reaction=9, drift=9)
)
_SIGNED = _PEAD + ", sg AS (SELECT *, sign(surprise_pct) * drift AS signed, date_diff('day', DATE '1970-01-01', event_date) AS day FROM pe WHERE surprise_pct <> 0 AND drift IS NOT NULL)"
_G = {"hit_rate": 9, "long_short": 6, "net": 6, "mean_signed": 6, "half1": 6, "half2": 6}
query(
    "pead_grade",
    sql.select(
        _SIGNED,
        f"""SELECT {sql_rounded(['n', *_G], **_G)} FROM (SELECT count(*) AS n, avg((sign(surprise_pct) = sign(drift))::INT) AS hit_rate,
  avg(drift) FILTER (surprise_pct > 0) - avg(drift) FILTER (surprise_pct < 0) AS long_short, avg(drift) FILTER (surprise_pct > 0) - avg(drift) FILTER (surprise_pct < 0) - 2 * 10.0::DOUBLE / 1e4 AS net, avg(signed) AS mean_signed,
  avg(signed) FILTER (day < h) AS half1, avg(signed) FILTER (day >= h) AS half2 FROM sg CROSS JOIN (SELECT quantile_cont(day, 0.5) AS h FROM sg))""",
    ),
)(lambda s, d: rounded(events.grade(events.pead_events(src.earnings(s, d), src.bars(s, d)), "surprise_pct"), **_G))

_DRAW = lambda *p: "('0x' || substr(md5(concat_ws(':', " + ", ".join(p) + ")), 1, 8))::BIGINT"


def _cluster_sql(partials: str, draws: int, seed: str) -> str:
    return f""", pt AS ({partials}), rk AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS slot_at FROM pt), kk AS (SELECT count(*) AS k FROM pt),
pk AS (SELECT b, {_DRAW(f"'{seed}'", 'b', 'slot')} % k AS slot_at FROM (SELECT b, k, unnest(range(0, k)) AS slot FROM (SELECT unnest(range(0, {draws})) AS b), kk)),
dr AS (SELECT b, sum(n) AS n, sum(s) AS s FROM pk JOIN rk USING (slot_at) GROUP BY b)"""


query(
    "pead_cluster_ci",
    sql.select(_SIGNED + _cluster_sql("SELECT ticker AS key, count(*) AS n, sum(signed) AS s FROM sg GROUP BY ticker", 2000, "pead"), "SELECT round(quantile_cont(s / n, 0.025), 6) AS lo, round(quantile_cont(s / n, 0.975), 6) AS hi FROM dr"),
)(
    lambda s, d: rounded(
        stats.cluster_bootstrap(
            events.signed(events.pead_events(src.earnings(s, d), src.bars(s, d)), "surprise_pct").groupBy(F.col("ticker").alias("key")).agg(F.count("*").alias("n"), F.sum("signed").alias("s")), 2000, "pead", F.col("s") / F.col("n")
        ),
        lo=6,
        hi=6,
    )
)

# Tone evaluation.
_AUC = "per AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM au GROUP BY score), ub AS (SELECT *, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS u FROM per) SELECT (sum(p) + sum(q))::BIGINT AS n, round(sum(u) / (sum(p)::DOUBLE * sum(q)), 9) AS auc FROM ub"
query("tone_auc", sql.select(NEWS_ROWS, f", au AS (SELECT round(news, 6) AS score, outcome_up::INT AS y FROM nr), {_AUC}"))(
    lambda s, d: rounded(stats.auc(news_rows(s, d).withColumn("news", F.round("news", 6)), "news", "outcome_up"), auc=9)
)
query("label_auc", f"WITH au AS (SELECT n_chars AS score, quality AS y FROM labels JOIN documents USING (doc_id)), {_AUC}")(
    lambda s, d: rounded(stats.auc(src.table(s, d, "labels").join(src.table(s, d, "documents"), "doc_id"), "n_chars", "quality"), auc=9)
)
_GRID = "gr AS (SELECT w, avg(power(1 / (1 + exp(-(logit_price + w * news))) - outcome_up::INT, 2)) AS brier FROM nr CROSS JOIN (SELECT round(-0.60::DOUBLE + 0.02::DOUBLE * unnest(range(0, 61)), 2) AS w) GROUP BY w)"
query("weight_grid", sql.select(NEWS_ROWS, f", {_GRID} SELECT w, round(brier, 9) AS brier FROM gr"))(lambda s, d: rounded(stats.brier_grid(news_rows(s, d)), brier=9))
query("weight_grid_best", sql.select(NEWS_ROWS, f", {_GRID} SELECT arg_min(w, brier) AS w, round(min(brier), 9) AS brier FROM gr"))(lambda s, d: rounded(stats.best_weight(stats.brier_grid(news_rows(s, d))), brier=9))
_P1 = "1 / (1 + exp(-(logit_price + 0.08::DOUBLE * news)))"
_P0 = "1 / (1 + exp(-logit_price))"
_E = {"brier_price": 9, "brier_news": 9, "acc_price": 9, "acc_news": 9, "always_up": 9}
query(
    "news_evaluation",
    sql.select(
        NEWS_ROWS,
        f"SELECT {sql_rounded(['n', *_E], **_E)} FROM (SELECT count(*) AS n, avg(power({_P0} - outcome_up::INT, 2)) AS brier_price, avg(power({_P1} - outcome_up::INT, 2)) AS brier_news, avg((({_P0} >= 0.5) = outcome_up)::INT) AS acc_price, avg((({_P1} >= 0.5) = outcome_up)::INT) AS acc_news, avg(outcome_up::INT) AS always_up FROM nr)",
    ),
)(lambda s, d: rounded(stats.news_evaluation(news_rows(s, d), 0.08), **_E))
query(
    "delta_brier_ci",
    sql.select(
        NEWS_ROWS + _cluster_sql(f"SELECT ticker AS key, count(*) AS n, sum(power({_P1} - outcome_up::INT, 2) - power({_P0} - outcome_up::INT, 2)) AS s FROM nr GROUP BY ticker", 1000, "news"),
        "SELECT round(quantile_cont(s / n, 0.025), 9) AS lo, round(quantile_cont(s / n, 0.975), 9) AS hi FROM dr",
    ),
)(lambda s, d: rounded(stats.cluster_bootstrap(stats.delta_brier_partials(news_rows(s, d), 0.08), 1000, "news", F.col("s") / F.col("n")), lo=9, hi=9))

# Ledger.
LEDGER = (
    sql.BARS
    + """, lg0 AS (
  SELECT ticker, dt AS as_of, 5 AS horizon_days, i, 0.5::DOUBLE + ((i * 7919) % 41 - 20)::DOUBLE / 100 AS p0, 0.5::DOUBLE + ((i * 104729) % 21 - 10)::DOUBLE / 100 AS base,
    CASE WHEN i % 7 <> 0 THEN 0.5::DOUBLE + ((i * 31) % 31 - 15)::DOUBLE / 100 END AS p_ml, ((i * 17) % 21 - 10)::DOUBLE / 10 AS tech, ((i * 13) % 21 - 10)::DOUBLE / 10 AS news_company,
    CASE WHEN i % 3 <> 0 THEN ((i * 11) % 21 - 10)::DOUBLE / 10 END AS news_market, ((i * 19) % 21 - 10)::DOUBLE / 10 AS news_politics,
    CASE WHEN i % 11 <> 0 THEN "close" * 0.9::DOUBLE END AS range_low, CASE WHEN i % 11 <> 0 THEN "close" * 1.1::DOUBLE END AS range_high FROM ix WHERE i % 5 = 0 AND i >= 60
), lgr AS (
  SELECT *, CASE WHEN abs(p0 - 0.5) >= 0.1 - 1e-9 THEN 'high' WHEN abs(p0 - 0.5) >= 0.05 - 1e-9 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN p0 >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM lg0
), lga AS (
  SELECT * EXCLUDE (i, p0), p0 AS p_up, 1 AS logged_at FROM lgr UNION ALL SELECT * EXCLUDE (i, p0), 1 - p0, 2 FROM lgr WHERE i % 25 = 0
), lg AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY ticker, as_of, horizon_days ORDER BY logged_at) AS k FROM lga) WHERE k = 1
), lb AS (
  SELECT ticker, dt AS as_of, "close" AS spot, lead(dt, 5) OVER w AS resolved_on, lead("close", 5) OVER w AS fin FROM ix WINDOW w AS (PARTITION BY ticker ORDER BY dt)
), gd AS (
  SELECT lg.*, resolved_on, round((fin / spot - 1) * 100, 2) AS realized_pct, CAST(round(CAST(CAST(fin AS VARCHAR) AS DECIMAL(30, 14)), 4) AS DOUBLE) AS end_price, fin / spot - 1 > 0 AS outcome_up, (direction = 'up') = (fin / spot - 1 > 0) AS correct,
    fin >= range_low AND fin <= range_high AS in_band FROM lg LEFT JOIN lb USING (ticker, as_of)
)"""
)


def graded(s, d):
    return ledger.resolve(ledger.first_logged(src.ledger(s, d)), src.bars(s, d))


_LC = ["ticker", "as_of", "horizon_days", "p_up", "base", "p_ml", "tech", "news_company", "news_market", "news_politics", "confidence", "direction", "logged_at"]
_LR = {"p_up": 6, "base": 6, "p_ml": 6}
query("ledger_dedup", sql.select(LEDGER, f"SELECT {sql_rounded(_LC, **_LR)} FROM lg"))(lambda s, d: rounded(ledger.first_logged(src.ledger(s, d)).select(*_LC), **_LR))
query("ledger_new_records", sql.select(LEDGER, "SELECT ticker, as_of FROM lg WHERE as_of >= DATE '1999-01-01'"))(
    lambda s, d: (lambda a: ledger.new_records(a, a.where("as_of < date'1999-01-01'")).select("ticker", "as_of"))(src.ledger(s, d))
)
_RC = ["ticker", "as_of", "resolved_on", "realized_pct", "end_price", "outcome_up", "correct", "in_band"]
query("ledger_resolve", sql.select(LEDGER, f"SELECT {', '.join(_RC)} FROM gd"))(lambda s, d: graded(s, d).select(*_RC))
_TR = {"hit_rate": 9, "always_up": 9, "brier": 9, "brier_drift": 9}
query(
    "track_record",
    sql.select(
        LEDGER,
        f"SELECT {sql_rounded(['logged', 'resolved', 'pending', 'since', *_TR], **_TR)} FROM (SELECT count(*) AS logged, count(outcome_up) AS resolved, count(*) - count(outcome_up) AS pending, min(as_of) AS since, avg(correct::INT) AS hit_rate, avg(outcome_up::INT) AS always_up, avg(power(p_up - outcome_up::INT, 2)) AS brier, avg(power(base - outcome_up::INT, 2)) FILTER (base IS NOT NULL) AS brier_drift FROM gd)",
    ),
)(lambda s, d: rounded(ledger.track_record(graded(s, d)), **_TR))
query("track_by_confidence", sql.select(LEDGER, "SELECT confidence, count(*) AS n, round(avg(correct::INT), 9) AS hit_rate FROM gd WHERE correct IS NOT NULL GROUP BY confidence"))(lambda s, d: rounded(ledger.by_confidence(graded(s, d)), hit_rate=9))
query("range_coverage", sql.select(LEDGER, "SELECT count(*) AS n, round(avg(in_band::INT), 9) AS coverage FROM gd WHERE in_band IS NOT NULL"))(lambda s, d: rounded(ledger.range_coverage(graded(s, d)), coverage=9))
query("recent_resolved", sql.select(LEDGER, "SELECT ticker, as_of, resolved_on, correct FROM gd WHERE correct IS NOT NULL ORDER BY resolved_on DESC, ticker, as_of LIMIT 30"))(
    lambda s, d: ledger.recent(graded(s, d)).select("ticker", "as_of", "resolved_on", "correct")
)

# Learner.
_LGT = lambda p: f"ln(greatest(0.03::DOUBLE, least(0.97::DOUBLE, {p})) / (1 - greatest(0.03::DOUBLE, least(0.97::DOUBLE, {p}))))"
_D = {"off": 6, "x_k_ml": 6, "x_tech": 6, "x_news_company": 6, "x_news_market": 6, "x_news_politics": 6}
query(
    "learner_design",
    sql.select(
        LEDGER,
        f"SELECT ticker, as_of, round({_LGT('base')}, 6) AS off, round(CASE WHEN p_ml IS NOT NULL THEN {_LGT('p_ml')} - {_LGT('base')} ELSE 0 END::DOUBLE, 6) AS x_k_ml, tech AS x_tech, coalesce(news_company, 0) AS x_news_company, coalesce(news_market, 0) AS x_news_market, coalesce(news_politics, 0) AS x_news_politics, outcome_up::INT::DOUBLE AS y FROM gd WHERE base IS NOT NULL AND tech IS NOT NULL AND outcome_up IS NOT NULL",
    ),
)(lambda s, d: rounded(learner.design(graded(s, d)).select("ticker", "as_of", *_D, "y"), off=6, x_k_ml=6))
query(
    "learner_split",
    sql.select(
        LEDGER,
        ", u AS (SELECT *, row_number() OVER (ORDER BY as_of, logged_at, ticker) AS r, count(*) OVER () AS total FROM gd WHERE horizon_days = 5 AND base IS NOT NULL AND outcome_up IS NOT NULL) SELECT ticker, as_of, CASE WHEN r <= greatest(floor(total * 0.7::DOUBLE), total - 200) THEN 'train' ELSE 'test' END AS part FROM u",
    ),
)(lambda s, d: learner.split(graded(s, d)).select("ticker", "as_of", "part"))


def _learner_fit(s, d):
    state = learner.update(graded(s, d), "2024-01-31 00:00")
    return s.createDataFrame([(k, v, state["source"], state["n_used"]) for k, v in state["weights"].items()], "weight string, value double, source string, n_used long")


query("learner_fit", None)(_learner_fit)

# Statistics.
DRAWS, BLOCK = 200, 4
_EDGE = f""", eg AS (SELECT ticker AS key, row_number() OVER (PARTITION BY ticker ORDER BY as_of) - 1 AS pos, count(*) OVER (PARTITION BY ticker) AS n, (correct::INT - outcome_up::INT)::DOUBLE AS value FROM gd WHERE correct IS NOT NULL),
bl AS (SELECT b, key, n, blk, {_DRAW("'edge'", 'key', 'b', 'blk')} % n AS st FROM (SELECT key, n, b, unnest(range(0, (n + {BLOCK - 1}) // {BLOCK})) AS blk FROM (SELECT DISTINCT key, n FROM eg), (SELECT unnest(range(0, {DRAWS})) AS b))),
rs AS (SELECT b, key, (st + k) % n AS pos FROM bl, (SELECT unnest(range(0, {BLOCK})) AS k) WHERE blk * {BLOCK} + k < n),
ed AS (SELECT b, sum(value) / (SELECT count(*) FROM eg) AS e FROM rs JOIN eg USING (key, pos) GROUP BY b)"""
query(
    "edge_bootstrap",
    sql.select(
        LEDGER + _EDGE,
        "SELECT round((SELECT avg(value) FROM eg), 9) AS edge, round(quantile_cont(e, 0.025), 9) AS lo, round(quantile_cont(e, 0.975), 9) AS hi, round(least(1.0::DOUBLE, 2 * least(avg((e <= 0)::INT), avg((e >= 0)::INT))), 9) AS p FROM ed",
    ),
)(lambda s, d: rounded(stats.edge_bootstrap(graded(s, d), BLOCK, DRAWS), edge=9, lo=9, hi=9, p=9))
_PS = {"accuracy": 9, "always_up": 9, "ret_up": 6, "ret_down": 6, "sure_accuracy": 9, "sure_always_up": 9}
_PSQL = "count(*) AS n, avg(correct::INT) AS accuracy, avg(outcome_up::INT) AS always_up, avg(realized_pct) FILTER (p_up >= 0.5) AS ret_up, avg(realized_pct) FILTER (p_up < 0.5) AS ret_down, count_if(abs(p_up - 0.5) >= 0.1 - 1e-9)::BIGINT AS sure_n, avg(correct::INT) FILTER (abs(p_up - 0.5) >= 0.1 - 1e-9) AS sure_accuracy, avg(outcome_up::INT) FILTER (abs(p_up - 0.5) >= 0.1 - 1e-9) AS sure_always_up, min(as_of) AS first, max(as_of) AS last"
_PCOLS = ["n", "accuracy", "always_up", "ret_up", "ret_down", "sure_n", "sure_accuracy", "sure_always_up", "first", "last"]
query("pooled_summary", sql.select(LEDGER, f"SELECT horizon_days, {sql_rounded(_PCOLS, **_PS)} FROM (SELECT horizon_days, {_PSQL} FROM gd WHERE correct IS NOT NULL GROUP BY horizon_days)"))(
    lambda s, d: rounded(stats.pooled_summary(graded(s, d), "horizon_days"), **_PS)
)
query("per_ticker_edge", sql.select(LEDGER, "SELECT ticker, count(*) AS n, round(avg(correct::INT), 9) AS accuracy, round(avg(outcome_up::INT), 9) AS always_up, round(avg(correct::INT) - avg(outcome_up::INT), 9) AS edge FROM gd WHERE correct IS NOT NULL GROUP BY ticker"))(
    lambda s, d: rounded(stats.pooled_summary(graded(s, d), "ticker").select("ticker", "n", "accuracy", "always_up", (F.col("accuracy") - F.col("always_up")).alias("edge")), accuracy=9, always_up=9, edge=9)
)
query(
    "shuffled_control",
    sql.select(
        LEDGER,
        ", dd AS (SELECT ticker, as_of, p_up >= 0.5 AS up, outcome_up FROM gd WHERE correct IS NOT NULL), l AS (SELECT up, row_number() OVER (ORDER BY ticker, as_of) AS r FROM dd), rr AS (SELECT outcome_up AS other, row_number() OVER (ORDER BY md5(concat_ws(':', 'shuffle', ticker, as_of::VARCHAR))) AS r FROM dd), g AS (SELECT avg((up = other)::INT) AS accuracy, avg(up::INT) * avg(other::INT) + (1 - avg(up::INT)) * (1 - avg(other::INT)) AS expected FROM l JOIN rr USING (r)) SELECT round(accuracy, 9) AS accuracy, round(expected, 9) AS expected, abs(accuracy - expected) < 0.03 AS ok FROM g",
    ),
)(lambda s, d: rounded(stats.shuffled_control(graded(s, d)), accuracy=9, expected=9))

# Cross-section, on weeks: look-back 52, skip 4.
_XS = """wk AS (SELECT p_brand AS name, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS wk, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) / sum(l_quantity) AS c FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
da AS (SELECT wk, row_number() OVER (ORDER BY wk) - 1 AS i, count(*) OVER () AS nd FROM (SELECT DISTINCT wk FROM wk)), m AS (SELECT name, i, nd, ln(c) AS lp FROM wk JOIN da USING (wk))"""


def _legs_sql(hold: int, near: int = 4, far: int = 52, sign: int = 1) -> str:
    return f"""{_XS}, j AS (SELECT a.i, a.name, {sign} * (n.lp - f.lp) AS sig, e.lp - a.lp AS fwd FROM m a JOIN m e ON e.name = a.name AND e.i = a.i + {hold} JOIN m n ON n.name = a.name AND n.i = a.i - {near} JOIN m f ON f.name = a.name AND f.i = a.i - {far} WHERE a.i >= {far} AND (a.i - {far}) % {hold} = 0 AND a.i < a.nd - {hold}),
r AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY i) AS names, row_number() OVER (PARTITION BY i ORDER BY sig, name) AS rank FROM j) WHERE names >= 10),
lg AS (SELECT *, CASE WHEN rank <= greatest(1, names // 5) THEN -1 WHEN rank > names - greatest(1, names // 5) THEN 1 ELSE 0 END AS leg FROM r),
sp AS (SELECT i, avg(fwd) FILTER (leg = 1) AS long_r, avg(fwd) FILTER (leg = -1) AS short_r, avg(fwd) FILTER (leg = 1) - avg(fwd) FILTER (leg = -1) AS spread FROM lg GROUP BY i)"""


def _legs(s, d, hold, near=4, far=52, sign=1):
    return crosssection.legs(src.weekly_closes(s, d), sign, near, far, hold)


query("weekly_closes", f"WITH {_XS} SELECT name, wk, c AS \"close\" FROM wk")(lambda s, d: src.weekly_closes(s, d))
query("xs_momentum_legs", f"WITH {_legs_sql(4)} SELECT CAST(i AS INT) AS i, name, round(sig, 9) AS sig, round(fwd, 9) AS fwd, leg FROM lg")(lambda s, d: rounded(_legs(s, d, 4), sig=9, fwd=9))
query("xs_reversal_legs", f"WITH {_legs_sql(1, 0, 5, -1)} SELECT CAST(i AS INT) AS i, name, round(sig, 9) AS sig, round(fwd, 9) AS fwd, leg FROM lg")(lambda s, d: rounded(_legs(s, d, 1, 0, 5, -1), sig=9, fwd=9))
_X = {k: 6 for k in ("gross_mean_pct", "gross_sharpe", "net_mean_pct", "net_sharpe", "hit_rate", "half1_pct", "half2_pct", "mean_long_pct", "mean_short_pct")}
query(
    "xs_spread_stats",
    f"""WITH {_legs_sql(4)}, d AS (SELECT *, row_number() OVER (ORDER BY i) AS k, count(*) OVER () AS n FROM sp)
SELECT {sql_rounded(['n_rebal', *_X], **_X)} FROM (SELECT count(*) AS n_rebal, avg(spread) * 100 AS gross_mean_pct, avg(spread) / stddev_samp(spread) * sqrt(252.0::DOUBLE / 4) AS gross_sharpe,
 (avg(spread) - 4 * 10.0::DOUBLE / 1e4) * 100 AS net_mean_pct, (avg(spread) - 4 * 10.0::DOUBLE / 1e4) / stddev_samp(spread) * sqrt(252.0::DOUBLE / 4) AS net_sharpe, avg((spread > 0)::INT) AS hit_rate,
 avg(spread) FILTER (k <= n // 2) * 100 AS half1_pct, avg(spread) FILTER (k > n // 2) * 100 AS half2_pct, avg(long_r) * 100 AS mean_long_pct, avg(short_r) * 100 AS mean_short_pct FROM d HAVING count(*) >= 20)""",
)(lambda s, d: rounded(crosssection.spread_stats(crosssection.spreads(_legs(s, d, 4)), 4), **_X))
query(
    "series_bootstrap",
    f"""WITH {_legs_sql(4)}, d AS (SELECT spread AS value, row_number() OVER (ORDER BY i) - 1 AS pos, count(*) OVER () AS n FROM sp),
bl AS (SELECT b, n, {_DRAW("'series'", "'all'", 'b', 'blk')} % n AS pos FROM (SELECT n, b, unnest(range(0, n)) AS blk FROM (SELECT DISTINCT n FROM d), (SELECT unnest(range(0, 500)) AS b))),
mm AS (SELECT b, sum(value) / max(d.n) AS m FROM bl JOIN d USING (pos) GROUP BY b) SELECT round(quantile_cont(m, 0.025), 9) AS lo, round(quantile_cont(m, 0.975), 9) AS hi FROM mm""",
)(lambda s, d: rounded(stats.series_bootstrap(crosssection.spreads(_legs(s, d, 4)).select(F.col("i").alias("pos"), F.col("spread").alias("value")), 1, 500), lo=9, hi=9))

# Fitted models.
query("walkforward_points", sql.select(sql.BARS + sql.base("ix", 21), "SELECT ticker, dt, round(coalesce(base_at, 0.5), 9) AS base FROM based WHERE n - 1 - 21 - i >= 0 AND (n - 22 - i) % 21 = 0 AND (n - 22 - i) / 21 < 48"))(
    lambda s, d: model.points(base_rate(src.sessions(src.bars(s, d)), 21), 21, 48, 21).select("ticker", "dt", F.round(F.coalesce("base_at", F.lit(0.5)), 9).alias("base"))
)
query("walkforward_predictions", None)(lambda s, d: model.walk_forward(src.bars(s, d)))
query("holdout", None)(lambda s, d: model.price_model(src.bars(s, d)))


def assessment(s, d, h):
    now = F.lit(tq.NOW)
    scored = scored_articles(s, d)
    matched = news.match_companies(scored, s.createDataFrame([("A", "The"), ("N", "Der"), ("R", "La")], "ticker string, name string"))
    bars = src.bars(s, d)
    return assess.assess(bars, scored, matched, src.earnings(s, d), now, h, model.price_model(bars, h))


query("assess_weekly", None)(lambda s, d: assess.payload(assessment(s, d, 5)))
query("snapshot", None)(lambda s, d: assess.cards(assessment(s, d, 5), src.quote(src.bars(s, d))))
query("assess_monthly", None)(lambda s, d: assess.payload(assessment(s, d, 21)))

# Events.
query("props_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")(lambda s, d: src.table(s, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k")))
query(
    "event_dedup_stream",
    "SELECT user_id, CAST(ts AS DATE) AS day, event_type, event_id FROM (SELECT row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS k, * FROM events) WHERE k = 1",
)(lambda s, d: streams.dedup_batch(streams.with_day(src.table(s, d, "events"))).select("user_id", "day", "event_type", "event_id"))
