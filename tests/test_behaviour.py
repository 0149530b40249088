"""Behaviour on synthetic bars: no look-ahead, statistics with a known answer, planner, learner."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.config import PRIOR_WEIGHTS
from barline.functions import text as tx
from barline.operators import events, indicators, learner, ledger, model, planner, signals, stats, volatility


def gbm(n=600, sigma=0.02, drift=0.0003, seed=1, ticker="T"):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(drift, sigma, n)))
    span = np.abs(rng.normal(0, 0.015, n)) * close
    dt = pd.bdate_range("2016-01-01", periods=n).date
    return pd.DataFrame({"ticker": ticker, "dt": dt, "open": close, "high": close + span, "low": close - span, "close": close, "volume": rng.integers(1e5, 1e7, n).astype(float)})


@pytest.fixture(scope="module")
def bars():
    return gbm()


def test_indicators_match_pandas(spark, bars):
    got = indicators.indicators(spark.createDataFrame(bars)).orderBy("dt").toPandas()
    c = bars["close"]
    delta = c.diff()
    gain, loss = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False).mean(), (-delta.clip(upper=0)).ewm(alpha=1 / 14, adjust=False).mean()
    want = {
        "sma50": c.rolling(50).mean(),
        "ema12": c.ewm(span=12, adjust=False).mean(),
        "rsi14": 100 - 100 / (1 + gain / loss.replace(0, np.nan)),
        "bb_up": c.rolling(20).mean() + 2 * c.rolling(20).std(),
        "vol21": c.pct_change().rolling(21).std(),
    }
    for k, v in want.items():
        np.testing.assert_allclose(got[k].to_numpy(float), v.to_numpy(float), rtol=1e-9)


def test_no_look_ahead(spark, bars):
    """Every session's columns are the same when all later rows are gone or noise."""
    cols = [*model.COLUMNS, "tech", "base", "p_up"]
    make = lambda b: indicators.features(signals.price_only(spark.createDataFrame(b))).where(F.col("i") == 400).select(*cols).first()
    full, cut = make(bars), make(bars.iloc[:401])
    noise = bars.copy()
    noise.loc[401:, ["open", "high", "low", "close", "volume"]] *= 7.5
    noisy = make(noise)
    for c in cols:
        assert full[c] == pytest.approx(cut[c], rel=1e-9) and full[c] == pytest.approx(noisy[c], rel=1e-9)


def test_walk_forward_does_not_peek(spark, bars):
    at = (("1 week", 5, 1, 5),)
    i = len(bars) - 1 - 5
    noise = bars.copy()
    noise.loc[i + 1 :, ["open", "high", "low", "close"]] *= 3.0
    a = model.walk_forward(spark.createDataFrame(bars), at).first()
    b = model.walk_forward(spark.createDataFrame(noise), at).first()
    assert a["p_up"] == b["p_up"] and a["p_ml"] == b["p_ml"] and b["outcome_up"]


def test_logistic_fit_is_a_minimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    mean, scale, w = model.fit_logistic(x, y)
    z = np.column_stack([(x - mean) / scale, np.ones(400)])
    p = 1 / (1 + np.exp(-z @ w))
    grad = 0.5 * z.T @ (p - y) + np.append(w[:-1], 0)
    assert np.abs(grad).max() < 1e-6 and w[0] > 0.5
    assert model.fit_logistic(x, np.ones(400)) is None


def test_holdout_against_a_twin(spark, bars):
    """All columns of the holdout from features and labels laid out by hand, fitted by damped fixed-point steps."""

    def fit(x, y):
        m, sd = x.mean(0), x.std(0)
        z = np.column_stack([np.ones(len(y)), (x - m) / sd])
        w, keep = np.zeros(z.shape[1]), np.r_[0.0, np.ones(z.shape[1] - 1)]
        bound = np.linalg.inv(0.5 * z.T @ z / 4 + np.diag(keep))  # curvature is nowhere larger
        for _ in range(5000):
            w = w - bound @ (0.5 * z.T @ (1 / (1 + np.exp(-z @ w)) - y) + keep * w)
        return lambda q: 1 / (1 + np.exp(-(w[0] + ((q - m) / sd) @ w[1:])))

    frame = model.scored(spark.createDataFrame(bars)).orderBy("dt").toPandas()
    x, c, tech = frame[model.COLUMNS].to_numpy(float), frame["close"].to_numpy(float), frame["tech"].to_numpy(float)
    h, n = 5, len(c)
    rows = [i for i in range(n - h) if frame["complete"][i]]
    y = np.array([float(c[i + h] > c[i]) for i in rows])
    base = [np.mean([c[j] > c[j - h] for j in range(h, i + 1)]) if i >= h + 29 else 0.5 for i in range(n)]
    k = 60
    for embargo in (False, True):
        train = [a for a, i in enumerate(rows[:-k]) if not embargo or i + h <= rows[-k]]
        p_ml = fit(x[[rows[a] for a in train]], y[train])(x[rows[-k:]])
        logit = lambda p: np.log(np.clip(p, 0.03, 0.97) / (1 - np.clip(p, 0.03, 0.97)))
        b = logit(np.array([base[i] for i in rows[-k:]]))
        p = 1 / (1 + np.exp(-(b + 0.15 * (logit(p_ml) - b) + 0.10 * tech[rows[-k:]])))
        got = model.price_model(spark.createDataFrame(bars), h, embargo).first()
        assert (got["train_rows"], got["holdout_days"], got["effective_n"]) == (len(train), k, k // h)
        assert got["baseline"] == pytest.approx(y[-k:].mean(), abs=6e-4) and got["base"] == pytest.approx(base[-1], abs=6e-4)
        assert got["hit_rate"] == pytest.approx(np.mean((p >= 0.5) == (y[-k:] > 0.5)), abs=6e-4)
        assert got["p_ml"] == pytest.approx(fit(x[rows], y)(x[-1:])[0], abs=2e-4)


def test_zero_loss_leaves_rsi_null(spark):
    b = gbm(40)
    b["close"] = np.arange(1.0, 41.0)
    got = indicators.indicators(spark.createDataFrame(b)).agg(F.count("rsi14")).first()[0]
    assert got == 0


def test_volatility(spark):
    b = pd.concat([gbm(4000, 0.02, 0, 5, "A"), gbm(30, 0.02, 0, 6, "B").head(20)])
    got = {r["ticker"]: r for r in volatility.ewma_vol(spark.createDataFrame(b)).collect()}
    assert abs(got["A"]["sigma_d"] - 0.02) < 0.005 and got["B"]["sigma_d"] is None
    week, month = (volatility.expected_range(spark.createDataFrame(gbm()), h).first() for h in (5, 21))
    assert week["low"] < gbm()["close"].iloc[-1] < week["high"] and month["pct"] > week["pct"]
    assert volatility.quantiles_for(13)[0] == pytest.approx(-1.1372 * (13 / 5) ** 0.5)


def test_brackets_against_a_loop(spark, bars):
    ind = indicators.indicators(spark.createDataFrame(bars)).orderBy("dt").toPandas()
    c, h, lo, a = (ind[k].to_numpy() for k in ("close", "high", "low", "atr14"))
    won = lost = 0
    for i in range(len(c) - 21):
        for j in range(i + 1, i + 21):
            if lo[j] <= c[i] - a[i]:
                lost += 1
                break
            if h[j] >= c[i] + 1.5 * a[i]:
                won += 1
                break
    n = len(c) - 21
    r = planner.bracket_stats(spark.createDataFrame(ind)).first()
    assert (r["sample_n"], r["target_first_pct"], r["stop_first_pct"]) == (n, round(100 * won / n, 1), round(100 * lost / n, 1))
    assert abs(r["target_first_pct"] + r["stop_first_pct"] + r["neither_pct"] - 100) <= 0.2
    assert r["net_level_edge_pct"] < r["level_edge_pct"]


def graded(spark, n, k=0.0, seed=4):
    rng = np.random.default_rng(seed)
    news = rng.uniform(-1, 1, n)
    up = rng.random(n) < 1 / (1 + np.exp(-k * news))
    rows = [("T", dt.datetime(2020, 1, 1) + dt.timedelta(days=i), 5, 0.5, None, 0.0, float(v), None, 0.0, bool(u), i) for i, (v, u) in enumerate(zip(news, up))]
    return spark.createDataFrame(rows, "ticker string, as_of timestamp, horizon_days int, base double, p_ml double, tech double, news_company double, news_market double, news_politics double, outcome_up boolean, logged_at int")


def test_learner(spark):
    assert learner.update(graded(spark, 35, 4), "now")["source"] == "prior"
    learned = learner.update(graded(spark, 300, 4), "now")
    assert learned["source"] == "adaptive" and learned["weights"]["news_company"] > 0.6
    idle = learner.update(graded(spark, 300, 0), "now")
    assert learned["weights"]["news_company"] - idle["weights"]["news_company"] > 0.3
    assert learner.summary(learned)["updates"] == 1


def test_learner_state_survives(spark, tmp_path):
    assert learner.load(spark, str(tmp_path / "none")) == learner.default_state()
    state = {**learner.default_state(), "n_used": 7, "weights": {**PRIOR_WEIGHTS, "tech": 0.2}}
    for v in (1, 2):
        learner.save(spark, {**state, "n_used": v}, v, str(tmp_path / "s"))
    assert learner.load(spark, str(tmp_path / "s"))["n_used"] == 2


def test_ledger_append_is_idempotent(spark, sf_dir, tmp_path):
    from barline.sources import tables

    rows = tables.ledger(spark, sf_dir).limit(50)
    rows = rows.select([F.col(c).cast("string") if c == "logged_at" else F.col(c) for c in rows.columns])
    path = str(tmp_path / "ledger")
    ledger.append(rows, path)
    n = ledger.read(spark, path).count()
    ledger.append(rows, path)
    ledger.append(rows, path, read_only=True)
    (tmp_path / "ledger" / "part-bad.json").write_text("{broken\n")
    assert ledger.read(spark, path).count() == n == ledger.first_logged(rows).count()


def test_bootstrap_sides(spark):
    def edge(hit, up):
        rng = np.random.default_rng(8)
        rows = [(t, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), bool(rng.random() < hit), bool(rng.random() < up)) for t in "AB" for i in range(150)]
        return stats.edge_bootstrap(spark.createDataFrame(rows, "ticker string, as_of timestamp, correct boolean, outcome_up boolean"), 12, 300).first()

    better, worse = edge(0.9, 0.5), edge(0.3, 0.6)
    assert better["lo"] > 0 and worse["hi"] < 0 and better["lo"] <= better["edge"] <= better["hi"]


def test_auc_against_pairs(spark):
    rows = [(1.0, True), (2.0, False), (2.0, True), (3.0, True), (0.0, False), (None, True)]
    pos, neg = [1, 2, 3], [2, 0]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / 6
    assert stats.auc(spark.createDataFrame(rows, "s double, y boolean"), "s", "y").first()["auc"] == pytest.approx(want)


def test_auc_over_buckets(spark):
    rng = np.random.default_rng(5)
    score = np.r_[rng.normal(0, 1, 150), rng.normal(0, 1e6, 100), rng.integers(-3, 3, 50), [float("inf"), -float("inf"), 1e300, -1e300, 0.0, -0.0]]
    y = rng.random(len(score)) < 0.4
    pos, neg = score[y], score[~y]
    want = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    df = spark.createDataFrame([(float(a), bool(b)) for a, b in zip(score, y)], "s double, y boolean")
    r = stats.auc(df, "s", "y").first()
    assert r["n"] == len(score) and r["auc"] == pytest.approx(want)


def test_pead_tilt(spark):
    rows = [("A", 15.0, 1), ("B", -15.0, 1), ("C", 15.0, 30), ("D", 5000.0, 0)]
    r = spark.createDataFrame(rows, "ticker string, surprise_pct double, sessions_ago int")
    got = {x["ticker"]: x["tilt"] for x in events.pead_tilt(r, 21).collect()}
    assert got["A"] > 0 > got["B"] and got["C"] == 0 and got["D"] == pytest.approx(0.085 * (20 - 5.3387) / 8.7637)
    assert {x["tilt"] for x in events.pead_tilt(r, 5).collect()} == {0.0}


def test_confidence_needs_more_than_one_standard_error(spark):
    rows = [(0.65, 0.60, 0.62, 12.0), (0.65, 0.40, 0.62, 12.0), (0.65, None, None, None), (0.56, None, None, None), (0.51, None, None, None)]
    df = spark.createDataFrame(rows, "p double, h double, b double, n double")
    got = [r[0] for r in df.select(signals.confidence(F.col("p"), F.col("h"), F.col("b"), F.col("n"))).collect()]
    assert got == ["high", "low", "high", "medium", "low"]


def test_company_name_equals_repeated_stripping(spark):
    import re

    from barline.functions.lexicon import COMPANY_ENDINGS

    def loop(name):
        name = re.sub(r"[,.()]", " ", name).strip()
        while (new := re.sub(rf"\b({COMPANY_ENDINGS})\.?$", "", name, flags=re.I).strip()) != name:
            name = new
        return name

    names = ["Apple Inc.", "BP p.l.c.", "Foo Holdings Group Ltd", "Se", "Acme (International) Co., Inc", "Technology One", "Inc", "A Co B"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(tx.company_name(F.col("n"))).collect()]
    assert got == [loop(n) for n in names]


def test_rule_sentiment():
    lex = {"good": 1.9, "bad": -2.5}
    s = lambda t: tx.rule_score(t, lex)
    assert s("good") > 0 > s("bad") and s("not good") < 0 and s("very good") > s("good") > s("slightly good")
    assert s("good!!!") > s("good") and s("GOOD day") > s("good day") and s("good but bad") < 0 and s("") == s(None) == 0


def test_rule_sentiment_by_hand():
    norm = lambda x: round(x / (x * x + 15) ** 0.5, 4)
    lex = {"good": 1.9, "bad": -2.5, "no": -1.2, "heart": 1.0, "ass": -2.5}
    cases = {
        "very good": 1.9 + 0.293,
        "very , good": 1.9 + 0.95 * 0.293,
        "it is VERY good": 1.9 + 0.293 + 0.733,
        "barely bad": -2.5 + 0.293,
        "isn't good": -0.74 * 1.9,
        "never so good": (1.9 + 0.293) * 1.25,
        "without doubt good": 1.9,
        "least good": -0.74 * 1.9,
        "at least good": 1.9,
        "no good": -0.74 * 1.9,
        "a day of kind of good": 1.9 - 0.293,
        "with a broken heart": -2.9,
        "what a bad ass day": -2.5 + 1.5,
        "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
        "GOOD day!!!!!!": 1.9 + 0.733 + 4 * 0.292,
        "bad ???": -2.5 - 3 * 0.18,
        "bad ?????": -2.5 - 0.96,
        "": 0.0,
    }
    assert {t: tx.rule_score(t, lex) for t in cases} == {t: norm(v) for t, v in cases.items()}


def test_ledger_reads_only_the_days_of_a_batch(spark, sf_dir, tmp_path):
    from barline.sources import tables

    rows = tables.ledger(spark, sf_dir)
    rows = rows.select([F.col(c).cast("string") if c == "logged_at" else F.col(c) for c in rows.columns]).cache()
    days = [r[0] for r in rows.select("as_of").distinct().orderBy("as_of").limit(4).collect()]
    path = str(tmp_path / "ledger")
    ledger.append(rows.where(F.col("as_of").isin(days[:2])), path)
    ledger.append(rows.where(F.col("as_of").isin(days[1:])), path)
    assert sorted(p.name for p in (tmp_path / "ledger").glob("day=*")) == [f"day={d}" for d in days]
    want = ledger.first_logged(rows.where(F.col("as_of").isin(days)))
    assert ledger.read(spark, path).count() == want.count()
    # another writer's copy of the lines changes no record
    twice = str(tmp_path / "twice")
    for _ in range(2):
        ledger.read(spark, path).write.mode("append").json(twice)
    assert ledger.records(spark, twice).count() == want.count()


def test_circular_blocks_against_a_loop(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(stats, "CHUNK", 7)
    rng = np.random.default_rng(2)
    series = {"a": 23, "b": 3, "c": 1, "d": 10}
    rows = [(k, 9000 * p if k == "a" else p, float(rng.normal())) for k, n in series.items() for p in range(n)]
    got = {(r["b"], r["key"]): r["total"] for r in stats.circular_blocks(spark.createDataFrame(rows, "key string, pos int, value double"), 5, 6, "s").collect()}
    want = {}
    for k, n in series.items():
        v = [x for q, _, x in rows if q == k]
        for b in range(6):
            blocks = -(-n // 5)
            starts = [int(hashlib.md5(f"s:{k}:{b}:{j}".encode()).hexdigest()[:8], 16) % n for j in range(blocks)]
            want[b, k] = sum(v[(s + o) % n] for j, s in enumerate(starts) for o in range(min(5, n - 5 * j)))
    assert got == pytest.approx(want)


def test_feeds_and_wires_know_all_entities(spark):
    from html import unescape
    from html.entities import html5

    from barline.operators import news

    titles = [f"a &{n} b" for n in html5] + ["It&#8217;s", "x &mdash; y", "caf&eacute;", "&#x1F600;!", "&#128;", "&#0;", "&amp;lt;", "&unknown; &", "\u2003lead\xa0", "&nbsp;x&nbsp;"]
    want = sorted(unescape(t).strip() for t in titles if unescape(t).strip())
    feed = spark.createDataFrame([("f", 0, t, f"<b>s</b>\u2003 {t}", 0.0, None) for t in titles], "feed string, pos int, title string, summary string, published double, updated double")
    got = news.parse_feed(feed).collect()
    assert sorted(r["title"] for r in got) == want
    assert sorted(r["summary"] for r in got) == sorted(" ".join(unescape(f" s  {t}").split())[:300] for t in titles if unescape(t).strip())
    import json

    wire = spark.createDataFrame([(json.dumps({"title": t}),) for t in titles], "json string")
    assert sorted(r["title"] for r in news.parse_wire(wire).collect()) == sorted(unescape(t.strip()) for t in titles)


def test_company_matching_by_brute_force(spark, monkeypatch):
    import re

    from barline.functions import text
    from barline.operators import news

    companies = [("AB", "The Big Company"), ("CD", "Big"), ("E", "Foo-Bar Ltd."), ("FG", "+Plus"), ("HI", r"Odd\\Ename"), ("JK", "!!!"), ("AB", "Second Name"), ("LM", None)]
    titles = ["The Big news", "Big AB day", "Foo-Bar up, Foo down", "a+Plus b", r"an Odd\\Ename here", "nothing", "", "AB AB Big The Big", None, "CDs", "Second Name AB"]
    rows = [(i, t) for i, t in enumerate(titles)] + [(1, "Big AB day")]
    a, c = spark.createDataFrame(rows, "article_id int, title string"), spark.createDataFrame(companies, "ticker string, name string")
    common = {(r["ticker"], r["name"]): r["n"] for r in c.select("ticker", "name", text.company_name(F.col("name")).alias("n")).collect()}

    def hit(t, w, least):
        return t is not None and len(w) >= least and re.search(rf"\b{re.escape(w)}\b", t) is not None

    want = sorted((i, x) for i, t in rows for x, n in companies if hit(t, common[x, n], 3) or hit(t, x, 2))
    for bound in (100_000, 0):
        monkeypatch.setattr(news, "BROADCAST_COMPANIES", bound)
        assert sorted((r["article_id"], r["ticker"]) for r in news.match_companies(a, c).collect()) == want
