import json
import os

from barline.operators import assess, indicators
from barline.plans import event_queries
from barline.sources import sinks, tables


def test_csv_and_json_round_trip(spark, sf_dir, tmp_path):
    df = tables.quote(tables.bars(spark, sf_dir))
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    sinks.write_json(df, str(tmp_path / "json"))
    lines = [json.loads(x) for f in os.listdir(tmp_path / "json") if f.startswith("part") for x in open(tmp_path / "json" / f)]
    assert {x["ticker"] for x in lines} == {"A", "N", "R"}


def test_history_payload_has_no_nan(spark, sf_dir):
    rows = sinks.history_payload(indicators.indicators(tables.bars(spark, sf_dir)), 30).collect()
    assert len(rows) == 90 and all(v == v for r in rows for v in r)


def test_assessment_payload(spark, sf_dir):
    keys = {"ticker", "as_of", "price", "p_up", "confidence", "direction", "signals", "expected_range", "trade_plan", "news_company", "news_market", "news_politics", "horizon_days"}
    a = event_queries.assessment(spark, sf_dir, 21).cache()
    for r in assess.payload(a).collect():
        d = json.loads(r["json"])
        assert keys <= set(d) and 0.05 <= d["p_up"] <= 0.95 and d["expected_range"]["low"] < d["price"] < d["expected_range"]["high"] and len(d["signals"]) == 7
    from pyspark.sql import functions as F

    assert assess.ledger_rows(a, "1", F.lit("now")).count() == 0


def test_cards_show_the_assessment(spark, sf_dir):
    quotes = tables.quote(tables.bars(spark, sf_dir))
    a = event_queries.assessment(spark, sf_dir, 5).cache()
    whole, quoted = {r["ticker"]: r for r in a.collect()}, {r["ticker"]: r for r in quotes.collect()}
    got = assess.cards(a, quotes).collect()
    assert len(got) == len(whole) == 3
    for r in got:
        w, q = whole[r["ticker"]], quoted[r["ticker"]]
        assert (r["price"], r["change_pct"], r["direction"], r["confidence"], r["news_score"]) == (q["price"], q["change_pct"], w["direction"], w["confidence"], w["news_company"])
        assert abs(r["prob_up"] - w["p_up"]) < 6e-4 and abs(r["tech_score"] - w["tech"]) < 6e-4
        late = w["hit_rate"] is not None and w["hit_rate"] < w["baseline"] - (0.25 / w["effective_n"]) ** 0.5
        assert r["caveat_flag"] == late and (not late or r["confidence"] == "low")
        assert (r["plan"] is None) == (w["trade_plan"] is None)
        if r["plan"]:
            assert (r["plan"]["mode"], r["plan"]["sell_at"], r["plan"]["stop_at"]) == (w["trade_plan"]["mode"], w["trade_plan"]["target"], w["trade_plan"]["stop"])
