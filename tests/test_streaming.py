import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators import ledger
from barline.streaming import streams, tick


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_dedup_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path / "in")
    events.repartitionByRange(3, "ts").write.parquet(path)
    got = drain(streams.dedup_stream(streams.read_events(spark, path, events.schema), "40 days"), "dedup")
    keys = lambda d: sorted(map(tuple, d.select("user_id", F.col("day").cast("string"), "event_type").collect()))
    assert keys(got) == keys(streams.dedup_batch(streams.with_day(events)))


def test_ledger_sink_appends_once(spark, tmp_path):
    rows = [("T", dt.date(2020, 1, d), 5, 0.6, str(n)) for n in (1, 2) for d in (1, 2, 3)]
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "ticker string, as_of date, horizon_days int, p_up double, logged_at string"
    spark.createDataFrame(rows, schema).write.json(src)
    for k in range(2):
        streams.ledger_sink(spark.readStream.schema(schema).json(src), out, str(tmp_path / f"cp{k}")).awaitTermination(120)
    got = ledger.read(spark, out)
    assert got.count() == 3 and {r["logged_at"] for r in got.collect()} == {"1"}


def graded(spark, tmp_path, name, parts, **kw):
    path = str(tmp_path / "in")
    schema = "ticker string, dt date, kind string, close double, horizon_days int"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return sorted(((r["as_of"], r["horizon_days"], r["resolved_on"], r["end_price"], r["outcome_up"]) for r in drain(streams.grade_stream(stream, **kw), name).collect()), key=lambda r: r[:2])


DAYS = [dt.date(2020, 1, d) for d in range(1, 21)]
BARS = [("T", d, "bar", 100.0 + i * (-1) ** (i // 5), None) for i, d in enumerate(DAYS)]
CLOSE = {b[1]: b[3] for b in BARS}


def prediction(k, h):
    return ("T", DAYS[k], "prediction", None, h)


def test_delayed_grading(spark, tmp_path):
    got = graded(spark, tmp_path, "graded", (BARS[:4] + [prediction(0, 3)], BARS[4:10] + [prediction(8, 3)]))
    assert got == [(DAYS[0], 3, DAYS[3], CLOSE[DAYS[3]], True)]


def test_late_and_early_predictions_are_graded_from_their_own_day(spark, tmp_path):
    parts = ([prediction(1, 2)], BARS[:6], [prediction(2, 1), prediction(4, 8), prediction(5, 40)], BARS[6:14])
    want = [(DAYS[k], h, DAYS[k + h], CLOSE[DAYS[k + h]], CLOSE[DAYS[k + h]] > CLOSE[DAYS[k]]) for k, h in ((1, 2), (2, 1), (4, 8))]
    assert graded(spark, tmp_path, "graded_late", parts) == want


def test_predictions_that_cannot_be_graded_come_out(spark, tmp_path):
    parts = (BARS[:3] + BARS[4:12], [prediction(3, 2), prediction(0, 2), prediction(10, 1)], BARS[12:])
    got = graded(spark, tmp_path, "graded_never", parts, keep_bars=4)
    assert got[:2] == [(DAYS[0], 2, None, None, None), (DAYS[3], 2, None, None, None)]
    assert got[2:] == [(DAYS[10], 1, DAYS[11], CLOSE[DAYS[11]], CLOSE[DAYS[11]] > CLOSE[DAYS[10]])]


def test_tick_retries_waits_and_goes_on():
    calls, waits = [], []

    def snapshot(g):
        calls.append(g)
        if g == "bad" or calls.count(g) < 3 and g == "flaky":
            raise ValueError(g)

    done, learned = tick.tick(["good", "flaky", "bad"], snapshot, lambda: "w", sleep=waits.append)
    assert (done, learned, calls.count("flaky"), calls.count("bad"), waits) == (2, "w", 3, 3, [3.0, 6.0, 3.0, 6.0])
    with pytest.raises(RuntimeError):
        tick.tick(["bad"], snapshot, lambda: None, sleep=waits.append)
    state = iter([1, 0, 2])
    assert tick.run_ticks(lambda: 1 / next(state), 600, rounds=3, sleep=waits.append) == 1 and waits[-2:] == [600, 600]


def test_running_average_continues(spark, tmp_path):
    path = str(tmp_path / "in")
    schema = "key string, ts timestamp, value double"
    rows = [("a", dt.datetime(2020, 1, 1, 0, i), float(i * i)) for i in range(20)]
    for part in (rows[:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    got = drain(streams.ewm_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), 0.2), "ewm", "update")
    want = pd.Series([r[2] for r in rows]).ewm(alpha=0.2, adjust=False).mean().iloc[-1]
    assert abs(got.orderBy(F.desc("n")).first()["ewm"] - want) < 1e-9
