"""Incremental forms: event dedup, exactly-once ledger appends and delayed grading."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.operators import ledger

EVENT_KEY = ["user_id", "day", "event_type"]


def with_day(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("day", F.col("ts").cast("date"))


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return with_day(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def dedup_stream(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """One event per (user, day, type); state is dropped once the watermark has passed it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(EVENT_KEY)


def dedup_batch(events: DataFrame) -> DataFrame:
    rest = [c for c in events.columns if c not in EVENT_KEY]
    return events.groupBy(*EVENT_KEY).agg(F.min(F.struct("ts", "event_id", *(c for c in rest if c not in ("ts", "event_id", "props")), "props")).alias("e")).select(*EVENT_KEY, "e.*")


def ledger_sink(predictions: DataFrame, path: str, checkpoint: str):
    """Appends each record once: a replayed batch finds its keys in the ledger."""
    return predictions.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: ledger.append(batch, path)).start()


GRADED = "ticker string, as_of date, horizon_days int, resolved_on date, end_price double, outcome_up boolean"
#: Bars of a ticker that are kept, for predictions that come late.
KEEP_BARS = 300


def grade_stream(rows: DataFrame, keep_bars: int = KEEP_BARS) -> DataFrame:
    """(ticker, dt, kind, close, horizon_days) -> graded records as their h-th later bar arrives.

    kind is ``bar`` or ``prediction``.  A prediction belongs to the bar of its day, whichever comes
    first, and is graded from that bar's close and the h-th bar after it.  One whose day is older
    than the last ``keep_bars`` bars, or has a later bar but none of its own, can't be graded: it comes
    out at once with null for what is unknown.  State per ticker: recent bars, open predictions.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bars = dict(map(tuple, state.get[0])) if state.exists else {}
        waiting = [tuple(p) for p in state.get[1]] if state.exists else []
        for r in pd.concat(list(batches)).itertuples():
            if r.kind == "bar":
                bars[r.dt] = float(r.close)
            else:
                waiting.append((r.dt, int(r.horizon_days)))
        days, out, left = sorted(bars), [], []
        place = {d: k for k, d in enumerate(days)}
        for day, h in sorted(waiting):
            k = place.get(day)
            if k is None and days and days[-1] > day:
                out.append((key[0], day, h, None, None, None))
            elif k is None or k + h >= len(days):
                left.append((day, h))
            else:
                end = bars[days[k + h]]
                out.append((key[0], day, h, days[k + h], end, end > bars[day]))
        # a bar that an open prediction starts from stays, with all after it
        first = min([len(days) - keep_bars, *(place[d] for d, _ in left if d in place)])
        state.update(([(d, bars[d]) for d in days[max(0, first) :]], left))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in GRADED.split(", ")])

    held = "bars array<struct<dt:date,close:double>>, waiting array<struct<as_of:date,h:int>>"
    return rows.groupBy("ticker").applyInPandasWithState(step, GRADED, held, "append", GroupStateTimeout.NoTimeout)


def ewm_stream(values: DataFrame, alpha: float) -> DataFrame:
    """(key, ts, value) -> (key, n, ewm): the running exponential average per key, continued across batches."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, y = state.get if state.exists else (0, None)
        for v in pd.concat(list(batches)).sort_values("ts")["value"]:
            y = float(v) if y is None else (1 - alpha) * y + alpha * float(v)
            n += 1
        state.update((n, y))
        yield pd.DataFrame([(key[0], n, y)], columns=["key", "n", "ewm"])

    return values.groupBy("key").applyInPandasWithState(step, "key string, n long, ewm double", "n long, ewm double", "update", GroupStateTimeout.NoTimeout)
