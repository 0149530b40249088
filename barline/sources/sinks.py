"""Result sinks: CSV rows, JSON documents and the last payload rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.windows import finite
from barline.sources.tables import last_rows


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row; nested columns stay nested."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def history_payload(ind: DataFrame, days: int = 260, places: int = 4) -> DataFrame:
    """The last ``days`` sessions of an indicator frame; NaN and infinite values are null."""
    doubles = {c for c, t in ind.dtypes if t == "double"}
    return last_rows(ind, days).select(*(F.round(finite(F.col(c)), places).alias(c) if c in doubles else F.col(c) for c in ind.columns))
