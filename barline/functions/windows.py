"""Window helpers.  All share one window per ticker, so one exchange and sort serve them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_ticker():
    return Window.partitionBy("ticker").orderBy("dt")


def lag(c, k: int = 1) -> Column:
    return F.lag(c, k).over(by_ticker())


def lead(c, k: int) -> Column:
    return F.lead(c, k).over(by_ticker())


def full(agg, c, n: int) -> Column:
    """``agg`` over the last ``n`` rows, null until all of them have a value."""
    w = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(w) == n, agg(c).over(w))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def logit(p: Column) -> Column:
    q = clip(p, 0.03, 0.97)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def draw(*parts) -> Column:
    """A reproducible 32-bit number from md5, equal in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def magnitude(x) -> Column:
    """A bucket that rises with the number, fine near zero, at most some 90,000 of them; NaN comes last."""
    x = F.lit(x) if not isinstance(x, Column) else x
    step = F.signum(x) * F.floor(F.least(F.log1p(F.abs(x)), F.lit(720.0)) * 64)
    return F.when(F.isnan(x), F.lit(1 << 20)).otherwise(step).cast("int")


def placed(df: DataFrame, name: str, bucket: Column, *order) -> DataFrame:
    """Adds ``name``: each row's place, from 1, in the order of ``bucket``, then ``order``.

    Only the number of rows per bucket is summed up in one window; rows are numbered bucket by bucket,
    so no task sorts the table.
    """
    df = df.withColumn("__bucket", bucket)
    per = df.groupBy(F.col("__bucket").alias("__b")).count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.join(per.select("__b", before.alias("__before")), F.col("__bucket").eqNullSafe(F.col("__b")))
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return df.withColumn(name, place).drop("__bucket", "__b", "__before")
