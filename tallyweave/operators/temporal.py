"""Joins and grids over time: as-of join, date spines, interval expansion, forward fill."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tallyweave.functions.scalar import is_business_day
from tallyweave.staging import written

#: Groups that rows without a key are dealt to.
NULL_GROUPS = 1 << 16


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: dict[str, str], tie_break: list[str] | None = None, period: str | None = None) -> DataFrame:
    """left with, for each row, the values of the last right row of its key that is not later. Keeps all left rows.

    Both sides go into one window by key, right rows before left rows of the same time, and the last non-null
    struct is carried forward: one shuffle, no product of the sides. Among right rows of one time the last by
    `tie_break` wins. values: {right column: output name}. Null keys and null times match nothing; such left rows
    are dealt by a hash, so that they do not meet in one task, and such right rows are left out.

    period (day, hour, …, as of date_trunc) is for keys that hold a large share of the rows: windows are then by key
    and period, so a key is as many tasks as it has periods. Rows without a hit in their own period take the last one
    of an earlier period, from a table of one row for each key and period."""
    known = F.col("_t").isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    picked = F.struct(F.lit(True).alias("hit"), *[F.col(c).alias(n) for c, n in values.items()])
    ties = F.struct(*[F.col(c) for c in tie_break or []]) if tie_break else F.lit(None).cast("string")
    ends = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), ties.alias("_tie"), picked.alias("_pick")).where(known)
    plain = [F.col(f.name) for f in left.schema if not isinstance(f.dataType, (MapType, ArrayType, StructType))]
    begins = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.xxhash64(*plain).alias("_hash"))
    begins = begins.withColumn("_salt", F.when(known, F.lit(0)).otherwise(F.pmod(F.col("_hash"), F.lit(NULL_GROUPS)))).drop("_hash")
    both = begins.unionByName(ends.withColumn("_salt", F.lit(0).cast("long")), allowMissingColumns=True)
    parts = [*by, "_salt"]
    if period:
        parts, both = [*parts, "_period"], both.withColumn("_period", F.date_trunc(period, F.col("_t").cast("timestamp")))
    order = Window.partitionBy(*parts).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_pick", F.last("_pick", ignorenulls=True).over(order)).where("_side = 1")
    if period:
        lasts = both.where(known & F.col("_period").isNotNull()).groupBy(*parts).agg(F.max_by(F.when(F.col("_side") == 0, F.col("_pick")), F.when(F.col("_side") == 0, F.struct("_t", "_tie"))).alias("_last"))
        before = Window.partitionBy(*by).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
        carried = lasts.select(*parts, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        out = out.join(carried, parts, "left").withColumn("_pick", F.coalesce("_pick", "_carried"))
    found = [F.when(known, F.col("_pick")[n]).alias(n) for n in values.values()]
    return out.select(*[F.col("_row")[c].alias(c) for c in left.columns], *found)


def date_spine(spark: SparkSession, start: dt.date, end: dt.date, inclusive_overrun: bool = False) -> DataFrame:
    """(dt): every day from start to end; with the overrun one day more, as a recursion that tests before it adds."""
    last = end + dt.timedelta(days=int(inclusive_overrun))
    if last < start:
        return spark.createDataFrame([], "dt date")
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(last))).alias("dt"))


def business_days(spark: SparkSession, start: dt.date, end: dt.date, inclusive_overrun: bool = False) -> DataFrame:
    return date_spine(spark, start, end, inclusive_overrun).where(is_business_day(F.col("dt")))


def expand_intervals(intervals: DataFrame, start: dt.date, end: dt.date, start_column: str = "start_date", end_column: str = "end_date") -> DataFrame:
    """A row for each business day of [start, end] on which an interval is open; a null end is open.

    Each interval makes its own days, so there is no join by inequality."""
    low, high = F.greatest(F.col(start_column), F.lit(start)), F.least(F.coalesce(F.col(end_column), F.lit(end)), F.lit(end))
    days = intervals.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    return days.withColumn("dt", F.explode(F.sequence("_low", "_high"))).where(is_business_day(F.col("dt"))).drop("_low", "_high")


def daily_forward_fill(df: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """(key, day, value): every day between a key's own first and last row, with the last non-null value so far.

    Each row fills the days up to the next one, so only the output has a row for each day."""
    order = Window.partitionBy(key).orderBy(day)
    rows = df.select(key, day, F.last(value, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(value), F.lead(day).over(order).alias("_next"))
    until = F.greatest(F.coalesce(F.date_sub("_next", 1), F.col(day)), F.col(day))
    return rows.withColumn(day, F.explode(F.sequence(F.col(day), until))).drop("_next")


def ordered_forward_fill(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with nulls of `columns` filled by the last value before them in one order of all rows, across all keys.

    Rows are dealt by range of the order and written with the number of their range. A window fills within a range, and what
    each range hands on is one row, so the order of all ranges is put together from as many rows as there are ranges."""
    held = written(df.repartitionByRange(*order).withColumn("_fill_range", F.spark_partition_id()), "fill-ranges")
    so_far = Window.partitionBy("_fill_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lasts = held.groupBy("_fill_range").agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(f"_filled_{c}") for c in columns])
    before = Window.orderBy("_fill_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_fill_range", *[F.last(f"_filled_{c}.v", ignorenulls=True).over(before).alias(f"_filled_{c}") for c in columns])
    filled = held.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns}).join(carried, "_fill_range", "left")
    return filled.withColumns({c: F.coalesce(c, f"_filled_{c}") for c in columns}).select(*df.columns)


def holdings_on(days: DataFrame, securities: DataFrame, quantity: Column) -> DataFrame:
    """Every security on every day with a quantity. Days are a calendar, a row each, so each security makes its own."""
    listed = [r[0] for r in days.select("as_of_date").distinct().orderBy("as_of_date").collect()]
    return securities.withColumn("as_of_date", F.explode(F.lit(listed).cast("array<date>"))).withColumn("held_shares", quantity)
