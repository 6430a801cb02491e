"""Exact quantiles of groups of any size: histograms narrow the range of values that holds each wanted rank.

A round counts each group's values in CELLS cells between the ends of the range that is left, where the rows are, by turns
of equal width and of equal width in magnitude; the cell that holds the wanted rank, with the least and greatest value in it, is the next range. It ends when a range holds at
most FEW values, which one window then numbers, or one value alone, however often. So no task holds a group, and no map of
all values is built, as an exact percentile does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.staging import written

CELLS, FEW = 4096, 4096


def _magnitude(x: Column) -> Column:
    """In order of x, with equal steps from one power of two to the next, so that one round finds a value's magnitude."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log2(F.abs(x)) + 1100))


def _half(x: Column) -> Column:
    """Half of x, so that no difference overflows: the ends of a range are in different cells always."""
    return x / 2


def exact_quantiles(df: DataFrame, by: list[str], column: str, at: list[float], cells: int = CELLS, few: int = FEW) -> DataFrame:
    """(by, q, n, value): of each group the quantiles `at`, interpolated between neighbours, and how many values it has.

    Nulls and NaN are no values; a group without values has no rows; a null in `by` is a value like any other."""
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], column, at, cells, few).drop("_all")
    keys = [f"_by{k}" for k in range(len(by))]
    # A null key as an empty string, marked: joins below are on equal keys.
    plain = [F.coalesce(F.col(b).cast("string"), F.lit("")) for b in by]
    marked = [F.concat(F.when(F.col(b).isNull(), "0").otherwise("1"), p) for b, p in zip(by, plain)]
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    rows = written(known.select(*[m.alias(k) for m, k in zip(marked, keys)], F.col(column).cast("double").alias("x")), "quantile-values")
    named = known.select(*by, *[m.alias(k) for m, k in zip(marked, keys)]).distinct()
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    exact = F.col("q") * (F.col("n") - 1)
    wanted = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor(exact), F.ceil(exact)))))
    state = written(wanted.select(*keys, "rank", F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"), "low", "high").distinct(), "quantile-ranges")
    done, scale = [], _magnitude
    while True:
        settled = (F.col("inside") <= few) | (F.col("low") == F.col("high"))
        done.append(state.where(settled))
        state = state.where(~settled)
        if state.isEmpty():
            break
        # Ranks of one group that are in one range are counted once.
        ranges = state.select(*keys, "low", "high", "before").distinct()
        inside = rows.join(ranges, keys).where("x between low and high")
        x, low, high = (scale(F.col(c)) for c in ("x", "low", "high"))
        part = F.when(high > low, (x - low) / (high - low)).otherwise(0.0)
        cell = F.least(F.floor(part * cells), F.lit(cells - 1)).cast("int")
        counts = inside.groupBy(*keys, "low", "before", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("from"), F.max("x").alias("to"))
        so_far = Window.partitionBy(*keys, "low", "before").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        hit = counts.join(state.select(*keys, "low", "before", "rank"), [*keys, "low", "before"]).where("rank >= ahead and rank < ahead + n")
        state = written(hit.select(*keys, "rank", F.col("ahead").alias("before"), F.col("n").alias("inside"), F.col("from").alias("low"), F.col("to").alias("high")), "quantile-ranges")
        scale = _half if scale is _magnitude else _magnitude
    ranges = done[0]
    for more in done[1:]:
        ranges = ranges.unionByName(more)
    one = ranges.where("low = high").select(*keys, "rank", F.col("low").alias("x"))
    left = written(ranges.where("low < high"), "quantile-left")
    spans = left.select(*keys, "low", "high", "before").distinct()
    place = F.row_number().over(Window.partitionBy(*keys, "low", "before").orderBy("x")) + F.col("before") - 1
    numbered = rows.join(spans, keys).where("x between low and high").withColumn("rank", place.cast("long")).select(*keys, "low", "before", "rank", "x")
    found = written(one.unionByName(numbered.join(left.select(*keys, "low", "before", "rank"), [*keys, "low", "before", "rank"]).select(*keys, "rank", "x")), "quantile-ranks")
    pairs = wanted.join(found, [*keys, "rank"]).groupBy(*keys, "q").agg(F.first("n").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
    value = F.col("a") + (F.col("b") - F.col("a")) * (exact - F.floor(exact))
    return pairs.withColumn("value", value).join(named, keys).select(*by, "q", "n", "value")
