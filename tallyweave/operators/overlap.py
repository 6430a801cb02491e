"""Joins of two tables of intervals: pairs that share a moment, without a comparison of all with all.

Time is cut into buckets of the mean length of the shorter side's intervals, or so long that a row is in COPIES buckets and
two more on average. An interval is in each bucket that it touches, and a
pair that shares several buckets is made in one of them, its owner: the bucket in which the later of the two begins. So
the join is one of equal keys and buckets, with a residual test. Buckets cover only the time in which pairs can begin, and rows
outside it go nowhere. A bucket of a key with more than HOT rows of a side is split: the side's rows are dealt to parts, the
other side's rows go to all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.staging import written

#: Rows of a side that one bucket of one key holds in one part.
HOT = 4096
#: Buckets of a row on average, besides those of its ends.
COPIES = 8
#: Buckets that the span of all intervals is cut into at most.
MOST_BUCKETS = 1 << 20
FOREVER = (1 << 62) - 1


def _moment(c: str, kind: str) -> Column:
    """Dates in days, timestamps in microseconds, numbers as they are."""
    if kind == "date":
        return F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")
    return F.unix_micros(F.col(c).cast("timestamp")) if kind.startswith("timestamp") else F.col(c).cast("long")


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_interval: tuple[str, str], right_interval: tuple[str, str], closed: bool = True, hot: int = HOT, width: int | None = None) -> DataFrame:
    """Pairs of rows with equal `by` whose intervals overlap: the columns of left, then of right without `by`.

    Intervals are from start to end, which is included if closed; a null end is open, a null start matches nothing, as does
    an interval that ends before it starts (not closed: that does not end after it starts), and a null key. Columns
    other than `by` must have different names. width: the length of a bucket, else one from the data."""
    if common := {*left.columns} & {*right.columns} - {*by}:
        raise ValueError(f"both sides have {', '.join(sorted(common))}")

    def side(df: DataFrame, interval: tuple[str, str], name: str) -> DataFrame:
        kinds = dict(df.dtypes)
        low, high = _moment(interval[0], kinds[interval[0]]), _moment(interval[1], kinds[interval[1]])
        last = F.coalesce(high, F.lit(FOREVER)) if closed else F.coalesce(high - 1, F.lit(FOREVER))
        rows = df.select(*[F.col(b).alias(f"_by{k}") for k, b in enumerate(by)], low.alias("_from"), last.alias("_to"), F.struct(*[F.col(c) for c in df.columns]).alias(name))
        known = F.col("_from").isNotNull() & (F.col("_to") >= F.col("_from"))
        for k in range(len(by)):
            known = known & F.col(f"_by{k}").isNotNull()
        return rows.where(known)

    sides = [written(side(left, left_interval, "_row"), "intervals-left"), written(side(right, right_interval, "_other"), "intervals-right")]
    spans = [s.agg(F.min("_from"), F.max("_from"), F.max("_to")).first() for s in sides]
    keys = [f"_by{k}" for k in range(len(by))]
    made = [F.col("_row")[c].alias(c) for c in left.columns] + [F.col("_other")[c].alias(c) for c in right.columns if c not in by]
    known = [s for s in spans if s[0] is not None]
    # The later begin of a pair is not before `first` nor after `last`; rows that do not reach there are in no pair.
    first = max((s[0] for s in known), default=0)
    last = min([max((s[1] for s in known), default=0), *(s[2] for s in known)])
    sides = [s.where((F.col("_from") <= F.lit(last)) & (F.col("_to") >= F.lit(first))) for s in sides]
    low, high = F.greatest("_from", F.lit(first)), F.least("_to", F.lit(last))
    if width is None:
        lengths = [s.agg(F.sum((high - low + 1).cast("double")), F.count("*")).first() for s in sides]
        means = [total / n for total, n in lengths if n]
        width = max(min(means, default=1), sum(x[0] or 0 for x in lengths) / (COPIES * max(1, sum(x[1] for x in lengths))))
    width = max(1, round(width), -(-(last - first + 1) // MOST_BUCKETS))
    place = lambda at: F.floor((at - F.lit(first)) / F.lit(width)).cast("long")
    dealt = lambda rows: rows.withColumn("_bucket", F.explode(F.sequence(place(low), place(high))))

    begun, other = (dealt(s.withColumn("_id", F.monotonically_increasing_id())) for s in sides)  # numbers in files
    # Rows of both sides in each bucket that has more than `hot` of one of them: a grid of parts, of at most about `hot` rows of each side.
    counted = [s.groupBy(*keys, "_bucket").agg(F.count("*").alias(name)) for s, name in ((begun, "_n"), (other, "_m"))]
    parts = lambda n: F.ceil(F.col(n) / hot).cast("int")
    crowded = counted[0].join(counted[1], [*keys, "_bucket"]).where((F.col("_n") > hot) | (F.col("_m") > hot)).select(*keys, "_bucket", parts("_n").alias("_parts"), parts("_m").alias("_parts2"))
    crowded = written(crowded, "crowded")  # a row for each `hot` rows at most

    def gridded(rows: DataFrame, own: str, all_of: str, names: tuple[str, str]) -> DataFrame:
        """rows by a part of their own side, once for each part of the other side."""
        rows = rows.join(crowded, [*keys, "_bucket"], "left").withColumn(names[0], F.pmod(F.xxhash64("_id"), F.coalesce(own, F.lit(1))).cast("int"))
        return rows.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.coalesce(all_of, F.lit(1)) - 1))).drop("_parts", "_parts2", "_id")

    begun = gridded(begun, "_parts", "_parts2", ("_part", "_part2"))
    other = gridded(other, "_parts2", "_parts", ("_part2", "_part")).withColumnsRenamed({"_from": "_from2", "_to": "_to2"})
    pairs = begun.join(other, [*keys, "_bucket", "_part", "_part2"]).where((F.col("_from") <= F.col("_to2")) & (F.col("_from2") <= F.col("_to")) & (F.col("_bucket") == place(F.greatest("_from", "_from2"))))
    return pairs.select(*made)
