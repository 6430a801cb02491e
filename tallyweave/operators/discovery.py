"""Keys of tables from their rows: unique columns and column pairs, and columns whose values another column holds.

All values of all columns are turned around once: each distinct value, with the columns that have it. Rows with equal sets
of columns are counted, so what is left is a table of column sets, as many as differ, whatever the tables' size. A column's
distinct values, and how many of them another column holds, are sums over it. Values are compared within their kind
(whole numbers, other numbers, texts, times).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, FractionalType, IntegralType, StringType, TimestampNTZType, TimestampType

from tallyweave.staging import written


def _kind(kind: DataType) -> str | None:
    kinds = {IntegralType: "whole", FractionalType: "number", StringType: "text", DateType: "time", TimestampType: "time", TimestampNTZType: "time"}
    return next((n for t, n in kinds.items() if isinstance(kind, t)), None)


def column_sets(tables: dict[str, DataFrame]) -> DataFrame:
    """(columns, n): how many distinct values are in exactly these columns, named table.column; nulls are in none."""
    parts = []
    for table, df in tables.items():
        cells = [F.struct(F.lit(f"{table}.{f.name}").alias("name"), F.lit(_kind(f.dataType)).alias("kind"), F.col(f.name).cast("string").alias("value")) for f in df.schema if _kind(f.dataType)]
        parts.append(df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where("value is not null"))
    rows = reduce(DataFrame.unionByName, parts)
    sets = rows.groupBy("kind", "value", "name").agg(F.lit(1).alias("_")).groupBy("kind", "value").agg(F.array_sort(F.collect_set("name")).alias("columns"))
    return sets.groupBy("columns").agg(F.count("*").alias("n"))


def profiles(tables: dict[str, DataFrame], sets: DataFrame | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, rows, nulls, distinct_values) of each column, from one pass a table and the sets."""
    counts = []
    for table, df in tables.items():
        columns = [F.struct(F.lit(table).alias("table_name"), F.lit(k).alias("ordinal"), F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.count("*").alias("rows"), F.count_if(F.col(f.name).isNull()).alias("nulls")) for k, f in enumerate(df.schema)]
        counts.append(df.agg(F.array(*columns).alias("x")).select(F.inline("x")))
    distinct = (sets if sets is not None else column_sets(tables)).select(F.explode("columns").alias("name"), "n").groupBy("name").agg(F.sum("n").alias("distinct_values"))
    rows = reduce(DataFrame.unionByName, counts)
    return rows.join(distinct, F.concat_ws(".", "table_name", "column_name") == F.col("name"), "left").drop("name").na.fill(0, ["distinct_values"])


def inclusions(sets: DataFrame) -> DataFrame:
    """(column, held_by, values): columns all of whose distinct values, one at least, another column has."""
    each = sets.withColumn("column", F.explode("columns"))
    total = each.groupBy("column").agg(F.sum("n").alias("values"))
    both = each.withColumn("held_by", F.explode("columns")).where(F.col("column") != F.col("held_by")).groupBy("column", "held_by").agg(F.sum("n").alias("shared"))
    return both.join(total, "column").where("shared = values").select("column", "held_by", "values")


def unique_columns(profile: DataFrame) -> DataFrame:
    """(table_name, ordinal, column_name) of columns without nulls whose values differ in all rows, of which there is one at least."""
    return profile.where("rows > 0 and nulls = 0 and distinct_values = rows").select("table_name", "ordinal", "column_name")


def unique_pairs(tables: dict[str, DataFrame], profile: DataFrame) -> list[tuple[str, str, str]]:
    """(table, a, b): pairs of columns that are unique together, for tables without a unique column. Pairs that cannot
    have as many different values as there are rows are not counted; the others in one pass a table, by a sketch first."""
    listed = [r.asDict() for r in profile.collect()]  # a row for each column
    out = []
    for table, df in tables.items():
        own = sorted((r for r in listed if r["table_name"] == table), key=lambda r: r["ordinal"])
        rows = own[0]["rows"] if own else 0
        if not rows or any(r["nulls"] == 0 and r["distinct_values"] == rows for r in own):
            continue
        able = [r for r in own if r["nulls"] == 0 and r["distinct_values"] > 1]
        pairs = [(a["column_name"], b["column_name"]) for a, b in combinations(able, 2) if a["distinct_values"] * b["distinct_values"] >= rows]
        if not pairs:
            continue
        about = df.agg(*[F.approx_count_distinct(F.struct(*p), 0.02).alias(str(k)) for k, p in enumerate(pairs)]).first()
        likely = [p for k, p in enumerate(pairs) if about[k] >= 0.85 * rows]
        out += [(table, *p) for p in likely if df.groupBy(*p).agg(F.count("*").alias("n")).where("n > 1").isEmpty()]
    return out


def keys_of(tables: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, list[str]], dict[str, list[str]]]:
    """(profiles, primary, foreign) of tables. A table's primary key is its first unique column, else its first unique pair.
    A foreign key is a column all of whose values the primary key of another table has, under a name that ends like it
    (after the first underscore), as whole numbers from 1 are in many columns that mean nothing to each other."""
    sets = written(column_sets(tables), "column-sets")
    profile = written(profiles(tables, sets), "column-profiles")
    primary: dict[str, list[str]] = {}
    for r in sorted(unique_columns(profile).collect(), key=lambda r: r["ordinal"]):
        primary.setdefault(r["table_name"], [r["column_name"]])
    for table, *pair in unique_pairs(tables, profile):
        primary.setdefault(table, pair)
    single = [f"{t}.{c[0]}" for t, c in primary.items() if len(c) == 1]
    foreign: dict[str, list[str]] = {}
    base = lambda c: c.split(".", 1)[1].split("_", 1)[-1]
    for r in sorted(inclusions(sets).where(F.col("held_by").isin(single)).collect()):
        (table, column), (other, _) = r["column"].split(".", 1), r["held_by"].split(".", 1)
        if table != other and base(r["column"]) == base(r["held_by"]) and column not in foreign.get(table, []):
            foreign.setdefault(table, []).append(column)
    return profile, primary, foreign
