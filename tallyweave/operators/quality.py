"""Data-quality reports as rows, each from one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tallyweave.functions.scalar import clean_symbol, number
from tallyweave.schemas import POSITIONS


def position_issues(positions: DataFrame) -> tuple[bool, list[str]]:
    """Whether broker positions are valid, and what is wrong with them. Zero positions count as an issue."""
    issues = []
    if missing := [c for c in POSITIONS.names if c not in positions.columns]:
        issues.append(f"Missing required columns: {missing}")
    if "held_shares" not in positions.columns:
        raise KeyError("held_shares")
    has_symbol = "symbol" in positions.columns
    n, symbols, held, zero = positions.agg(
        F.count("*"),
        F.count_if(F.col("symbol").isNull()) if has_symbol else F.lit(0),
        F.count_if(F.col("held_shares").isNull()),
        F.count_if(number(F.col("held_shares")) == 0),
    ).first()
    if n == 0:
        return False, [*issues, "DataFrame is empty"]
    issues += [f"Found {k} null values in critical column '{c}'" for c, k in (("symbol", symbols), ("held_shares", held)) if k]
    if zero:
        issues.append(f"Found {zero} positions with zero shares")
    kinds = {f.name: f.dataType for f in positions.schema}
    issues += [f"'{c}' column is not numeric" for c in ("held_shares", "avg_cost") if c in kinds and not isinstance(kinds[c], NumericType)]
    return not issues, issues


def issue_rows(positions: DataFrame) -> DataFrame:
    """(issue) rows for positions; none if they are valid."""
    return positions.sparkSession.createDataFrame([(x,) for x in position_issues(positions)[1]], "issue string")


def without_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns that are null in every row, found in one pass; an empty table keeps all of them."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] or not counts["_rows"]])


def clean_positions(positions: DataFrame) -> DataFrame:
    """Symbols trimmed in upper case, numbers as doubles (null if they are none); zero rows stay."""
    rules = {"symbol": clean_symbol(F.col("symbol")), "held_shares": number(F.col("held_shares")), "avg_cost": number(F.col("avg_cost"))}
    return positions.withColumns({c: rule for c, rule in rules.items() if c in positions.columns})


def position_report(positions: DataFrame) -> DataFrame:
    """(check, n) for positions."""
    checks = {"rows": F.count("*"), "null_symbol": F.count_if(F.col("symbol").isNull()), "null_held_shares": F.count_if(F.col("held_shares").isNull()), "zero_held_shares": F.count_if(F.col("held_shares") == 0)}
    return positions.agg(*[c.alias(n) for n, c in checks.items()]).unpivot([], list(checks), "check", "n")


def market_report(market_data: DataFrame) -> DataFrame:
    """One row: rows, securities, dates, nulls, zero volumes, closes that are not positive, range and mean of close."""
    return market_data.agg(
        F.count("*").alias("n_rows"),
        F.count_distinct("security_id").alias("n_securities"),
        F.count_distinct("as_of_date").alias("n_dates"),
        F.count_if(F.col("close").isNull()).alias("n_null_close"),
        F.count_if(F.col("volume").isNull()).alias("n_null_volume"),
        F.count_if(F.col("volume") == 0).alias("n_zero_volume"),
        F.count_if(F.col("close") <= 0).alias("n_bad_close"),
        F.min("close").alias("min_close"),
        F.max("close").alias("max_close"),
        F.avg("close").alias("avg_close"),
    )


def missing_report(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that were asked for and not delivered."""
    return wanted.select(key).where(f"{key} is not null").distinct().join(found.select(key).distinct(), key, "left_anti")


def completion_rate(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """One row: wanted, found, percent of the wanted keys that are found."""
    have = found.select(key).distinct().withColumn("_found", F.lit(1))
    both = wanted.select(key).distinct().join(have, key, "left")
    return both.agg(F.count("*").alias("wanted"), F.count("_found").alias("found")).withColumn("percent", F.coalesce(F.try_divide(F.col("found") * 100.0, F.col("wanted").cast("double")), F.lit(0.0)))


def prefix_histogram(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """The most frequent first characters; ties by character."""
    return df.groupBy(F.substring(column, 1, 1).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "prefix").limit(top)
