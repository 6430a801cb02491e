"""Versioned upserts as pure functions (existing, batch) -> new table, and writers that apply them to partitions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.scalar import mapped
from tallyweave.schemas import require
from tallyweave.staging import written

#: Broker codes and what they stand for in the security master.
SECURITY_TYPES = {"STK": "Common Stock", "OPT": "Option", "FUT": "Future", "BOND": "Bond", "CASH": "Cash", "CFD": "CFD"}
ASSET_CLASSES = {"STK": "Equity", "OPT": "Derivatives", "FUT": "Derivatives", "BOND": "Fixed Income", "CASH": "Cash", "CFD": "Derivatives"}
EXCHANGES = {"NASDAQ": "XNAS", "NYSE": "XNYS", "AMEX": "XASE", "SMART": "XNAS", "ISLAND": "XNAS", "ARCA": "ARCX", "BATS": "BATS"}
MISSING_KEYS = ["symbol", "ib_security_type", "ib_exchange", "ib_currency"]


def without_keys(existing: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not among those of another table; a null is a key like any other."""
    gone = keys_of.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    equal = F.lit(True)
    for k in keys:
        equal = equal & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return existing.join(gone, equal, "left_anti")


def replaced_by(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key is not in the batch, and the batch."""
    return without_keys(existing, batch, keys).unionByName(batch, allowMissingColumns=True)


def upsert_market_data(existing: DataFrame, batch: DataFrame, strict: bool = False) -> DataFrame:
    """Replaces by date, security and interval. strict: by date alone, which drops other securities of that date."""
    keys = ["as_of_date"] if strict else [c for c in ("as_of_date", "security_id", "interval") if c in batch.columns and c in existing.columns]
    return replaced_by(existing, batch, keys)


def upsert_index_constituents(existing: DataFrame, batch: DataFrame) -> DataFrame:
    return replaced_by(existing, batch, ["index_id"])


def upsert_holdings(existing: DataFrame, batch: DataFrame, now: dt.datetime, by: str, strict: bool = False) -> DataFrame:
    """Replaces by date and portfolio. strict: only the earliest date of the batch is cleared, for all its portfolios."""
    batch_ = stamped(batch, now, by)
    if not strict:
        return replaced_by(existing, batch_, ["as_of_date", "port_id"])
    first = batch.agg(F.min("as_of_date")).first()[0]
    cleared = batch.select(F.lit(first).cast("date").alias("as_of_date"), "port_id")
    return without_keys(existing, cleared, ["as_of_date", "port_id"]).unionByName(batch_, allowMissingColumns=True)


def stamped(rows: DataFrame, now: dt.datetime | None = None, by: str | None = None) -> DataFrame:
    """rows with the stamps of a load: by default the time of the query and the session's user."""
    return rows.withColumns({"upsert_date": F.lit(now).cast("timestamp") if now else F.current_timestamp(), "upsert_by": F.lit(by) if by else F.session_user()})


def inserted_from(existing: DataFrame, selected: DataFrame, id_column: str, order: list[str], now: dt.datetime | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A table after an insert of selected rows, stamped and with new ids; and the inserted rows themselves, as an
    insert that returns its identities does. Columns that the rows lack are null."""
    new = written(with_new_ids(existing, stamped(selected, now, by), id_column, order), "inserted")
    return existing.unionByName(new, allowMissingColumns=True), new


def upsert_fundamentals(existing: DataFrame, batch: DataFrame, today: dt.date) -> DataFrame:
    """Versions of fundamentals. Active rows are open ones with a security and a metric of the batch (each by itself)
    and the vendor and effective date of the batch's first row by date and vendor (a load has one of each). None
    active: insert open. As many as the batch has: replace them by the batch as it is. Else: close them today and
    insert the batch open. No batch: no change."""
    size, first = batch.agg(F.count("*"), F.min(F.struct("effective_date", "source_vendor"))).first()
    if not size:
        return existing
    first = (first["source_vendor"], first["effective_date"])
    securities, metrics = batch.select("security_id").distinct(), batch.select("metric_type").distinct()
    flagged = (
        existing.join(securities.withColumn("_s", F.lit(True)), "security_id", "left")
        .join(metrics.withColumn("_m", F.lit(True)), "metric_type", "left")
        .withColumn("_active", F.coalesce(F.col("_s") & F.col("_m") & F.col("end_date").isNull() & F.col("source_vendor").eqNullSafe(F.lit(first[0])) & F.col("effective_date").eqNullSafe(F.lit(first[1]).cast("date")), F.lit(False)))
        .select(*existing.columns, "_active")
    )
    active = flagged.where("_active").count()
    opened = batch.withColumn("end_date", F.lit(None).cast("date"))
    if active == 0:
        return existing.unionByName(opened.select(*existing.columns))
    if active == size:
        return flagged.where("not _active").drop("_active").unionByName(batch.select(*existing.columns))
    closed = flagged.withColumn("end_date", F.when(F.col("_active"), F.lit(today)).otherwise(F.col("end_date"))).drop("_active")
    return closed.unionByName(opened.select(*existing.columns))


def with_new_ids(existing: DataFrame, batch: DataFrame, id_column: str, order: list[str]) -> DataFrame:
    """batch with ids after the largest one of existing, in the given order, without a gap.

    The rows are dealt by range and written with the number of the range that holds them, so that counting and
    numbering see the same ranges whatever adaptive execution does. A row's id is the number of rows in the ranges
    before its own, and its place there; no task sees more than one range, and one row a range is summed up."""
    top = existing.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long")).first()[0]
    ranked = written(batch.drop(id_column).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranked.groupBy("_part").agg(F.count("*").alias("_size")).select("_part", (F.coalesce(F.sum("_size").over(before), F.lit(0)) + F.lit(top)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranked.withColumn("_nth", nth).join(bases, "_part").withColumn(id_column, F.col("_base") + F.col("_nth")).drop("_part", "_nth", "_base")


def missing_securities(positions: DataFrame, security_master: DataFrame) -> DataFrame:
    """Positions whose symbol the security master does not have."""
    return positions.join(security_master.select("symbol").where("symbol is not null").distinct(), "symbol", "left_anti")


def new_securities(missing: DataFrame, now: dt.datetime) -> DataFrame:
    """Security master rows (without ids) for the distinct missing positions."""
    rows = require(missing, *MISSING_KEYS).select(*MISSING_KEYS).distinct()
    return rows.select(
        "symbol",
        F.col("symbol").alias("name"),
        F.col("ib_currency").alias("currency"),
        mapped(F.col("ib_security_type"), SECURITY_TYPES, "Common Stock").alias("security_type"),
        mapped(F.col("ib_security_type"), ASSET_CLASSES, "Other").alias("asset_class"),
        mapped(F.col("ib_exchange"), EXCHANGES, "XNAS").alias("exchange"),
        F.lit(1).alias("is_active"),
        F.lit("IB").alias("source_vendor"),
        F.lit(now).cast("timestamp").alias("upsert_date"),
        F.lit("ib_portfolio_loader").alias("upsert_by"),
    )


def insert_missing(security_master: DataFrame, positions: DataFrame, now: dt.datetime) -> DataFrame:
    rows = with_new_ids(security_master, new_securities(missing_securities(positions, security_master), now), "security_id", ["symbol", "security_type", "exchange", "currency"])
    return security_master.unionByName(rows, allowMissingColumns=True)


def activated(security_master: DataFrame, symbols: DataFrame) -> DataFrame:
    """is_active set to 1 for the listed symbols."""
    listed = symbols.select("symbol").distinct().withColumn("_on", F.lit(True))
    return security_master.join(listed, "symbol", "left").withColumn("is_active", F.when(F.col("_on"), 1).otherwise(F.col("is_active"))).select(*security_master.columns)
