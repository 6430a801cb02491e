"""The joined portfolio market data that the analytics start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.temporal import asof_join


def portfolio_market_data(portfolio: DataFrame, holdings: DataFrame, securities: DataFrame, market_data: DataFrame, fundamentals: DataFrame | None = None, metric: str | None = None, by: list[str] | None = None) -> DataFrame:
    """portfolio, holdings, securities and market data joined on their keys, with the fundamentals known on each date.

    Holdings without a price are left out. Vendor columns are named by their table. Catalyst broadcasts portfolio
    or securities where their size allows it; holdings and market data meet on security and date. by: the columns that all
    tables but the portfolios share, security_id alone by default."""
    by = by or ["security_id"]
    held = holdings.join(portfolio, "port_id").join(securities.withColumnRenamed("source_vendor", "security_source_vendor"), by)
    quoted = held.join(market_data, [*by, "as_of_date"]).withColumn("as_of_date", F.to_date("as_of_date"))
    quoted = quoted.where("as_of_date is not null")
    if fundamentals is None:
        return quoted
    known = fundamentals.where(F.col("effective_date").isNotNull() & F.col("security_id").isNotNull())
    if metric is not None:
        known = known.where(F.col("metric_type") == metric)
    values = fundamental_names(known, quoted, by)
    return asof_join(quoted, known, by, "as_of_date", "effective_date", values, [c for c in ("end_date",) if c in known.columns])


def fundamental_names(fundamentals: DataFrame, quoted: DataFrame, by: list[str]) -> dict[str, str]:
    """The columns that fundamentals add to quoted rows, with their names there."""
    return {c: ("fundamental_source_vendor" if c == "source_vendor" else c) for c in fundamentals.columns if c not in by and (c == "source_vendor" or c not in quoted.columns)}
