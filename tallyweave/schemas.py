"""Schemas of the six stored tables and of the frames between operators. Every non-key column is nullable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES: dict[str, DataType] = {"long": LongType(), "int": IntegerType(), "double": DoubleType(), "string": StringType(), "date": DateType(), "timestamp": TimestampType()}


def _schema(columns: str) -> StructType:
    """A schema from `name type, …`, without a session."""
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


SECURITY_MASTER = _schema(
    "security_id long, symbol string, name string, isin string, sedol string, cusip string, figi string, loanxid string, country string, currency string, "
    "sector string, industry_group string, industry string, security_type string, asset_class string, exchange string, is_active int, source_vendor string, upsert_date timestamp, upsert_by string"
)
SECURITY_FUNDAMENTALS = _schema("security_id long, metric_type string, metric_value double, source_vendor string, effective_date date, end_date date")
MARKET_DATA = _schema(
    "md_id long, as_of_date date, security_id long, open double, high double, low double, close double, adj_close double, volume long, dividends double, stock_splits double, interval string, dataload_date timestamp"
)
PORTFOLIO = _schema("port_id long, portfolio_short_name string, portfolio_name string, portfolio_type string, is_active int")
PORTFOLIO_HOLDINGS = _schema("ph_id long, as_of_date date, port_id long, security_id long, held_shares double, upsert_date timestamp, upsert_by string")
INDEX_CONSTITUENTS = _schema("constituent_id long, index_id long, security_id long, exchange_ticker string, start_date date, end_date date, source_vendor string, upsert_date timestamp, upsert_by string")
POSITIONS = _schema("as_of_date date, portfolio_short_name string, symbol string, ib_security_type string, ib_exchange string, ib_currency string, held_shares double, avg_cost double")
EOD = _schema("as_of_date date, security_id long, open double, high double, low double, close double, adj_close double, volume long, dividends double, stock_splits double, dataload_date timestamp, interval string")

TABLES = {
    "security_master": SECURITY_MASTER,
    "security_fundamentals": SECURITY_FUNDAMENTALS,
    "market_data": MARKET_DATA,
    "portfolio": PORTFOLIO,
    "portfolio_holdings": PORTFOLIO_HOLDINGS,
    "index_constituents": INDEX_CONSTITUENTS,
}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """df, if it has the columns; else a ValueError that names the missing ones."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
