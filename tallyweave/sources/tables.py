"""Stored tables: Parquet under one root, a catalog, or JDBC. Filters and columns go down to the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.scalar import parsed_date, snake_case
from tallyweave.schemas import TABLES
from tallyweave.sources.relational import ROWS_A_PART, Relational, with_retries

__all__ = ["SPLITS", "Store", "with_retries"]

#: Of each table: the column by which a server's rows are split into tasks, and one that spreads what has one value there.
SPLITS: dict[str, tuple[str | None, str | None]] = {
    "security_master": ("security_id", None),
    "security_fundamentals": ("effective_date", "security_id"),
    "market_data": ("as_of_date", "security_id"),
    "portfolio": (None, None),
    "portfolio_holdings": ("as_of_date", "security_id"),
    "index_constituents": ("start_date", "security_id"),
}


class Store:
    """The six tables by name: root, a folder of Parquet tables; or jdbc, the options of a relational server, or that server; else the
    session's catalog. Loads go to where the tables are read."""

    def __init__(self, spark: SparkSession, root: str | None = None, jdbc: dict[str, str] | None = None, rows_a_part: int = ROWS_A_PART, server: Relational | None = None):
        self.spark, self.root, self.rows_a_part = spark, root, rows_a_part
        self.server = Relational(spark, jdbc) if jdbc is not None else server

    def _on_server(self, name: str) -> str:
        return f"{'reference' if name == 'index_constituents' else 'dbo'}.{name}"

    def table(self, name: str) -> DataFrame:
        if self.server is not None:
            return self.server.read(self._on_server(name), *SPLITS[name], self.rows_a_part)
        if self.root is not None:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}")
        return self.spark.table(name)

    def security_master(self) -> DataFrame:
        return self.table("security_master")

    def portfolio(self, short_names: list[str]) -> DataFrame:
        """Also inactive portfolios."""
        return self.table("portfolio").select("port_id", "portfolio_short_name", "portfolio_name", "portfolio_type").where(F.col("portfolio_short_name").isin(short_names))

    def portfolio_holdings(self, start: str, end: str) -> DataFrame:
        """Both dates (YYYY-MM-DD) included."""
        return self.table("portfolio_holdings").select("as_of_date", "port_id", "security_id", "held_shares").where(F.col("as_of_date").between(F.lit(parsed_date(start)), F.lit(parsed_date(end))))

    def market_data(self, start: str, end: str) -> DataFrame:
        return self.table("market_data").where(F.col("as_of_date").between(F.lit(parsed_date(start)), F.lit(parsed_date(end))))

    def index_constituents(self, start: str, end: str) -> DataFrame:
        """All rows: the dates are checked and restrict nothing, as intervals of any time may matter."""
        parsed_date(start), parsed_date(end)
        return self.table("index_constituents")

    def security_fundamentals(self, metric_type: str | None = None) -> DataFrame:
        """With a metric, its value column is named after it in snake case."""
        rows = self.table("security_fundamentals")
        if metric_type is None:
            return rows
        return rows.where(F.col("metric_type") == metric_type).withColumnRenamed("metric_value", snake_case(metric_type))

    def portfolio_market_data(self, start: str, end: str, short_names: list[str], metric: str = "sharesOutstanding") -> DataFrame:
        from tallyweave.operators.portfolio import portfolio_market_data

        return portfolio_market_data(self.portfolio(short_names), self.portfolio_holdings(start, end), self.security_master(), self.market_data(start, end), self.security_fundamentals(metric))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows; columns that a table does not have are left out. On a server: all of them or none."""
        rows = rows.select(*[c for c in TABLES[name].names if c in rows.columns])
        if self.server is not None:
            self.server.append(self._on_server(name), rows)
        elif self.root is not None:
            rows.write.mode("append").parquet(f"{self.root}/{name}")
        else:
            missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.spark.table(name).schema if f.name not in rows.columns]
            rows.select("*", *missing).select(*self.spark.table(name).columns).write.insertInto(name)

    def replace_partitions(self, name: str, rows: DataFrame, by: str) -> None:
        """Rewrites only the values of `by` that rows has; rows must hold all of their new content. A folder is rewritten
        in partitions of `by`, a server's rows in one transaction, a catalog's table in its own partitions."""
        if self.server is not None:
            self.server.replace(self._on_server(name), rows.select(*[c for c in TABLES[name].names if c in rows.columns]), by)
            return
        if self.root is None:
            raise ValueError("a catalog's tables are partitioned as they were made; write them by insertInto")
        rows.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.root}/{name}")
