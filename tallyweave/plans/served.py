"""Queries over a relational server. An embedded database in the session's JVM stands in for it in sessions of one machine, a
database file in the shared folder in others; `Relational` takes any server's options."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.plans import views
from tallyweave.plans.registry import query, rounded
from tallyweave.plans.views import ctes, table
from tallyweave.sources.fileserver import FileServer
from tallyweave.sources.relational import Relational
from tallyweave.sources.tables import Store


def embedded(spark: SparkSession) -> dict[str, str]:
    """Options of a new database in the memory of the session's JVM."""
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def server(spark: SparkSession) -> Relational:
    """A new and empty server that every task of the session reaches."""
    return Relational(spark, embedded(spark)) if spark.sparkContext.master.split("[")[0] == "local" else FileServer(spark)


LINES = ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag"]


def served_lines(spark: SparkSession, sf: str) -> Relational:
    """lineitem on a server, loaded in one transaction."""
    lines, rows = server(spark), table(spark, sf, "lineitem").select(*LINES)
    rows = rows.withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    lines.create("lines", rows, "l_returnflag varchar(1)")
    lines.append("lines", rows)
    return lines


@query("select l_orderkey, l_linenumber, cast(l_shipdate as date) as l_shipdate, l_quantity from lineitem where cast(l_shipdate as date) between date '1994-01-01' and date '1996-06-30' and l_returnflag = 'R'")
def server_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A scan by several tasks, split by date; filters and columns are in each task's query."""
    between = {"l_shipdate": (dt.date(1994, 1, 1), dt.date(1996, 6, 30)), "l_returnflag": ("R", "R")}
    return served_lines(spark, sf).read("lines", "l_shipdate", "l_orderkey", rows_a_part=2000, columns=LINES[:4], between=between)


@query("select l_returnflag, count(*) as n, cast(sum(l_orderkey) as bigint) as orders from lineitem group by l_returnflag")
def server_scan_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """A split by a number with few values, whose large parts are split again by the order's remainder."""
    lines = served_lines(spark, sf).read("lines", "l_linenumber", "l_orderkey", rows_a_part=1500, columns=["l_returnflag", "l_orderkey"])
    return lines.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("orders"))


def _served(spark: SparkSession, **tables: DataFrame) -> Store:
    """A store on a server with these tables."""
    store = Store(spark, server=server(spark), rows_a_part=1000)
    for name, rows in tables.items():
        text = ", ".join(f"{c} varchar(200)" for c, kind in rows.dtypes if kind == "string")
        store.server.create(store._on_server(name), rows, text or None)
        store.append(name, rows)
    return store


@query(
    ctes("portfolio", "market", "market_data")
    + """select as_of_date, security_id, round(close * f, 6) as close, volume from market_data, (values (1.0::double)) x(f) where as_of_date <> date '2024-01-10'
union all select as_of_date, security_id, round(close * 2, 6), volume from market_data where as_of_date = date '2024-01-10' and security_id % 2 = 0
union all select cast(as_of_date + interval 400 day as date), security_id, round(close, 6), volume from market_data where as_of_date = date '2024-01-11'"""
)
def server_store(spark: SparkSession, sf: str) -> DataFrame:
    """Loads of a store on a server: market data, one day of it replaced, another day appended anew."""
    rows = views.market_data(spark, sf)
    store = _served(spark, market_data=rows)
    store.replace_partitions("market_data", rows.where("as_of_date = date '2024-01-10' and security_id % 2 = 0").withColumn("close", F.col("close") * 2), "as_of_date")
    store.append("market_data", rows.where("as_of_date = date '2024-01-11'").withColumn("as_of_date", F.date_add("as_of_date", 400)))
    return rounded(store.table("market_data").select("as_of_date", "security_id", "close", "volume"), "close")


@query(ctes("portfolio", "market", "holdings") + "select as_of_date, port_id, security_id, held_shares from holdings where as_of_date between date '2024-01-05' and date '2024-01-20'")
def server_holdings(spark: SparkSession, sf: str) -> DataFrame:
    return _served(spark, portfolio_holdings=views.holdings(spark, sf)).portfolio_holdings("2024-01-05", "2024-01-20")
