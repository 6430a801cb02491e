"""The co-bucketed store: equal to the plain operator, no exchange between its tables, loads in parts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators.portfolio import portfolio_market_data
from tallyweave.sources.buckets import Bucketed
from tallyweave.staging import written

FIRST = dt.date(2023, 11, 20)


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    day = lambda k: FIRST + dt.timedelta(days=k)
    portfolio = written(spark.createDataFrame([(p, f"P{p}", f"Port {p}", "Portfolio") for p in range(1, 4)], "port_id long, portfolio_short_name string, portfolio_name string, portfolio_type string"), "portfolio")  # of known size
    # security 1 holds a third of all holdings; one is without a date, one without a security
    held = [(day(k), 1 + rnd.randrange(3), 1 if rnd.random() < 0.33 else 2 + rnd.randrange(20), float(k)) for k in range(120) for _ in range(12)]
    holdings = spark.createDataFrame([*held, (None, 1, 1, 1.0), (day(3), 1, None, 1.0)], "as_of_date date, port_id long, security_id long, held_shares double")
    securities = spark.createDataFrame([(s, f"S{s}", "A") for s in range(1, 20)], "security_id long, symbol string, source_vendor string")
    prices = spark.createDataFrame([(day(k), s, k + s / 100) for k in range(120) for s in range(1, 23) if (k + s) % 7], "as_of_date date, security_id long, close double")
    # facts long before the first month, several in one, equal times that end_date orders, none at all for some
    facts = [(s, float(100 * s + k), "F", day(k), day(k + 30) if k % 2 else None) for s in range(1, 15) for k in (-400, -3, 11, 14, 40, 77) if (s + k) % 3]
    facts += [(1, 5.5, "F", day(40), day(99)), (2, 6.5, "F", None, None)]
    fundamentals = spark.createDataFrame(facts, "security_id long, shares double, source_vendor string, effective_date date, end_date date")
    return portfolio, holdings, securities, prices, fundamentals


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, df.select(*columns).collect()))


def test_bucketed_equals_the_operator(spark, tables, tmp_path):
    portfolio, holdings, securities, prices, fundamentals = tables
    store = Bucketed(spark, f"file://{tmp_path}/store", buckets=6)
    for part in ("as_of_date < date '2023-12-15'", "as_of_date between date '2023-12-15' and date '2024-01-20'", "as_of_date > date '2024-01-20' or as_of_date is null"):
        store.load(holdings.where(part), prices.where(part), securities, fundamentals)
    days = F.col("as_of_date").between(dt.date(2023, 12, 5), dt.date(2024, 2, 10))
    got = store.portfolio_market_data(portfolio, "2023-12-05", "2024-02-10")
    assert got.count() > 300
    assert rows(got) == rows(portfolio_market_data(portfolio, holdings.where(days), securities, prices.where(days), fundamentals))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("BroadcastExchange") == 1  # the portfolios
    spread = holdings.where("security_id = 1").select(F.trunc("as_of_date", "month").alias("m")).distinct().count()
    assert store.table("securities").where("security_id = 1").count() == spread - 1  # without the row that has no date
    store.drop()
    assert not spark.catalog.tableExists(f"{store.name}_holdings")


def test_bucketed_without_rows(spark, tables, tmp_path):
    portfolio, holdings, securities, prices, fundamentals = tables
    store = Bucketed(spark, f"file://{tmp_path}/empty", buckets=2)
    store.load(holdings.where("false"), prices.where("false"), securities, fundamentals)
    assert store.portfolio_market_data(portfolio, "2023-12-05", "2024-02-10").count() == 0
    store.drop()
