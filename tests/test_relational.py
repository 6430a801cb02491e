"""Reads and loads of a relational server, on an embedded database."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyweave.plans.served import embedded, served_lines
from tallyweave.sources.relational import Relational, connection_lost, ranges, with_retries
from tallyweave.sources.tables import Store

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(400)]
SCHEMA = "k long, d date, x double, s string"


def served(spark, rows, types="s varchar(20)"):
    server = Relational(spark, embedded(spark))
    df = spark.createDataFrame(rows, SCHEMA)
    server.create("t", df, types)
    server.append("t", df)
    return server


def test_parts_hold_each_row_once(spark):
    rows = [(k, D[0] if k % 3 == 0 else D[k % 400] if k % 50 else None, k / 7, "a") for k in range(900)] + [(None, D[0], None, "n"), (-5, D[399], 1.0, "b")]
    server = served(spark, rows)
    for split, spread, least in (("d", "k", 8), ("k", None, 5), ("x", "k", 5), ("d", None, 4)):
        df = server.read("t", split, spread, rows_a_part=100)
        assert df.rdd.getNumPartitions() >= least
        assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows, key=repr)
        sizes = [len(x) for x in df.rdd.glom().collect()]
        assert max(sizes) <= (250 if spread or split != "d" else 350)


def test_empty_and_single_values(spark):
    for rows in ([], [(1, None, None, "n")], [(7, D[3], 2.5, "z")] * 5):
        server = served(spark, rows)
        for split in ("k", "d", "x"):
            assert sorted(map(tuple, server.read("t", split, "k", 2).collect()), key=repr) == sorted(rows, key=repr)


def test_filters_and_columns_reach_the_parts(spark, sf):
    df = served_lines(spark, sf).read("lines", "l_shipdate", rows_a_part=1000).where("l_quantity > 30 and l_returnflag = 'R'").select("l_orderkey")
    assert df.rdd.getNumPartitions() > 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(L_QUANTITY,30.0)" in plan.replace("l_quantity", "L_QUANTITY") and "EqualTo" in plan and "ReadSchema: struct<L_ORDERKEY" in plan.replace("l_orderkey", "L_ORDERKEY")


def test_ranges_are_even():
    parts = ranges([(0, 5), (1, 5), (2, 100), (3, 1), (5, 2)], 10, 2, 10)
    assert parts == [(None, 14, 10), (14, 16, 100), (16, None, 3)]


def test_a_load_is_whole(spark):
    server = served(spark, [(1, D[0], 1.0, "a")])
    rows = spark.createDataFrame([(2, D[1], 2.0, "b"), (2, D[1], 2.0, "b")], SCHEMA)
    server.append("t", rows)
    assert server.read("t").count() == 3  # equal rows are two
    with pytest.raises(Exception):
        server.append("t", rows.withColumn("s", F.lit("longer than the column's twenty letters")))
    assert server.read("t").count() == 3
    tables = server.query("select count(*) as n from sys.systables where tablename like '%LOAD%'")
    assert tables[0][0] == 0


def test_rows_written_twice_count_once(spark):
    server = served(spark, [(1, D[0], 1.0, "a")])
    own_query = server.query

    def query(sql):
        if "count(distinct load_row)" in sql:  # the load's table as a task that ran twice leaves it
            own = sql.split()[-1]
            server.execute(f"insert into {own} select * from {own}")
        return own_query(sql)

    server.query = query
    server.append("t", spark.createDataFrame([(2, D[1], 2.0, "b"), (2, D[1], 2.0, "b"), (3, None, None, "n")], SCHEMA))
    assert sorted(r["K"] if "K" in r else r["k"] for r in (x.asDict() for x in server.read("t").collect())) == [1, 2, 2, 3]


def test_replace_takes_null_as_a_value(spark):
    server = served(spark, [(1, D[0], 1.0, "a"), (2, D[0], 1.0, "b"), (3, None, 1.0, "c"), (4, D[1], 1.0, "d")])
    server.replace("t", spark.createDataFrame([(9, D[0], 5.0, "n"), (8, None, 5.0, "m")], SCHEMA), "d")
    assert sorted(r[0] for r in server.read("t").collect()) == [4, 8, 9]
    server.replace("t", spark.createDataFrame([(7, D[1], 5.0, "n")], SCHEMA), "d")
    assert sorted(r[0] for r in server.read("t").collect()) == [7, 8, 9]


def test_only_connection_errors_are_tried_again(spark):
    class Java:
        def __init__(self, name, state=None, cause=None):
            self.name, self.state, self.cause = name, state, cause

        def getClass(self):
            return self

        def getName(self):
            return self.name

        def getSQLState(self):
            return self.state

        def getCause(self):
            return self.cause

    def error(java):
        e = RuntimeError()
        e.java_exception = java
        return e

    assert connection_lost(error(Java("org.apache.spark.SparkException", cause=Java("java.sql.SQLException", "08001"))))
    assert connection_lost(error(Java("java.net.ConnectException"))) and connection_lost(ConnectionResetError())
    assert not connection_lost(error(Java("java.sql.SQLSyntaxErrorException", "42X05"))) and not connection_lost(ValueError())
    calls = []

    def lost():
        calls.append(1)
        raise error(Java("java.sql.SQLTransientConnectionException", "08006"))

    with pytest.raises(RuntimeError):
        with_retries(lost, wait_minutes=0)
    assert len(calls) == 3
    server = Relational(spark, embedded(spark))
    with pytest.raises(Exception) as found:
        server.read("absent")
    assert not connection_lost(found.value)


def test_a_store_loads_where_it_reads(spark, tmp_path):
    rows = spark.createDataFrame([(D[0], 1, 2.0)], "as_of_date date, security_id long, close double")
    spark.sql("drop table if exists market_data")
    spark.sql("create table market_data (as_of_date date, security_id bigint, close double, volume bigint) using parquet")
    store = Store(spark)
    store.append("market_data", rows)
    assert [tuple(r) for r in store.table("market_data").collect()] == [(D[0], 1, 2.0, None)]
    with pytest.raises(ValueError):
        store.replace_partitions("market_data", rows, "as_of_date")
    spark.sql("drop table market_data")
