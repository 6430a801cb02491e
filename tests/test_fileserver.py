"""The database file that stands in for a server where a session has several machines."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyweave.sources.fileserver import FileServer
from tests.test_relational import D, SCHEMA

ROWS = [(k, D[0] if k % 3 == 0 else D[k % 400] if k % 50 else None, k / 7, "a") for k in range(900)] + [(None, dt.date(1960, 2, 29), None, None), (-5, D[399], 1.0, "b")]


def served(spark, rows):
    server, df = FileServer(spark), spark.createDataFrame(rows, SCHEMA)
    server.create("dbo.t", df)
    server.append("dbo.t", df)
    return server


def test_parts_hold_each_row_once(spark):
    server = served(spark, ROWS)
    for split, spread in ((None, None), ("d", "k"), ("k", None), ("x", "k"), ("d", None)):
        df = server.read("dbo.t", split, spread, 100)
        assert split is None or df.rdd.getNumPartitions() >= 4
        assert df.schema == spark.createDataFrame([], SCHEMA).schema and sorted(map(tuple, df.collect()), key=repr) == sorted(ROWS, key=repr)
    assert served(spark, []).read("dbo.t", "d", "k", 2).count() == 0


def test_loads_are_whole_and_rows_written_twice_count_once(spark):
    server = served(spark, [(1, D[0], 1.0, "a"), (2, None, 2.0, "b")])
    server.replace("dbo.t", spark.createDataFrame([(9, D[0], 5.0, "n"), (8, None, 5.0, "m"), (8, None, 5.0, "m")], SCHEMA), "d")
    assert sorted(r[0] for r in server.read("dbo.t").collect()) == [8, 8, 9]
    bad = spark.range(10).select(F.col("id").alias("k"), F.lit(None).cast("date").alias("d"), F.lit(0.0).alias("x"), F.expr("if(id = 9, raise_error('no'), 'a')").alias("s"))
    with pytest.raises(Exception):
        server.append("dbo.t", bad)
    own_query = server.query

    def query(sql):
        if "count(distinct load_row)" in sql:  # the load's table as a task that ran twice leaves it
            own = sql.split()[-1]
            server.execute(f"insert into {own} select * from {own}")
        return own_query(sql)

    server.query = query
    server.append("dbo.t", spark.createDataFrame([(3, D[1], 1.0, "c")] * 2, SCHEMA))
    assert sorted(r[0] for r in server.read("dbo.t").collect()) == [3, 3, 8, 8, 9]
    assert own_query("select count(*) from sqlite_master where type = 'table'") == [(1,)]


CLUSTER = """
from pyspark.sql import SparkSession
import __spark_entry__
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map={"spark.executor.memory": "1024m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": "file://%s"}).getOrCreate()
for name in ("server_holdings", "server_scan_by_key"):
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_executors_reach_the_server(tmp_path, duck, sf):
    import __spark_entry__

    root = str(Path(__file__).parent.parent)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    run = subprocess.run([sys.executable, "-c", CLUSTER % tmp_path], env=env | {"PYTHONPATH": root, "SPARK_LOCAL_DIRS": str(tmp_path)}, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    want = [f"{n} {len(duck.sql(__spark_entry__.oracle_sql()[n]).fetchall())}" for n in ("server_holdings", "server_scan_by_key")]
    assert [x for x in run.stdout.splitlines() if x.startswith("server_")] == want, run.stderr[-2000:]


def test_tasks_of_a_load_write_files_of_their_own(spark):
    server, df = FileServer(spark), spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    server.create("t", df)
    server.append("t", df)
    files = [x for x in Path(server.path).parent.iterdir() if x.name != "db"]
    assert len(files) == 4 and sum(n for _, n in server.shards("t")) == len(ROWS)
    before = server.read("t", "d", "k", 50)
    server.append("t", spark.createDataFrame([(7, D[0], 1.0, "z")], SCHEMA).coalesce(1))
    server.replace("t", spark.createDataFrame([(8, dt.date(1960, 2, 29), 1.0, "y")], SCHEMA).coalesce(1), "d")
    assert sum(Path(f) in files for f, _ in server.shards("t")) == 3  # the one with that day is written anew
    assert sorted(map(tuple, server.read("t", "d", "k", 50).collect()), key=repr) == sorted([r for r in ROWS if r[1] != dt.date(1960, 2, 29)] + [(7, D[0], 1.0, "z"), (8, dt.date(1960, 2, 29), 1.0, "y")], key=repr)
    assert sorted(map(tuple, before.collect()), key=repr) == sorted(ROWS, key=repr)
    with pytest.raises(ValueError):
        server.create("t", df)


def test_queries_on_files_equal_their_sql(spark, duck, sf, monkeypatch):
    import __spark_entry__
    from tallyweave.plans import served as plans
    from tests.compare import same

    monkeypatch.setattr(plans, "server", FileServer)
    for name in ("server_scan", "server_scan_by_key", "server_store", "server_holdings"):
        same(__spark_entry__.queries()[name](spark, sf), duck.sql(__spark_entry__.oracle_sql()[name]))


def test_columns_and_ranges_are_in_the_queries_of_tasks(spark, monkeypatch):
    server = served(spark, ROWS)
    for split in (None, "d"):
        found = server.read("dbo.t", split, "k", 100, columns=["s", "K"], between={"d": (D[3], D[90]), "s": ("a", "a")})
        want = [(r[3], r[0]) for r in ROWS if r[1] is not None and D[3] <= r[1] <= D[90] and r[3] == "a"]
        assert found.columns == ["s", "K"] and sorted(map(tuple, found.collect())) == sorted(want) and want
        assert "Filter" not in found._jdf.queryExecution().executedPlan().toString()
