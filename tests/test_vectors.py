"""Graph search and the index on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import search
from tallyweave.operators.graph import Graphs, linked, walked
from tallyweave.operators.vector_store import VectorStore
from tallyweave.staging import fresh_path

SCHEMA = "vec_id long, embedding array<double>, hash string"


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 4, (30, 16))
    return centres[rng.integers(0, 30, 3000)] + rng.normal(0, 1, (3000, 16))


def frame(spark, points, ids=None):
    ids = range(len(points)) if ids is None else ids
    return spark.createDataFrame([(int(i), p.tolist(), f"h{i}") for i, p in zip(ids, points)], SCHEMA)


def hits(found, true):
    a, b = ({(r["query_id"], r["id"]) for r in x.collect()} for x in (found, true))
    return len(a & b) / max(1, len(b))


def test_graphs_find_what_the_exact_search_finds(spark, points):
    vectors = frame(spark, points)
    asked = vectors.where("vec_id % 50 = 0")
    found = Graphs.build(vectors, shard=1000).neighbours(asked, 10)
    rows = found.collect()
    assert len(rows) == 600 and sorted({r["nth"] for r in rows}) == list(range(1, 11))
    assert hits(found, search.exact_neighbours(vectors, asked, 10)) >= 0.9
    assert max(r["compared"] for r in rows) < 0.6 * len(points)
    assert all(r["distance"] == pytest.approx(((points[r["id"]] - points[r["query_id"]]) ** 2).sum()) for r in rows[:100])


def test_graphs_of_copies_few_rows_and_odd_rows(spark):
    same = [[1.0, 2.0]] * 40 + [[5.0, 5.0]]
    odd = spark.createDataFrame([(i, v, "") for i, v in enumerate(same)] + [(100, None, ""), (101, [1.0], ""), (102, [None, 1.0], "")], SCHEMA)
    found = Graphs.build(odd, shard=16).neighbours(odd, 3)
    rows = found.collect()
    assert {r["query_id"] for r in rows} == set(range(41)) and all(r["distance"] == 0 for r in rows if r["query_id"] < 40)
    assert Graphs.build(odd.limit(0)).neighbours(odd, 3).count() == 0
    one = Graphs.build(odd.where("vec_id = 40"))
    assert [tuple(r)[:2] for r in one.neighbours(odd.where("vec_id in (0, 40)"), 3).orderBy("query_id").collect()] == [(0, 40), (40, 40)]


def test_a_walk_over_all_is_exact(points):
    part = points[:300]
    place, score, compared = walked(part[:20], part, linked(part), 5, 300)
    for q in range(20):
        true = np.argsort(((part - part[q]) ** 2).sum(1), kind="stable")[:5]
        assert set(true) == set(place[q][:5]) and compared[q] == 300


def state(store):
    return sorted((r["id"], r["hash"], r["cell"]) for r in store.rows().collect())


def test_store_after_loads_equals_a_fresh_one(spark, points):
    vectors = frame(spark, points)
    store = VectorStore.build(vectors.where("vec_id < 2000"), fresh_path(spark, "store"), 25, hash_column="hash")
    index = store.index()
    store.upsert(vectors.where("vec_id >= 1500"), hash_column="hash")
    moved = frame(spark, points[:40] + 9.0, range(40)).withColumn("hash", F.concat("hash", F.lit("b")))
    store.upsert(moved, hash_column="hash")
    touched = store.delete(vectors.where("vec_id between 100 and 120"))
    assert 0 < len(touched) <= 21
    left = vectors.where("vec_id >= 40 and not vec_id between 100 and 120").unionByName(moved)
    assert [x[:2] for x in state(store)] == sorted((r["vec_id"], r["hash"]) for r in left.collect())
    asked = left.where("vec_id % 50 = 0")
    same = lambda df: sorted((r["query_id"], r["nth"], r["id"], round(r["distance"], 9)) for r in df.collect())
    assert same(store.neighbours(asked, 10)) == same(index.neighbours(left, asked, 10))
    before = state(store)
    assert store.vacuum() > 0 and store.vacuum() == 0 and state(store) == before
    assert same(VectorStore(spark, store.path).neighbours(asked, 10)) == same(index.neighbours(left, asked, 10))


def test_search_reads_the_cells_of_its_queries(spark, points):
    vectors = frame(spark, points)
    store = VectorStore.build(vectors, fresh_path(spark, "store"), 30)
    one = store.index().cells(search._rows(vectors.where("vec_id = 7"), "vec_id", "embedding"), 2).first()["cells"]
    rows = store.rows(one)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert all(f"{c}" in filters for c in one) and "cell#" in filters
    scan = [x for x in rows.select("id", "cell")._jdf.queryExecution().executedPlan().collectLeaves().mkString("|").split("|") if "FileScan" in x]
    assert len(scan) == 1 and {r["cell"] for r in rows.select("cell").distinct().collect()} == set(one)
    assert rows.count() < 0.3 * len(points)


def test_refresh_writes_what_changed(spark, points):
    vectors = frame(spark, points[:600])
    store = VectorStore.build(vectors, fresh_path(spark, "store"), 12, hash_column="hash")
    assert store.changes(vectors, "vec_id", "hash").count() == 0 and store.refresh(vectors) == []
    source = vectors.where("vec_id <> 5").withColumn("hash", F.when(F.col("vec_id") == 9, "other").otherwise(F.col("hash"))).unionByName(frame(spark, points[700:702], [700, 701]))
    assert sorted(map(tuple, store.changes(source, "vec_id", "hash").collect())) == [(5, "gone"), (9, "changed"), (700, "new"), (701, "new")]
    assert 0 < len(store.refresh(source)) <= 4
    assert [x[:2] for x in state(store)] == sorted((r["vec_id"], r["hash"]) for r in source.collect())
    store.delete(source)
    assert store.rows().count() == 0 and store.neighbours(source.limit(3), 5).count() == 0
