"""Queries over stored vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import search
from tallyweave.operators.graph import Graphs
from tallyweave.operators.vector_store import VectorStore
from tallyweave.plans.registry import query
from tallyweave.plans.views import table
from tallyweave.staging import fresh_path, written


def _recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(enough): whether 0.9 of the exact answers are found."""
    hits = true.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.agg(F.coalesce(F.sum("hit") >= 0.9 * F.count("*"), F.lit(True)).alias("enough"))


ANSWERS = "count(*) filter (where vec_id % 50 = 0) as queries, least(15, count(*)) * count(*) filter (where vec_id % 50 = 0) as answers, true as enough"


@query(f"select {ANSWERS}, true as fewer from embeddings")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The graphs against the exact search: queries, answers, whether 0.9 of the exact ones are found, and whether queries
    were compared with fewer vectors than there are."""
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0")
    found = written(Graphs.build(vectors).neighbours(asked, beam=48), "found")
    compared = found.where("nth = 1").agg((F.sum("compared") < F.count("*") * F.lit(vectors.count())).alias("fewer"))
    return found.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("answers")).join(_recall(found, search.exact_neighbours(vectors, asked))).join(compared)


@query(f"select {ANSWERS} from embeddings where vec_id % 7 <> 3")
def stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """An index on disk: built of a part, then added to, changed and deleted from; searched from disk against an exact search."""
    vectors = table(spark, sf, "embeddings")
    store = VectorStore.build(vectors.where("vec_id % 3 <> 0"), fresh_path(spark, "vectors"), nlist=20, nprobe=2)
    store.upsert(vectors.where("vec_id % 3 <> 1"))
    store.delete(vectors.where("vec_id % 7 = 3"))
    left = vectors.where("vec_id % 7 <> 3")
    asked = left.where("vec_id % 50 = 0")
    found = written(store.neighbours(asked), "found")
    return found.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("answers")).join(_recall(found, search.exact_neighbours(left, asked)))


@query("select vec_id as id, case when vec_id % 5 = 0 then 'new' when vec_id % 5 = 1 then 'gone' else 'changed' end as change from embeddings where vec_id % 5 <= 2")
def index_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What a source has that its index has not, by content hashes."""
    rows = table(spark, sf, "embeddings").withColumn("hash", F.sha2(F.concat_ws("/", "vec_id", "label"), 256))
    store = VectorStore.build(rows.where("vec_id % 5 <> 0"), fresh_path(spark, "vectors"), nlist=20, hash_column="hash")
    source = rows.where("vec_id % 5 <> 1").withColumn("hash", F.when(F.col("vec_id") % 5 == 2, F.sha2("hash", 256)).otherwise(F.col("hash")))
    return store.changes(source, "vec_id", "hash")
