"""Reranking of search results, context packing and conversation memory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words by which a question is taken to ask for functions, classes or tables.
FUNCTION_WORDS, CLASS_WORDS, DB_WORDS = ("function", "def", "method", "call"), ("class", "object", "inherit"), ("table", "column", "database", "sql", "select")
SIMPLE_WORDS = ("function", "class", "method", "def")


def best(found: DataFrame, k: int, by: list[str] | None) -> DataFrame:
    """The k rows of the highest score, ties by rank; of each group if `by` names columns."""
    if not by:
        return found.orderBy(F.desc("score"), "rank").limit(k)
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "rank")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= k).drop("_nth")


def rerank_simple(found: DataFrame, query: str, k: int = 5, by: list[str] | None = None) -> DataFrame:
    """score 1 / (1 + distance), and 0.1 more for semantic chunks if the query speaks of code; ties by rank."""
    bonus = 0.1 if any(w in query.lower() for w in SIMPLE_WORDS) else 0.0
    score = F.lit(1.0) / (1.0 + F.col("distance")) + F.when(F.col("type") == "code_semantic", bonus).otherwise(0.0)
    return best(found.withColumn("score", score), k, by)


def rerank_score(query: str, now: dt.datetime) -> Column:
    """Score over columns distance, type, content and metadata map(entity_type, last_modified)."""
    q = query.lower()
    asks = {name: any(w in q for w in words) for name, words in (("function", FUNCTION_WORDS), ("class", CLASS_WORDS), ("db", DB_WORDS))}
    kind, entity = F.coalesce("type", F.lit("")), F.col("metadata")["entity_type"]
    semantic = kind == "code_semantic"
    bonus = F.lit(0.0)
    if asks["db"]:
        bonus = F.when(kind.startswith("sql"), 0.15).otherwise(bonus)
    if asks["class"]:
        bonus = F.when(semantic, F.when(entity == "class", 0.2).otherwise(0.0)).otherwise(bonus)
    if asks["function"]:
        bonus = F.when(semantic, F.when(entity == "function", 0.2).otherwise(0.0)).otherwise(bonus)
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp(F.col("metadata")["last_modified"]))) / 86400)
    recency = F.when(age < 7, 0.1).when(age < 30, 0.05).otherwise(0.0)
    liked = F.lit(0.0) if asks["db"] else F.when(semantic, 0.1).otherwise(0.0)
    size = F.char_length(F.coalesce("content", F.lit("")))
    length = F.when(size < 200, -0.05).when(size > 5000, -0.03).otherwise(0.0)
    return F.lit(1.0) / (1.0 + F.col("distance")) + 0.15 * bonus + 0.05 * recency + 0.1 * liked + 0.05 * length


def rerank(found: DataFrame, query: str, now: dt.datetime, k: int = 8, by: list[str] | None = None) -> DataFrame:
    return best(found.withColumn("score", rerank_score(query, now)), k, by)


def packed_context(chunks: DataFrame, group: list[str], order: str, most: int = 8000) -> DataFrame:
    """(group, context): chunks in order under a budget of characters.

    A chunk is a header line and its content. The first chunk that would pass the budget is cut if over 100
    characters of room are left, and taken; packing goes on as long as room is left. Columns: source, type,
    content, metadata map(entity_type, file_type, line_count).

    A running sum within the group first drops chunks that cannot be reached, so a context gathers no more chunks
    than fill the budget, however large its group is: what is taken whole adds its length, a chunk that is cut
    leaves under 100 characters, and no chunk with its header is under 17, so the third after that finds no room."""
    meta = F.col("metadata")
    extra = F.concat(*[F.coalesce(F.concat(F.lit(f" | {label}: "), F.nullif(meta[key], F.lit(""))), F.lit("")) for label, key in (("Entity", "entity_type"), ("Type", "file_type"), ("Lines", "line_count"))])
    line = Window.partitionBy(*group).orderBy(order)
    rows = chunks.select(*group, order, F.coalesce("content", F.lit("")).alias("body"), "source", "type", extra.alias("_extra")).withColumn("_n", F.row_number().over(line))
    rows = rows.withColumn("_head", F.concat(F.lit("[Source "), F.col("_n").cast("string"), F.lit(": "), F.coalesce("source", F.lit("")), F.lit(" ("), F.coalesce("type", F.lit("")), F.lit(")"), "_extra", F.lit("]")))
    room = F.sum((F.char_length("_head") + F.char_length("body")).cast("long")).over(line.rowsBetween(Window.unboundedPreceding, -3))
    near = rows.withColumn("_used", room).where(F.coalesce("_used", F.lit(0)) < most)
    body = F.substring("body", 1, most + 1)  # its length still tells whether it fits, and a cut takes less
    listed = near.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("_n", "_head", body.alias("body")))).alias("_rows"))

    def step(state: Column, r: Column) -> Column:
        head, size = F.char_length(r["_head"]), F.char_length(r["body"])
        left = most - state["used"] - head - 100
        over = state["used"] + head + size + 50 > most
        text = F.concat(r["_head"], F.lit("\n"), F.when(over, F.concat(F.substring(r["body"], F.lit(1), F.greatest(left, F.lit(0))), F.lit("\n... [truncated]"))).otherwise(r["body"]), F.lit("\n"))
        fits = ~state["done"] & (~over | (left > 100))
        return F.struct(F.when(fits, F.concat(state["parts"], F.array(text))).otherwise(state["parts"]).alias("parts"), F.when(fits, state["used"] + F.char_length(text)).otherwise(state["used"]).alias("used"), (~fits).alias("done"))

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("used"), F.lit(False).alias("done"))
    return listed.select(*group, F.concat(F.lit("\n" + "=" * 60 + "\n"), F.array_join(F.aggregate("_rows", start, step)["parts"], "\n")).alias("context"))


def conversation_context(exchanges: DataFrame, group: str, order: str, keep: int = 10, shown: int = 3, most: int = 200) -> DataFrame:
    """(group, context): of the last `keep` exchanges (query, response) the last `shown`, answers cut at `most` characters.

    The window keeps `shown` rows a group before anything is gathered."""
    last = Window.partitionBy(group).orderBy(F.desc(order))
    rows = exchanges.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= min(keep, shown))
    text = F.concat(F.lit("Previous Q: "), F.coalesce("query", F.lit("")), F.lit("\nPrevious A: "), F.substring(F.coalesce("response", F.lit("")), 1, most), F.lit("..."))
    return rows.groupBy(group).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("_n", text.alias("text"))))), lambda r: r["text"]), "\n").alias("context"))
