"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns the columns of docs
(the last one returns packed pieces). `run` writes each stage's rows to the shared folder and reads them again, so
no stage is computed twice and a lost executor costs one stage's tasks at most.

Defined results, of all stages: texts of any length are worked on whole; extra columns, whatever their names, are
carried as they are, but n_chars, which follows the text where a stage changes it; an empty table gives an empty
result. Nulls, ties and repeated rows are told by each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm import langid, minhash, packing, secrets, substring
from tallyweave.staging import written


def _with_text(rows: DataFrame, columns: list[str], text) -> DataFrame:
    """The columns of the struct `row` with another text, and n_chars to match it."""
    new = rows.withColumn("new_text", text)
    named = {"text": F.col("new_text"), "n_chars": F.char_length("new_text").cast("long")}
    return new.select(*[named[c].alias(c) if c in named else F.col("row")[c].alias(c) for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language that the model has learned, by limits that its own held-out examples set.

    Null texts and texts without a letter go; without any labelled row no language is known and all go. A null
    doc_id or lang changes nothing for a row. Repeated rows are judged alike."""
    rows = langid.training_sample(docs)
    return langid.predict(docs, langid.fit(rows) if rows else None).where("recognised").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group (five-word shingles, similarity 0.8).

    Null texts and texts without words are copies of nothing and stay. Rows without a doc_id are compared with
    nothing and stay. Of rows that repeat a doc_id and its text one stays; rows of one doc_id with different texts
    are one document, which stays or goes as a whole."""
    dropped = minhash.near_duplicates(docs, width=5, threshold=0.8).where(~F.col("kept")).select("doc_id").distinct()
    left = docs.join(dropped, "doc_id", "left_anti").select(F.struct(*docs.columns).alias("row"))
    order = Window.partitionBy(F.col("row.doc_id"), F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256), F.col("row.text").isNull()).orderBy(F.xxhash64("row"))
    return left.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words and more that a document of a smaller doc_id has; documents with nothing left go.

    Null texts, and rows without a doc_id, stay as they are; so do texts that lose nothing, white space included.
    Rows of one doc_id remove nothing of each other."""
    rows = substring.remove_repeats(docs, 50).where("n_removed = 0 or n_removed < n_words")
    return _with_text(rows, docs.columns, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts by placeholders of their kind. Null texts stay null; each row is scanned for itself."""
    return _with_text(secrets.find_secrets(docs), docs.columns, F.col("redacted"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, packed into sequences. A null or empty text is one piece, the end token; repeated
    rows are packed each for itself."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Hashed features, calibrated probabilities and tokenizer ids are no SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
