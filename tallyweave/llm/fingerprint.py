"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch is {hashes, exact}. Of a text of over EXACT different shingles it holds every shingle hash in the lowest
1/SCALE of the 64-bit range, whatever their number; of a shorter text all hashes, marked as exact, of which that
fraction can still be taken. So sketches merge: the union of two, exact while both are and it has up to EXACT
hashes, else cut to the fraction, is the sketch of the texts' united shingles (`merged`). As the fraction is the
same for all texts, the share of one sketch that is in another estimates containment between documents of very
unequal length. Likeness is exact between two exact sketches, else estimated within the fraction.

All of it is DataFrame expressions. The next document in doc_id order is found without sorting into one
partition: exact values of doc_id cut the range into buckets, and the first row of a bucket is also sent to the
bucket before it, so that a window inside each bucket sees its successor. Only the cut values (at most CUTS
numbers) go through the driver.

Defined results: null or empty text has no words, an exact sketch without hashes, and likeness 1 to another of
those, 0 to any other; a long text without a hash in the fraction (one in 5000 at EXACT shingles, and rarer by e with
every SCALE shingles more) has likeness 1 to another of those, which copies of it are, and 0 to any other; texts of under WORDS words have one shingle, the whole; a null doc_id sorts
first; rows of one doc_id are ordered by a hash of their text, and have to fit one task; repeated shingles count
once; any length is read whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.columns import let, run_hashes, words_of

WORDS, SCALE, EXACT, CUTS = 5, 8, 64, 65_535


def kept(hashes: Column) -> Column:
    """Those in the fraction; hashes are signed, so the range begins at -2**63."""
    return F.filter(hashes, lambda x: x < F.lit(-(1 << 63) + (1 << 64) // SCALE).cast("long"))


def _of_set(hashes: Column) -> Column:
    """The sketch of a set of all shingle hashes."""
    exact = F.size(hashes) <= EXACT
    return F.struct(F.sort_array(F.when(exact, hashes).otherwise(kept(hashes))).alias("hashes"), exact.alias("exact"))


def sketch(text: Column) -> Column:
    """struct(hashes array<long> ascending, exact boolean)."""

    def of(words: Column) -> Column:
        n = F.size(words)
        hashes = F.when(n >= WORDS, run_hashes(words, WORDS)).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))
        return let(F.array_distinct(hashes), _of_set)

    return let(words_of(text), of)


def merged(a: Column, b: Column) -> Column:
    """The sketch of the shingles of both."""
    both = let(F.array_union(a["hashes"], b["hashes"]), lambda u: F.struct(u.alias("u"), (a["exact"] & b["exact"] & (F.size(u) <= EXACT)).alias("exact")))
    return let(both, lambda x: F.struct(F.sort_array(F.when(x["exact"], x["u"]).otherwise(kept(x["u"]))).alias("hashes"), x["exact"].alias("exact")))


def printed(sketch_: Column) -> Column:
    """`=` and all hashes of an exact sketch, `~` and the hashes of the fraction of any other; base64 of eight bytes each,
    the highest first."""
    packed = F.unhex(F.array_join(F.transform(sketch_["hashes"], lambda h: F.lpad(F.hex(h), 16, "0")), ""))
    return F.concat(F.when(sketch_["exact"], F.lit("=")).otherwise(F.lit("~")), F.translate(F.base64(packed), "\r\n", ""))


def _compared(a: Column, b: Column, rule) -> Column:
    """rule over both lists of hashes, whole if both are exact, else of the fraction, and whether both are exact or neither is."""
    exact = a["exact"] & b["exact"]
    part = lambda x: F.when(exact | ~x["exact"], x["hashes"]).otherwise(kept(x["hashes"]))
    return let(F.struct(part(a).alias("a"), part(b).alias("b"), (a["exact"] == b["exact"]).alias("alike")), lambda p: rule(p["a"], p["b"], p["alike"]))


def similarity(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard similarity of two shingle sets, from their sketches."""

    def rule(x: Column, y: Column, alike: Column) -> Column:
        total = F.size(x) + F.size(y)
        both = F.size(F.array_intersect(x, y))
        return F.when(total == 0, alike.cast("double")).otherwise(both / (total - both))

    return _compared(a, b, rule)


def containment(a: Column, b: Column) -> Column:
    """Estimate of the share of a's shingles that are in b; null where the sketch of a has none."""
    return _compared(a, b, lambda x, y, alike: F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(x).cast("double")))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): next_text is of the next row in ascending doc_id, for the last row of the first."""
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("key", key)
    wanted = min(CUTS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    first, cuts = rows.agg(F.min("key"), F.percentile_approx("key", [k / (wanted + 1) for k in range(1, wanted + 1)], max(10_000, 16 * wanted))).first()
    cuts = sorted({c for c in cuts or [] if c > first})
    depth = len(cuts).bit_length()
    padded = cuts + [(1 << 63) - 1] * ((1 << depth) - 1 - len(cuts))
    table = F.split(F.lit(",".join(map(str, padded))), ",").cast("array<long>") if depth else None  # folds to one literal
    bucket = F.lit(0)
    if depth:  # binary search for the number of cuts that are not above the key
        steps = F.lit([1 << k for k in range(depth - 1, -1, -1)])
        bucket = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get(table, at + s - 1) <= F.col("key"), at + s).otherwise(at))
        bucket = F.least(bucket, F.lit(len(cuts)))
    placed = rows.withColumn("bucket", bucket)
    opens = F.lit(True) if first is None else (F.col("key") == first) if not depth else (F.col("key") == first) | (F.get(table, F.col("bucket") - 1) == F.col("key"))
    before = F.when(F.col("bucket") > 0, F.col("bucket") - 1).otherwise(F.lit(len(cuts)))
    copies = F.when(opens, F.array(F.struct(F.col("bucket").alias("of"), F.lit(0).alias("guard")), F.struct(before.alias("of"), F.lit(1).alias("guard")))).otherwise(F.array(F.struct(F.col("bucket").alias("of"), F.lit(0).alias("guard"))))
    spread = placed.select("doc_id", "key", "text", F.inline(copies))
    order = Window.partitionBy("of").orderBy("guard", "key", F.xxhash64("text"))
    return spread.withColumn("next_text", F.lead("text").over(order)).where("guard = 0").select("doc_id", "text", "next_text")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text (its second half replaced from the next text) and likenesses."""
    half = "cast(floor(char_length(text) / 2) as int)"
    edited = F.expr(f"concat(left(text, char_length(text) - {half}), left(next_text, {half}))")
    pairs = with_next(docs).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "text", "next_text", edited.alias("edited"))
    sketches = pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("a"), sketch(F.col("edited")).alias("b"), sketch(F.col("next_text")).alias("c"))
    return sketches.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed(F.col("a")).alias("fingerprint"),
        printed(F.col("b")).alias("edited_fingerprint"),
        similarity(F.col("a"), F.col("b")).alias("near_edited"),
        similarity(F.col("a"), F.col("c")).alias("near_next"),
        containment(F.col("b"), F.col("a")).alias("edited_in_text"),
    )
