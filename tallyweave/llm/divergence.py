"""Source divergence audit: how far the terms of a source lie from its language and from the language's other sources.

Terms are counted in Arrow batches, (lang, source, term) by (lang, source, term), and added up by Spark. A term is kept
if LEAST documents of its language have it. Each group of a language and a source, and each language, gives each kept
term the share p = 1 + (10^9 (count + 1)) div (N + V), and p diverges from q by ((p - q)^2) div q.

Pairs of sources are sums over all kept terms, of which most occur in neither source. So a sum is put together from
the value that a term in neither has, V times, and corrections: for terms in one source, by a histogram of its shares
against the other's share of an absent term; for terms in both, by the sources that a term's row lists, in blocks of
BLOCK of them. Nothing is emitted for each term and pair of sources.

The highest terms of a group are found by radix selection: histograms over 16 bits of the value at a time, counted
where the rows are, narrow the range that holds each group's k-th value; ties of that value are narrowed in the same
way by their UTF-8 bytes, 2 of them, then 4, 8 and so on. No group is sorted or collected but its k rows.

Defined results: null text, lang and source are the empty string; texts of any length are read whole; rows that repeat
are documents each for itself; groups without terms are there, with count 0 for all kept terms; a language without kept
terms has pairs of value 0; equal values are by the item's UTF-8 bytes; an empty table gives an empty result; doc_id and
extra columns of any name are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textnp import byte_class, chunks, coded_terms
from tallyweave.staging import mapped, written

LEAST, TOP, BLOCK, SALTS = 3, 200, 256, 16
#: Terms are runs of ASCII letters and of all that is not ASCII.
BREAKS = byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Pairs of sources that one step of numpy looks at.
STEP = 1 << 20
GROUP = ["lang", "source"]


def cells(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences, and documents, of each term in each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, source = (b.column(c).dictionary_encode() for c in (0, 1))
            pair = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            for i, j, data, offsets in chunks(b.column(2), 8 << 20):
                names, code, doc = coded_terms(data, offsets, BREAKS)
                t = max(1, len(names))
                key, n = np.unique(pair[i:j][doc] * t + code, return_counts=True)
                once = np.unique(doc * t + code)
                df = np.unique(pair[i:j][once // t] * t + once % t, return_counts=True)[1]
                of, term = key // t, key % t
                columns = [lang.dictionary.take(pa.array(of // max(1, len(source.dictionary)))), source.dictionary.take(pa.array(of % max(1, len(source.dictionary)))), names.take(pa.array(term)), pa.array(n), pa.array(df)]
                for s in range(0, len(key), 1 << 17):
                    yield pa.RecordBatch.from_arrays([c.slice(s, 1 << 17) for c in columns], names=[*GROUP, "term", "n", "df"])

    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*GROUP, "text")])
    return mapped(rows, run, "lang string, source string, term string, n long, df long").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The cells of kept terms, with the term's count in the language, the number of its sources, and a mark on one of its rows."""
    term = Window.partitionBy("lang", "term")
    rows = cells(docs).select(*GROUP, "term", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("lang_n"), F.count("*").over(term).alias("sources"), (F.col("source") == F.min("source").over(term)).alias("first"))
    return rows.where(F.col("df") >= least).drop("df")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + (10^9 (count + 1)) div (total + terms), whose product may pass 64 bits; 0 where there are no terms."""
    whole = F.call_function("div", (count + 1).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)"), F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))
    return F.when(terms > 0, whole + 1).otherwise(F.lit(0)).cast("long")


def gap(p: Column, q: Column) -> Column:
    """((p - q)^2) div q."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, terms, absent): a row for each group that occurs; absent is the share of a term that it lacks."""
    there = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in GROUP]).distinct()
    sums = kept.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"))
    rows = there.join(sums, GROUP, "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms"])
    return rows.withColumn("absent", share(F.lit(0), F.col("total"), F.col("terms")))


def in_both(entries: DataFrame) -> DataFrame:
    """(lang, source, item, value): for terms in two sources, what their pair's sum has beyond what each alone corrects.

    A term's sources are dealt to blocks, and a row lists the sources of two blocks, so that no row holds all of them."""
    blocks = F.ceil(F.col("sources") / BLOCK)
    rows = entries.where("sources > 1").select("lang", "term", "source", "p", "absent", F.pmod(F.xxhash64("source"), blocks).alias("block"), blocks.alias("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    lists = rows.groupBy("lang", "term", "i", "j").agg(F.collect_list(F.struct("source", "p", "absent", "block")).alias("sources"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            langs = b.column(0).dictionary_encode()
            flat, size = b.column(2).flatten(), np.diff(b.column(2).offsets.to_numpy())
            source = flat.field(0).dictionary_encode()
            p, absent, block = (flat.field(c).to_numpy() for c in (1, 2, 3))
            code, s = source.indices.to_numpy().astype(np.int64), len(source.dictionary)
            first = np.concatenate([[0], np.cumsum(size)])
            within = (b.column(1).to_numpy() == b.column(3).to_numpy())[np.repeat(np.arange(len(size)), size)]
            lang = np.repeat(langs.indices.to_numpy().astype(np.int64), size)
            done, pairs = 0, np.cumsum(size.astype(np.int64) ** 2)
            while done < len(size):
                end = max(done + 1, int(np.searchsorted(pairs, (pairs[done - 1] if done else 0) + STEP, "right")))
                at = np.arange(first[done], first[end])  # entries, each of which meets all of its row
                many = np.repeat(size[done:end], size[done:end])
                left = np.repeat(at, many)
                begins = np.repeat(np.repeat(first[done:end], size[done:end]), many)
                right = begins + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
                apart = (code[left] != code[right]) & (within[left] | (block[left] != block[right]))
                left, right = left[apart], right[apart]
                f = lambda x, y: (x - y) ** 2 // y
                value = f(p[left], p[right]) - f(p[left], absent[right]) - f(absent[left], p[right]) + f(absent[left], absent[right])
                key, of = np.unique((lang[left] * s + code[left]) * s + code[right], return_inverse=True)
                sums = np.zeros(len(key), np.int64)
                np.add.at(sums, of, value)
                for k, v in zip(key.tolist(), sums.tolist()):
                    total[langs.dictionary[k // s // s].as_py(), source.dictionary[k // s % s].as_py(), source.dictionary[k % s].as_py()] += v
                done = end
            if len(total) > STEP:
                yield batch(total)
                total.clear()
        yield batch(total)

    def batch(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k[c] for k in total], pa.string()) for c in range(3)), pa.array(list(total.values()), pa.int64())], names=[*GROUP, "item", "value"])

    return mapped(lists.select("lang", "i", "sources", "j"), run, "lang string, source string, item string, value long")


def pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): each source against each other one of its language, in all ranks."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"), "terms", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    dealt = lambda rows, *by: rows.withColumn("salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(others, ["lang", "salt"]).where("source <> item")
    p, absent, other = F.col("p"), F.col("absent"), F.col("other")
    neither = F.when(F.col("terms") > 0, F.col("terms") * gap(absent, F.greatest(other, F.lit(1)))).otherwise(F.lit(0))
    base = dealt(groups.select(*GROUP, "absent"), "source").select(*GROUP, "item", neither.alias("value"))
    shares = dealt(entries.groupBy(*GROUP, "p", "absent").agg(F.count("*").alias("n")), "source", "p")
    there = shares.groupBy(*GROUP, "item").agg(F.sum(F.col("n") * (gap(p, other) - gap(absent, other))).alias("value"), F.sum(F.col("n") * (gap(other, p) - gap(other, absent))).alias("back"))
    one = there.select(*GROUP, "item", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))).alias("x")).select("lang", "x.*")
    sums = base.unionByName(one).unionByName(in_both(entries)).groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))


def highest(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of the highest value of each group with their rank, equal values by the item's UTF-8 bytes.

    rows: the columns `by`, item (once a group) and value (long, 0 or more). The state has one row for each group of more
    than k rows: the bits of its k-th value that are known, and how many rows of that range are still wanted."""

    def narrowed(found: DataFrame, digit: Column, more: list[str], descending: bool) -> DataFrame:
        """By group: the digit in which the last wanted row lies, what is wanted of it, and how many rows it has."""
        counts = found.groupBy(*by, *more, "wanted", digit.alias("digit")).agg(F.count("*").alias("n"))
        ordered = Window.partitionBy(*by).orderBy(F.desc("digit") if descending else F.asc("digit")).rowsBetween(Window.unboundedPreceding, 0)
        upto = counts.withColumn("upto", F.sum("n").over(ordered))
        return upto.where("upto >= wanted and upto - n < wanted").withColumn("wanted", F.col("wanted") - F.col("upto") + F.col("n"))

    state = None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("value", shift).bitwiseAND(0xFFFF)
        found = rows.withColumns({"wanted": F.lit(k), "bits": F.lit(0)}) if state is None else rows.join(state.drop("n"), by).where(F.shiftright("value", shift + 16) == F.col("bits"))
        known = (F.col("bits") * 65536 + F.col("digit")).cast("long").alias("bits")
        state = written(narrowed(found, digit, ["bits"], True).select(*by, known, F.col("wanted").cast("long").alias("wanted"), "n"), "radix-values")
    kth = state.withColumnRenamed("bits", "kth")
    item = F.col("item").cast("binary")
    settled, tied, width = kth.where("n = wanted").select(*by, "kth", F.lit(None).cast("binary").alias("last")), kth.where("n > wanted").select(*by, "kth", "wanted", F.lit(b"").alias("last")), 2
    while not tied.isEmpty():
        found = rows.join(tied, by).where((F.col("value") == F.col("kth")) & (item.substr(F.lit(1), F.length("last")) == F.col("last")))
        part = item.substr(F.length("last") + 1, F.lit(width))
        tied = written(narrowed(found, part, ["kth", "last"], False).select(*by, "kth", "wanted", F.concat("last", "digit").alias("last"), "n"), "radix-ties")
        settled, tied, width = settled.unionByName(tied.where("n = wanted").select(*by, "kth", "last")), tied.where("n > wanted").drop("n"), 2 * width
    first = F.col("kth").isNull() | (F.col("value") > F.col("kth")) | ((F.col("value") == F.col("kth")) & (F.col("last").isNull() | (item.substr(F.lit(1), F.length("last")) <= F.col("last"))))
    chosen = rows.join(settled, by, "left").where(first).select(*rows.columns)
    return chosen.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """(lang, source, part, item, value, rank) of both parts."""
    kept = written(kept_terms(docs, least), "divergence-terms")
    groups = written(groups_of(docs, kept), "divergence-groups")
    totals = F.col("total"), F.col("terms")
    entries = written(kept.join(groups, GROUP).select(*GROUP, "term", "sources", "absent", share(F.col("n"), *totals).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q")), "divergence-shares")
    terms = entries.where("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    parts = {"pair": pairs(entries, groups), "term": highest(terms, GROUP, top)}
    found = [rows.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, rows in parts.items()]
    return found[0].unionByName(found[1])
