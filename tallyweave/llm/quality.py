"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for a document. The ledger holds its measurements and one long of failure bits; a
policy is a versioned set of rules, applied as a bit mask, so that a new policy needs no second look at the
texts. Ablations (what a policy would keep without one of its rules) and comparisons of policies come from counts by
failure bits. A version never changes: its rules are listed by name, and another choice of rules is another version.
Version 2 of the default policy leaves out the count of insults, which looks at ten words of one language and drops clean
documents that quote them; operator 13 judges toxicity. The count stays in the ledger for version 1.

All of it is DataFrame expressions. Repeated 8-word windows are found in the row itself: hashes of all windows;
only where some are equal, the pairs (hash, position) are sorted and neighbours compared. Nothing is shuffled.

Defined results: null or empty text has no words, fails few_words and is not kept; repeated rows are judged each
for itself; texts of any length are read whole, and their windows take memory in proportion to their words; only doc_id
and text are read, other columns are dropped, whatever their names; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.columns import let, run_hashes, words_of

WINDOW = 8
#: Insults that version 1 of the default policy counts.
INSULTS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")

#: name: SQL condition under which a document fails; the order gives the bits and only ever grows at its end.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines > 3 and 100 * n_dup_lines > 30 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)",
    "insults": "n_insults >= 2 or 100 * n_insults > n_words",
}
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


VERSIONS = (
    Policy("base", 1, ("few_words", "repeated_windows")),
    Policy("default", 1, ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "insults")),
    Policy("default", 2, ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length")),
)
#: The latest version of each policy.
POLICIES = {p.name: p for p in sorted(VERSIONS, key=lambda p: p.version)}

#: All rules of the ledger, for ablations of it.
EVERY_RULE = Policy("ledger", 1, tuple(RULES))


def _repeated_words(hashes: Column, n_words: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more."""

    def covered(pairs: Column) -> Column:
        hit = F.filter(
            F.transform(pairs, lambda x, k: F.when((x["h"] == F.get(pairs, k - 1)["h"]) | (x["h"] == F.get(pairs, k + 1)["h"]), x["at"])),
            lambda at: at.isNotNull(),
        )
        return let(F.array_sort(hit), lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))

    pairs = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_insults) for each row."""
    text = F.coalesce(docs["text"], F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]"))
    cut = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        words_of(docs["text"]).alias("words"),
        lines.alias("lines"),
        F.char_length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).alias("n_symbols"),
        F.regexp_count(text, F.lit(rf"(?i)\b(?:{'|'.join(INSULTS)})\b")).alias("n_insults"),
    )
    hashed = cut.select("*", run_hashes(F.col("words"), WINDOW).alias("hashes"))
    return hashed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("hashes"), F.size("words")).cast("long").alias("n_repeat_words"),
        F.col("n_insults").cast("long").alias("n_insults"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failed_bits of each row."""
    bits = F.lit(0).cast("long")
    for name, failing in RULES.items():
        bits = bits + F.when(F.expr(failing), F.lit(BIT[name])).otherwise(F.lit(0))
    return measured(docs).withColumn("failed_bits", bits)


def judged(entries: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """The ledger with the policy's verdict: base_failed, kept and the policy's name."""
    failed = lambda p: F.col("failed_bits").bitwiseAND(F.lit(p.mask).cast("long")) != 0
    return entries.withColumns({"base_failed": failed(POLICIES["base"]), "kept": ~failed(POLICIES["base"]) & ~failed(policy), "policy": F.lit(f"{policy.name}-{policy.version}")})


def ablation(entries: DataFrame, policy: Policy = POLICIES["default"]) -> DataFrame:
    """(rule, n_failed, n_only): documents that fail a rule of the policy, and that only this rule drops."""
    counts = entries.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])
    rows = counts.select("bits", "n", F.inline(rules))
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def compared(entries: DataFrame, policies: tuple[Policy, ...] = VERSIONS, against: Policy = POLICIES["default"]) -> DataFrame:
    """(policy, n_kept, n_gained, n_lost) of each policy, from one ledger: documents that it keeps, that it keeps and
    `against` drops, and that `against` keeps and it drops."""
    counts = entries.groupBy("failed_bits").agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(f"{p.name}-{p.version}").alias("policy"), F.lit(p.mask).cast("long").alias("mask")) for p in policies])
    passes = lambda mask: F.col("failed_bits").bitwiseAND(mask) == 0
    rows = counts.select("failed_bits", "n", F.inline(each)).select("policy", "n", passes(F.col("mask")).alias("here"), passes(F.lit(against.mask).cast("long")).alias("there"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return rows.groupBy("policy").agg(total(F.col("here")).alias("n_kept"), total(F.col("here") & ~F.col("there")).alias("n_gained"), total(~F.col("here") & F.col("there")).alias("n_lost"))
