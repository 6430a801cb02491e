"""Chat formatting with typed content parts.

A turn is a list of parts (text, image, audio, document). A visitor flattens the parts in order: text parts are
escaped, other parts become a placeholder with their ordinal in the conversation's attachment list, where their
reference and expanded token count are recorded. The template writes

    ### role: content</turn>\\n

for each turn. Texts cannot forge control strings: `\\`, `#`, `<` and (in roles) `:` are written as `\\\\`, `\\h`,
`\\l` and `\\c`, and read back exactly. The loss mask is a list of code point spans [start, end) of the formatted
conversation: the contents of the turns of the trained role.

All of it is DataFrame expressions: a running sum gives each turn its place, one shuffle by conversation serves
both that sum and the final list. A conversation is one output row, so it has to fit one row; nothing else is
gathered.

Defined results: null text, null roles and empty part lists are empty; a null conv_id is a conversation of its
own; rows that repeat a turn are turns of their own, in the order role, content; unknown part types become
placeholders of their name; a part without units counts DEFAULT_UNITS tokens; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.columns import let

OPEN, CLOSE = "### ", "</turn>\n"
#: Tokens that one unit of a part stands for: a tile of an image, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 600}
DEFAULT_UNITS = 1
PARTS = "array<struct<type:string,text:string,ref:string,units:long>>"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c, code in (("#", "h"), ("<", "l")):
        out = F.replace(out, F.lit(c), F.lit("\\" + code))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(":"), F.lit("\\c"))


def unescaped(text: Column) -> Column:
    """Every run of backslashes begins with a whole escape, so cutting at doubled ones from the left is exact."""
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\h"), F.lit("#")), F.lit("\\c"), F.lit(":"))
    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def flattened(parts: Column) -> Column:
    """struct(content, attachments): the visitor over the parts of one turn. Placeholders count within the turn."""
    part_tokens = lambda p: F.coalesce(p["units"], F.lit(DEFAULT_UNITS)) * F.coalesce(*[F.when(p["type"] == k, F.lit(n)) for k, n in TOKENS.items()], F.lit(1))
    listed = F.coalesce(parts, F.array().cast(PARTS))
    others = F.filter(listed, lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    attachments = F.transform(others, lambda p, k: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).cast("long").alias("tokens"), k.alias("ordinal")))

    def visit(p: Column, k: Column) -> Column:
        before = F.size(F.filter(F.slice(listed, 1, k), lambda q: F.coalesce(q["type"], F.lit("text")) != "text"))
        return F.when(F.coalesce(p["type"], F.lit("text")) == "text", escaped(p["text"])).otherwise(F.concat(F.lit("<|"), escaped(p["type"]), F.lit(":"), before.cast("string"), F.lit("|>")))

    return F.struct(F.array_join(F.transform(listed, visit), "").alias("content"), attachments.alias("attachments"))


def format_parts(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """Conversations from rows (conv_id, turn, role, parts); see `format_turns`."""
    flat = turns.select("conv_id", "turn", "role", flattened(F.col("parts")).alias("flat"))
    return _formatted(flat.select("conv_id", "turn", "role", F.col("flat.content").alias("content"), F.col("flat.attachments").alias("attachments")), train_role)


def format_turns(turns: DataFrame, train_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, turn_starts, loss, attachments, n_attached_tokens) from rows (conv_id, turn, role, text).

    loss has a span [start, end) for each turn, empty for turns that are not trained."""
    one = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))
    return format_parts(turns.select("conv_id", "turn", "role", one.alias("parts")), train_role)


def _formatted(turns: DataFrame, train_role: str) -> DataFrame:
    head = F.concat(F.lit(OPEN), escaped_role(F.col("role")), F.lit(": "))
    cut = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), "content", "attachments")
    sized = cut.select("*", F.concat("head", "content", F.lit(CLOSE)).alias("block"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    placed = sized.select("*", F.row_number().over(order).alias("nth"), (F.sum(F.char_length("block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("block")).alias("start"))
    start = F.col("start") + F.char_length("head")
    end = F.when(F.col("role") == train_role, start + F.char_length("content")).otherwise(start)
    listed = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "block", "start", F.struct(start.alias("start"), end.alias("end")).alias("loss"), "attachments"))).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["nth"].alias("turn"), a["ordinal"].alias("ordinal"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = listed.select("conv_id", F.array_join(F.transform("rows", lambda r: r["block"]), "").alias("formatted"), F.transform("rows", lambda r: r["start"]).alias("turn_starts"), F.transform("rows", lambda r: r["loss"]).alias("loss"), attachments.alias("attachments"))
    return out.withColumn("n_attached_tokens", F.aggregate(F.transform("attachments", lambda a: a["tokens"]), F.lit(0).cast("long"), lambda a, x: a + x))


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of formatted conversations, with turns array<struct<role,text>> and loss_texts read out of them."""
    blocks = formatted.withColumn("blocks", F.slice(F.split("formatted", CLOSE), 1, F.size("turn_starts")))

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(OPEN) + 1))
        return let(F.split(body, ": ", 2), lambda x: F.struct(unescaped(x[0]).alias("role"), unescaped(x[1]).alias("text")))

    def masked(block: Column, k: Column) -> Column:
        span, start = F.get("loss", k), F.get("turn_starts", k)
        return unescaped(F.substr(block, (span["start"] - start + 1).cast("int"), (span["end"] - span["start"]).cast("int")))

    return blocks.withColumns({"turns": F.transform("blocks", turn), "loss_texts": F.transform("blocks", masked)}).drop("blocks")


def digests(turns: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, read back from its formatted text and its loss mask."""
    back = read_back(format_turns(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("loss_texts", "").alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return read.select("conv_id", "n_turns", sha("said").alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), sha("learnt").alias("loss_sha256"), "formatted_chars")
