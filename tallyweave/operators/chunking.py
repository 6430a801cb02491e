"""Text and code chunks: line windows with overlap, and functions and classes of source files.

Chunk borders depend on everything before them in a text, which no built-in function expresses; each text is cut
by one Arrow-batched function, and texts never meet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.staging import mapped

SIZE, OVERLAP, LEAST = 1000, 200, 100
#: What makes a stripped line a border, at which a chunk may rather end: how it begins, or how it ends.
BORDER = re.compile(r"^(?:def |class |# ===|\"{3}|'{3}|#.{10})|(?:\"{3}|'{3})$")


def chunk(text: str, size: int = SIZE, overlap: int = OVERLAP, boundary_aware: bool = False, near: int = 3) -> list[str]:
    """Chunks of whole lines of about `size` characters, each starting with up to `overlap` characters of the last.

    A short text is one chunk as it is. Of a longer one, chunks of LEAST characters or fewer are left out. With
    boundary_aware a full chunk ends only within `near` lines of a boundary line and grows until then."""
    if len(text) <= size:
        return [text]
    lines = text.split("\n")
    close = [True] * len(lines)
    if boundary_aware:
        marks = [0] * (len(lines) + 1)
        for k, line in enumerate(lines):
            if BORDER.search(line.strip()):
                marks[max(0, k - near)] += 1
                marks[min(len(lines), k + near + 1)] -= 1
        depth = 0
        for k in range(len(lines)):
            depth += marks[k]
            close[k] = depth > 0
    out, first, used = [], 0, 0
    for k, line in enumerate(lines):
        if used + len(line) + 1 > size and k > first and close[k]:
            out.append("\n".join(lines[first:k]))
            start, kept = k, 0
            while start > first and kept + len(lines[start - 1]) + 1 <= overlap:
                start -= 1
                kept += len(lines[start]) + 1
            first, used = start, kept
        used += len(line) + 1
    out.append("\n".join(lines[first:]))
    return [c for c in out if len(c) > LEAST]


#: Patterns of functions and classes in the simple and in the decorated form.
SIMPLE = {
    "function": re.compile(r"def\s+(\w+)\s*\([^)]*\):[^{]*?(?=\n(?:def|class|\Z))", re.S | re.M),
    "class": re.compile(r"class\s+(\w+)[^:]*:[^{]*?(?=\n(?:def|class|\Z))", re.S | re.M),
}
DECORATED = {
    "function": re.compile(r"((?:@\w+(?:\([^)]*\))?\s*\n)*)\s*def\s+(\w+)\s*\([^)]*\)(?:\s*->\s*[^:]+)?:[^{]*?(?=\n(?:def|class|\Z|@\w+\s*\ndef|@\w+\s*\nclass))", re.S | re.M),
    "class": re.compile(r"((?:@\w+(?:\([^)]*\))?\s*\n)*)\s*class\s+(\w+)(?:\([^)]*\))?:[^{]*?(?=\n(?:def|class|\Z|@\w+\s*\ndef|@\w+\s*\nclass))", re.S | re.M),
}
def chunk_texts(df: DataFrame, id_column: str, text_column: str = "text", size: int = SIZE, overlap: int = OVERLAP, boundary_aware: bool = False) -> DataFrame:
    """(id, chunk_no, content): chunks of each text from 0; null text has none."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(k, n, c) for k, t in enumerate(b.column(1).to_pylist()) if t is not None for n, c in enumerate(chunk(t, size, overlap, boundary_aware))]
            ids, numbers, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(texts, pa.string())], names=[id_column, "chunk_no", "content"])

    return mapped(df.select(id_column, text_column), run, f"`{id_column}` {kind}, chunk_no int, content string")


def import_lines(code: Column) -> Column:
    """The import statements among the first 20 lines, one a line."""
    plain = F.transform(F.slice(F.split(code, "\n"), 1, 20), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(plain, lambda x: x.rlike("^(?:import|from) ")), "\n")


def code_entities(df: DataFrame, id_column: str, text_column: str = "text", with_imports: bool = True) -> DataFrame:
    """(id, entity_no, entity_type, entity_name, content, has_decorators, method_count, line_count): functions, then
    classes, of over LEAST characters each. with_imports puts the text's imports before each, and tells decorators,
    lines and a class's methods; without, those three are null.

    Only the patterns run in Python, which yield place, name, decorators and body; the rest is column expressions."""
    kind = df.schema[id_column].dataType.simpleString()
    forms = DECORATED if with_imports else SIMPLE
    columns = [("entity_no", pa.int32()), ("entity_type", pa.string()), ("entity_name", pa.string()), ("above", pa.string()), ("body", pa.string()), ("imports", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, cells = [], []
            for k, (code, imports) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                hits = [(form, m[m.lastindex], m[1], m[0].strip()) for form, pattern in forms.items() for m in pattern.finditer(code or "")]
                hits = [x for x in hits if len(x[3]) > LEAST]
                owner += [k] * len(hits)
                cells += [(n, *x, imports) for n, x in enumerate(hits)]
            made = [pa.array(x, t) for x, (_, t) in zip(zip(*cells) if cells else [[]] * len(columns), columns)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner, pa.int64())), *made], names=[id_column, *(n for n, _ in columns)])

    found = mapped(df.select(id_column, text_column, import_lines(F.col(text_column)).alias("imports")), run, f"`{id_column}` {kind}, entity_no int, entity_type string, entity_name string, above string, body string, imports string")
    if not with_imports:
        none = F.lit(None)
        return found.select(id_column, "entity_no", "entity_type", "entity_name", F.col("body").alias("content"), none.cast("boolean").alias("has_decorators"), none.cast("int").alias("method_count"), none.cast("int").alias("line_count"))
    methods = F.regexp_count("body", F.lit(r"(?U)\n\s+def\s+\w+"))
    return found.select(
        id_column,
        "entity_no",
        "entity_type",
        "entity_name",
        F.when(F.col("imports") != "", F.concat("imports", F.lit("\n\n"), "body")).otherwise(F.col("body")).alias("content"),
        F.col("above").rlike(r"(?U)\S").alias("has_decorators"),
        F.when(F.col("entity_type") == "class", methods).alias("method_count"),
        (F.regexp_count("body", F.lit("\n")) + 1).alias("line_count"),
    )


def file_chunks(files: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, type, content, metadata) of code files (path, content, modified): entities, and boundary-aware text chunks."""
    rows = files.select(F.col("path").alias("source"), "content", F.col("modified").cast("string").alias("modified"))
    facts = rows.select("source", F.regexp_extract("source", r"(\.\w+)$", 1).alias("file_type"), F.char_length("content").cast("string").alias("file_size"), "modified")
    code = code_entities(rows, "source", "content").select("source", F.lit("code_semantic").alias("type"), "content", "entity_type", "entity_name", F.col("line_count").cast("string").alias("line_count"))
    text = chunk_texts(rows, "source", "content", size, overlap, True).select("source", F.lit("code_text").alias("type"), "content")
    both = code.unionByName(text, allowMissingColumns=True).join(facts, "source")
    entries = F.map_filter(F.create_map(*[x for c in ("file_type", "file_size", "entity_type", "entity_name", "line_count") for x in (F.lit(c), F.col(c))], F.lit("file_path"), F.col("source"), F.lit("last_modified"), F.col("modified")), lambda k, v: v.isNotNull())
    return both.select("source", "type", "content", entries.alias("metadata"))
