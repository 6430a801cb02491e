"""Files and catalogs: CSV, JSON, source trees, table introspection, and the artefacts of the retrieval layer."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.functions.scalar import truncated
from tallyweave.staging import bounded_batches, give_back

CODE_TYPES = ("py", "sql", "md", "txt", "json", "yaml", "yml")
SKIPPED = ("__pycache__", ".git", ".venv", "venv", "node_modules", ".idea", ".vscode", "build", "dist")
LEAST_CHARS = 100


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_rows(spark: SparkSession, path: str, schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(*columns) if columns else rows


def code_files(spark: SparkSession, root: str, types: tuple[str, ...] = CODE_TYPES, skipped: tuple[str, ...] = SKIPPED, least: int = LEAST_CHARS) -> DataFrame:
    """(path, content, modified, size) of the files below root with an allowed ending, outside the skipped folders."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(types) + "}").load(root)
    inside = ~F.col("path").rlike("/(?:" + "|".join(x.replace(".", r"\.") for x in skipped) + ")/")
    rows = files.where(inside).select("path", F.expr("try_validate_utf8(cast(content as string))").alias("content"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    return rows.where(F.char_length("content") >= least)


def columns_of(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable) of the catalog's tables; metadata only."""
    found = [(t.name, k, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables(database) for k, c in enumerate(spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name))]
    return spark.createDataFrame(found, "table_name string, ordinal int, column_name string, data_type string, nullable boolean")


def schema_chunks(columns: DataFrame, primary: dict[str, list[str]] | None = None, foreign: dict[str, list[str]] | None = None) -> DataFrame:
    """(source, type, content): one text for each table, a line for each column with [PK] and [FK] marks."""
    marked = lambda keys, mark: F.when(F.concat_ws(".", "table_name", "column_name").isin([f"{t}.{c}" for t, cs in (keys or {}).items() for c in cs]), F.lit(mark)).otherwise(F.lit(""))
    line = F.concat(F.lit("  - "), F.col("column_name"), F.lit(": "), F.col("data_type"), F.when(F.col("nullable"), F.lit("")).otherwise(F.lit(" NOT NULL")), marked(primary, " [PK]"), marked(foreign, " [FK]"))
    listed = columns.groupBy("table_name").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    return listed.select(F.col("table_name").alias("source"), F.lit("sql_schema").alias("type"), F.concat(F.lit("Table: "), F.col("table_name"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("content"))


def sample_chunk(df: DataFrame, name: str, rows: int = 5, most: int = 50) -> DataFrame:
    """(source, type, content): a few rows as text, values cut at `most` characters. A sample by its definition."""
    shown = df.limit(rows).select(F.concat_ws(" | ", *[truncated(F.coalesce(F.col(c).cast("string"), F.lit("NULL")), most) for c in df.columns]).alias("line"))
    return shown.agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines")).select(F.lit(name).alias("source"), F.lit("sql_sample").alias("type"), F.concat(F.lit(" | ".join(df.columns) + "\n"), F.col("lines")).alias("content"))


def embedded(chunks: DataFrame, encode, dimensions_type: str = "array<float>", most: int = 8000, batch: int = 32) -> DataFrame:
    """chunks with `embedding` from encode(list of texts) -> list of vectors, and `embedding_error`; longer texts are cut
    with a marker.

    A batch that fails leaves nulls and its error in its own rows, so vectors and chunks never shift against each other.
    Texts go to Python by bytes, not by rows, and a worker's memory stays the same however many rows its task has."""
    bounded_batches(chunks.sparkSession)

    @F.pandas_udf(f"embedding {dimensions_type}, error string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out: list = []
            for k in range(0, len(texts), batch):
                part = list(texts.iloc[k : k + batch])
                try:
                    out += [(v, None) for v in encode(part)]
                except (OSError, ValueError, RuntimeError) as e:
                    out += [(None, repr(e))] * len(part)
            yield pd.DataFrame(out, columns=["embedding", "error"])
            del texts, out
            give_back()

    made = chunks.withColumn("_made", vectors(truncated(F.coalesce("content", F.lit("")), most, "\n... [truncated]")))
    return made.select(*chunks.columns, F.col("_made.embedding").alias("embedding"), F.col("_made.error").alias("embedding_error"))


def save(df: DataFrame, path: str) -> None:
    """A Parquet artefact that is there whole or as before: written beside its place, then renamed to it. What was there
    comes back if that fails; between the two renames, a moment, nothing is at the place."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    aside, ready = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (old, new))
    moved = fs.exists(place) and fs.rename(place, aside)
    try:
        if not fs.rename(ready, place):
            raise OSError(f"cannot rename {new} to {path}")
    except Exception:
        if moved:
            fs.rename(aside, place)
        fs.delete(ready, True)
        raise
    if moved:
        fs.delete(aside, True)


def load_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A Parquet artefact, or no rows where it is missing."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_entries(text: str) -> list[dict]:
    """Entries of a cache or metadata text in either layout, a list of entries or an object with a list under `chunks`
    or `metadata`; a text that is no JSON has none."""
    try:
        found = json.loads(text)
    except ValueError:
        return []
    if isinstance(found, dict):
        found = next((found[k] for k in ("chunks", "metadata") if isinstance(found.get(k), list)), [])
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


#: Rows of a sheet, without its header.
SHEET_ROWS = 1_048_575


def to_excel(df: DataFrame, path: str) -> int:
    """A small result, such as the statements of one company, as a workbook of one sheet on the driver's disk; returns
    its rows. More rows than a sheet holds are a ValueError. Numbers are numbers, nulls are empty, all else is text."""
    rows = df.limit(SHEET_ROWS + 1).collect()
    if len(rows) > SHEET_ROWS:
        raise ValueError(f"a sheet holds {SHEET_ROWS} rows")

    def cell(value) -> str:
        if value is None:
            return "<c/>"
        if isinstance(value, (int, float)) and not isinstance(value, bool) and value - value == 0:  # finite
            return f"<c><v>{value!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'

    lines = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in [df.columns, *rows])
    kind, main = "http://schemas.openxmlformats.org/package/2006/", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = "application/vnd.openxmlformats-officedocument.spreadsheetml."
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{kind}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet}sheet.main+xml"/><Override PartName="/xl/sheet1.xml" ContentType="{sheet}worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{kind}relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{kind}relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="sheet1.xml"/></Relationships>',
        "xl/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return len(rows)
