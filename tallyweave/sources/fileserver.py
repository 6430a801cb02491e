"""A relational database in files of the shared folder (SQLite), with the reads and loads of `Relational`.

It stands in for a server where a session has several machines: an embedded database of the driver's JVM is not there for
executors, but files are there for all tasks. A table is in shards, files of about SHARD rows. A task of a load writes shards
of its own, under new names in each attempt, so no task waits for another and a task that runs twice counts once; one
transaction in the catalog file then names those of the attempts that ended well, and a load that fails names none. A read
takes small shards together and splits large ones by predicates, each in the shard alone, on an index that the shard's own task
makes: so the work on a shard does not depend on how many there are. Columns and ranges that a read names are in its queries. A replacement writes anew only shards that hold one of
its values; a table that was read before keeps the shards it had. Dates are stored as days since 1970-01-01 and come back as dates;
columns are numbers, strings or dates.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing, suppress
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DoubleType, FloatType, IntegerType, StringType, StructField, StructType

from tallyweave.sources.relational import ROWS_A_PART, Between, Relational
from tallyweave.staging import fresh_path, mapped

#: Seconds that a reader waits for one that makes an index; rows of one Arrow batch, and of a shard.
WAIT, ROWS, SHARD = 3600, 50_000, 250_000
#: Shards of a task, each with its predicate.
Part = list[tuple[str, str]]


def _connected(path: str) -> sqlite3.Connection:
    connection = sqlite3.connect(path, timeout=WAIT, isolation_level=None)
    connection.execute("pragma synchronous = off")  # the file ends with the session
    return connection


def _kind(field: StructField) -> str:
    return "text" if isinstance(field.dataType, StringType) else "real" if isinstance(field.dataType, (DoubleType, FloatType)) else "integer"


def _stored(schema: StructType) -> StructType:
    return StructType([StructField(f.name, IntegerType() if isinstance(f.dataType, DateType) else f.dataType) for f in schema])


class _Shard(Relational):
    """One shard, inside a task."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns = path, columns

    def _named(self, table: str) -> str:
        return '"rows"'

    def names(self, table: str) -> dict[str, str]:
        return {c.lower(): f'"{c}"' for c in self.columns}

    def query(self, sql: str) -> list:
        with closing(_connected(self.path)) as connection:
            return connection.execute(sql).fetchall()

    def _cell(self, split: str, low, width, bounds: list) -> str:
        return f"({split} - {low}) / {width}" if isinstance(low, int) else super()._cell(split, low, width, bounds)

    def _remainder(self, spread: str, pieces: int) -> str:
        return f"abs(coalesce({spread}, 0)) % {pieces}"

    def parts(self, split: str, spread: str | None, rows_a_part: int) -> list[str]:
        names = self.names("rows")
        indexed = ", ".join(names[c.lower()] for c in (split, spread) if c)
        self.query(f'create index if not exists "{split}_{spread}" on "rows" ({indexed})')
        return self.predicates("rows", split, spread, rows_a_part)


class FileServer(Relational):
    most_parts = 1024

    def __init__(self, spark: SparkSession):
        super().__init__(spark, {})
        folder = fresh_path(spark, "server")
        if not folder.startswith(("file:", "/")):
            raise ValueError(f"a database file needs a shared folder that is mounted, not {folder}")
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
        self.folder, self.schemas = place.toUri().getPath(), {}
        self.path = f"{self.folder}/db"
        self.execute("create table shards (name text, file text, n integer)")

    def names(self, table: str) -> dict[str, str]:
        return {f.name.lower(): f'"{f.name}"' for f in self.schemas[table]}

    def query(self, sql: str) -> list:
        """Of the catalog."""
        with closing(_connected(self.path)) as connection:
            return connection.execute(sql).fetchall()

    def execute(self, *statements: str) -> None:
        """On the catalog, in one transaction."""
        with closing(_connected(self.path)) as connection:
            connection.execute("begin immediate")
            try:
                for sql in statements:
                    connection.execute(sql)
                connection.execute("commit")
            except BaseException:
                connection.execute("rollback")
                raise

    def create(self, table: str, rows: DataFrame, types: str | None = None) -> None:
        """An empty table with the columns of rows; lengths in `types` mean nothing here."""
        if table in self.schemas:
            raise ValueError(f"table {table} is there already")
        self.schemas[table] = rows.schema

    def shards(self, table: str) -> list[tuple[str, int]]:
        """Files of a table and their rows."""
        name = table.replace("'", "''")
        return self.query(f"select file, n from shards where name = '{name}' order by rowid")

    def _rows(self, table: str, parts: list[Part], number: bool = False, columns: list[str] | None = None, between: Between | None = None) -> DataFrame:
        """Rows of the parts, one task each; number: each with the number of its part."""
        names, whole = self.names(table), self.schemas[table]
        schema = whole if columns is None else StructType([StructField(c, next(f.dataType for f in whole if f.name.lower() == c.lower())) for c in columns])
        stored = _stored(schema) if not number else _stored(schema).add("load_part", "integer")
        arrow, select = to_arrow_schema(stored), f"select {', '.join(names[f.name.lower()] for f in schema)}"
        tests = "".join(f" and {names[c.lower()]} between ? and ?" for c in between or {})
        ends = [(x - dt.date(1970, 1, 1)).days if isinstance(x, dt.date) else x for pair in (between or {}).values() for x in pair]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    for file, test in parts[part]:
                        with closing(_connected(file)) as connection:
                            found = connection.execute(f'{select}{f", {part}" if number else ""} from "rows" where {test}{tests}', ends)
                            while rows := list(islice(found, ROWS)):
                                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        rows = mapped(self.spark.range(0, len(parts), 1, max(1, len(parts))), run, stored)
        return rows.select(*[F.date_from_unix_date(f.name).alias(f.name) if isinstance(f.dataType, DateType) else F.col(f.name) for f in schema], *["load_part"] * number)

    def read(self, table: str, split: str | None = None, spread: str | None = None, rows_a_part: int = ROWS_A_PART, columns: list[str] | None = None, between: Between | None = None) -> DataFrame:
        shards, known = self.shards(table), self.schemas[table].names
        rows_a_part = max(rows_a_part, math.ceil(sum(n for _, n in shards) / self.most_parts))
        large = [file for file, n in shards if split is not None and n > rows_a_part]
        apart, held = {*large}, rows_a_part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    tests = _Shard(large[k], known).parts(split, spread, rows_a_part)
                    yield pa.RecordBatch.from_arrays([pa.array([large[k]] * len(tests)), pa.array(tests)], names=["file", "test"])

        parts: list[Part] = []
        if large:
            parts = [[(r["file"], r["test"])] for r in mapped(self.spark.range(0, len(large), 1, len(large)), run, "file string, test string").collect()]
        for file, n in shards:
            if file not in apart:
                if held + n > rows_a_part:
                    parts.append([])
                    held = 0
                parts[-1].append((file, "1 = 1"))
                held += n
        return self._rows(table, parts, columns=columns, between=between)

    def _written(self, table: str, rows: DataFrame) -> list[tuple[str, int]]:
        """New shards with the rows, which no table has yet."""
        held = rows.select(*[F.unix_date(f.name).alias(f.name) if isinstance(f.dataType, DateType) else F.col(f.name) for f in rows.schema])
        names, folder = self.names(table), self.folder
        create = 'create table "rows" (' + ", ".join(f'"{f.name}" {_kind(f)}' for f in self.schemas[table]) + ")"
        insert = f'insert into "rows" ({", ".join(names[c.lower()] for c in rows.columns)}) values ({", ".join("?" * len(rows.columns))})'

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: list[tuple[str, int]] = []
            more = True
            try:
                while more:
                    more, file, n = False, f"{folder}/{uuid.uuid4().hex}", 0
                    for batch in batches:
                        if not batch.num_rows:
                            continue
                        if not n:
                            made.append((file, 0))
                            connection = _connected(file)
                            connection.execute("pragma journal_mode = off")  # none reads the file before it is whole
                            connection.execute(create)
                            connection.execute("begin")
                        connection.executemany(insert, zip(*(c.to_pylist() for c in batch.columns)))
                        n += batch.num_rows
                        if more := n >= SHARD:
                            break
                    if n:
                        connection.execute("commit")
                        connection.close()
                        made[-1] = (file, n)
            except BaseException:
                for file, _ in made:
                    with suppress(OSError):
                        os.remove(file)
                raise
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], names=["file", "n"])

        return [tuple(r) for r in mapped(held, run, "file string, n long").collect()]

    def _named_by(self, table: str, shards: list[tuple[str, int]]) -> list[str]:
        name = table.replace("'", "''")
        return [f"insert into shards values ('{name}', '{file}', {n})" for file, n in shards]

    def append(self, table: str, rows: DataFrame) -> None:
        self.execute(*self._named_by(table, self._written(table, rows)))

    def replace(self, table: str, rows: DataFrame, by: str) -> None:
        """The rows of all values of `by` that rows has are replaced by rows; a null is a value like any other."""
        by, old = self.names(table)[by.lower()].strip('"'), self.shards(table)
        new = self._written(table, rows)
        values = self._rows(table, [[(file, "1 = 1")] for file, _ in new], columns=[by]).select(F.col(by).alias("value")).distinct()
        same = F.col(by).eqNullSafe(F.col("value"))
        found = self._rows(table, [[(file, "1 = 1")] for file, _ in old], number=True, columns=[by]).distinct().join(values, same, "left_semi").select("load_part").distinct().collect()
        touched = [old[r["load_part"]][0] for r in found]
        kept = self._written(table, self._rows(table, [[(file, "1 = 1")] for file in touched]).join(values, same, "left_anti")) if touched else []
        self.execute(*[f"delete from shards where file = '{file}'" for file in touched], *self._named_by(table, kept + new))
