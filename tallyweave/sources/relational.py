"""Tables of a relational server over JDBC: reads in many tasks, loads that are there whole or not at all.

A read is split by predicates, one task each. One small query on the server counts the rows of a number or date column in
CELLS ranges of equal width; neighbouring ranges become parts of about `rows_a_part` rows. A part that stays larger,
because a few values hold its rows, is split again by the remainder of an integer column. Nulls of the split column
are a part of their own. Filters and columns of the plan go down to each part's query as they do in any JDBC scan.

A load goes through a table of its own: tasks write their rows there, each row with its number in the load, so that a
task that runs twice writes nothing that counts twice; then one transaction moves the distinct rows on. A load that
fails leaves the target as it was.
"""

from __future__ import annotations

import datetime as dt
import math
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.staging import written

T = TypeVar("T")
#: Least and greatest value by column.
Between = dict[str, tuple[object, object]]

CELLS, ROWS_A_PART, MOST_PARTS, WRITERS = 256, 1_000_000, 4096, 8
#: SQLSTATE class of connection errors, and Java errors of a lost or refused connection.
CONNECTION_STATE, CONNECTION_ERRORS = "08", ("SQLTransientConnectionException", "SQLNonTransientConnectionException", "SQLRecoverableException", "java.net.ConnectException", "java.net.SocketException", "SocketTimeoutException")


def connection_lost(error: BaseException) -> bool:
    """Whether an error, or a Java error that caused it, says that a connection could not be made or was lost."""
    if isinstance(error, ConnectionError):
        return True
    cause, steps = getattr(error, "java_exception", None) or getattr(error, "_origin", None), 0
    while cause is not None and steps < 20:
        name = cause.getClass().getName()
        state = cause.getSQLState() if name.startswith("java.sql.") or "SQLException" in name else None
        if any(e in name for e in CONNECTION_ERRORS) or (state or "").startswith(CONNECTION_STATE):
            return True
        cause, steps = cause.getCause(), steps + 1
    return False


def with_retries(call: Callable[[], T], retry: Callable[[BaseException], bool] = connection_lost, most: int = 3, wait_minutes: float = 2) -> T:
    """call(), again after a wait where its error is one to retry; the last error, and any other, is raised."""
    if most < 1:
        raise ValueError("at least one attempt is needed")
    for attempt in range(1, most + 1):
        try:
            return call()
        except Exception as e:
            if attempt == most or not retry(e):
                raise
            time.sleep(wait_minutes * 60)
    raise AssertionError


def literal(value) -> str:
    """A number or a date in SQL."""
    if isinstance(value, (dt.date, dt.datetime)):
        return f"{{d '{value:%Y-%m-%d}'}}"  # the escape of JDBC, which each driver turns into its own syntax
    return repr(value)


def ranges(counts: list[tuple[int, int]], low, width, rows_a_part: int) -> list[tuple[object, object, int]]:
    """(from, to, rows) of parts of about rows_a_part rows from the counts of cells of equal width; the last part's end is open."""
    parts, begin, rows = [], 0, 0
    for cell, n in sorted(counts):
        if rows and rows + n > rows_a_part:
            parts.append((begin, cell, rows))
            begin, rows = cell, 0
        rows += n
    parts.append((begin, None, rows))
    at = lambda cell: None if cell is None else low + width * cell
    return [(at(a) if k else None, at(b), n) for k, (a, b, n) in enumerate(parts)]


class Relational:
    """A relational server. options: those of spark.read.format("jdbc"), url at least."""

    #: Parts of a read at most, about; larger tables have larger parts.
    most_parts = MOST_PARTS

    def __init__(self, spark: SparkSession, options: dict[str, str]):
        self.spark, self.options = spark, options

    def _reader(self, dbtable: str):
        return self.spark.read.format("jdbc").options(**self.options).option("dbtable", dbtable)

    def names(self, table: str) -> dict[str, str]:
        """The columns of a table by their names in lower case, as SQL of the server writes them."""
        with self._connection() as connection:
            quote = connection.getMetaData().getIdentifierQuoteString().strip()
        return {c.lower(): f"{quote}{c}{quote}" for c in with_retries(self._reader(table).load).columns}

    def query(self, sql: str) -> list:
        """Rows of a small result, such as counts."""
        return with_retries(lambda: self._reader(f"({sql}) q").load().collect())

    def _named(self, table: str) -> str:
        """A table's name in SQL."""
        return table

    def _cell(self, split: str, low, width, bounds: list) -> str:
        """The number of the range of a value, in SQL."""
        return "case " + " ".join(f"when {split} < {literal(b)} then {c}" for c, b in enumerate(bounds)) + f" else {len(bounds)} end" if bounds else "0"

    def _remainder(self, spread: str, pieces: int) -> str:
        return f"mod(abs(coalesce({spread}, 0)), {pieces})"

    def predicates(self, table: str, split: str, spread: str | None = None, rows_a_part: int = ROWS_A_PART) -> list[str]:
        """Conditions of which each row of the table meets exactly one.

        spread: an integer column by whose remainder parts of too many rows are split again; nulls count as remainder 0."""
        names = self.names(table)
        split, spread = names[split.lower()], names[spread.lower()] if spread else None
        low, high, rows, known = self.query(f"select min({split}) as lo, max({split}) as hi, count(*) as n, count({split}) as k from {self._named(table)}")[0]
        rows_a_part = max(rows_a_part, math.ceil(rows / self.most_parts))  # the work of the server is parts times rows where it has no index
        out = [(f"{split} is null", rows - known)] if rows > known else []
        if known:
            days = isinstance(low, dt.date)
            distance = (high - low).days if days else high - low
            width = max(1, math.ceil((distance + 1) / CELLS)) if days or isinstance(low, int) else float(distance) / CELLS or 1.0
            bounds = [low + (dt.timedelta(days=width * c) if days else width * c) for c in range(1, CELLS)]
            bounds = [b for b in bounds if b <= high]
            cell = self._cell(split, low, width, bounds)
            counts = [(int(r[0]), int(r[1])) for r in self.query(f"select c, count(*) as n from (select {cell} as c from {self._named(table)} where {split} is not null) x group by c")]
            for a, b, n in ranges(counts, low, dt.timedelta(days=width) if days else width, rows_a_part):
                tests = [f"{split} >= {literal(a)}"] * (a is not None) + [f"{split} < {literal(b)}"] * (b is not None)
                out.append((" and ".join([*tests, f"{split} is not null"]), n))
        parts = []
        for test, n in out:
            pieces = min(MOST_PARTS, math.ceil(n / rows_a_part)) if spread else 1
            parts += [test] if pieces <= 1 else [f"{test} and {self._remainder(spread, pieces)} = {k}" for k in range(pieces)]
        return parts or ["1 = 1"]

    def read(self, table: str, split: str | None = None, spread: str | None = None, rows_a_part: int = ROWS_A_PART, columns: list[str] | None = None, between: Between | None = None) -> DataFrame:
        """A table, by as many tasks as `predicates` says; without a split column by one.

        columns, between: only these columns, and rows with values in these ranges, ends included; they are in each task's query."""
        if split is None:
            rows = with_retries(self._reader(table).load)
        else:
            parts = self.predicates(table, split, spread, rows_a_part)
            other = {k: v for k, v in self.options.items() if k != "url"}
            rows = with_retries(lambda: self.spark.read.jdbc(self.options["url"], table, predicates=parts, properties=other))
        for c, (low, high) in (between or {}).items():
            rows = rows.where(F.col(c).between(F.lit(low), F.lit(high)))
        return rows if columns is None else rows.select(*columns)

    @contextmanager
    def _connection(self):
        jvm = self.spark._jvm
        if "driver" in self.options:
            jvm.java.lang.Class.forName(self.options["driver"])
        properties = jvm.java.util.Properties()
        for key in ("user", "password"):
            if key in self.options:
                properties.setProperty(key, self.options[key])
        connection = with_retries(lambda: jvm.java.sql.DriverManager.getConnection(self.options["url"], properties))
        try:
            yield connection
        finally:
            connection.close()

    def execute(self, *statements: str) -> None:
        """Statements in one transaction."""
        with self._connection() as connection:
            connection.setAutoCommit(False)
            try:
                statement = connection.createStatement()
                for sql in statements:
                    statement.execute(sql)
                connection.commit()
            except Exception:
                connection.rollback()
                raise

    def create(self, table: str, rows: DataFrame, types: str | None = None) -> None:
        """An empty table with the columns of rows; types: those that differ from the driver's, as `name type, …`."""
        writer = rows.limit(0).write.format("jdbc").options(**self.options).option("dbtable", table)
        (writer.option("createTableColumnTypes", types) if types else writer).save()

    def _load(self, table: str, rows: DataFrame, before: Callable[[str], list[str]]) -> None:
        """Moves rows into the table in one transaction, after the statements that `before` makes of the load's own table."""
        held = written(rows, "load").withColumn("load_row", F.monotonically_increasing_id())  # of files, so each attempt numbers alike
        names = self.names(table)
        columns = ", ".join(names[c.lower()] for c in rows.columns)
        own = f"{table}_load_{uuid.uuid4().hex[:12]}"
        self.execute(f"create table {own} as select {columns}, cast(0 as bigint) as load_row from {table} with no data")
        try:
            held.write.format("jdbc").options(**self.options).option("dbtable", own).option("numPartitions", WRITERS).option("batchsize", 5000).mode("append").save()
            rows_, numbers = self.query(f"select count(*) as n, count(distinct load_row) as k from {own}")[0]
            again = f"(select distinct load_row, {columns} from {own}) x" if rows_ > numbers else own
            self.execute(*before(own), f"insert into {table} ({columns}) select {columns} from {again}")
        finally:
            self.execute(f"drop table {own}")

    def append(self, table: str, rows: DataFrame) -> None:
        self._load(table, rows, lambda own: [])

    def replace(self, table: str, rows: DataFrame, by: str) -> None:
        """The rows of all values of `by` that rows has are replaced by rows; a null is a value like any other."""
        by = self.names(table)[by.lower()]
        self._load(table, rows, lambda own: [f"delete from {self._named(table)} where {by} in (select {by} from {own} where {by} is not null) or ({by} is null and exists (select 1 from {own} where {by} is null))"])
