"""Vendor formats brought to the stored schemas, and a Python data source for end-of-day prices."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

from tallyweave.functions.scalar import half_even, last_weekday_of, number
from tallyweave.schemas import EOD, POSITIONS, require
from tallyweave.staging import written

#: Intervals of requests and what the second price vendor calls them.
FREQUENCIES = {"1d": "D", "1wk": "W", "1mo": "M", "5d": "D"}
#: Price columns of the two vendors.
RAW_COLUMNS = {"Open Price": "open", "High Price": "high", "Low Price": "low", "Accumulated Volume": "volume"}
YAHOO_COLUMNS = {"Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume", "Dividends": "dividends", "Stock Splits": "stock_splits"}


def frequency(interval: str) -> str:
    return FREQUENCIES.get(interval, "D")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """All double columns rounded half to even."""
    return df.withColumns({c: half_even(F.col(c), digits) for c, t in df.dtypes if t == "double"})


def check_request(symbols: DataFrame, start: dt.date, end: dt.date) -> None:
    require(symbols, "symbol", "security_id")
    if start >= end:
        raise ValueError("the start has to lie before the end")


def yahoo_prices(raw: DataFrame, symbols: DataFrame, loaded: dt.datetime, interval: str = "1d") -> DataFrame:
    """EOD rows from raw (symbol, Date, Open, …): renamed, named by security_id, rounded to 4 places."""
    named = raw.withColumnsRenamed(YAHOO_COLUMNS).join(symbols.select("symbol", "security_id"), "symbol")
    out = named.select(*[F.to_date("Date").alias(f.name) if f.name == "as_of_date" else F.lit(loaded).cast("timestamp").alias(f.name) if f.name == "dataload_date" else F.lit(interval).alias(f.name) if f.name == "interval" else (F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EOD])
    return rounded(out)


def name_price_columns(df: DataFrame) -> DataFrame:
    """Renames by position: of exactly two columns `Close Price`, the first is close and the second adj_close."""
    closes = [k for k, c in enumerate(df.columns) if c == "Close Price"]
    names = [RAW_COLUMNS.get(c, c) for c in df.columns]
    for k, name in zip(closes, ("close", "adj_close") if len(closes) == 2 else ()):
        names[k] = name
    return df.toDF(*names)


def resolved(symbols: DataFrame, lookup: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """symbols with `ric` from lookup (symbol, ric); a ric that contains a key of overrides becomes its value."""
    ric = F.col("ric")
    for part, other in (overrides or {}).items():
        ric = F.when(F.coalesce(F.col("ric").contains(part), F.lit(False)), F.lit(other)).otherwise(ric)
    found = symbols.select("symbol").distinct().join(lookup, "symbol", "left").withColumn("ric", ric)
    return symbols.join(found, "symbol", "left")


def refinitive_prices(raw: DataFrame, symbols: DataFrame, loaded: dt.datetime, interval: str = "1d") -> DataFrame:
    """EOD rows from raw (Instrument, Date, prices) and symbols (ric, security_id); rounded to 4 places."""
    named = name_price_columns(raw).withColumnRenamed("Instrument", "ric").join(symbols.where("ric is not null").select("ric", "security_id"), "ric", "left")
    fixed = {"as_of_date": F.to_date("Date"), "dataload_date": F.lit(loaded), "interval": F.lit(interval), "dividends": F.lit(0.0), "stock_splits": F.lit(0.0)}
    return rounded(named.select(*[fixed.get(f.name, F.col(f.name) if f.name in named.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EOD]))


def fundamentals_from_wide(wide: DataFrame, metrics: list[str], effective: dt.date, vendor: str = "Yahoo Finance") -> DataFrame:
    """One open row for each numeric metric that is not null."""
    require(wide, "security_id")
    rows = wide.select("security_id", *[number(F.col(m)).alias(m) for m in metrics]).unpivot(["security_id"], metrics, "metric_type", "metric_value")
    return rows.where("metric_value is not null").select("security_id", "metric_type", "metric_value", F.lit(vendor).alias("source_vendor"), F.lit(effective).alias("effective_date"), F.lit(None).cast("date").alias("end_date"))


def fundamentals_from_json(answers: DataFrame, vendor: str = "SimFin") -> DataFrame:
    """answers (security_id, body): body is a JSON list of {metric, value, endDate}. Bodies that are no JSON give no rows;
    `unreadable` lists them."""
    parsed = F.from_json("body", "array<struct<metric:string,value:double,endDate:string>>")
    rows = answers.select("security_id", F.inline(parsed))
    return rows.select("security_id", F.col("metric").alias("metric_type"), F.col("value").alias("metric_value"), F.lit(vendor).alias("source_vendor"), F.col("endDate").try_cast("date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"))


def unreadable(answers: DataFrame) -> DataFrame:
    """Answers whose body is no JSON list."""
    return answers.where(F.coalesce(F.json_array_length("body"), F.lit(-1)) < 0)


def positions(frames: list[DataFrame], as_of: dt.date) -> DataFrame:
    """Broker positions of several accounts under one schema and date."""
    if not frames:
        raise ValueError("no account given")
    out = None
    for frame in frames:
        rows = frame.select(*[F.lit(as_of).alias(f.name) if f.name == "as_of_date" else F.col(f.name).cast(f.dataType).alias(f.name) for f in POSITIONS])
        out = rows if out is None else out.unionByName(rows)
    return out


def constituents_as_of(members: DataFrame, day: dt.date) -> DataFrame:
    """Seed rows (ric, exchange_ticker, start_date, end_date) from an index snapshot."""
    return members.select("ric", "exchange_ticker", F.lit(day).cast("timestamp").alias("start_date"), F.lit(None).cast("timestamp").alias("end_date"))


def constituent_changes(changes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Change events (ric, date, change) with the ticker of their ric."""
    return changes.join(tickers.select("ric", "exchange_ticker"), "ric", "left")


def prefixed_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Inner join on several keys; other columns of equal names get the suffixes."""
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    a, b = (side.withColumnsRenamed({c: c + suffix for c in clash}) for side, suffix in zip((left, right), suffixes))
    return a.join(b, keys)


def positions_by_account(fetch: Callable[[str], DataFrame], accounts: str | list[str], today: dt.date) -> tuple[DataFrame | None, dict[str, str]]:
    """Positions of one account or several, dated by the last weekday; and what went wrong, by account, for those left out."""
    frames, failed = [], {}
    for account in [accounts] if isinstance(accounts, str) else accounts:
        try:
            frames.append(fetch(account))
        except (OSError, ValueError) as e:
            failed[account] = repr(e)
    return positions(frames, last_weekday_of(today)) if frames else None, failed


#: Rows of end-of-day prices, and why a symbol has none.
FETCHED = StructType([*EOD, StructField("error", StringType())])


class EodPartition(InputPartition):
    def __init__(self, symbols: list[tuple[str, int]]):
        self.symbols = symbols


class EodReader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Callable[[str, str, str], Iterator[tuple]]):
        self.options, self.fetch = options, fetch

    def partitions(self) -> list[EodPartition]:
        pairs = [(symbol, int(number_)) for symbol, _, number_ in (x.rpartition(":") for x in self.options["symbols"].split(",") if x)]
        batch = int(self.options.get("batch", "50"))
        return [EodPartition(pairs[k : k + batch]) for k in range(0, len(pairs), batch)]

    def read(self, partition: EodPartition) -> Iterator[tuple]:
        """Rows of FETCHED; a symbol that fails or has no rows is one row with its security_id and an error."""
        now, interval = dt.datetime.now(), self.options.get("interval", "1d")
        for symbol, security_id in partition.symbols:
            error = "no rows"
            try:
                for day, *values in list(self.fetch(symbol, self.options["start"], self.options["end"])):
                    yield (day, security_id, *values, now, interval, None)
                    error = None
            except (OSError, ValueError) as e:
                error = repr(e)
            if error:
                yield (None, security_id, *[None] * 8, now, interval, error)


def eod_source(name_: str, fetch: Callable[[str, str, str], Iterator[tuple]]) -> type[DataSource]:
    """A data source class to register, over the option `symbols` (symbol:security_id,…), `batch` of them a partition.

    fetch(symbol, start, end) yields (as_of_date, open, high, low, close, adj_close, volume, dividends, stock_splits)."""

    class Eod(DataSource):
        @classmethod
        def name(cls) -> str:
            return name_

        def schema(self) -> StructType:
            return FETCHED

        def reader(self, schema: StructType) -> EodReader:
            return EodReader(dict(self.options), fetch)

    return Eod


def load_prices(source: str, symbols: DataFrame, start: dt.date, end: dt.date, interval: str = "1d", batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """Prices of a registered source for symbols (symbol, security_id), rounded to 4 places; and (symbol, error) of those
    it has none for. The request is checked first; the list of symbols is one request, so it is on the driver."""
    check_request(symbols, start, end)
    spark = symbols.sparkSession
    asked = symbols.select("symbol", "security_id").where("symbol is not null and security_id is not null").distinct()
    listed = ",".join(f"{r['symbol']}:{r['security_id']}" for r in asked.orderBy("security_id", "symbol").collect())
    found = spark.read.format(source).options(symbols=listed, start=str(start), end=str(end), interval=interval, batch=str(batch)).load()
    found = written(found, "prices")
    return rounded(found.where("error is null").drop("error")), found.where("error is not null").join(asked, "security_id").select("symbol", "error")


def bulk_statements(spark: SparkSession, paths: list[str], schemas: list[str], keys: list[str]) -> DataFrame:
    """Bulk statement files (separated by semicolons, with a header) joined on their keys; other columns of equal
    names in the first two get _x and _y."""
    frames = [spark.read.csv(path, header=True, sep=";", schema=schema) for path, schema in zip(paths, schemas, strict=True)]
    out = frames[0]
    for frame in frames[1:]:
        out = prefixed_join(out, frame, keys)
    return out
