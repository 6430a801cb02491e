"""Index membership: intervals from joiner and leaver events, and float-adjusted shares."""

from __future__ import annotations

import bisect
import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.functions.scalar import clipped, half_even
from tallyweave.operators.fold import folded
from tallyweave.operators.temporal import daily_forward_fill, ordered_forward_fill
from tallyweave.sources.vendor import constituent_changes, constituents_as_of

INTERVAL = "struct<ticker:string,start_date:timestamp,end_date:timestamp>"


def membership_intervals(seeds: DataFrame, events: DataFrame, window_start: dt.datetime) -> DataFrame:
    """(ric, exchange_ticker, start_date, end_date) from seeds (ric, exchange_ticker) and events (ric, exchange_ticker,
    date, seq, change).

    Events fold in the order date, seq within a ric; other rics never matter to it. A joiner moves an open interval
    that still starts at the window's start, else opens one; a leaver closes the latest open interval that began
    by then, else adds one from the window's start. A ric's events fit one row, as an index changes rarely."""
    start = F.lit(window_start).cast("timestamp")
    listed = events.groupBy("ric").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("timestamp").alias("date"), "seq", "change", F.col("exchange_ticker").alias("ticker")))).alias("events"))
    opened = seeds.groupBy("ric").agg(F.collect_list(F.struct(F.col("exchange_ticker").alias("ticker"), start.alias("start_date"), F.lit(None).cast("timestamp").alias("end_date"))).alias("seeds"))
    none = F.array().cast(f"array<{INTERVAL}>")

    def interval(ticker: Column, low: Column, high: Column) -> Column:
        return F.struct(ticker.alias("ticker"), low.alias("start_date"), high.alias("end_date"))

    def at(state: Column, k: Column, new) -> Column:
        return F.transform(state, lambda x, i: F.when(i == k, new(x)).otherwise(x))

    def first_index(flags: Column) -> Column:
        return F.array_position(flags, True) - 1

    def step(state: Column, e: Column) -> Column:
        untouched = first_index(F.transform(state, lambda x: (x["start_date"] == start) & x["end_date"].isNull()))
        joined = F.when(untouched >= 0, at(state, untouched, lambda x: interval(e["ticker"], e["date"], x["end_date"]))).otherwise(F.concat(state, F.array(interval(e["ticker"], e["date"], F.lit(None).cast("timestamp")))))
        fits = F.transform(state, lambda x: F.when(x["end_date"].isNull() & (x["start_date"] <= e["date"]), x["start_date"]))
        latest = F.array_max(fits)
        last = F.size(state) - F.array_position(F.reverse(fits), latest)
        left = F.when(latest.isNotNull(), at(state, last, lambda x: interval(x["ticker"], x["start_date"], e["date"]))).otherwise(F.concat(state, F.array(interval(e["ticker"], start, e["date"]))))
        return F.when(e["change"] == "Joiner", joined).when(e["change"] == "Leaver", left).otherwise(state)

    both = opened.join(listed, "ric", "full")
    folded = F.aggregate(F.coalesce("events", F.array().cast("array<struct<date:timestamp,seq:bigint,change:string,ticker:string>>")), F.coalesce("seeds", none).cast(f"array<{INTERVAL}>"), step)
    return both.select("ric", F.inline(folded)).select("ric", F.col("ticker").alias("exchange_ticker"), "start_date", "end_date")


class OpenIntervals:
    """The open intervals of one ric: (start, number, ticker) by start, then in the order in which they were opened.

    Closed intervals never change, so they leave at once; what stays is what is open."""

    def __init__(self, window_start: dt.datetime, live: list[tuple] | None = None, opened: int = 0):
        self.window_start, self.live, self.opened = window_start, live or [], opened

    def open(self, ticker: str | None, start: dt.datetime) -> None:
        bisect.insort(self.live, (start, self.opened, ticker), key=lambda x: x[:2])
        self.opened += 1

    def event(self, date: dt.datetime, change: str | None, ticker: str | None) -> tuple | None:
        """The interval (ticker, start, end) that an event closes, if it does. Events come by date, then seq."""
        if change == "Joiner":
            at = bisect.bisect_left(self.live, (self.window_start, 0), key=lambda x: x[:2])
            if at < len(self.live) and self.live[at][0] == self.window_start:  # the first that has not moved yet
                number = self.live.pop(at)[1]
                bisect.insort(self.live, (date, number, ticker), key=lambda x: x[:2])
            else:
                self.open(ticker, date)
        elif change == "Leaver":
            at = bisect.bisect_right(self.live, date, key=lambda x: x[0]) - 1
            if at < 0:
                return ticker, self.window_start, date
            start, _, own = self.live.pop(at)
            return own, start, date
        return None

    def left(self) -> list[tuple]:
        return [(ticker, start, None) for start, _, ticker in self.live]


def membership_intervals_streamed(seeds: DataFrame, events: DataFrame, window_start: dt.datetime) -> DataFrame:
    """The intervals of `membership_intervals` for rics of any number of events: seeds and events come sorted by ric and
    time, and only what is open is held. A null ric is a ric like any other."""
    kind = "ric string, exchange_ticker string, start_date timestamp, end_date timestamp"
    rows = seeds.select("ric", F.lit(None).cast("timestamp").alias("date"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("change"), "exchange_ticker", F.lit(0).alias("side"))
    rows = rows.unionByName(events.select("ric", F.col("date").cast("timestamp").alias("date"), F.col("seq").cast("long").alias("seq"), "change", "exchange_ticker", F.lit(1).alias("side")))

    def begin(key: tuple) -> tuple:
        return key[0], OpenIntervals(window_start)

    def step(state: tuple, row: dict):
        ric, held = state
        if row["side"] == 0:
            held.open(row["exchange_ticker"], window_start)
        elif row["date"] is not None:
            closed = held.event(row["date"].replace(tzinfo=None), row["change"], row["exchange_ticker"])
            if closed:
                yield (ric, *closed)

    def finish(state: tuple):
        ric, held = state
        yield from ((ric, *x) for x in held.left())

    return folded(rows, ["ric"], [F.col("side"), F.col("date"), F.col("seq"), F.col("change"), F.col("exchange_ticker")], begin, step, finish, StructType.fromDDL(kind))


def enriched(intervals: DataFrame, security_master: DataFrame, now: dt.datetime, index_id: int = 1) -> DataFrame:
    """Constituent rows with security_id by symbol; ric stays, as the float-adjusted shares need it."""
    named = intervals.join(security_master.select("security_id", "symbol"), intervals["exchange_ticker"] == F.col("symbol"), "left")
    return named.select(F.lit(index_id).cast("long").alias("index_id"), F.col("security_id").cast("long").alias("security_id"), "exchange_ticker", "start_date", "end_date", F.lit("refinitive").alias("source_vendor"), F.lit(now).cast("timestamp").alias("upsert_date"), F.lit("tallyweave.membership").alias("upsert_by"), "ric")


def index_constituents(members: DataFrame, changes: DataFrame, tickers: DataFrame, security_master: DataFrame, start: dt.date, now: dt.datetime, index_id: int = 1) -> DataFrame:
    """Constituent rows of an index from its members (ric, exchange_ticker) at the start, the changes since (ric, date,
    seq, change), tickers (ric, exchange_ticker) and the security master: snapshot, events, fold, security ids."""
    seeds, events = constituents_as_of(members, start), constituent_changes(changes, tickers)
    intervals = membership_intervals(seeds.select("ric", "exchange_ticker"), events, dt.datetime.combine(start, dt.time()))
    return enriched(intervals, security_master, now, index_id)


def float_adjusted_shares(constituents: DataFrame, shares: DataFrame, free_float: DataFrame, seq: str | None = None, strict: bool = False) -> DataFrame:
    """(security_id, metric_type, metric_value, source_vendor, effective_date, end_date).

    constituents (ric, exchange_ticker, security_id), shares (instrument, date, outstanding_shares), free_float
    (instrument, date, seq, free_float_pct). The last free float of a day (by seq) is filled forward daily, joined
    to the shares, rounded half to even and clipped to 0..100 percent. Gaps are filled forward within an
    instrument; values never pass from one instrument to another. strict: gaps of all columns, the security too, are
    filled in one order of all rows by instrument and date, so an instrument without a value takes the one before's."""
    order = Window.partitionBy("instrument", "date").orderBy(F.desc(seq or "seq"))
    last = free_float.where("free_float_pct is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1")
    filled = daily_forward_fill(last.select("instrument", "date", "free_float_pct"), "instrument", "date", "free_float_pct")
    merged = shares.join(filled, ["instrument", "date"], "left")
    known = constituents.select(F.col("ric").alias("instrument"), "security_id").distinct()
    joined = known.join(merged, "instrument", "right")
    if strict:
        joined = ordered_forward_fill(joined, ["instrument", "date"], ["security_id", "outstanding_shares", "free_float_pct"])
    so_far = Window.partitionBy("instrument", "security_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last("outstanding_shares", ignorenulls=True).over(so_far) * (clipped(half_even(F.last("free_float_pct", ignorenulls=True).over(so_far)), 0, 100) / 100)
    return joined.select("security_id", F.lit("Shares Outstanding").alias("metric_type"), value.alias("metric_value"), F.lit("refinitive").alias("source_vendor"), F.col("date").alias("effective_date"), F.lit(None).cast("date").alias("end_date"))
