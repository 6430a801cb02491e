"""Index membership from a stream of joiner and leaver events: the rule of the batch fold, with its state in the store.

A ric's state is its open intervals; a closed one is a row of the stream as soon as its leaver comes. Events of a ric are
taken by date and seq within a micro-batch, so a batch must not hold events before those of earlier batches; one that
does is an error of the stream rather than a wrong interval. The intervals that are open after a batch are told by
`open_at_end`: with it each batch also yields them, marked, and the last batch's are the ones that hold.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyweave.operators.membership import OpenIntervals

RESULT = "ric string, exchange_ticker string, start_date timestamp, end_date timestamp"
STATE = "starts array<timestamp>, numbers array<bigint>, tickers array<string>, opened bigint, last timestamp"


class Fold(StatefulProcessor):
    """Closed intervals of a ric, and the open ones after each batch if asked for."""

    def __init__(self, window_start: dt.datetime, open_at_end: bool):
        self.window_start, self.open_at_end = window_start, open_at_end

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, last = OpenIntervals(self.window_start), None
        if self.state.exists():
            starts, numbers, tickers, opened, last = self.state.get()
            held = OpenIntervals(self.window_start, list(zip((x.replace(tzinfo=None) for x in starts), numbers, tickers)), opened)
            last = last.replace(tzinfo=None) if last is not None and not pd.isna(last) else None
        out = []
        for r in pd.concat(list(rows)).sort_values(["side", "date", "seq", "change", "exchange_ticker"], na_position="first").itertuples(index=False):
            if r.side == 0:
                held.open(r.exchange_ticker, self.window_start)
                continue
            if pd.isna(r.date):
                continue
            date = r.date.to_pydatetime().replace(tzinfo=None)
            if last is not None and date < last:
                raise ValueError(f"an event of {date} came after one of {last}")
            last = date
            if closed := held.event(date, r.change, r.exchange_ticker):
                out.append((key[0], *closed))
        self.state.update(([x[0] for x in held.live], [x[1] for x in held.live], [x[2] for x in held.live], held.opened, last))
        if self.open_at_end:
            out += [(key[0], *x) for x in held.left()]
        yield pd.DataFrame(out, columns=["ric", "exchange_ticker", "start_date", "end_date"]).astype({"start_date": "datetime64[ns]", "end_date": "datetime64[ns]"})

    def close(self) -> None:
        pass


def stream_membership(rows: DataFrame, window_start: dt.datetime, open_at_end: bool = False) -> DataFrame:
    """Intervals from a stream of (ric, side, date, seq, change, exchange_ticker): side 0 for seeds, which come no later
    than the first events of their ric, side 1 for events."""
    return rows.groupBy("ric").transformWithStateInPandas(Fold(window_start, open_at_end), RESULT, "Append", "None")
