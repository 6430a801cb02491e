"""Scalar rules of the analytics tables as column expressions and driver helpers."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def number(value: Column) -> Column:
    """A double, or null where the value is none."""
    return value.cast("string").try_cast("double")


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def clipped(value: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def mapped(key: Column, mapping: dict[str, str], default: str | None = None) -> Column:
    """The mapping's value, or the default for other keys and null."""
    found = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.when(key.isNotNull(), F.try_element_at(found, key)), F.lit(default))


def snake_case(name: str) -> str:
    """An underscore before each capital, lower case, none in front: `marketCap` is `market_cap`."""
    return re.sub("([A-Z])", r"_\1", name).lower().lstrip("_")


def snake_case_column(name: Column) -> Column:
    return F.ltrim(F.lower(F.regexp_replace(name, "([A-Z])", "_$1")), F.lit("_"))


def last_weekday(day: Column) -> Column:
    """The day itself from Monday to Friday, else the Friday before."""
    number_ = F.dayofweek(day)
    return F.date_sub(day, F.when(number_ == 1, 2).when(number_ == 7, 1).otherwise(0))


def last_weekday_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=max(0, day.weekday() - 4))


def date_range(mode: str, today: dt.date, days_back: int = 5) -> tuple[dt.date, dt.date]:
    """First and last day to load: latest_eod, recent, ytd; any other mode is the last weekday alone."""
    day = last_weekday_of(today)
    if mode == "latest_eod":
        return day, day + dt.timedelta(days=1)
    if mode == "recent":
        return day - dt.timedelta(days=days_back), day
    if mode == "ytd":
        return dt.date(day.year, 1, 1), day
    return day, day


def is_business_day(day: Column) -> Column:
    return F.dayofweek(day).between(2, 6)


def parsed_date(text: str) -> dt.date:
    """A date of the form YYYY-MM-DD, or a ValueError."""
    return dt.datetime.strptime(text, "%Y-%m-%d").date()


def truncated(text: Column, most: int, marker: str = "...") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(marker))).otherwise(text)


def content_hash(*parts: Column, kind: str = "sha256") -> Column:
    """sha256 or md5 of the parts in their order, null as empty; equal contents have equal hashes at any time."""
    content = F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]).cast("binary")
    if kind not in ("sha256", "md5"):
        raise ValueError(f"unknown hash {kind!r}")
    return F.sha2(content, 256) if kind == "sha256" else F.md5(content)
