"""Dates: one value on the driver, a column as a ladder of formats."""

from __future__ import annotations

import re
import warnings
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_utc_datetime(value: Any, dayfirst: bool = False):
    """A UTC timestamp from a date in any of its usual spellings; what is none becomes NaT with a warning.

    Naive values are UTC, integers are nanoseconds since 1970, and years
    beyond the nanosecond range are kept.
    """
    if value is None:
        return pd.NaT
    try:
        return pd.to_datetime(value, dayfirst=dayfirst, utc=True)
    except pd.errors.OutOfBoundsDatetime as error:
        warnings.warn(f"{value!r} is beyond the nanosecond range ({error}); parsed alone", stacklevel=2)
        stamp = pd.Timestamp(value)
        return stamp.tz_localize("UTC") if stamp.tzinfo is None else stamp.tz_convert("UTC")
    except (ValueError, TypeError) as error:
        warnings.warn(f"{value!r} is no date and becomes null: {error}", stacklevel=2)
        return pd.NaT


_SUFFIXED = re.compile(r"^\s*([+-]?\d+(?:\.\d+)?)\s*(h|m|min|s|sec|ms|w)\s*$")
_SECONDS = {"h": 3600, "m": 60, "min": 60, "s": 1, "sec": 1, "ms": 0.001, "w": 7 * 86400}


def widened_timedelta(value: Any) -> Any:
    """Spellings such as '6h' or '+90m' as timedeltas; everything else is left to the model's own parser."""
    if isinstance(value, str) and (m := _SUFFIXED.match(value)):
        return timedelta(seconds=float(m[1]) * _SECONDS[m[2]])
    return value


_TIMES = ("", " H:m:s", " H:m", "'T'H:m:s")
_MONTH_FIRST = ("M-d-yyyy", "M/d/yyyy", "M.d.yyyy")
_DAY_FIRST = ("d-M-yyyy", "d/M/yyyy", "d.M.yyyy")
_NAMED = ("MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d yyyy")
_OTHER = ("yyyy/M/d", "yyyy.M.d")


_TAILS = ("", r" \d{1,2}:\d{1,2}:\d{1,2}", r" \d{1,2}:\d{1,2}", r"T\d{1,2}:\d{1,2}:\d{1,2}")
_SHAPES = (r"\d{1,2}-\d{1,2}-\d{4}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}\.\d{1,2}\.\d{4}")


def date_formats(dayfirst: bool) -> list[tuple[str, tuple[str, ...]]]:
    """Shapes of dates as patterns, and the formats a date of this shape can have, in order of preference."""
    first, second = (_DAY_FIRST, _MONTH_FIRST) if dayfirst else (_MONTH_FIRST, _DAY_FIRST)
    shapes = list(zip(_SHAPES, zip(first, second, strict=True), strict=True))
    return [*shapes, (r"\d{4}/\d{1,2}/\d{1,2}", _OTHER[:1]), (r"\d{4}\.\d{1,2}\.\d{1,2}", _OTHER[1:]), (r".*\p{L}{3}.*?\d{4}", _NAMED)]


def _ladder(text: Column, dayfirst: bool) -> Column:
    """By shape first, then by the shape of the time: a value is tried against the few formats it can have."""
    parsed = lambda formats, time: F.coalesce(*(F.try_to_timestamp(text, F.lit(f + time)) for f in formats))
    out = F.when(text.rlike(r"^\d{8}$"), parsed(("yyyyMMdd",), "")).when(text.rlike(r"^\d{8}T\d{6}$"), parsed(("yyyyMMdd",), "'T'HHmmss"))
    for shape, formats in date_formats(dayfirst):
        by_time = None
        for tail, time in zip(_TAILS, _TIMES, strict=True):
            condition = text.rlike(f"^{shape}{tail}$")
            by_time = F.when(condition, parsed(formats, time)) if by_time is None else by_time.when(condition, parsed(formats, time))
        out = out.when(text.rlike(f"^{shape}"), by_time)
    return out


def to_timestamp(column: Column, kind: T.DataType, dayfirst: bool = False) -> Column:
    """A column as UTC timestamps, in a session whose time zone is UTC; what is no date is null.

    Strings go down a ladder: ISO 8601 by the JVM's cast, then the formats that
    `date_formats` has for the string's shape, in order.  Month and day swap where only one order is a date.
    """
    if isinstance(kind, T.TimestampType):
        return column
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(kind, T.IntegralType):
        return F.timestamp_micros(F.floor(column / F.lit(1000)).cast("long"))
    if isinstance(kind, T.FractionalType):
        return F.timestamp_micros(F.floor(column.cast("double") / F.lit(1000.0)).try_cast("long"))
    if isinstance(kind, T.StringType):
        text = F.trim(column)
        iso = F.when(text.rlike(r"^\d{4}-\d{1,2}(-\d{1,2}.*)?$|^\d{4}$"), text.try_cast("timestamp"))
        return F.coalesce(iso, F.when(text.rlike(r"\d"), _ladder(text, dayfirst)))
    return F.lit(None).cast("timestamp")


def within(column: Column, start: Column | None, end: Column | None) -> Column:
    """start <= column <= end, either bound optional, both inclusive; a null is not within."""
    out = F.lit(True)
    if start is not None:
        out = out & F.coalesce(column >= start, F.lit(False))
    if end is not None:
        out = out & F.coalesce(column <= end, F.lit(False))
    return out
