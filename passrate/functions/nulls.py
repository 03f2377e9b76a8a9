"""One notion of null: NaN and the user's markers become SQL NULL, and predicates are two-valued."""

from __future__ import annotations

import math
from collections.abc import Iterable
from datetime import date, datetime
from decimal import Decimal
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passrate.functions.dates import to_utc_datetime


def nan_to_null(column: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(column), column) if isinstance(kind, (T.DoubleType, T.FloatType)) else column


def as_list(value: Any) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple, set)) else [value]


def is_null_literal(value: Any) -> bool:
    return value is None or (isinstance(value, float) and math.isnan(value)) or value is pd.NaT or value is pd.NA


def literals(values: Iterable[Any], kind: T.DataType, parse_dates: bool = False) -> list[Column]:
    """The literals that a column of this type can equal: strings never equal numbers, 1 equals 1.0, True equals 1."""
    out: list[Column] = []
    for value in values:
        if is_null_literal(value):
            continue
        number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
        if isinstance(kind, T.StringType):
            if isinstance(value, str):
                out.append(F.lit(value))
        elif isinstance(kind, T.BooleanType):
            if isinstance(value, bool) or (number and value in (0, 1)):
                out.append(F.lit(bool(value)))
        elif isinstance(kind, T.IntegralType):
            if isinstance(value, bool) or (number and math.isfinite(value) and value == int(value)):
                if -(1 << 63) <= int(value) < 1 << 63:
                    out.append(F.lit(int(value)).cast("long"))
        elif isinstance(kind, T.NumericType):
            if isinstance(value, bool) or number:
                out.append(F.lit(float(value)))
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            stamp = value if isinstance(value, (date, datetime)) else to_utc_datetime(value) if isinstance(value, str) and parse_dates else None
            stamp = to_utc_datetime(stamp) if stamp is not None else pd.NaT
            if not pd.isna(stamp):
                out.append(F.lit(stamp.isoformat()).cast("timestamp"))
    return out


def is_in(column: Column, values: Iterable[Any], kind: T.DataType, parse_dates: bool = False) -> Column:
    """Two-valued membership: a null is in no list."""
    found = literals(values, kind, parse_dates)
    return F.coalesce(column.isin(*found), F.lit(False)) if found else F.lit(False)


def without_markers(column: Column, kind: T.DataType, markers: Any) -> Column:
    """The user's missing-value markers as NULL."""
    found = literals(as_list(markers), kind, parse_dates=True)
    return F.when(~column.isin(*found), column) if found else column


def skip_mask(columns: list[Column], policy: str) -> Column:
    if policy == "never":
        return F.lit(False)
    nulls = [c.isNull() for c in columns]
    return reduce(lambda a, b: a | b, nulls) if policy == "any" else reduce(lambda a, b: a & b, nulls)


def surely(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))
