"""Whole-column statistics: one aggregate for the simple ones; order statistics and modes without a task that holds all values."""

from __future__ import annotations

import math
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passrate.functions.expressions import Statistic, statistic_column

#: Rows among which an order statistic is found by sorting.
AT_ONCE = 1 << 18
_ACCURACY = 10_000


def compute(flat: DataFrame, wanted: dict[Statistic, Column]) -> dict[Statistic, Any]:
    """The value of each statistic of its column over all rows; nulls are left out."""
    ordered = {s: c for s, c in wanted.items() if s.name in ("median", "quantile", "mode")}
    simple = {s: c for s, c in wanted.items() if s not in ordered}
    found: dict[Statistic, Any] = {}
    if simple:
        row = flat.agg(*(statistic_column(s, c).alias(f"s{i}") for i, (s, c) in enumerate(simple.items()))).first()
        found = dict(zip(simple, row, strict=True))
    for s, column in ordered.items():
        found[s] = mode(flat, column) if s.name == "mode" else quantile(flat, column, 0.5 if s.name == "median" else s.argument)
    return {s: float(v) if isinstance(v, Decimal) else v for s, v in found.items()}


def mode(df: DataFrame, column: Column) -> Any:
    """The most frequent value, the smallest of several."""
    values = df.select(column.alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    row = values.orderBy(F.desc("n"), "v").first()
    return None if row is None else row["v"]


def quantile(df: DataFrame, column: Column, q: float, at_once: int = AT_ONCE) -> float | None:
    """The exact quantile, linear between neighbours.

    A sketch brackets the wanted ranks within a share of the rows that its
    error bounds, the bracket's rows are counted, and so on until they are few
    enough to sort.  No task holds more than a sketch or the last bracket.
    """
    values = df.select(column.cast("double").alias("v")).where("v IS NOT NULL")
    inside, count, below = values, values.count(), 0
    if not count:
        return None
    rank = q * (count - 1)
    low, part = math.floor(rank), rank - math.floor(rank)
    while count > at_once:
        at, slack = low - below, 2.0 / _ACCURACY
        ends = inside.agg(F.percentile_approx("v", [max(0.0, at / count - slack), min(1.0, (at + 2) / count + slack)], _ACCURACY)).first()[0]
        if ends[0] == ends[1]:
            return ends[0]  # both neighbours lie between equal bounds
        less, within = values.agg(F.count_if(F.col("v") < ends[0]), F.count_if(F.col("v").between(*ends))).first()
        if less > low or less + within < low + 2 or within == count:
            break  # an unlucky sketch, or few values with many repeats
        inside, count, below = values.where(F.col("v").between(*ends)), within, less
    if count <= at_once:
        rows = [r["v"] for r in inside.orderBy("v").offset(low - below).limit(2).collect()]
    else:
        rows = _by_counts(inside, low - below)
    a, b = rows[0], rows[-1]
    return b - (b - a) * (1 - part) if part >= 0.5 else a + (b - a) * part


def _by_counts(inside: DataFrame, at: int) -> list[float]:
    """The values at ranks `at` and `at` + 1, a bisection on counts: for columns whose rows repeat few values."""
    ends = inside.agg(F.min("v"), F.max("v")).first()
    out = []
    for rank in (at, at + 1):
        low, high = ends
        while low < high:  # halves the bracket, and moves its ends to values that occur
            middle = low + (high - low) / 2
            if middle >= high:
                middle = low
            n, top, bottom = inside.agg(F.count_if(F.col("v") <= middle), F.max(F.when(F.col("v") <= middle, F.col("v"))), F.min(F.when(F.col("v") > middle, F.col("v")))).first()
            low, high = (low, top) if n > rank else (bottom, high)
        out.append(low)
    return out
