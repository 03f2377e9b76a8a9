"""Rules as masks: for each rule two boolean columns, evaluated and passing, over a flat frame."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passrate import rules as R
from passrate.functions import coerce, dates, expressions, nulls
from passrate.functions.patterns import matches


@dataclass
class Bound:
    """A column of the flat frame, its type, and the name results show it under."""

    column: Column
    kind: T.DataType
    shown: str


@dataclass
class Masks:
    evaluated: Column
    passing: Column
    losses: dict[str, Column] = field(default_factory=dict)  # rows that coercion made null, by column
    shown: list[tuple[str, Column]] = field(default_factory=list)  # what a failed sample holds
    value: Column | None = None  # of a uniqueness rule

    @property
    def failed(self) -> Column:
        return self.evaluated & ~nulls.surely(self.passing)


def prepared(rule: R.BaseRule, bound: dict[str, Bound]) -> dict[str, tuple[Column, Column, T.DataType]]:
    """Per used column: as read, and coerced with markers made null; and the coerced type."""
    out = {}
    used = set(rule.columns_used())
    for name in (n for n in bound if n in used):  # in the source's order
        b = bound[name]
        read = nulls.nan_to_null(b.column, b.kind)
        if isinstance(rule, R.ValidityRegexRule):
            coerced, kind = coerce.to_text(read, b.kind), T.StringType()
        elif isinstance(rule, R.ValidityNumericalRangeRule):
            coerced, kind = coerce.to_number(read, b.kind), T.DoubleType()
        elif isinstance(rule, (R.TimelinessStaticRule, R.TimelinessRelativeRule)):
            coerced, kind = dates.to_timestamp(read, b.kind, rule.dayfirst), T.TimestampType()
        else:
            coerced, kind = read, b.kind
        out[name] = (read, nulls.without_markers(coerced, kind, rule.na_values), kind)
        if coerced is not read:
            out[name] += (coerced,)
    return out


def compile_rule(rule: R.BaseRule, bound: dict[str, Bound], statistics: dict[expressions.Statistic, Any]) -> Masks:
    columns = prepared(rule, bound)
    value, kind = columns[rule.field][1:3]
    evaluated = ~nulls.skip_mask([c[1] for c in columns.values()], rule.skip_if_null)
    losses = {name: c[0].isNotNull() & c[3].isNull() for name, c in columns.items() if len(c) > 3}
    shown = [(bound[name].shown, c[1]) for name, c in columns.items()]
    masks = Masks(evaluated, F.lit(True), losses, shown)
    if isinstance(rule, R.UniquenessRule):
        masks.evaluated, masks.value = value.isNotNull(), value
    elif isinstance(rule, R.CompletenessRule):
        masks.evaluated, masks.passing = F.lit(True), value.isNotNull()
    elif isinstance(rule, R.AccuracyRule):
        found = nulls.is_in(value, rule.valid_values, kind)
        if any(nulls.is_null_literal(v) for v in rule.valid_values):
            found = found | value.isNull()
        masks.passing = ~found if rule.inverse else found
    elif isinstance(rule, R.ValidityRegexRule):
        masks.passing = nulls.surely(matches(value, rule.regex_pattern))
    elif isinstance(rule, R.ValidityNumericalRangeRule):
        bounds = []
        if rule.min_value != -math.inf:
            bounds.append(value >= F.lit(float(rule.min_value)))
        if rule.max_value != math.inf:
            bounds.append(value <= F.lit(float(rule.max_value)))
        passing = value.isNotNull()
        for b in bounds:
            passing = passing & b
        masks.passing = nulls.surely(passing)
    elif isinstance(rule, R.ConsistencyRule):
        compiler = expressions.Compiler({n: (dates.to_timestamp(c[1], c[2]) if expressions.kind_of(c[2]) == "ts" else c[1], expressions.kind_of(c[2])) for n, c in columns.items()}, statistics)
        condition, then = rule.parts()
        if condition is not None:
            masks.evaluated = evaluated & compiler.condition(condition)
        masks.passing = compiler.condition(then)
    elif isinstance(rule, R.TimelinessStaticRule):
        literal = lambda d: None if d is None else F.lit(d.isoformat()).cast("timestamp")
        masks.passing = dates.within(value, literal(rule.start_date), literal(rule.end_date))
    elif isinstance(rule, R.TimelinessRelativeRule):
        if rule.reference_column:
            reference = columns[rule.reference_column][1]
            edge = lambda d: None if d is None else reference + F.lit(d)
        else:
            edge = lambda d: None if d is None else F.lit((rule.reference_date + d).isoformat()).cast("timestamp")
        masks.passing = dates.within(value, edge(rule.start_timedelta), edge(rule.end_timedelta))
    else:
        masks.passing = rule.passing({name: c[1] for name, c in columns.items()})  # a user's own rule
    return masks


def statistic_columns(rule: R.BaseRule, bound: dict[str, Bound]) -> dict[expressions.Statistic, Column]:
    """The column of each statistic that a rule's expressions need, markers made null."""
    if not isinstance(rule, R.ConsistencyRule):
        return {}
    columns = prepared(rule, bound)
    wanted = [s for part in rule.parts() if part is not None for s in expressions.statistics_in(part)]
    return {s: columns[s.column][1] for s in wanted}
