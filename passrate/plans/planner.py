"""From a list of rules to as few jobs as they need.

Rules that explode the same arrays share a flattened branch.  A branch's
counts are one aggregate: every rule adds its evaluated and passing counters
and its coercion losses, so the table is scanned once, with only the columns
used.  Statistics in expressions are one aggregate before that.  Uniqueness is a
group-by a rule, pre-aggregated before its shuffle.  Samples are taken for rules that fail.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passrate import rules as R
from passrate.operators import paths
from passrate.operators.masks import Bound, Masks, compile_rule, statistic_columns
from passrate.options import SampleConfig
from passrate.plans import statistics

#: Aggregates in one select: keeps generated code within the JVM's method size.
CHUNK = 90
ROW_ID = "__row_id__"


@contextmanager
def utc_session(spark: SparkSession) -> Iterator[None]:
    """Naive timestamps are UTC: the session's time zone is, while a plan is built and run."""
    before = spark.conf.get("spark.sql.session.timeZone")
    if before == "UTC":
        yield
        return
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def pass_rate(passing: int, evaluated: int) -> float | None:
    return passing / evaluated if evaluated else None


class Branch:
    """The rules that see the same rows."""

    def __init__(self, df: DataFrame, rules: list[tuple[int, R.BaseRule]], row_id: str | None):
        self.rules = rules
        wanted = list(dict.fromkeys(c for _, r in rules for c in r.columns_used()))
        order = {name: i for i, name in enumerate(df.columns)}  # columns keep the source's order, as samples show them
        wanted.sort(key=lambda c: order.get(c, order.get(paths.parse(c)[0].name, len(order))))
        names = {path: f"c{i}" for i, path in enumerate(wanted)}
        if row_id:
            names[row_id] = ROW_ID
        self.flat = paths.flatten_as(df, names)
        self.bound = {path: Bound(F.col(name), self.flat.schema[name].dataType, paths.safe_name(path)) for path, name in names.items()}
        self.masks: dict[int, Masks] = {}

    def compile(self) -> None:
        wanted = {}
        for _, rule in self.rules:
            wanted |= statistic_columns(rule, self.bound)
        found = statistics.compute(self.flat, wanted) if wanted else {}
        self.masks = {i: compile_rule(rule, self.bound, found) for i, rule in self.rules}

    def counters(self) -> dict[tuple[int, str], Column]:
        out: dict[tuple[int, str], Column] = {}
        for i, rule in self.rules:
            m = self.masks[i]
            if not isinstance(rule, R.UniquenessRule):
                out[i, "evaluated"] = F.count_if(m.evaluated)
                out[i, "passing"] = F.count_if(m.evaluated & m.passing)
            for name, loss in m.losses.items():
                out[i, f"loss {name}"] = F.count_if(loss)
        return out

    def counted(self) -> DataFrame:
        """The one-row aggregate over the branch."""
        return self.flat.agg(*(c.alias(f"{i}|{what}") for (i, what), c in self.counters().items()))

    def occurrences(self, i: int) -> DataFrame:
        """Distinct values of a uniqueness rule, and how often each occurs."""
        value = self.masks[i].value
        return self.flat.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def branches(df: DataFrame, rules: list[R.BaseRule], row_id: str | None = None) -> list[Branch]:
    missing = sorted({c for r in rules for c in r.columns_used() if c not in df.columns and not paths.is_nested(c)})
    if missing:
        raise ValueError(f"columns {missing} are not in the data, which has {df.columns}")
    grouped: dict[tuple[frozenset[str], frozenset[str]], list[tuple[int, R.BaseRule]]] = {}
    for i, rule in enumerate(rules):
        used = rule.columns_used()
        paths.check_marks([c for c in used if c not in df.columns])
        picked = frozenset(p for c in used if c not in df.columns for p in paths.prefixes(c, ("[]",)))
        grouped.setdefault((paths.exploded(used, df.columns), picked), []).append((i, rule))
    merged: list[tuple[frozenset, frozenset, list]] = []
    for (exploded, picked), members in grouped.items():  # [] leaves rows as they are: join branches where the marks agree
        for k, (other, marks, held) in enumerate(merged):
            if other == exploded and _agree(marks | picked, exploded):
                merged[k] = (other, marks | picked, held + members)
                break
        else:
            merged.append((exploded, picked, members))
    return [Branch(df, members, row_id) for _, _, members in merged]


def _agree(picked: frozenset[str], exploded: frozenset[str]) -> bool:
    base = lambda p: p.removesuffix("[*]").removesuffix("[]")
    return not {base(p) for p in picked} & {base(p) for p in exploded}


def counts_frame(df: DataFrame, rules: list[R.BaseRule]) -> DataFrame:
    """The counts as a lazy table, a row a rule: position, field, records_evaluated, records_passing, pass_rate."""
    out: DataFrame | None = None
    with utc_session(df.sparkSession):
        for branch in branches(df, rules):
            branch.compile()
            plain = [(i, r) for i, r in branch.rules if not isinstance(r, R.UniquenessRule)]
            for at in range(0, len(plain), CHUNK // 2):
                part = plain[at : at + CHUNK // 2]
                row = branch.flat.agg(*(c.alias(f"{w}{i}") for i, _ in part for w, c in (("e", F.count_if(branch.masks[i].evaluated)), ("p", F.count_if(branch.masks[i].evaluated & branch.masks[i].passing)))))
                each = F.array(*(F.struct(F.lit(i).alias("position"), F.lit(r.field).alias("field"), F.col(f"e{i}").alias("e"), F.col(f"p{i}").alias("p")) for i, r in part))
                out = _joined(out, row.select(F.explode(each).alias("r")).select("r.*"))
            for i, rule in branch.rules:
                if isinstance(rule, R.UniquenessRule):
                    row = branch.occurrences(i).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("e"), F.count(F.lit(1)).alias("p"))
                    out = _joined(out, row.select(F.lit(i).alias("position"), F.lit(rule.field).alias("field"), "e", "p"))
    return out.select("position", "field", F.col("e").cast("long").alias("records_evaluated"), F.col("p").cast("long").alias("records_passing"), F.try_divide(F.col("p").cast("double"), F.col("e").cast("double")).alias("pass_rate"))


def _joined(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def sample_frame(flat: DataFrame, failed: Column, shown: list[tuple[str, Column]], n: int) -> list[Row]:
    """The n smallest distinct failing tuples, in order.

    First the smallest 50 n rows, which need no shuffle; if repeats fill them
    the values beyond the last found are grouped, and repeated values group well.
    """
    keys = [f"v{i}" for i in range(len(shown))]
    rows = flat.where(failed).select(*(_ordered(c, flat).alias(k) for k, (_, c) in zip(keys, shown, strict=True)))
    got = rows.orderBy(*keys).limit(50 * n).collect()
    found = list(dict.fromkeys(got))
    if len(found) >= n or len(got) < 50 * n:
        return found[:n]
    last = F.struct(*(F.lit(v).cast(f.dataType) if not isinstance(v, (list, Row, dict)) else F.lit(None) for v, f in zip(found[-1], rows.schema.fields, strict=True)))
    beyond = rows.where(F.struct(*keys) > last) if None not in found[-1] else rows
    more = beyond.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys).limit(2 * n).select(*keys).collect()
    return list(dict.fromkeys([*found, *more]))[:n]


def _ordered(column: Column, flat: DataFrame) -> Column:
    kind = flat.select(column.alias("x")).schema[0].dataType
    return F.to_json(column) if "map<" in kind.simpleString() else column


def json_value(value: Any) -> Any:
    """What JSON can hold: dates as ISO 8601 text, UTC where they have a time."""
    if isinstance(value, datetime):
        return value.isoformat() if value.tzinfo else value.isoformat() + "+00:00"
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, Row):
        return {k: json_value(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [json_value(v) for v in value]
    if isinstance(value, float) and value != value:
        return None
    return value


def as_spark(data: Any) -> tuple[DataFrame, list | None]:
    """A Spark frame, and for pandas data its index labels, by row number."""
    if isinstance(data, DataFrame):
        return data, None
    if isinstance(data, pd.DataFrame):
        spark = SparkSession.getActiveSession() or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
        return pandas_frame(spark, data), list(data.index)
    if type(data).__module__.startswith("elasticsearch"):
        raise NotImplementedError("Elasticsearch sources are not supported")
    raise ValueError(f"You must pass in a pandas or Spark DataFrame, not {type(data).__name__}")


def pandas_frame(spark: SparkSession, data: pd.DataFrame) -> DataFrame:
    """A pandas frame with its row number; columns of mixed types become text."""
    fields, columns = [], []
    for name in data.columns:
        series = data[name]
        present = [v for v in series if not _missing(v)]
        kind, convert = _spark_type(series, present)
        fields.append(T.StructField(str(name), kind))
        columns.append([None if _missing(v) else convert(v) for v in series])
    fields.append(T.StructField(ROW_ID, T.LongType()))
    rows = [(*row, i) for i, row in enumerate(zip(*columns, strict=True))] if columns else []
    return spark.createDataFrame(rows, T.StructType(fields))


def _missing(value: Any) -> bool:
    return value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value)


def _spark_type(series: pd.Series, present: list):
    if pd.api.types.is_bool_dtype(series) or (present and all(isinstance(v, bool) for v in present)):
        return T.BooleanType(), bool
    if pd.api.types.is_datetime64_any_dtype(series) or (present and all(isinstance(v, (datetime, pd.Timestamp)) for v in present)):
        utc = lambda v: (pd.Timestamp(v).tz_localize("UTC") if pd.Timestamp(v).tzinfo is None else pd.Timestamp(v)).to_pydatetime()
        return T.TimestampType(), utc
    if present and all(isinstance(v, date) for v in present):
        return T.DateType(), lambda v: v
    number = lambda v: isinstance(v, (int, float)) or hasattr(v, "item")
    if present and all(number(v) and not isinstance(v, str) for v in present) and pd.api.types.is_numeric_dtype(pd.Series(present)):
        whole = all(float(v).is_integer() for v in present if float(v) not in (float("inf"), float("-inf"))) and all(abs(float(v)) < 2**63 for v in present)
        return (T.LongType(), int) if whole else (T.DoubleType(), float)
    return T.StringType(), str


def measure(data: Any, rules: list[R.BaseRule], id_column: str | None = None, sample_size: int | None = None) -> list:
    """A result for each rule.

    `id_column` names a column whose smallest failing values become
    records_failed_ids; for pandas data these are the index labels.
    """
    from passrate.report import DataQualityResult

    df, labels = as_spark(data)
    n = SampleConfig.RECORDS_FAILED_SAMPLE_SIZE if sample_size is None else sample_size
    row_id = ROW_ID if labels is not None else id_column
    results: dict[int, DataQualityResult] = {}
    with utc_session(df.sparkSession):
        for branch in branches(df, rules, row_id):
            branch.compile()
            counters = list(branch.counters().items())
            counts: dict[tuple[int, str], int] = {}
            for at in range(0, len(counters), CHUNK):
                part = counters[at : at + CHUNK]
                row = branch.flat.agg(*(c.alias(f"k{j}") for j, (_, c) in enumerate(part))).first()
                counts |= {key: value for (key, _), value in zip(part, row, strict=True)}
            for i, rule in branch.rules:
                results[i] = _result(branch, i, rule, counts, n, row_id, labels)
    return [results[i] for i in range(len(rules))]


def _result(branch: Branch, i: int, rule: R.BaseRule, counts: dict, n: int, row_id: str | None, labels: list | None):
    from passrate.report import DataQualityResult

    masks = branch.masks[i]
    for name in masks.losses:
        if lost := counts[i, f"loss {name}"]:
            warnings.warn(f"Column '{name}' has {lost} additional NULL values after coercion", stacklevel=4)
    failed, sample, ids = masks.failed, None, None
    if isinstance(rule, R.UniquenessRule):
        occurrences = branch.occurrences(i)
        row = occurrences.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        passing, evaluated = row[0], row[1]
    else:
        passing, evaluated = counts[i, "passing"], counts[i, "evaluated"]
    rate = pass_rate(passing, evaluated)
    if rate is not None and rate != 1.0 and n > 0:
        if isinstance(rule, R.UniquenessRule):
            rows = occurrences.where("n > 1").orderBy("value").limit(n).select("value").collect()
        else:
            rows = sample_frame(branch.flat, failed, masks.shown, n)
        sample = [{name: json_value(v) for (name, _), v in zip(masks.shown, row, strict=True)} for row in rows]
        if row_id:
            ids = _failed_ids(branch, rule, masks, n, labels)
    return DataQualityResult(
        field=rule.field,
        data_quality_dimension=rule.data_quality_dimension,
        records_evaluated=evaluated,
        pass_rate=rate,
        rule_id=rule.rule_id,
        rule_description=rule.rule_description,
        rule_data=json.dumps(rule.to_dict()),
        records_failed_sample=sample,
        records_failed_ids=ids,
    )


def _failed_ids(branch: Branch, rule: R.BaseRule, masks: Masks, n: int, labels: list | None) -> list:
    if isinstance(rule, R.UniquenessRule):  # all rows of a value but its first
        keyed = branch.flat.select(masks.value.alias("value"), ROW_ID).where("value IS NOT NULL")
        first = keyed.groupBy("value").agg(F.min(ROW_ID).alias("first"))
        rows = keyed.join(first, "value").where(F.col(ROW_ID) > F.col("first")).select(ROW_ID)
    else:
        rows = branch.flat.where(masks.failed).select(ROW_ID)
    found = [r[0] for r in rows.distinct().orderBy(ROW_ID).limit(n).collect()]
    return found if labels is None else [labels[k].item() if hasattr(labels[k], "item") else labels[k] for k in found]
