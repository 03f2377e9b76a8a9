"""Queries through the results, reports, files and refusals of the engine, each with SQL that gives the same rows.

A sample holds the smallest failing tuples, columns in the source's order.
"""

from __future__ import annotations

import json
import re
import tempfile
import warnings
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pydantic import ValidationError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passrate import rules as R
from passrate.config import DataQualityConfig
from passrate.errors import DQFunctionError
from passrate.functions.dates import to_utc_datetime
from passrate.models import DamaFramework
from passrate.operators import paths
from passrate.options import SampleConfig
from passrate.plans import queries as Q
from passrate.plans.planner import measure
from passrate.report import DataQualityReport

Rows = Callable[[SparkSession, str], list[tuple]]

_MIN_PRICE = R.ValidityNumericalRangeRule(field="o_totalprice", min_value=2000)
_IN_PAIRS = R.ConsistencyRule(field="o_totalprice", expression="`o_totalprice` >= 2000 or `o_orderstatus` == 'X'")
_FEW_IDS = "SELECT {} AS id FROM orders WHERE NOT o_totalprice >= 2000 ORDER BY o_orderkey LIMIT 10"
_COUNTS = "field string, records_evaluated long, pass_rate double"
_COUNTS_SQL = f"SELECT field, records_evaluated, pass_rate FROM ({Q._REPORT_SQL})"


def _rows(schema: str, make: Rows) -> Q.Query:
    """What the engine leaves on the driver, a few rows a rule, as a table."""
    return lambda spark, sf_dir: spark.createDataFrame(make(spark, sf_dir), schema)


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q._table(spark, sf_dir, "orders")


def _config(**about: Any) -> DataQualityConfig:
    return DataQualityConfig(dataset_name="orders", dataset_id=7, measurement_sample="all", lifecycle_stage="raw", measurement_time="2024-05-06T07:08:09Z", rules=list(Q._REPORT_RULES), **about)


def _counts(report: DataQualityReport) -> list[tuple]:
    return [(r.field, r.records_evaluated, r.pass_rate) for r in report.results]


def _values(columns: str, rows: list[tuple]) -> str:
    literal = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns})"


def _refused(cases: dict[str, tuple[Callable[..., Any], type]]) -> tuple[Q.Query, str]:
    """Case and error of calls that the engine refuses, each a function of (spark, sf_dir)."""

    def make(spark: SparkSession, sf_dir: str) -> list[tuple]:
        out = []
        for name, (call, _) in cases.items():
            try:
                call(spark, sf_dir)
                out.append((name, "none"))
            except Exception as error:  # the kind of error is the result
                out.append((name, type(error).__name__))
        return out

    return _rows("case string, error string", make), _values('"case", error', [(n, kind.__name__) for n, (_, kind) in cases.items()])


def _warned(call: Callable[[], Any], pattern: str) -> list[re.Match]:
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        call()
    return [m for w in caught if (m := re.search(pattern, str(w.message)))]


def _lost(spark: SparkSession, sf_dir: str) -> list[tuple]:
    rule = R.ValidityNumericalRangeRule(field="level", min_value=2)
    return [(int(m[1]),) for m in _warned(lambda: measure(Q._texts(spark, sf_dir), [rule]), r"has (\d+) additional NULL")]


def _with_size(n: int, call: Callable[[], Any]) -> Any:
    before = SampleConfig.RECORDS_FAILED_SAMPLE_SIZE
    SampleConfig.RECORDS_FAILED_SAMPLE_SIZE = n
    try:
        return call()
    finally:
        SampleConfig.RECORDS_FAILED_SAMPLE_SIZE = before


def _sample(result) -> list[tuple]:
    return [tuple(r.values()) for r in result.records_failed_sample or []]


def _through_yaml(spark: SparkSession, sf_dir: str) -> list[tuple]:
    with tempfile.TemporaryDirectory() as folder:  # read again by this driver only
        path = Path(folder, "rules.yaml")
        _config().to_yaml(path)
        return _counts(DataQualityConfig.from_yaml(path).execute(_orders(spark, sf_dir)))


def _merged_yaml(spark: SparkSession, sf_dir: str) -> list[tuple]:
    with tempfile.TemporaryDirectory() as folder:
        one, two, patterns = (Path(folder, n) for n in ("one.yaml", "two.yaml", "patterns.yaml"))
        one.write_text("dataset_name: first\nrules:\n- {function: validity_regex, field: o_orderpriority, regex_pattern: urgent}\n", encoding="utf-8")
        two.write_text("dataset_name: second\nrules:\n- {function: completeness, field: o_orderstatus}\n", encoding="utf-8")
        patterns.write_text("urgent: '[12]-'\n", encoding="utf-8")
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            config = DataQualityConfig.from_yaml([one, two], regex_yaml_path=patterns)
        return [(config.dataset_name, *c) for c in _counts(config.execute(_orders(spark, sf_dir)))]


def _from_report(spark: SparkSession, sf_dir: str) -> list[tuple]:
    report = _config().execute(_orders(spark, sf_dir), sample_size=0)
    again = DataQualityConfig.from_report(report)
    return [(again.dataset_name, again.dataset_id, *c) for c in _counts(again.execute(_orders(spark, sf_dir), sample_size=0))]


def _through_json(spark: SparkSession, sf_dir: str) -> list[tuple]:
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder, "report.json")
        _config().execute(_orders(spark, sf_dir)).to_json(path)
        return [(r["field"], r["records_evaluated"], r["pass_rate"], r["measurement_time"]) for r in json.loads(path.read_text(encoding="utf-8"))["results"]]


def _through_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = _config().execute(_orders(spark, sf_dir))
    return DataQualityReport.from_dataframe(report.to_dataframe(decimals=10)).to_spark(spark).select("dataset_name", "dataset_id", "lifecycle_stage", "field", "data_quality_dimension", "records_evaluated", F.round("pass_rate", 6).alias("pass_rate"))


def _rounded(spark: SparkSession, sf_dir: str) -> list[tuple]:
    frame = _config().execute(_orders(spark, sf_dir)).to_dataframe(decimals=2, measurement_time_format="%d.%m.%Y %H:%M")
    return [tuple(r) for r in frame[["field", "pass_rate", "measurement_time"]].itertuples(index=False)]


def _shifted(spark: SparkSession, sf_dir: str) -> list[tuple]:
    report = DataQualityConfig(rules=[_MIN_PRICE]).execute(_orders(spark, sf_dir), id_column="o_orderkey")
    return [(i,) for i in report.to_dataframe(records_failed_ids_shift=2)["records_failed_ids"][0]]


def _pandas_nation(spark: SparkSession, sf_dir: str):
    frame = Q._table(spark, sf_dir, "nation").toPandas().set_index("n_nationkey").sort_index()
    frame["n_name"] = frame["n_name"].where(frame.index % 5 != 0)
    return measure(frame, [R.CompletenessRule(field="n_name"), R.UniquenessRule(field="n_regionkey")])


def _to_now(spark: SparkSession, sf_dir: str) -> list[tuple]:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # it says which moment it takes
        rule = R.TimelinessRelativeRule(field="o_orderdate", start_timedelta="-20000d", end_timedelta="0d")
    return _counts(DataQualityReport(results=measure(_orders(spark, sf_dir), [rule])))


_SCHEMA_ROWS = [("dataset_name", "string"), ("dataset_id", "string"), ("measurement_sample", "string"), ("lifecycle_stage", "string"), ("measurement_time", "timestamp"), ("field", "string"), ("data_quality_dimension", "string"), ("records_evaluated", "bigint"), ("pass_rate", "double"), ("rule_id", "string"), ("rule_description", "string"), ("rule_data", "string"), ("records_failed_ids", "string"), ("records_failed_sample", "string")]
_DIMENSIONS = ["Completeness", "Uniqueness", "Accuracy", "Validity", "Validity", "Consistency", "Timeliness", "Timeliness"]
_STAMPED_SQL = " UNION ALL ".join(f"SELECT 'orders' AS dataset_name, '7' AS dataset_id, 'raw' AS lifecycle_stage, field, '{d}' AS data_quality_dimension, records_evaluated, round(pass_rate, 6) AS pass_rate FROM ({s})" for d, s in zip(_DIMENSIONS, Q._REPORT_SQL.split(" UNION ALL "), strict=True))

_C = R.ConsistencyRule


def _consistency(field: str, expression: str, table: str, sql: str) -> tuple[Q.Query, str]:
    return Q._counted(table, _C(field=field, expression=expression)), Q._sql(field, table, sql)


_P = "o_orderpriority"
ALL: dict[str, tuple[Q.Query, str]] = {
    "failed_sample_topn": (_rows("o_totalprice double, o_orderstatus string", lambda s, d: [(r["o_totalprice"], r["o_orderstatus"]) for r in measure(_orders(s, d), [_IN_PAIRS])[0].records_failed_sample]), "SELECT DISTINCT o_totalprice, o_orderstatus FROM orders WHERE NOT o_totalprice >= 2000 ORDER BY o_orderstatus, o_totalprice LIMIT 10"),
    "uniqueness_failed_sample": (_rows("l_orderkey long", lambda s, d: _sample(measure(Q._table(s, d, "lineitem"), [R.UniquenessRule(field="l_orderkey")])[0])), "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 10"),
    "coercion_loss": (_rows("lost long", _lost), f"SELECT count(*) FILTER (WHERE level IS NOT NULL AND TRY_CAST(trim(level) AS DOUBLE) IS NULL) AS lost FROM {Q._TEXTS_SQL}"),
    "failed_ids": (_rows("id long", lambda s, d: [(i,) for i in measure(_orders(s, d), [_MIN_PRICE], id_column="o_orderkey")[0].records_failed_ids]), _FEW_IDS.format("o_orderkey")),
    "failed_ids_uniqueness": (_rows("id long", lambda s, d: [(i,) for i in measure(_orders(s, d), [R.UniquenessRule(field="o_custkey")], id_column="o_orderkey")[0].records_failed_ids]), "SELECT o_orderkey AS id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 ORDER BY 1 LIMIT 10"),
    "failed_sample_nested": (_rows("quantity double", lambda s, d: _sample(measure(Q._nested(s, d), [R.ValidityNumericalRangeRule(field="lines[*].l_quantity", min_value=10)])[0])), "SELECT DISTINCT l_quantity AS quantity FROM lineitem WHERE l_quantity < 10 ORDER BY 1 LIMIT 10"),
    "failed_sample_of_dates": (_rows("day string", lambda s, d: _sample(measure(_orders(s, d), [R.TimelinessStaticRule(field="o_orderdate", start_date="1996-01-01")])[0])), "SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS day FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' ORDER BY 1 LIMIT 10"),
    "failed_sample_size": (_rows("o_totalprice double", lambda s, d: _sample(measure(_orders(s, d), [_MIN_PRICE], sample_size=3)[0])), "SELECT DISTINCT o_totalprice FROM orders WHERE NOT o_totalprice >= 2000 ORDER BY 1 LIMIT 3"),
    "failed_sample_global_size": (_rows("o_totalprice double", lambda s, d: _with_size(4, lambda: _sample(measure(_orders(s, d), [_MIN_PRICE])[0]))), "SELECT DISTINCT o_totalprice FROM orders WHERE NOT o_totalprice >= 2000 ORDER BY 1 LIMIT 4"),
    "failed_sample_gate": (_rows("field string, sampled boolean", lambda s, d: [(r.field, r.records_failed_sample is not None) for r in measure(_orders(s, d), [R.CompletenessRule(field="o_orderstatus"), _MIN_PRICE])]), "SELECT 'o_orderstatus' AS field, count(*) FILTER (WHERE o_orderstatus IS NULL) > 0 AS sampled FROM orders UNION ALL SELECT 'o_totalprice', count(*) FILTER (WHERE NOT o_totalprice >= 2000) > 0 FROM orders"),
    "failed_mask": (lambda s, d: _failed_rows(s, d), "SELECT count(*) AS failed, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderstatus = 'F' AND NOT o_totalprice > 100000"),
    "report_table": (lambda s, d: _config().execute(_orders(s, d)).to_spark(s).select("dataset_name", "dataset_id", "lifecycle_stage", "field", "data_quality_dimension", "records_evaluated", F.round("pass_rate", 6).alias("pass_rate")), _STAMPED_SQL),
    "report_through_pandas": (_through_frame, _STAMPED_SQL),
    "report_schema": (_rows("name string, kind string", lambda s, d: DataQualityReport(results=measure(Q._table(s, d, "region"), [R.CompletenessRule(field="r_name")])).to_spark(s).dtypes), _values("name, kind", _SCHEMA_ROWS)),
    "report_column_order": (_rows("place long, name string", lambda s, d: list(enumerate(_config().execute(_orders(s, d), sample_size=0).to_dataframe().columns))), _values("place, name", [(i, n) for i, (n, _) in enumerate(_SCHEMA_ROWS)])),
    "report_rounded": (_rows("field string, pass_rate double, measurement_time string", _rounded), f"SELECT field, round(pass_rate, 2) AS pass_rate, '06.05.2024 07:08' AS measurement_time FROM ({Q._REPORT_SQL})"),
    "report_shifted_ids": (_rows("id long", _shifted), _FEW_IDS.format("o_orderkey + 2")),
    "report_json": (_rows(f"{_COUNTS}, measurement_time string", _through_json), f"SELECT *, '2024-05-06T07:08:09+00:00' AS measurement_time FROM ({_COUNTS_SQL})"),
    "report_rule_data": (_rows("field string, function string", lambda s, d: [(r.field, json.loads(r.rule_data)["function"]) for r in measure(_orders(s, d), list(Q._REPORT_RULES), sample_size=0)]), _values('field, "function"', [(r.field, r.function) for r in Q._REPORT_RULES])),
    "rule_dates_as_iso": (_rows("start_date string", lambda s, d: [(R.TimelinessStaticRule(field="x", start_date="31/12/1999", dayfirst=True).to_dict()["start_date"],)]), "SELECT '1999-12-31T00:00:00+00:00' AS start_date"),
    "config_yaml": (_rows(_COUNTS, _through_yaml), _COUNTS_SQL),
    "config_yaml_merged": (_rows(f"dataset_name string, {_COUNTS}", _merged_yaml), "SELECT 'first' AS dataset_name, field, records_evaluated, pass_rate FROM (" + Q._sql(_P, "orders", f"{_P} LIKE '1-%' OR {_P} LIKE '2-%'") + " UNION ALL " + Q._sql("o_orderstatus", "orders", "o_orderstatus IS NOT NULL") + ")"),
    "config_from_report": (_rows(f"dataset_name string, dataset_id long, {_COUNTS}", _from_report), f"SELECT 'orders' AS dataset_name, 7::BIGINT AS dataset_id, * FROM ({_COUNTS_SQL})"),
    "pandas_source": (_rows(_COUNTS, lambda s, d: _counts(DataQualityReport(results=_pandas_nation(s, d)))), "SELECT 'n_name' AS field, count(*) AS records_evaluated, count(*) FILTER (WHERE n_nationkey % 5 <> 0) / count(*)::DOUBLE AS pass_rate FROM nation UNION ALL SELECT 'n_regionkey', count(*), count(DISTINCT n_regionkey) / count(*)::DOUBLE FROM nation"),
    "pandas_index_labels": (_rows("label long", lambda s, d: [(i,) for r in _pandas_nation(s, d) for i in r.records_failed_ids]), "(SELECT n_nationkey::BIGINT AS label FROM nation WHERE n_nationkey % 5 = 0 ORDER BY 1 LIMIT 10) UNION ALL (SELECT n_nationkey FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1 ORDER BY 1 LIMIT 10)"),
    "timeliness_relative_now": (_rows(_COUNTS, _to_now), "SELECT 'o_orderdate' AS field, count(*) AS records_evaluated, avg((o_orderdate BETWEEN now()::TIMESTAMP - INTERVAL 20000 DAY AND now()::TIMESTAMP)::INT) AS pass_rate FROM orders"),
    "timedelta_spellings": (Q._counted("events", R.TimelinessRelativeRule(field="ts", reference_date="2024-01-08", start_timedelta="-168h", end_timedelta="PT36H")), Q._sql("ts", "events", "ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-09 12:00:00'")),
    "regex_in_python": (Q._counted("orders", R.ValidityRegexRule(field=_P, regex_pattern="(1)?(?(1)-URG|[2-4])")), Q._sql(_P, "orders", f"regexp_matches({_P}, '^(1-URG|[2-4])')")),
    "dimensions": (_rows("name string, looked_up string", lambda s, d: [(m.value, DamaFramework(m.value.upper()).value) for m in DamaFramework]), _values("name, looked_up", [(n, n) for n in ("Uniqueness", "Completeness", "Validity", "Consistency", "Accuracy", "Timeliness")])),
    "dates_to_utc": (_rows("text string, utc string", lambda s, d: [(t, to_utc_datetime(t).isoformat()) for t in ("2024-02-29", "2024-02-29T12:30:00+01:00", "05-01-2024", "2024-02-29 01:02:03")]), _values("text, utc", [("2024-02-29", "2024-02-29T00:00:00+00:00"), ("2024-02-29T12:30:00+01:00", "2024-02-29T11:30:00+00:00"), ("05-01-2024", "2024-05-01T00:00:00+00:00"), ("2024-02-29 01:02:03", "2024-02-29T01:02:03+00:00")])),
    "refused_sources": _refused({
        "a list": (lambda s, d: _config().execute([1]), ValueError),
        "elasticsearch": (lambda s, d: _config().execute(type("Client", (), {"__module__": "elasticsearch.client"})()), NotImplementedError),
        "a column that is not there": (lambda s, d: measure(_orders(s, d), [R.CompletenessRule(field="nowhere")]), ValueError),
    }),
    "refused_rules": _refused({
        "if without then": (lambda s, d: _C(field="a", expression={"if": "`a` > 1"}), ValidationError),
        "no bound": (lambda s, d: R.TimelinessStaticRule(field="a"), ValidationError),
        "no date": (lambda s, d: R.TimelinessStaticRule(field="a", start_date="soon"), ValidationError),
        "two references": (lambda s, d: R.TimelinessRelativeRule(field="a", reference_date="2024-01-01", reference_column="b", end_timedelta="1d"), ValidationError),
        "no timedelta": (lambda s, d: R.TimelinessRelativeRule(field="a", reference_date="2024-01-01"), ValidationError),
        "an unknown dimension": (lambda s, d: R.CompletenessRule(field="a", data_quality_dimension="Beauty"), ValidationError),
    }),
    "refused_expressions": _refused({
        e: (lambda s, d, e=e: measure(_orders(s, d), [_C(field="o_totalprice", expression=e)]), DQFunctionError)
        for e in ("`o_totalprice` > @limit", "{'a': `o_totalprice`}", "(x := `o_totalprice`) > 1", "`o_totalprice`.shift() > 1", "`o_totalprice`.std(ddof=0) > 1", "`o_totalprice` + 1")
    }),
    "refused_paths": _refused({
        "[*] beside []": (lambda s, d: paths.flatten(Q._nested(s, d), ["lines[*].l_partkey", "lines[].l_quantity"]), ValueError),
        "no such field": (lambda s, d: paths.flatten(Q._nested(s, d), ["about.nothing"]), ValueError),
        "an array without a mark": (lambda s, d: paths.flatten(Q._nested(s, d), ["lines.l_partkey"]), ValueError),
    }),
    "consistency_title": _consistency(_P, f"`{_P}`.str.title() == '2-High'", "orders", f"{_P} = '2-HIGH'"),
    "consistency_zfill": _consistency("p_size", "`p_size`.astype('str').str.zfill(3) <= '007' or (-`p_size`).astype('str').str.zfill(4) == '-042'", "part", "p_size <= 7 OR p_size = 42"),
    "consistency_split": _consistency(_P, f"`{_P}`.str.split('[-]U').str.len() == 2 or `{_P}`.str.split('-', n=1).str.get(1) == 'HIGH'", "orders", f"contains({_P}, '-U') OR {_P} = '2-HIGH'"),
    "consistency_replace": _consistency(_P, f"`{_P}`.str.replace('E', '', n=1) == '1-URGNT' or `{_P}`.str.replace('(?P<level>[0-9])-', r'\\g<level>:', regex=True) == '5:LOW'", "orders", f"regexp_replace({_P}, 'E', '') = '1-URGNT' OR {_P} = '5-LOW'"),
    "consistency_count": _consistency(_P, f"`{_P}`.str.count('E') >= 2 or `{_P}`.str.count('[HG]') == 3", "orders", f"length({_P}) - length(replace({_P}, 'E', '')) >= 2 OR length(regexp_replace({_P}, '[^HG]', '', 'g')) = 3"),
    "consistency_isdigit": _consistency(_P, f"`{_P}`.str[0].str.isdigit() and not `{_P}`.str.isnumeric() and `{_P}`.str[2:].str.isupper()", "orders", f"regexp_matches({_P}, '^[0-9]') AND NOT regexp_matches({_P}, '[a-z]')"),
    "consistency_match": _consistency(_P, f"`{_P}`.str.match('[12]-') or `{_P}`.str.fullmatch('5-L.W') or `{_P}`.str.title().str[2:].str.istitle() and `{_P}`.str.contains('medium', case=False)", "orders", f"regexp_matches({_P}, '^([12]-|5-L.W$)') OR contains({_P}, 'MEDIUM')"),
    "consistency_skew": (Q._counted("events", _C(field="value", expression="`value` > 40 * `value`.skew() and `value`.kurt() < `value`")), Q._sql("value", "events, (SELECT skewness(value) AS s, kurtosis(value) AS k FROM events)", "value > 40 * s AND k < value")),
    "consistency_mode": (Q._counted("orders", _C(field=_P, expression=f"`{_P}` == `{_P}`.mode()[0]")), Q._sql(_P, f"orders, (SELECT {_P} AS m FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)", f"{_P} = m")),
    "consistency_math": (Q._counted("part", _C(field="p_size", expression="exp(log(`p_size`)) > 10.5 and sin(`p_size`) ** 2 + cos(`p_size`) ** 2 > 0.99 and log10(`p_size`) < 1.65 and arctan2(`p_size`, 1) > 0 and ceil(`p_size` / 4) > 3")), Q._sql("p_size", "part", "p_size >= 11 AND log10(p_size) < 1.65 AND ceil(p_size / 4.0) > 3")),
}


def _failed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the failed mask of an if/then marks."""
    from passrate.plans.planner import branches

    (branch,) = branches(_orders(spark, sf_dir), [Q._REPORT_RULES[5]], "o_orderkey")
    branch.compile()
    return branch.flat.where(branch.masks[0].failed).agg(F.count(F.lit(1)).alias("failed"), F.count_distinct(branch.bound["o_orderkey"].column).alias("keys"))
