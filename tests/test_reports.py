"""Reports, configurations, files, streams."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
import pytest
import yaml
from pydantic import ValidationError

import passrate as P
from passrate.plans.planner import branches, counts_frame
from passrate.report import RESULT_SCHEMA
from passrate.streaming.batches import measure_batches

RULES = [P.CompletenessRule(field="x", rule_id=1), P.ValidityNumericalRangeRule(field="x", min_value=2, rule_description="at least 2"), P.UniquenessRule(field="x"), P.TimelinessRelativeRule(field="t", reference_date="2024-01-01", start_timedelta="-1d", end_timedelta="PT6H")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (2, "2023-12-31"), (None, None)], "x int, t string")


@pytest.fixture(scope="module")
def config():
    return P.DataQualityConfig(dataset_name="shop", dataset_id=7, lifecycle_stage="in", measurement_time="2024-05-06T07:08:09Z", rules=RULES)


@pytest.fixture(scope="module")
def report(config, df):
    return config.execute(df)


def test_metadata_is_on_every_result(report):
    assert {(r.dataset_name, r.dataset_id, r.lifecycle_stage, r.measurement_time) for r in report.results} == {("shop", 7, "in", datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))}
    assert [r.pass_rate for r in report.results] == [0.75, pytest.approx(2 / 3), pytest.approx(2 / 3), pytest.approx(2 / 3)]
    assert report.results[0].rule_id == 1
    assert json.loads(report.results[1].rule_data)["min_value"] == 2


def test_pandas_frame(report):
    frame = report.to_dataframe(decimals=2, measurement_time_format="%Y/%m/%d")
    assert list(frame.columns) == [f.name for f in RESULT_SCHEMA]
    assert frame["pass_rate"].tolist() == [0.75, 0.67, 0.67, 0.67]
    assert set(frame["measurement_time"]) == {"2024/05/06"}
    assert P.DataQualityReport().to_dataframe().empty
    for bad in (0, 11, 2.5):
        with pytest.raises(ValueError):
            report.to_dataframe(decimals=bad)
    with pytest.raises(ValueError):
        report.to_dataframe(measurement_time_format="day %Q")


def test_frames_and_json_round_trip(report, tmp_path):
    again = P.DataQualityReport.from_dataframe(report.to_dataframe(decimals=10))
    assert [r.field for r in again.results] == [r.field for r in report.results]
    assert again.results[1].records_failed_sample == report.results[1].records_failed_sample
    text = report.to_json(tmp_path / "r.json")
    assert json.loads((tmp_path / "r.json").read_text()) == json.loads(text) == report.to_dict()


def test_lists_in_frames_may_be_json_text():
    row = {"field": "x", "data_quality_dimension": "Validity", "pass_rate": float("nan"), "rule_data": "{}", "records_failed_sample": '[{"x": 1}]', "records_failed_ids": "oops"}
    with pytest.warns(UserWarning, match="no JSON"):
        (result,) = P.DataQualityReport.from_dataframe(pd.DataFrame([row])).results
    assert (result.pass_rate, result.records_failed_sample, result.records_failed_ids) == (None, [{"x": 1}], None)


def test_ids_can_be_shifted():
    result = P.DataQualityResult(field="x", data_quality_dimension="Validity", pass_rate=0.5, rule_data="{}", records_failed_ids=[1, 2])
    assert P.DataQualityReport(results=[result]).to_dataframe(records_failed_ids_shift=2)["records_failed_ids"][0] == [3, 4]
    result.records_failed_ids = ["a", 2]
    assert P.DataQualityReport(results=[result]).to_dataframe(records_failed_ids_shift=2)["records_failed_ids"][0] == ["a", 2]


def test_spark_table(report, spark):
    rows = report.to_spark(spark).collect()
    assert rows[0]["dataset_id"] == "7" and rows[0]["records_evaluated"] == 4
    assert json.loads(rows[1]["records_failed_sample"]) == [{"x": 1.0}]


def test_yaml_round_trip(config, df, report, tmp_path):
    path = tmp_path / "new" / "rules.yaml"
    config.to_yaml(path)
    with pytest.raises(FileExistsError):
        config.to_yaml(path)
    config.to_yaml(path, overwrite=True)
    loaded = P.DataQualityConfig.from_yaml(path)
    assert loaded == config
    assert [r.pass_rate for r in loaded.execute(df).results] == [r.pass_rate for r in report.results]
    assert P.DataQualityConfig.from_report(report).rules == config.rules


def test_several_files_and_named_patterns(tmp_path):
    one, two, names = (tmp_path / n for n in ("1.yaml", "2.yaml", "p.yaml"))
    one.write_text(yaml.safe_dump({"dataset_name": "first", "rules": [{"function": "validity_regex", "field": "a", "regex_pattern": "CODE"}]}))
    two.write_text(yaml.safe_dump({"dataset_name": "second", "rules": [{"function": "uniqueness", "field": "b"}]}))
    names.write_text("CODE: '^\\d+$'\n")
    with pytest.warns(UserWarning, match="first file"):
        config = P.DataQualityConfig.from_yaml([one, two], regex_yaml_path=names)
    assert (config.dataset_name, [r.field for r in config.rules], config.rules[0].regex_pattern) == ("first", ["a", "b"], r"^\d+$")
    names.write_text("CODE: 3\n")
    with pytest.raises(ValueError):
        P.DataQualityConfig.from_yaml(one, regex_yaml_path=names)
    with pytest.raises(FileNotFoundError):
        P.DataQualityConfig.from_yaml(tmp_path / "none.yaml")
    one.write_text("data_set: x\n")
    with pytest.raises(ValidationError):
        P.DataQualityConfig.from_yaml(one)


def test_unreadable_entries_are_left_out():
    make = lambda data, name="d": P.DataQualityResult(field="x", data_quality_dimension="Validity", pass_rate=None, rule_data=data, dataset_name=name)
    good = json.dumps({"function": "uniqueness", "field": "x"})
    with pytest.warns(UserWarning):
        config = P.DataQualityConfig.from_report(P.DataQualityReport(results=[make(good), make("{"), make(""), make("{}", "other")]))
    assert (len(config.rules), config.dataset_name) == (1, "d")
    with pytest.raises(ValueError):
        P.DataQualityConfig.from_report(P.DataQualityReport())


def test_one_branch_reads_only_what_it_uses(spark, tmp_path):
    spark.range(10).selectExpr("id AS a", "id AS b", "CAST(id AS STRING) AS c", "named_struct('x', id, 'y', id) AS s").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rules = [P.CompletenessRule(field="a"), P.ValidityNumericalRangeRule(field="s.x", max_value=5), P.ValidityRegexRule(field="a", regex_pattern="[0-4]"), P.TimelinessStaticRule(field="a", start_date="1970-01-01")]
    (branch,) = branches(table, rules)
    branch.compile()
    plan = branch.counted()._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint,s:struct<x:bigint>>" in plan
    assert "Python" not in plan and plan.count("Scan parquet") == 1
    assert [r["records_passing"] for r in counts_frame(table, rules).orderBy("position").collect()] == [10, 6, 5, 10]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (None,)], "x int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x int").parquet(str(tmp_path / "in"))
    got = []
    query = measure_batches(stream, P.DataQualityConfig(rules=[P.CompletenessRule(field="x")]), lambda report, n: got.append((n, report.results[0].pass_rate)), checkpointLocation=str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert got == [(0, 0.5)]
