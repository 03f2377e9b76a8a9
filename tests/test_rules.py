"""Each rule against small tables: counts, samples, ids, nulls, markers, coercion."""

from __future__ import annotations

import warnings
from datetime import timedelta

import pandas as pd
import pytest
from pydantic import ValidationError

import passrate as P
from passrate.models import DamaFramework

NAN = float("nan")


def frame(spark, schema, *rows):
    return spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], schema)


def check(rule, df, evaluated, rate, sample=None):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        result = rule.evaluate(df)
    assert result.records_evaluated == evaluated
    assert result.pass_rate == (None if rate is None else pytest.approx(rate))
    if sample is not None:
        assert result.records_failed_sample == sample
    return result


def test_completeness(spark):
    df = frame(spark, "x string", "a", None, "", "missing")
    check(P.CompletenessRule(field="x"), df, 4, 0.75, [{"x": None}])
    check(P.CompletenessRule(field="x", na_values="missing"), df, 4, 0.5)
    check(P.CompletenessRule(field="x", na_values=["missing", "", 3]), df, 4, 0.25)
    assert P.CompletenessRule(field="x", skip_if_null="any").skip_if_null == "never"
    check(P.CompletenessRule(field="x"), frame(spark, "x double", 1.0, NAN, None), 3, 1 / 3)


def test_empty_tables_have_no_rate(spark):
    df = frame(spark, "x string")
    for rule in (P.CompletenessRule(field="x"), P.UniquenessRule(field="x"), P.AccuracyRule(field="x", valid_values=["a"]), P.ConsistencyRule(field="x", expression="`x` == 'a'")):
        check(rule, df, 0, None)


def test_uniqueness(spark):
    check(P.UniquenessRule(field="x"), frame(spark, "x int", 1, 2, 3, 3, None, 2, 2), 6, 0.5, [{"x": 2}, {"x": 3}])
    check(P.UniquenessRule(field="x", na_values=0.0), frame(spark, "x int", 0, 0, 5), 1, 1.0)
    check(P.UniquenessRule(field="x"), frame(spark, "x double", NAN, NAN, 1.5), 1, 1.0)
    check(P.UniquenessRule(field="x"), frame(spark, "x int", None, None), 0, None)


def test_accuracy(spark):
    df = frame(spark, "x string", "a", "A", "b", None)
    check(P.AccuracyRule(field="x", valid_values=["a", "b"]), df, 3, 2 / 3, [{"x": "A"}])
    check(P.AccuracyRule(field="x", valid_values=["a", "b"], inverse=True), df, 3, 1 / 3)
    check(P.AccuracyRule(field="x", valid_values=["a"], inverse=True, skip_if_null="never"), df, 4, 0.75)
    check(P.AccuracyRule(field="x", valid_values=[1, 2]), df, 3, 0.0)
    check(P.AccuracyRule(field="x", valid_values=[1, "2", 3.0, 4.5, True]), frame(spark, "x int", 1, 2, 3, 4), 4, 0.5)
    check(P.AccuracyRule(field="x", valid_values=[True]), frame(spark, "x boolean", True, False), 2, 0.5)


def test_regex(spark):
    check(P.ValidityRegexRule(field="x", regex_pattern="ab"), frame(spark, "x string", "abc", "cab", "ab\n", None), 3, 2 / 3, [{"x": "cab"}])
    check(P.ValidityRegexRule(field="x", regex_pattern=r"\d{2}$"), frame(spark, "x int", 12, 123, 7), 3, 1 / 3)
    check(P.ValidityRegexRule(field="x", regex_pattern="True"), frame(spark, "x boolean", True, False), 2, 0.5)
    check(P.ValidityRegexRule(field="x", regex_pattern="a|b", na_values=-1), frame(spark, "x string", "bx", "-1"), 2, 0.5)


def test_numeric_range(spark):
    df = frame(spark, "x string", "5", " 10 ", "abc", "1e1", "-3", None, "5d", "inf", "nan")
    rule = P.ValidityNumericalRangeRule(field="x", min_value=0, max_value=10)
    check(rule, df, 5, 0.6, [{"x": -3.0}, {"x": float("inf")}])
    with pytest.warns(UserWarning, match="'x' has 3 additional NULL"):
        rule.evaluate(df)
    check(P.ValidityNumericalRangeRule(field="x", min_value=None, max_value=3), frame(spark, "x int", 1, 5), 2, 0.5)
    check(P.ValidityNumericalRangeRule(field="x", na_values=[-1, "x"], min_value=0), frame(spark, "x decimal(9,2)", None), 0, None)
    assert P.ValidityNumericalRangeRule.model_validate({"field": "x", "min_value": None}).min_value == -float("inf")


def test_static_dates(spark):
    df = frame(spark, "x string", "2023-01-01", "2023-12-31T10:00:00+00:00", "05-01-2024", "20230501", "Jan 5, 2023", "never", None, "3025-01-01")
    check(P.TimelinessStaticRule(field="x", start_date="2023-01-01", end_date="2023-12-31T10:00:00"), df, 6, 4 / 6)
    check(P.TimelinessStaticRule(field="x", end_date="2024-05-01"), df, 6, 5 / 6, [{"x": "3025-01-01T00:00:00+00:00"}])
    check(P.TimelinessStaticRule(field="x", start_date="31/05/2022", dayfirst=True), frame(spark, "x string", "01/06/2022", "30/05/2022"), 2, 0.5)
    check(P.TimelinessStaticRule(field="x", start_date="2023-01-01", na_values="2023-01-05"), frame(spark, "x string", "2023-01-05", "2023-01-06"), 1, 1.0)
    with pytest.raises(ValidationError):
        P.TimelinessStaticRule(field="x")
    with pytest.raises(ValidationError), warnings.catch_warnings():
        warnings.simplefilter("ignore")
        P.TimelinessStaticRule(field="x", start_date="no date")


def test_relative_dates(spark):
    df = frame(spark, "x string, r string", ("2024-01-03", "2024-01-01"), ("2024-01-09", "2024-01-01"), (None, "2024-01-01"), ("2024-01-01", None))
    check(P.TimelinessRelativeRule(field="x", reference_column="r", start_timedelta="0d", end_timedelta="7d"), df, 2, 0.5, [{"x": "2024-01-09T00:00:00+00:00", "r": "2024-01-01T00:00:00+00:00"}])
    check(P.TimelinessRelativeRule(field="x", reference_date="2024-01-05", start_timedelta="-2d"), df, 3, 2 / 3)
    with pytest.warns(UserWarning, match="now"):
        rule = P.TimelinessRelativeRule(field="x", end_timedelta=timedelta(0))
    assert rule.reference_date is not None
    assert P.TimelinessRelativeRule(field="x", reference_date="2024-01-01", end_timedelta="+6h").end_timedelta == timedelta(hours=6)
    assert P.TimelinessRelativeRule(field="x", reference_date="2024-01-01", end_timedelta=90).end_timedelta == timedelta(seconds=90)
    with pytest.raises(ValidationError):
        P.TimelinessRelativeRule(field="x", reference_date="2024-01-01", reference_column="r", end_timedelta="1d")
    with pytest.raises(ValidationError):
        P.TimelinessRelativeRule(field="x", reference_date="2024-01-01")


def test_dates_of_all_types(spark):
    df = spark.sql("SELECT DATE'2024-01-01' AS d, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS n, TIMESTAMP'2024-01-01 00:00:00' AS t, 1704067200000000000L AS i")
    for field in "dnti":
        check(P.TimelinessStaticRule(field=field, start_date="2024-01-01", end_date="2024-01-01"), df, 1, 1.0)


def test_session_time_zone_does_not_matter(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS n")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        check(P.TimelinessStaticRule(field="n", start_date="2024-01-01", end_date="2024-01-01"), df, 1, 1.0)
        assert spark.conf.get("spark.sql.session.timeZone") == "America/New_York"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_skip_policies(spark):
    df = frame(spark, "a int, b int", (1, 1), (1, None), (None, 1), (None, None), (3, 1))
    for policy, evaluated, passing in (("any", 2, 1), ("all", 4, 1), ("never", 5, 1)):
        check(P.ConsistencyRule(field="a", expression="`a` > 1 and `b` == 1", skip_if_null=policy), df, evaluated, passing / evaluated)


def test_if_then(spark):
    df = frame(spark, "a int, b string", (1, "x"), (2, "y"), (None, "x"), (3, None))
    check(P.ConsistencyRule(field="a", expression={"if": "`a` >= 2", "then": "`b`.notnull()"}), df, 2, 0.5, [{"a": 3, "b": None}])
    with pytest.raises(ValidationError):
        P.ConsistencyRule(field="a", expression={"if": "`a` > 1"})


def test_samples_are_distinct_ordered_and_capped(spark):
    df = spark.range(5000).selectExpr("IF(id < 4000, 0, id) AS x")
    result = P.ValidityNumericalRangeRule(field="x", min_value=10_000).evaluate(df)
    assert result.records_failed_sample == [{"x": float(v)} for v in [0, *range(4000, 4009)]]
    assert result.records_failed_ids is None
    P.SampleConfig.RECORDS_FAILED_SAMPLE_SIZE = 3
    try:
        assert len(P.ValidityNumericalRangeRule(field="x", min_value=10_000).evaluate(df).records_failed_sample) == 3
    finally:
        P.SampleConfig.RECORDS_FAILED_SAMPLE_SIZE = 10


def test_ids(spark):
    df = frame(spark, "k long, x int", (7, 1), (9, None), (8, None))
    assert P.CompletenessRule(field="x").evaluate(df, id_column="k").records_failed_ids == [8, 9]


def test_pandas_source_gives_index_labels(spark):
    df = pd.DataFrame({"x": [1, 2, 2, None], "m": ["a", 1, None, "b"]}, index=list("pqrs"))
    assert P.CompletenessRule(field="x").evaluate(df).records_failed_ids == ["s"]
    assert P.UniquenessRule(field="x").evaluate(df).records_failed_ids == ["r"]
    assert P.CompletenessRule(field="m").evaluate(df).pass_rate == 0.75


def test_sources_and_columns_are_checked(spark):
    with pytest.raises(ValueError, match="You must pass in"):
        P.CompletenessRule(field="x").evaluate([1, 2])
    with pytest.raises(ValueError, match="not in the data"):
        P.CompletenessRule(field="y").evaluate(frame(spark, "x int", 1))


def test_dimensions():
    assert DamaFramework("uniqueness") is DamaFramework.Uniqueness
    assert P.UniquenessRule(field="x", data_quality_dimension="VALIDITY").data_quality_dimension is DamaFramework.Validity
    with pytest.raises(ValueError):
        DamaFramework("speed")


def test_columns_with_awkward_names(spark):
    df = frame(spark, "`_id` int, `a.b` int, a struct<b:int>", (1, 5, (7,)), (1, None, (8,)))
    check(P.UniquenessRule(field="_id"), df, 2, 0.5, [{"_id": 1}])
    check(P.CompletenessRule(field="a.b"), df, 2, 0.5)


def test_many_rules_agree_with_each_alone(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS x", "IF(id % 5 = 0, NULL, CAST(id AS STRING)) AS s")
    rules = [P.ValidityNumericalRangeRule(field="x", max_value=k % 7) for k in range(120)] + [P.UniquenessRule(field="x"), P.CompletenessRule(field="s"), P.UniquenessRule(field="s")]
    together = P.DataQualityConfig(rules=rules).execute(df, sample_size=0)
    for rule, result in list(zip(rules, together.results, strict=True))[::20] + list(zip(rules, together.results, strict=True))[-3:]:
        alone = rule.evaluate(df.repartition(3), sample_size=0)
        assert (alone.records_evaluated, alone.pass_rate) == (result.records_evaluated, result.pass_rate)
