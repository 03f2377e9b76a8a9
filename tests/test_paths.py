"""Nested paths: flattening, validation, names, and every rule on them."""

from __future__ import annotations

import pytest

import passrate as P
from passrate.operators import paths

SCHEMA = "id int, shop struct<name:string, carts:array<struct<tag:string, items:array<struct<sku:string, day:string>>>>>, notes array<string>, marks array<int>, bag map<string,int>"
ROWS = [
    (1, ("north", [("a", [("x", "2024-01-01"), ("y", "2024-02-01")]), ("b", [("z", None), (None, "2024-03-01")])]), ["n"], [1, 2], {"k": 1}),
    (2, ("south", [("c", [])]), [], [3], {}),
    (3, (None, [(None, None), ("d", [("x", "2025-01-01")])]), None, [], None),
    (4, ("west", None), [None, "m"], None, {"k": 5}),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


@pytest.mark.parametrize(
    ("wanted", "rows", "names"),
    [
        (["shop.name"], 4, ["shop_name"]),
        (["shop.name", "shop.carts[*].tag"], 6, ["shop_name", "shop_carts_all_tag"]),
        (["shop.name", "shop.carts[*].items[*].day"], 8, ["shop_name", "shop_carts_all_items_all_day"]),
        (["shop.carts[].tag", "shop.carts[].items[].day"], 4, ["shop_carts_first_tag", "shop_carts_first_items_first_day"]),
        (["shop.carts[].items[*].sku"], 5, ["shop_carts_first_items_all_sku"]),
        (["notes[*]", "marks[*]"], 2 + 1 + 1 + 2, ["notes_all", "marks_all"]),
        (["id", "notes[]"], 4, ["id", "notes_first"]),
        (["bag.k"], 4, ["bag_k"]),
    ],
)
def test_rows_and_names(df, wanted, rows, names):
    flat = P.flatten(df, wanted)
    assert (flat.count(), flat.columns) == (rows, names)


def test_values(df):
    flat = P.flatten(df, ["id", "notes[]", "shop.carts[].items[].sku"])
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, "n", "x"), (2, None, None), (3, None, None), (4, "m", None)]
    assert P.flatten(df, ["id"]) is df
    assert [r[0] for r in P.flatten(df, ["bag.k"]).collect()] == [1, None, None, 5]


def test_an_array_is_exploded_once_beside_siblings(df):
    flat = P.flatten(df, ["shop.carts[*].tag", "shop.carts[*].items[*].sku", "marks[*]"])
    assert flat.where("marks_all = 1").count() == 4
    plan = flat._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 3


@pytest.mark.parametrize("path", ["nope", "shop.nope", "shop.carts.tag", "shop.name[*]", "notes", "id.x", "shop[*].name", "shop.carts[*].items", "shop.carts[*].tag.x", "notes[*].x"])
def test_bad_paths(df, path):
    with pytest.raises(ValueError):
        P.flatten(df, ["shop.name", path])


def test_one_array_has_one_mark(df):
    with pytest.raises(ValueError, match="both"):
        P.flatten(df, ["shop.carts[*].tag", "shop.carts[].tag"])
    with pytest.raises(ValueError, match="both"):
        P.ConsistencyRule(field="notes[*]", expression="`notes[]` == 'n'").evaluate(df)


def test_safe_names():
    assert [paths.safe_name(p) for p in ("a", "_a", "a.b", "a[*].b[]", "a[]")] == ["a", "_a", "a_b", "a_all_b_first", "a_first"]


def test_every_rule_on_paths(df):
    rules = [
        P.CompletenessRule(field="shop.carts[*].tag"),
        P.UniquenessRule(field="shop.carts[*].items[*].sku"),
        P.AccuracyRule(field="shop.carts[*].tag", valid_values=["a", "b"]),
        P.ValidityRegexRule(field="shop.name", regex_pattern="[ns]"),
        P.ValidityNumericalRangeRule(field="marks[*]", min_value=2),
        P.ConsistencyRule(field="shop.carts[*].tag", expression={"if": "`shop.name` == 'north'", "then": "`shop.carts[*].tag` == 'a'"}),
        P.TimelinessStaticRule(field="shop.carts[*].items[*].day", end_date="2024-12-31"),
        P.TimelinessRelativeRule(field="shop.carts[*].items[*].day", reference_date="2024-01-01", end_timedelta="40d"),
        P.CompletenessRule(field="shop.carts[].tag"),
    ]
    report = P.DataQualityConfig(rules=rules).execute(df)
    got = [(r.records_evaluated, r.pass_rate and round(r.pass_rate, 4)) for r in report.results]
    assert got == [(6, 0.6667), (4, 0.75), (4, 0.5), (3, 0.6667), (3, 0.6667), (2, 0.5), (4, 0.75), (4, 0.5), (4, 0.5)]
    assert report.results[0].field == "shop.carts[*].tag"
    assert report.results[0].records_failed_sample == [{"shop_carts_all_tag": None}]
    assert report.results[1].records_failed_sample == [{"shop_carts_all_items_all_sku": "x"}]
    assert [r.to_dict() for r in P.DataQualityConfig.from_report(report).rules] == [r.to_dict() for r in rules]
