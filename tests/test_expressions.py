"""The expression language against pandas.eval on the same rows, and its refusals."""

from __future__ import annotations

import re

import pandas as pd
import pytest

from passrate import ConsistencyRule, DataQualityConfig, DQFunctionError
from passrate.functions.expressions import columns_in, with_safe_names
from passrate.operators.paths import safe_name

ROWS = [(1, 4.0, "Apple pie", "2024-01-31"), (2, None, "banana", "2024-02-29"), (None, -2.5, None, "2023-12-31"), (4, 9.0, "Kiwi 42", None), (0, 0.0, "", "2024-06-01"), (-7, 2.5, "ÉCLAIR", "2024-06-03")]
NAMES = ["-5", "42", "o'neil-smith", "\u00b2", "\u4e00", "12\u0663"]

CASES = [
    "`a` > 1",
    "`a` != 2",
    "`a` == 2",
    "~(`a` > 1)",
    "not `a` > 1 and `b` < 5",
    "`a` > 0 & `b` > 1 | `a` == 4",
    "-8 < `a` <= 2",
    "`a` in [1, 4]",
    "`a` not in [1, 4.0]",
    "`s` in ['banana', 'x']",
    "`a` + `b` * 2 > 3",
    "`a` - 1 == `b` / 4",
    "`b` / `a` > 1",
    "`a` // 2 == 0",
    "`a` % 3 == 2",
    "`a` ** 2 > 10",
    "-`a` > 0",
    "abs(`b`) > 2",
    "sqrt(`b`) == 3",
    "exp(`a`) > 2",
    "floor(`b`) == 2",
    "`a`.isnull()",
    "`a`.notna() and `s`.notnull()",
    "`a`.isin([1, 2])",
    "`a`.between(1, 4)",
    "`b`.fillna(7) > 5",
    "`b`.round() == 2",
    "`b`.clip(0, 3) == 3",
    "`a`.gt(1)",
    "`a`.ne(2)",
    "`b` > `b`.mean()",
    "abs(`b` - `b`.mean()) < `b`.std()",
    "`b` >= `b`.median()",
    "`b` > `b`.quantile(0.25)",
    "`b` == `b`.max() or `a` == `a`.min()",
    "`a` * 2 >= `a`.sum()",
    "`s`.str.len() > 6",
    "`s`.str.lower() == 'kiwi 42'",
    "`s`.str.upper() == 'BANANA'",
    "`s`.str.strip() == ''",
    "`s`.str[0] == 'b'",
    "`s`.str[-1] == '2'",
    "`s`.str[1:3] == 'pp'",
    "`s`.str[-2:] == '42'",
    "`s`.str.slice(0, 4) == 'Kiwi'",
    "`s`.str.replace('an', 'x') == 'bxxa'",
    "`s`.str.split(' ').str[1] == 'pie'",
    "`s`.str.zfill(8) == '00banana'",
    "`n`.str.zfill(4) == '-005'",
    "`n`.str.zfill(4) == '0042'",
    "`n`.str.title() == \"O'Neil-Smith\"",
    "`s`.str.title() == 'Apple Pie'",
    "`s`.str.capitalize() == 'Banana'",
    "`s`.str.count('a') == 3",
    "`s`.str.count('[Aa]') > 0",
    "`s`.str.split(' ').str.len() == 2",
    "`s`.str.split().str.len() == 1",
    "`s`.str.split().str.get(1) == '42'",
    "`s`.str.split('a.', regex=True).str[0] == 'b'",
    "`s`.str.split('an', n=1).str[1] == 'ana'",
    "`s`.str.split('[ae]').str.len() > 2",
    "`s`.str.split(' ').str.join('-') == 'Kiwi-42'",
    "`s`.str.get(1) == 'p'",
    "`s`.str.replace('a', 'x', n=2) == 'bxnxna'",
    "`s`.str.replace('(?P<x>n)a', r'\\g<x>o', regex=True) == 'banono'",
    "`s`.str.replace('(a)(n)', r'\\2\\1', regex=True) == 'bnanaa'",
    "`s`.str.replace('APPLE', '$1', case=False, regex=True) == '$1 pie'",
    "`s`.str.find('an') == 1",
    "`s`.str.removeprefix('ban') == 'ana'",
    "`s`.str.removesuffix('pie') == 'Apple '",
    "`s`.str.repeat(2) == 'bananabanana'",
    "`b` > `b`.skew()",
    "`b` > `b`.kurt()",
    "`a` == `a`.mode()[0]",
    "`s` == `s`.mode()[0]",
    "`b` > `b`.quantile(q=0.6)",
    "`b`.between(left=0, right=4, inclusive='left')",
    "`d` > '2024-01-15'",
    "`d`.dt.year == 2024",
    "`d`.dt.dayofweek == 5",
    "`d`.dt.is_month_end",
    "`d`.dt.quarter == 2",
    "`a` == 1 or `d`.dt.month == 6",
]
#: pandas wants no nulls under string predicates; they count as false here.
TEXT_CASES = ["`s`.str.startswith('b')", "`s`.str.endswith('e')", "`s`.str.contains('an+a$')", "`s`.str.contains('i 4', regex=False)", "`s`.str.match('[A-K]')", "`s`.str.fullmatch('[a-z]+')", "`s`.str.istitle()", "`s`.str.isupper()", "`s`.str.islower()", "`s`.str.isalpha()", "`n`.str.isdigit()", "`n`.str.isnumeric()", "`n`.str.isdecimal()", "`n`.str.isalnum()", "`n`.str.contains('O.N', case=False)"]


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(*r, n) for r, n in zip(ROWS, NAMES, strict=True)]
    pdf = pd.DataFrame(rows, columns=list("absdn"))
    pdf["d"] = pd.to_datetime(pdf["d"])
    df = spark.createDataFrame(rows, "a int, b double, s string, d string, n string").selectExpr("a", "b", "s", "CAST(d AS TIMESTAMP) AS d", "n")
    return pdf, df.coalesce(1)


@pytest.fixture(scope="module")
def rates(frames):
    """All cases in one rule set: one aggregate."""
    expressions = CASES + TEXT_CASES
    config = DataQualityConfig(rules=[ConsistencyRule(field="a", expression=e, skip_if_null="never") for e in expressions])
    return dict(zip(expressions, (r.pass_rate for r in config.execute(frames[1], sample_size=0).results), strict=True))


def by_pandas(pdf: pd.DataFrame, expression: str) -> pd.Series:
    try:
        return pdf.eval(expression)
    except (ValueError, NotImplementedError, TypeError, AttributeError):  # pandas.eval has no slices
        return eval(re.sub(r"`(\w)`", r"pdf['\1']", expression), {"pdf": pdf, "abs": abs})


@pytest.mark.parametrize("expression", CASES + TEXT_CASES)
def test_agrees_with_pandas(frames, rates, expression):
    pdf, _ = frames
    expected = by_pandas(pdf.assign(s=pdf["s"].fillna("\0") if expression in TEXT_CASES else pdf["s"]), expression).fillna(False).astype(bool)
    if expression in TEXT_CASES and "`s`" in expression:
        expected &= pdf["s"].notna()
    assert round(rates[expression] * len(ROWS)) == int(expected.sum())


@pytest.mark.parametrize("expression", ["`a` + 1", "`b`.std() < 15", "`a` >", "`a`.shift() > 1", "`a`.cumsum() > 1", "a > 1 and `a` > 1", "`s` > 3", "`a`.foo() > 1", "@x > `a`", "{'x': 1} == `a`", "`a`[0] == 1", "`s` + 1 == 2", "lambda: `a`", "`a` and `b`", "`b`.std(ddof=0) < `b`", "`b`.quantile(0.5, interpolation='lower') < `b`", "`b`.mean(skipna=False) < `b`", "`b`.mode() == `b`", "`a`.rank() > 1", "`a`.duplicated()", "`s`.str.contains('a', flag=2)", "`s`.str.contains('a', flags=8)", "`s`.str.split('a', expand=True).str[0] == 'b'", "`s`.str.split('a').str.contains('b')", "`a`.fillna(1, limit=2) > 1", "`s`.str.isdigit(1)"])
def test_refusals(frames, expression):
    with pytest.raises(DQFunctionError):
        ConsistencyRule(field="a", expression=expression).evaluate(frames[1])


def test_statistics_see_all_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (-9, "y")], "a int, g string")
    rule = ConsistencyRule(field="a", expression={"if": "`g` == 'x'", "then": "`a` < `a`.mean()"}, na_values=-9)
    result = rule.evaluate(df)  # the mean of 1, 2, 3
    assert (result.records_evaluated, result.pass_rate) == (2, 0.5)


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0, 2.0, 7.5, 9.0, 11.0], [3.0] * 50, [float(i % 7) for i in range(300)], [i / 7 for i in range(997)], [0.0] * 200 + [1.0, 2.0], [-1e300, 1e300, 5.0, 5.0, 6.0]])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_quantiles_by_brackets(spark, values, q):
    """With brackets of a few rows: the sketch, the counts and the bisection give what sorting does."""
    from passrate.plans import statistics

    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").coalesce(1)
    for at_once in (4, 1000) if q in (0.25, 0.5) else (1000,):
        assert statistics.quantile(df, df["v"], q, at_once) == pytest.approx(pd.Series(values).quantile(q), rel=1e-12)


def test_division_by_zero_is_infinite_or_null(spark):
    df = spark.createDataFrame([(1, 0), (-1, 0), (0, 0)], "a int, b int")
    assert ConsistencyRule(field="a", expression="`a` / `b` > 1").evaluate(df).pass_rate == pytest.approx(1 / 3)
    assert ConsistencyRule(field="a", expression="`a` / `b` < 1").evaluate(df).pass_rate == pytest.approx(1 / 3)


def test_column_names():
    assert columns_in({"if": "`a.b[*].c` > 1", "then": "`d` == `a.b[*].c`"}) == ["a.b[*].c", "d"]
    with pytest.raises(ValueError):
        columns_in("a > 1")
    assert with_safe_names("`a.b[*].c` > `d`", safe_name) == "`a_b_all_c` > `d`"
    assert with_safe_names({"if": "`x[]`>1", "then": "`y`>1"}, safe_name) == {"if": "`x_first`>1", "then": "`y`>1"}
