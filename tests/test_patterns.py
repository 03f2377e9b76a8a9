"""Python patterns in the JVM: the same matches, value by value."""

from __future__ import annotations

import re

import pytest

from passrate.functions.patterns import Untranslatable, matches, translate

PATTERNS = [
    "ab", "a|b", "(?:a|b)c", r"^\d+$", r"\w+@\w+\.\w+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", r"\s*x", "[^a-c]+$", "[]a]+", "[^]a]+", "[a[]+", "[a&&b]+", r"[\w&&x]+",
    "(?P<y>\\d{4})-(?P<m_1>\\d\\d)", r"(?P<c>.)(?P=c)", r"(.)\1", r"a\Z", "a$", "(?i:AB)c", "(?i)ab", "(?s).b", "(?x) a b", "a{,2}b", "a{2,3}?", "(?=ab)a", "(?!ab)a", "(?<=a)b", "a++b", "(?>a+)b", r"\bab\b",
    r"\D+", r"\S+", r"\W", r"[\d-]+", "[a-]+", "[-a]+", r"\.", "", ".*", ".", "é", r"\x41", "(?#note)ab", "(a)?(?(1)b|c)", r"[\[\]]+", r"\\", "[$^]+", "(?a)\\d+",
]
VALUES = ["", "a", "b", "ab", "ABc", "abc", "cab", "aab", "aa", "a\n", "\nb", "x", " x", "2024-01-02", "11", "١٢", "é", "É", "user@ex.com", "a b", "]a", "[a", "a&b", "&&", "a-", "-1", ".", "\\", "$^", "AB", "aaab", "A", "ab ab", "\x0b", "a_b", "[]", "\r", "a\r"]


@pytest.fixture(scope="module")
def found(spark):
    """All pairs of pattern and value in a few selects."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "i int, v string").coalesce(1)
    v = df["v"]
    rows = df.select("i", *(matches(v, p).alias(f"m{k}") for k, p in enumerate(PATTERNS))).orderBy("i").collect()
    return {p: [r[k + 1] for r in rows] for k, p in enumerate(PATTERNS)}


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_as_re_match(found, pattern):
    assert found[pattern] == [re.match(pattern, v) is not None for v in VALUES]


def test_modes(spark):
    df = spark.createDataFrame([("xab",), ("ab",), ("AB",), (None,)], "v string").coalesce(1)
    rows = df.select(matches(df["v"], "ab", "search").alias("s"), matches(df["v"], "a|ab", "fullmatch").alias("f"), matches(df["v"], "ab", "match", True).alias("i")).collect()
    assert [tuple(r) for r in rows] == [(True, False, False), (True, True, True), (False, False, True), (None, None, None)]


def test_translation():
    assert translate(r"(?P<a_b>\d)\Z") == r"(?<ax5fb>\d)\z"
    with pytest.raises(Untranslatable):
        translate("(a)?(?(1)b|c)")
    with pytest.raises(re.error):
        translate("(")


def test_plans_have_no_python_worker(spark):
    df = spark.createDataFrame([("a",)], "v string")
    plan = df.select(matches(df["v"], r"(?P<x>[a-z]+)\d*$"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
