"""Queries over the driver's tables, at least one per operator, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passrate import rules as R
from passrate.operators import paths
from passrate.plans.planner import counts_frame

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(source: Callable[[SparkSession, str], DataFrame] | str, *rules: R.BaseRule) -> Query:
    """The counts of the rules over a table, or over what a function makes of the tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _table(spark, sf_dir, source) if isinstance(source, str) else source(spark, sf_dir)
        return counts_frame(df, list(rules)).drop("position")

    return run


def _sql(field: str, source: str, passing: str, evaluated: str = "TRUE") -> str:
    return (
        f"SELECT '{field}' AS field, count(*) FILTER (WHERE {evaluated}) AS records_evaluated, count(*) FILTER (WHERE ({evaluated}) AND coalesce(({passing}), FALSE)) AS records_passing, "
        f"(count(*) FILTER (WHERE ({evaluated}) AND coalesce(({passing}), FALSE)))::DOUBLE / nullif(count(*) FILTER (WHERE {evaluated}), 0)::DOUBLE AS pass_rate FROM {source}"
    )


def _unique_sql(field: str, source: str, column: str) -> str:
    return f"SELECT '{field}' AS field, count({column}) AS records_evaluated, count(DISTINCT {column}) AS records_passing, count(DISTINCT {column})::DOUBLE / nullif(count({column}), 0)::DOUBLE AS pass_rate FROM {source}"


# -- inputs made of the tables


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an ordered array of structs; orders without lines have a null."""
    line = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_returnflag").alias("line"))
    lines = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("line")).alias("lines"))  # the lines of one order: a few
    orders = _table(spark, sf_dir, "orders")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"], "left").select("o_orderkey", "o_custkey", "o_orderdate", F.struct("o_orderstatus", "o_totalprice").alias("about"), "lines")


_NESTED_SQL = "orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey"
_FIRST_SQL = "(SELECT o.*, l.* FROM orders o LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_quantity, l_returnflag) = 1) l ON l.l_orderkey = o.o_orderkey)"


def _holed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("total"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
        "o_custkey",
    )


_HOLED_SQL = "(SELECT o_orderkey, NULLIF(o_orderstatus, 'P') AS status, CASE WHEN o_totalprice >= 50000 THEN o_totalprice END AS total, NULLIF(o_orderpriority, '5-LOW') AS priority, o_custkey FROM orders)"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and dates as text, some of them broken."""
    digit = F.substring("o_orderpriority", 1, 1)
    return _table(spark, sf_dir, "orders").select(
        F.when(digit == "5", F.lit("n/a")).when(digit == "4", F.concat(F.lit(" "), digit, F.lit(".5 "))).otherwise(digit).alias("level"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("soon")).when(F.col("o_orderkey") % 7 == 1, F.date_format("o_orderdate", "MM/dd/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )


_TEXTS_SQL = """(SELECT CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'n/a' WHEN '4' THEN ' 4.5 ' ELSE substr(o_orderpriority, 1, 1) END AS level,
CASE o_orderkey % 7 WHEN 0 THEN 'soon' WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderdate, o_orderkey FROM orders)"""


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, orders = _table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).select("l_shipdate", "o_orderdate")


def _flat(*wanted: str, shape: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: shape(paths.flatten(_nested(spark, sf_dir), list(wanted)))


_TOTAL_SQL = "SELECT count(*) AS n, count({0}) AS n_values, count(DISTINCT {0}) AS n_distinct FROM {1}"


def _totals(column: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.count(column).alias("n_values"), F.count_distinct(column).alias("n_distinct"))


_DAY0 = "2024-01-01"
_REPORT_RULES: tuple[R.BaseRule, ...] = (
    R.CompletenessRule(field="o_orderpriority", na_values="4-NOT SPECIFIED"),
    R.UniquenessRule(field="o_orderkey"),
    R.AccuracyRule(field="o_orderpriority", valid_values=["1-URGENT", "2-HIGH"]),
    R.ValidityRegexRule(field="o_orderstatus", regex_pattern="[FO]"),
    R.ValidityNumericalRangeRule(field="o_totalprice", min_value=1000, max_value=300000),
    R.ConsistencyRule(field="o_totalprice", expression={"if": "`o_orderstatus` == 'F'", "then": "`o_totalprice` > 100000"}),
    R.TimelinessStaticRule(field="o_orderdate", start_date="1995-01-01", end_date="1996-12-31"),
    R.TimelinessRelativeRule(field="o_orderdate", reference_date="1995-06-01", start_timedelta="-90d", end_timedelta="90d"),
)
_REPORT_SQL = " UNION ALL ".join([
    _sql("o_orderpriority", "orders", "o_orderpriority <> '4-NOT SPECIFIED'"),
    _unique_sql("o_orderkey", "orders", "o_orderkey"),
    _sql("o_orderpriority", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    _sql("o_orderstatus", "orders", "o_orderstatus IN ('F', 'O')"),
    _sql("o_totalprice", "orders", "o_totalprice BETWEEN 1000 AND 300000"),
    _sql("o_totalprice", "orders", "o_totalprice > 100000", "o_orderstatus = 'F'"),
    _sql("o_orderdate", "orders", "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"),
    _sql("o_orderdate", "orders", "o_orderdate BETWEEN TIMESTAMP '1995-06-01' - INTERVAL 90 DAY AND TIMESTAMP '1995-06-01' + INTERVAL 90 DAY"),
])

_C = R.ConsistencyRule
_ALL: dict[str, tuple[Query, str]] = {
    "completeness_plain": (_counted("orders", R.CompletenessRule(field="o_orderstatus")), _sql("o_orderstatus", "orders", "o_orderstatus IS NOT NULL")),
    "completeness_na_values": (_counted("orders", R.CompletenessRule(field="o_orderpriority", na_values="4-NOT SPECIFIED")), _sql("o_orderpriority", "orders", "NULLIF(o_orderpriority, '4-NOT SPECIFIED') IS NOT NULL")),
    "completeness_na_list": (_counted("part", R.CompletenessRule(field="p_size", na_values=[1, 2.0, "3"])), _sql("p_size", "part", "p_size NOT IN (1, 2)")),
    "uniqueness_key": (_counted("orders", R.UniquenessRule(field="o_orderkey")), _unique_sql("o_orderkey", "orders", "o_orderkey")),
    "uniqueness_fk": (_counted("orders", R.UniquenessRule(field="o_custkey")), _unique_sql("o_custkey", "orders", "o_custkey")),
    "uniqueness_na_values": (_counted("part", R.UniquenessRule(field="p_size", na_values=[1, 2])), _unique_sql("p_size", "(SELECT CASE WHEN p_size > 2 THEN p_size END AS p_size FROM part)", "p_size")),
    "accuracy_list": (_counted("orders", R.AccuracyRule(field="o_orderpriority", valid_values=["1-URGENT", "2-HIGH"])), _sql("o_orderpriority", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')")),
    "accuracy_inverse": (_counted("orders", R.AccuracyRule(field="o_orderpriority", valid_values=["1-URGENT", "2-HIGH"], inverse=True)), _sql("o_orderpriority", "orders", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")),
    "accuracy_na": (_counted("orders", R.AccuracyRule(field="o_orderpriority", valid_values=["1-URGENT", "2-HIGH"], na_values=["5-LOW"])), _sql("o_orderpriority", "orders", "o_orderpriority IN ('1-URGENT', '2-HIGH')", "o_orderpriority <> '5-LOW'")),
    "accuracy_numbers": (_counted("part", R.AccuracyRule(field="p_size", valid_values=[1, 2.0, "3", 4.5, 50])), _sql("p_size", "part", "p_size IN (1, 2, 50)")),
    "accuracy_never_skipped": (_counted(_holed_orders, R.AccuracyRule(field="status", valid_values=["F"], inverse=True, skip_if_null="never")), _sql("status", _HOLED_SQL, "NOT coalesce(status = 'F', FALSE)")),
    "regex_match_prefix": (_counted("customer", R.ValidityRegexRule(field="c_name", regex_pattern="[Cc]ust.*[05]")), _sql("c_name", "customer", "regexp_matches(c_name, '^(?:[Cc]ust.*[05])')")),
    "regex_full": (_counted("pages", R.ValidityRegexRule(field="url", regex_pattern=r"https?://[a-z0-9.]+/[^?#]*$")), _sql("url", "pages", r"regexp_matches(url, '^(?:https?://[a-z0-9.]+/[^?#]*$)')")),
    "regex_on_number": (_counted("part", R.ValidityRegexRule(field="p_size", regex_pattern=r"[1-3]\d?$")), _sql("p_size", "part", r"regexp_matches(p_size::VARCHAR, '^(?:[1-3]\d?$)')")),
    "regex_named_group": (_counted("orders", R.ValidityRegexRule(field="o_orderpriority", regex_pattern=r"(?P<level>[135])-\w+")), _sql("o_orderpriority", "orders", r"regexp_matches(o_orderpriority, '^(?:[135]-\w+)')")),
    "range_inclusive": (_counted("lineitem", R.ValidityNumericalRangeRule(field="l_quantity", min_value=5, max_value=40)), _sql("l_quantity", "lineitem", "l_quantity BETWEEN 5 AND 40")),
    "range_open_min": (_counted("customer", R.ValidityNumericalRangeRule(field="c_acctbal", max_value=0)), _sql("c_acctbal", "customer", "c_acctbal <= 0")),
    "range_open_max": (_counted("customer", R.ValidityNumericalRangeRule(field="c_acctbal", min_value=5000)), _sql("c_acctbal", "customer", "c_acctbal >= 5000")),
    "range_string_coerce": (_counted(_texts, R.ValidityNumericalRangeRule(field="level", min_value=2, max_value=4.5)), _sql("level", _TEXTS_SQL, "TRY_CAST(trim(level) AS DOUBLE) BETWEEN 2 AND 4.5", "TRY_CAST(trim(level) AS DOUBLE) IS NOT NULL")),
    "consistency_simple": (_counted("lineitem", _C(field="l_quantity", expression="`l_quantity` > 25")), _sql("l_quantity", "lineitem", "l_quantity > 25")),
    "consistency_two_cols": (_counted("lineitem", _C(field="l_tax", expression="`l_discount` <= `l_tax`")), _sql("l_tax", "lineitem", "l_discount <= l_tax")),
    "consistency_arith": (_counted("part", _C(field="p_size", expression="(`p_size` * 2 + 1) % 3 == 0 and `p_size` // 4 < 5 and -`p_size` ** 2 < -9")), _sql("p_size", "part", "(p_size * 2 + 1) % 3 = 0 AND floor(p_size / 4.0) < 5 AND p_size * p_size > 9")),
    "consistency_bool": (_counted("lineitem", _C(field="l_quantity", expression="`l_quantity` > 10 & ~(`l_returnflag` == 'R') | `l_linenumber` >= 5")), _sql("l_quantity", "lineitem", "(l_quantity > 10 AND NOT l_returnflag = 'R') OR l_linenumber >= 5")),
    "consistency_strings": (_counted("orders", _C(field="o_orderpriority", expression="`o_orderpriority`.str.startswith('1') or `o_orderpriority`.str.contains('MED.UM') or `o_orderpriority`.str.len() == 5")), _sql("o_orderpriority", "orders", "starts_with(o_orderpriority, '1') OR regexp_matches(o_orderpriority, 'MED.UM') OR length(o_orderpriority) = 5")),
    "consistency_string_parts": (_counted("orders", _C(field="o_orderpriority", expression="`o_orderpriority`.str[2:].str.lower().str.strip() == 'urgent' or `o_orderpriority`.str[0].isin(['5']) or `o_orderpriority`.str.split('-').str[1].str.endswith('IUM')")), _sql("o_orderpriority", "orders", "lower(trim(substr(o_orderpriority, 3))) = 'urgent' OR substr(o_orderpriority, 1, 1) = '5' OR ends_with(split_part(o_orderpriority, '-', 2), 'IUM')")),
    "consistency_dates": (_counted("orders", _C(field="o_orderdate", expression="`o_orderdate` > '1996-01-01' and `o_orderdate`.dt.month <= 6 and `o_orderdate`.dt.dayofweek < 5")), _sql("o_orderdate", "orders", "o_orderdate > TIMESTAMP '1996-01-01' AND month(o_orderdate) <= 6 AND isodow(o_orderdate) < 6")),
    "consistency_isin": (_counted("part", _C(field="p_size", expression="`p_size` in [1, 2, 3] or `p_size`.isin([48, 49.0]) or `p_size`.between(20, 22)")), _sql("p_size", "part", "p_size IN (1, 2, 3, 48, 49, 20, 21, 22)")),
    "consistency_not_in": (_counted(_holed_orders, _C(field="status", expression="`status` not in ['F']", skip_if_null="never")), _sql("status", _HOLED_SQL, "coalesce(status NOT IN ('F'), TRUE)")),
    "consistency_not_equal": (_counted(_holed_orders, _C(field="status", expression="`status` != 'F'", skip_if_null="never")), _sql("status", _HOLED_SQL, "coalesce(status <> 'F', TRUE)")),
    "consistency_chained": (_counted("part", _C(field="p_size", expression="10 < `p_size` <= 20")), _sql("p_size", "part", "p_size > 10 AND p_size <= 20")),
    "consistency_functions": (_counted("customer", _C(field="c_acctbal", expression="abs(`c_acctbal`) > 500 and floor(sqrt(abs(`c_acctbal`))) % 2 == 0 and `c_acctbal`.fillna(0).clip(0, 9000) < 9000")), _sql("c_acctbal", "customer", "abs(c_acctbal) > 500 AND floor(sqrt(abs(c_acctbal)))::BIGINT % 2 = 0 AND c_acctbal < 9000")),
    "consistency_nulls": (_counted(_holed_orders, _C(field="status", expression="`status`.notnull() and `total`.isnull()", skip_if_null="never")), _sql("status", _HOLED_SQL, "status IS NOT NULL AND total IS NULL")),
    "consistency_if_then": (_counted("orders", _C(field="o_totalprice", expression={"if": "`o_orderstatus` == 'F'", "then": "`o_totalprice` > 100000"})), _sql("o_totalprice", "orders", "o_totalprice > 100000", "o_orderstatus = 'F'")),
    "consistency_skip_any": (_counted(_holed_orders, _C(field="status", expression="`status` == 'F' or `total` > 200000", skip_if_null="any")), _sql("status", _HOLED_SQL, "coalesce(status = 'F', FALSE) OR coalesce(total > 200000, FALSE)", "status IS NOT NULL AND total IS NOT NULL")),
    "consistency_skip_all": (_counted(_holed_orders, _C(field="status", expression="`status` == 'F' or `total` > 200000")), _sql("status", _HOLED_SQL, "coalesce(status = 'F', FALSE) OR coalesce(total > 200000, FALSE)", "status IS NOT NULL OR total IS NOT NULL")),
    "consistency_skip_never": (_counted(_holed_orders, _C(field="status", expression="`status` == 'F' or `total` > 200000", skip_if_null="never")), _sql("status", _HOLED_SQL, "coalesce(status = 'F', FALSE) OR coalesce(total > 200000, FALSE)")),
    "consistency_mean_std": (_counted("part", _C(field="p_retailprice", expression="abs(`p_retailprice` - `p_retailprice`.mean()) <= `p_retailprice`.std()")), _sql("p_retailprice", "part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part)", "abs(p_retailprice - m) <= s")),
    "consistency_median_quantile": (_counted("events", _C(field="value", expression="`value`.median() < `value` <= `value`.quantile(0.9)")), _sql("value", "events, (SELECT quantile_cont(value, 0.5) AS m, quantile_cont(value, 0.9) AS q FROM events)", "value > m AND value <= q")),
    "timeliness_static": (_counted("orders", R.TimelinessStaticRule(field="o_orderdate", start_date="1995-01-01", end_date="1996-12-31")), _sql("o_orderdate", "orders", "o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")),
    "timeliness_static_open_start": (_counted("orders", R.TimelinessStaticRule(field="o_orderdate", end_date="1996-12-31")), _sql("o_orderdate", "orders", "o_orderdate <= TIMESTAMP '1996-12-31'")),
    "timeliness_static_open_end": (_counted("orders", R.TimelinessStaticRule(field="o_orderdate", start_date="01/06/1995", dayfirst=True)), _sql("o_orderdate", "orders", "o_orderdate >= TIMESTAMP '1995-06-01'")),
    "timeliness_relative_date": (_counted("events", R.TimelinessRelativeRule(field="ts", reference_date=_DAY0, start_timedelta="0d", end_timedelta="7d")), _sql("ts", "events", f"ts BETWEEN TIMESTAMP '{_DAY0}' AND TIMESTAMP '{_DAY0}' + INTERVAL 7 DAY")),
    "timeliness_relative_column": (_counted(_shipped, R.TimelinessRelativeRule(field="l_shipdate", reference_column="o_orderdate", start_timedelta="0d", end_timedelta="121d")), _sql("l_shipdate", "lineitem JOIN orders ON l_orderkey = o_orderkey", "l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 121 DAY")),
    "timeliness_string_dates": (_counted(_texts, R.TimelinessStaticRule(field="day", start_date="1995-01-01", end_date="1996-12-31")), _sql("day", _TEXTS_SQL, "date_trunc('day', o_orderdate) BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'", "day <> 'soon'")),
    "flatten_struct": (_flat("about.o_orderstatus", shape=_totals("about_o_orderstatus")), _TOTAL_SQL.format("o_orderstatus", "orders")),
    "flatten_explode_all": (_flat("o_orderkey", "lines[*].l_partkey", shape=_totals("lines_all_l_partkey")), _TOTAL_SQL.format("l_partkey", _NESTED_SQL)),
    "flatten_first": (_flat("o_orderkey", "lines[].l_partkey", shape=_totals("lines_first_l_partkey")), _TOTAL_SQL.format("l_partkey", _FIRST_SQL)),
    "flatten_two_level": (
        lambda spark, sf_dir: _totals("customers_all_lines_all")(paths.flatten(_two_level(spark, sf_dir), ["c_nationkey", "customers[*].lines[*]"])),
        _TOTAL_SQL.format("o_orderkey", "customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey"),
    ),
    "flatten_sibling": (
        lambda spark, sf_dir: _totals("lines_all_l_linenumber")(paths.flatten(_nested(spark, sf_dir).withColumn("marks", F.array(F.lit(1), F.lit(2))), ["lines[*].l_linenumber", "marks[*]"])),
        _TOTAL_SQL.format("l_linenumber", _NESTED_SQL + " CROSS JOIN (SELECT 1 UNION ALL SELECT 2)"),
    ),
    "nested_completeness": (_counted(_nested, R.CompletenessRule(field="lines[*].l_shipdate")), _sql("lines[*].l_shipdate", _NESTED_SQL, "l_shipdate IS NOT NULL")),
    "nested_accuracy": (_counted(_nested, R.AccuracyRule(field="lines[*].l_returnflag", valid_values=["A", "N"])), _sql("lines[*].l_returnflag", _NESTED_SQL, "l_returnflag IN ('A', 'N')", "l_returnflag IS NOT NULL")),
    "nested_regex": (_counted(_nested, R.ValidityRegexRule(field="about.o_orderstatus", regex_pattern="[FO]$")), _sql("about.o_orderstatus", "orders", "o_orderstatus IN ('F', 'O')")),
    "nested_range": (_counted(_nested, R.ValidityNumericalRangeRule(field="lines[*].l_quantity", min_value=10, max_value=30)), _sql("lines[*].l_quantity", _NESTED_SQL, "l_quantity BETWEEN 10 AND 30", "l_quantity IS NOT NULL")),
    "nested_first": (_counted(_nested, R.ValidityNumericalRangeRule(field="lines[].l_quantity", min_value=10, max_value=30)), _sql("lines[].l_quantity", _FIRST_SQL, "l_quantity BETWEEN 10 AND 30", "l_quantity IS NOT NULL")),
    "nested_static": (_counted(_nested, R.TimelinessStaticRule(field="lines[*].l_shipdate", start_date="1996-01-01")), _sql("lines[*].l_shipdate", _NESTED_SQL, "l_shipdate >= TIMESTAMP '1996-01-01'", "l_shipdate IS NOT NULL")),
    "nested_relative": (_counted(_nested, R.TimelinessRelativeRule(field="lines[*].l_shipdate", reference_column="o_orderdate", end_timedelta="60d")), _sql("lines[*].l_shipdate", _NESTED_SQL, "l_shipdate <= o_orderdate + INTERVAL 60 DAY", "l_shipdate IS NOT NULL")),
    "nested_if_then": (_counted(_nested, _C(field="lines[*].l_quantity", expression={"if": "`about.o_orderstatus` == 'F'", "then": "`lines[*].l_quantity` > 20"})), _sql("lines[*].l_quantity", _NESTED_SQL, "l_quantity > 20", "o_orderstatus = 'F'")),
    "nested_uniqueness": (_counted(_nested, R.UniquenessRule(field="lines[*].l_partkey")), _unique_sql("lines[*].l_partkey", _NESTED_SQL, "l_partkey")),
    "array_elements": (_counted("embeddings", R.ValidityNumericalRangeRule(field="embedding[*]", min_value=0)), _sql("embedding[*]", "(SELECT unnest(embedding) AS e FROM embeddings)", "e >= 0")),
    "config_fused_report": (_counted("orders", *_REPORT_RULES), _REPORT_SQL),
}


def _two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with customers with their orders' keys."""
    orders = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("lines"))
    customer = _table(spark, sf_dir, "customer")
    joined = customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left")
    return joined.select("c_nationkey", F.array(F.struct("c_custkey", "lines")).alias("customers"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of each rule over orders, and rules on their nested lines, as result rows."""
    flat = counts_frame(_table(spark, sf_dir, "orders"), list(_REPORT_RULES))
    nested = counts_frame(_nested(spark, sf_dir), [R.CompletenessRule(field="lines[*].l_shipdate"), R.ValidityNumericalRangeRule(field="lines[*].l_quantity", min_value=10), R.CompletenessRule(field="about.o_orderstatus")])
    return flat.unionByName(nested)


def _every() -> dict[str, tuple[Query, str]]:
    from passrate.plans.report_queries import ALL

    return _ALL | ALL


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _every().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _every().items()}
