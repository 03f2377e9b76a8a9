"""The operators' queries over the driver's tables: each on its whole table, whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from passrate.llm import media, packing, pieces, pii, quality, simhash, substrings, suffixes, syncmers, tokens
from passrate.llm.common import table


def op1_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op4_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_windows(table(spark, sf_dir, "documents"))


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edit_likeness(table(spark, sf_dir, "documents"))


def op6_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_texts(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name.startswith("op") and name[2].isdigit()}


#: A piece holds its windows whole, so that each is cut out of a short string.
_OP1_SQL = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2 * 711) AS piece FROM (SELECT doc_id, h, unnest(range(0, greatest(1, length(h) // 2), 512)) AS p FROM texts)),
windows AS (SELECT doc_id, p + k AS p, md5(substr(piece, 2 * k + 1, 400)) AS w FROM (SELECT doc_id, p, piece, unnest(range(0, least(512, length(piece) // 2 - 199))) AS k FROM pieces)),
repeated AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY w) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM repeated),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs UNION ALL SELECT doc_id, NULL, NULL, max(b) FROM runs GROUP BY doc_id),
parts AS (SELECT g.doc_id, g.before, g.b - g.a AS gone, substr(t.h, 2 * g.before + 1, 2 * (coalesce(g.a, length(t.h) // 2) - g.before)) AS part FROM gaps g JOIN texts t USING (doc_id)),
cut AS (SELECT doc_id, sum(gone) AS n_removed, count(gone) AS n_spans, string_agg(part, '' ORDER BY before) AS kept FROM parts GROUP BY doc_id)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(c.n_removed, 0)::BIGINT AS n_removed, coalesce(c.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(c.kept, t.h))) AS kept_sha256
FROM texts t LEFT JOIN cut c USING (doc_id)
"""

_OP4_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, j, array_to_string(w[j:j + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS j FROM texts WHERE len(w) >= 20)),
later AS (SELECT doc_id, j FROM windows QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, j) > 1),
gone AS (SELECT DISTINCT doc_id, j + k AS i FROM later, (SELECT unnest(range(20)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """The other results hold hashes, models or tokens that SQL has not; tests/llm holds their brute-force versions."""
    return {"op1_repeated_bytes": _OP1_SQL, "op4_repeated_windows": _OP4_SQL}
