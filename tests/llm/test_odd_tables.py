"""Tables that hold the operators' own column names, other id types, and many repeated rows without an id."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passrate.llm import blocks, media, packing, pieces, pii, quality, similar, simhash, substrings, suffixes, syncmers, tokens
from tests.llm.conftest import odd_rows

INTERNAL = "score score_ _quality_score key salt told _key _base _terms _d _k text_key t n e c words entities base k1 k2 node fp root row rank keys size block carried row_key tie curve part role following bucket kind data quality held_out".split()


@pytest.fixture(scope="module")
def clashing(checkpoints, spark):
    rows = [(d, t) for d, t in odd_rows()[:30]] + [(900, "write to quill@site.org now"), (None, None), (900, "write to quill@site.org now")]
    return spark.createDataFrame([(d, t, *["x"] * len(INTERNAL)) for d, t in rows], "doc_id int, text string, " + ", ".join(f"`{c}` string" for c in INTERNAL))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(50)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("stage", ["keep_good", "sanitise", "drop_repeated_bytes", "simhash", "similar"])
def test_stages_keep_clashing_columns(clashing, labels, stage):
    run = {"keep_good": lambda d: quality.keep_good(d, labels, threshold=0.0), "sanitise": pii.sanitise, "drop_repeated_bytes": suffixes.drop_repeated_bytes, "simhash": simhash.keep_one, "similar": similar.keep_one}[stage]
    got = run(clashing)
    assert got.columns == clashing.columns and [f.dataType for f in got.schema] == [f.dataType for f in clashing.schema]
    rows = got.collect()
    assert rows and all(r[c] == "x" for r in rows for c in INTERNAL)
    if stage in ("keep_good", "sanitise", "drop_repeated_bytes"):
        assert len(rows) == 33
    if stage == "sanitise":
        assert [r["text"] for r in rows if r["doc_id"] == 900] == ["write to <EMAIL> now"] * 2


@pytest.mark.parametrize("query", [suffixes.repeated_bytes, simhash.near_duplicates, pii.pii_spans, substrings.repeated_windows, syncmers.edit_likeness, media.stored_texts, packing.packed, pieces.encoded, tokens.token_counts])
def test_queries_take_integer_ids_and_clashing_columns(clashing, query):
    got = query(clashing)
    assert dict(got.dtypes)["doc_id"] == "bigint"
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == {r["doc_id"] for r in clashing.select("doc_id").collect()}


def test_scores_take_integer_ids_and_clashing_columns(clashing, labels):
    assert quality.quality_scores(clashing, labels).count() == 33


def test_images_are_described_beside_columns_of_the_same_names(spark):
    image = media.encode([bytes(576)])[0]
    df = spark.createDataFrame([(bytearray(image), 1, 2, 3, 4, 5, "y")], "media binary, width int, height int, Thumbnail int, thumbnail_hash int, error int, error_ string")
    got = media.describe(df)
    assert got.columns == [*df.columns, "width_", "height_", "thumbnail_", "thumbnail_hash_", "error__"]
    (row,) = got.collect()
    assert row["width_"] * row["height_"] >= 576 and row["error__"] is None and row["width"] == 1


def test_repeated_rows_without_an_id_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(blocks, "n_blocks", lambda df: 8)
    df = spark.createDataFrame([(None, "same words again " * 20)] * 400, "doc_id long, text string").repartition(4)
    def finish(block, answers, n):
        return pa.table({"rows": pa.array([block.table.num_rows], pa.int64())})

    sizes = [r["rows"] for r in blocks.exchange(df, lambda b, n: [(0, b.number, 1, b"")], lambda t: [], lambda b, a, n: [], lambda t: [], finish, "rows long").collect()]
    assert sum(sizes) == 400 and len(sizes) == 8 and max(sizes) < 100
    placed = packing.along_curve(df, partition_bytes=4000).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(placed) >= 4 and max(r["count"] for r in placed) < 200


def test_a_cluster_needs_a_shared_folder():
    from passrate.llm.common import ensure_checkpoint_dir

    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(type("Session", (), {"sparkContext": Context})())
