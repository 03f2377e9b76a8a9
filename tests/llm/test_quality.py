"""The compression classifier: held-out accuracy, folds, and tables too small to learn from."""

from __future__ import annotations

import random
import zlib

import pytest

from passrate.llm import quality
from tests.llm.conftest import odd_rows, prose, table_of


def labelled(n: int = 240):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        junk = " ".join(rng.choice(["CLICK", "buy!!!", "$$$", "free", "win", ">>>", "www", "now"]) + str(rng.randrange(10)) for _ in range(60))
        rows.append((i, prose(rng, 70) if good else junk))
        labels.append((i, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = labelled()
    extra = [(1000, None), (1001, ""), (None, "no id"), (1002, "word " * 30_000), (5, rows[5][1])]
    truth = {d: q for d, q, _ in labels}
    table = spark.createDataFrame([*labels, (None, 1, 0), (7, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return quality.quality_scores(table_of(spark, rows + extra), table, dictionary_bytes=2048).collect(), truth, len(rows) + len(extra)


def test_held_out_accuracy(scored):
    rows, truth, n = scored
    assert len(rows) == n
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum((s >= 0.3) == bool(t) for s, t in held) >= 0.97 * len(held)


def test_folds_and_scores(scored):
    for r in scored[0]:
        text = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    same = [r["score"] for r in scored[0] if r["doc_id"] == 5]
    assert len(same) == 2 and same[0] == same[1]


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = labelled(120)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    models = [quality.fit(table_of(spark, rows), spark.createDataFrame(x, schema), dictionary_bytes=1024) for x in (labels, flipped)]
    assert models[0] == models[1] and models[0].weights


def test_too_few_labels_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    docs = table_of(spark, odd_rows())
    model = quality.fit(docs, labels)
    assert model.weights == [] and model.prior in (0.0, 0.5, 1.0)
    kept = quality.keep_good(docs, labels.where("doc_id < 0"))  # nothing is known: all stay
    assert kept.columns == docs.columns and kept.count() == len(odd_rows())
    assert quality.quality_scores(docs.where("doc_id < 0"), labels).count() == 0
