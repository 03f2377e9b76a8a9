"""Packing: every token once and in place, gapless sequences, neighbours on the curve."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from passrate.llm import packing
from tests.llm.conftest import odd_rows, prose, table_of

tokenizers = pytest.importorskip("tokenizers")


def test_hilbert_curve_visits_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    place = packing.hilbert(points, 3)
    assert sorted(place.tolist()) == list(range(side**3))
    path = points[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_vectors_of_long_texts_are_whole(monkeypatch):
    rng = random.Random(1)
    texts = [prose(rng, 500).encode(), b"", b"abc", prose(rng, 30).encode()]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = [packing.vectors(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    monkeypatch.setattr(packing, "CHUNK_BYTES", 300)
    monkeypatch.setattr(packing, "spans_of_rows", lambda o: ((i, i + 1) for i in range(len(o) - 1)))
    assert np.allclose(packing.vectors(data, offsets), whole)


@pytest.mark.parametrize(("parts", "length"), [("3", 1024), ("2", 16)])
def test_rows(spark, parts, length):
    rows = odd_rows() + [(900, "words <|endoftext|> here")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = packing.packed(table_of(spark, rows), length=length, keep_ids=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    library = tokenizers.Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
    for d, t in rows:
        want = library.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted(by_doc.pop(d), key=lambda r: r["start"])
        assert [i for r in mine for i in r["ids"]] == want and {r["doc_tokens"] for r in mine} == {len(want)}
        assert [r["start"] for r in mine] == np.cumsum([0] + [r["length"] for r in mine])[:-1].tolist()
    assert not by_doc
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        size = sum(r["length"] for r in pieces)
        assert size <= length and size & (size - 1) == 0
        assert [r["offset"] for r in pieces] == np.cumsum([0] + [r["length"] for r in pieces])[:-1].tolist()


def test_nulls_repeats_and_no_rows(spark):
    got = packing.packed(table_of(spark, [(None, None), (None, "null id"), (4, "same"), (4, "same"), (5, "")])).collect()
    assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] == 5) == 1
    assert sorted(r["doc_tokens"] for r in got if r["doc_id"] == 4 and r["start"] == 0) == [2, 2]
    assert packing.packed(table_of(spark, [])).count() == 0
