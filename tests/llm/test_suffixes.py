"""Suffix-array dedup against a count of all windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from passrate.llm import blocks, suffixes
from tests.llm.conftest import odd_rows, table_of


def brute(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(bool(g) and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("length", "params", "block_bytes"), [(200, {}, 8 << 20), (200, {}, 3000), (200, {"hot": 1}, 3000), (40, {"gram": 12, "hot": 3}, 2000), (30, {"gram": 29}, 4000), (24, {"gram": 4, "hot": 2}, 1 << 20)])
def test_against_all_windows(spark, monkeypatch, length, params, block_bytes):
    monkeypatch.setattr(blocks, "n_blocks", lambda df: max(1, 60000 // block_bytes))
    rows = odd_rows()
    assert got(suffixes.repeated_bytes(table_of(spark, rows).repartition(3), length, **params)) == brute(rows, length)


@pytest.mark.parametrize("seed", range(4))
def test_few_letters(spark, monkeypatch, seed):
    """Texts of two letters: every gram repeats, in many contexts, within and across texts."""
    monkeypatch.setattr(blocks, "n_blocks", lambda df: 3)
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    for params in ({"gram": 5}, {"gram": 5, "hot": 2}):
        assert got(suffixes.repeated_bytes(table_of(spark, rows), 16, **params)) == brute(rows, 16)


def test_long_texts_are_cut_into_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK_BYTES", 500)
    rows = odd_rows(2)
    block = type("B", (), {})()
    raw = "".join(t or "" for _, t in rows).encode()
    block.data, block.offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
    anchors = suffixes.Anchors(block, 200, 56)
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(anchors.low, anchors.high, strict=True)])
    assert np.array_equal(np.sort(windows), np.arange(len(raw) - 199))


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "z" * 30 + "abc" * 80), (None, "z" * 30 + "abc" * 80), (5, "q" * 500), (5, "q" * 500), (6, None)]
    assert got(suffixes.repeated_bytes(table_of(spark, rows))) == brute(rows, 200)


def test_empty_table(spark):
    assert suffixes.repeated_bytes(table_of(spark, odd_rows()).where("doc_id < 0")).count() == 0


def test_kept_text_has_whole_characters(spark):
    a, b = "é" * 150, "x" + "é" * 150
    df = spark.createDataFrame([(1, "ü" + a + "!", "u"), (2, b, None), (3, None, "w")], "doc_id long, text string, carried string")
    out = {r["doc_id"]: r for r in suffixes.drop_repeated_bytes(df).collect()}
    assert (out[1]["text"], out[2]["text"], out[3]["text"], out[1]["carried"]) == ("ü!", "x", None, "u")
    assert suffixes.drop_repeated_bytes(df).columns == df.columns


@pytest.mark.parametrize("seed", range(5))
def test_merge_of_runs(seed):
    rng = random.Random(seed)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 40))) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9))]
    coded = [(r, suffixes.neighbour_lcp(r, 64).tolist() if r else []) for r in runs]
    order, lcp = suffixes.merge_runs(coded)
    merged = [runs[r][i] for r, i in order]
    assert merged == sorted(s for r in runs for s in r)
    expected = [0] + [next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) for a, b in zip(merged[:-1], merged[1:], strict=True)]
    assert lcp == expected[: len(lcp)]


def test_known_prefixes_are_not_compared_again():
    """Strings with long shared beginnings: each byte of a shared beginning is looked at about once a string."""

    class Seen(bytes):
        looked = 0

        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop is not None:
                Seen.looked += max(0, min(key.stop, len(self)) - (key.start or 0))
            return bytes.__getitem__(self, key)

    strings = [b"p" * 1000 + bytes([65 + i // 26, 65 + i % 26]) for i in range(200)]
    runs = [[Seen(s) for s in strings[k::8]] for k in range(8)]
    suffixes.merge_runs([(r, [0] + [1001 if a[1000] == b[1000] else 1000 for a, b in zip(r[:-1], r[1:], strict=True)]) for r in runs])
    assert Seen.looked < 8 * 3000 + 200 * 60
