"""Window dedup against a scan in document order, and the prefilter's promise."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from passrate.llm import blocks, substrings
from passrate.llm.common import window_hashes
from tests.llm.conftest import odd_rows, table_of


def brute(rows, width):
    first: dict[tuple, tuple] = {}
    order = lambda d: -(1 << 63) if d is None else d
    words = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in words:
        for j in range(len(w) - width + 1):
            key, at = tuple(w[j : j + width]), (order(d), j)
            first[key] = min(first.get(key, at), at)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < (order(d), j):
                gone[j : j + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("width", "n"), [(20, 1), (20, 17), (3, 5), (1, 4)])
def test_against_scan(spark, monkeypatch, width, n):
    monkeypatch.setattr(blocks, "n_blocks", lambda df: n)
    rows = odd_rows(3) + [(None, "a b c d e f a b c d"), (None, None), (100, "again " * 60), (100, "again " * 60)]
    assert got(substrings.repeated_windows(table_of(spark, rows).repartition(3), width)) == brute(rows, width)


def test_a_narrow_sketch_lets_more_through_but_changes_nothing(spark, monkeypatch):
    rows = odd_rows(4)
    monkeypatch.setattr(substrings, "CELL_BITS", 4)
    dedup = substrings.WindowDedup(5)
    monkeypatch.setattr(blocks, "n_blocks", lambda df: 1)
    assert dedup.width == 5
    assert got(substrings.repeated_windows(table_of(spark, rows).coalesce(1), 5)) == brute(rows, 5)


def test_long_words_and_chunks():
    data = np.frombuffer(b"aa bb  " + b"c" * 50 + b"\tdd aa", np.uint8)
    starts, ends, rows = substrings.words_of(data, np.array([0, 4, len(data)]))  # the second row starts inside "bb"
    assert [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [b"aa", b"b", b"b", b"c" * 50, b"dd", b"aa"]
    assert rows.tolist() == [0, 0, 1, 1, 1, 1]
    one = substrings.word_hashes(data, starts, ends)
    assert one[0][0] == one[0][5] and one[1][1] == one[1][2] and len(set(one[0].tolist())) == 4


def thue_morse(n: int) -> str:
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_and_windows_that_cancel_in_polynomial_hashes(spark, n):
    """A Thue-Morse word and its complement have the same polynomial hash modulo 2**64; as words, and as windows of one-letter words."""
    one = thue_morse(n)
    two = one.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {tail}"), (2, f"{two} {tail}"), (3, " ".join(one)), (4, " ".join(two))]
    assert got(substrings.repeated_windows(table_of(spark, rows[:2]))) == brute(rows[:2], 20)
    assert got(substrings.repeated_windows(table_of(spark, rows[2:]), n)) == brute(rows[2:], n)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 20, 64])
def test_window_hashes_tell_windows_apart(width):
    values = np.random.default_rng(1).integers(0, 3, 300).astype(np.uint64)
    hashes = window_hashes(values, width)
    windows = [tuple(values[i : i + width].tolist()) for i in range(len(values) - width + 1)]
    assert len(hashes) == len(windows) and len(set(zip(windows, hashes.tolist(), strict=True))) == len(set(windows)) == len(set(hashes.tolist()))


def test_packing_of_integers():
    values = np.sort(np.random.default_rng(0).integers(0, 1 << 62, 1000).astype(np.uint64))
    assert np.array_equal(substrings.unpack(substrings.pack(values)), values)
    assert len(substrings.unpack(substrings.pack(values[:0]))) == 0


def test_kept_text(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "x a b  c d y"), (3, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substrings.drop_repeated_windows(df, 3).collect()} == {1: "a b c d", 2: "x y", 3: ""}


def test_empty_table(spark):
    assert substrings.repeated_windows(table_of(spark, odd_rows()).where("doc_id < 0")).count() == 0
