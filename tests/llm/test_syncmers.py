"""Closed syncmers by definition; edited texts and neighbours by a plain loop."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from passrate.llm import syncmers
from passrate.llm.common import RollingHash, byte_codes, mix64
from tests.llm.conftest import odd_rows, prose, table_of


def test_anchors_by_definition():
    data = np.frombuffer(prose(random.Random(1), 200).encode(), np.uint8)
    small = mix64(RollingHash(byte_codes(3)[data], 9).all(syncmers.S))
    w = syncmers.K - syncmers.S + 1
    want = [i for i in range(len(data) - syncmers.K + 1) if min(small[i : i + w]) in (small[i], small[i + w - 1])]
    assert syncmers.anchors(data)[0].tolist() == want


def test_anchors_are_context_free():
    passage = np.frombuffer(prose(random.Random(2), 60).encode(), np.uint8)
    alone = syncmers.anchors(passage)
    inside = syncmers.anchors(np.concatenate([np.full(37, 65, np.uint8), passage, np.full(50, 66, np.uint8)]))
    here = (inside[0] >= 37) & (inside[0] <= 37 + len(passage) - syncmers.K)
    assert np.array_equal(inside[0][here] - 37, alone[0]) and np.array_equal(inside[1][here], alone[1])


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = prose(random.Random(3), 3000).encode()
    whole = syncmers.fingerprints([text])
    monkeypatch.setattr(syncmers, "CHUNK_BYTES", 700)
    assert np.array_equal(syncmers.fingerprints([b"x", text, b""])[1], whole[0])


def brute(rows):
    rows = [(d, t or "") for d, t in rows]
    out = []
    for (d, t), (_, nxt) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        a, b, c = (syncmers.fingerprints([x.encode()]) for x in (t, changed, nxt))
        out.append((d, len(t), hashlib.sha256(changed.encode()).hexdigest(), a.astype("<u2").tobytes().hex(), b.astype("<u2").tobytes().hex(), float(syncmers.likeness(a, b)[0]), float(syncmers.likeness(a, c)[0])))
    return out


@pytest.mark.parametrize("parts", ["1", "5"])
def test_rows(checkpoints, spark, parts):
    rows = sorted(odd_rows(), key=lambda r: r[0])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((tuple(r) for r in syncmers.edit_likeness(table_of(spark, random.Random(1).sample(rows, len(rows)))).collect()), key=lambda r: r[0])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(rows)


def test_one_row_no_rows_and_repeats(checkpoints, spark):
    def run(rows):
        return syncmers.edit_likeness(table_of(spark, rows)).collect()

    (one,) = run([(1, "abcdef")])
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0
    assert run([]) == []
    assert sorted((r["doc_id"], r["near_next"]) for r in run([(1, "same text"), (1, "same text"), (None, None)]) if r["doc_id"])[0] == (1, 0.0)


def test_chains_are_by_position():
    """A text whose halves are swapped shares its anchors but not their order; the longest chain against all subsets by brute force."""
    rng = random.Random(5)
    text = "".join(chr(rng.randrange(97, 123)) for _ in range(4000)).encode()
    one, two, three = syncmers.fingerprints([text, text[2000:] + text[:2000], text[:2000] + b"inserted here" * 20 + text[2000:]])
    like = lambda x, y: float(syncmers.likeness(x[None], y[None])[0])
    assert like(one, one) == 1.0 and like(one, three) > 0.85 and 0.35 < like(one, two) < 0.7
    for x, y in ((one, two), (one, three)):
        pairs = sorted((int(a[1]), int(b[1])) for a, b in zip(x, y, strict=True) if a[0] == b[0] and a[0])
        chain = [1] * len(pairs)
        for i in range(len(pairs)):
            chain[i] += max((chain[j] for j in range(i) if pairs[j][1] <= pairs[i][1]), default=0)
        assert like(x, y) == max(chain) / int(((x[:, 0] != 0) | (y[:, 0] != 0)).sum())


def test_places_are_the_anchors_own():
    text = prose(random.Random(6), 300).encode()
    at, h = syncmers.anchors(np.frombuffer(text, np.uint8))
    (got,) = syncmers.fingerprints([text])
    for k in range(syncmers.BINS):
        mine = [(int(x), int(p)) for x, p in zip(h, at, strict=True) if (int(x) >> 40) % syncmers.BINS == k]
        assert got[k, 1] == (min(mine)[1] // syncmers.PLACE_BYTES + 1 if mine else 0)


def test_likeness_separates_halves_from_strangers():
    rng = random.Random(8)
    texts = ["".join(chr(rng.randrange(97, 123)) if rng.random() > 0.15 else " " for _ in range(3000)) for _ in range(12)]
    prints = syncmers.fingerprints([t.encode() for t in texts])
    half = syncmers.fingerprints([syncmers.edited(a, b).encode() for a, b in zip(texts, texts[1:] + texts[:1], strict=True)])
    assert syncmers.likeness(prints, half).min() > 0.15 > 0.1 > syncmers.likeness(prints, np.roll(prints, 1, axis=0)).max()
