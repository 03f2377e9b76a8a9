"""Near copies against all pairs by exact similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from passrate.llm import similar
from tests.llm.conftest import odd_rows, table_of


def shingles(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def kept_by_hand(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, row in enumerate(rows):
        key = (row[0] is None, row[0] or 0, row[1] or "")
        least[find(i)] = min(least.get(find(i), (key, row)), (key, row), key=lambda x: x[0])
    return sorted((row for _, row in least.values()), key=str)


def rows_with_near_copies():
    """Originals of 120 words, and copies with one to four words changed: similarities from about 0.7 to 0.92."""
    rng = random.Random(4)
    rows = odd_rows() + [(None, "only here without an id"), (None, "nor has this one"), (None, "only here without an id")]
    for i in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows.append((1000 + 10 * i, " ".join(words)))
        for k in range(1, 5):
            other = list(words)
            for p in rng.sample(range(120), k):
                other[p] = "changed"
            rows.append((1000 + 10 * i + k, " ".join(other)))
    return rows


def test_stage_against_all_pairs(checkpoints, spark):
    rows = rows_with_near_copies()
    kept = corpus_pipeline.one_of_near_duplicates(spark, table_of(spark, rows), "")
    assert kept.columns == table_of(spark, []).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == kept_by_hand(rows)


def test_crowded_keys_are_dealt_to_pairs_of_parts(checkpoints, spark, monkeypatch):
    monkeypatch.setattr(similar, "CROWD", 3)
    monkeypatch.setattr(similar, "SALTS", 1)
    rows = rows_with_near_copies()
    base = [f"w{i}" for i in range(200)]
    rng = random.Random(2)
    for k in range(60):  # a chain of edits: neighbours link, the ends do not
        for _ in range(3):
            base[rng.randrange(200)] = f"new{k}"
        rows.append((5000 + k, " ".join(base)))
    got = similar.keep_one(table_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == kept_by_hand(rows)


def test_no_rows(checkpoints, spark):
    assert similar.keep_one(table_of(spark, [])).collect() == []
