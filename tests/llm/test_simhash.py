"""SimHash: fingerprints by definition, links by all pairs, components on hard graphs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from passrate.llm import simhash
from tests.llm.conftest import odd_rows, table_of


def fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values: list[int], radius: int) -> list[int]:
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def expected(rows, radius=2):
    prints = [fingerprint(t) for _, t in rows]
    groups: dict[int, list] = {}
    roots = components(prints, radius)
    for r, (d, _) in zip(roots, rows, strict=True):
        groups.setdefault(r, []).append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return sorted(((d, f"{p:016x}", least[r]) for (d, _), p, r in zip(rows, prints, roots, strict=True)), key=str)


def test_against_all_pairs(checkpoints, spark):
    rows = odd_rows() + [(None, "one"), (None, None), (None, "alone in the world"), (100, "Repeat id"), (100, "Repeat id")]
    got = sorted((tuple(r) for r in simhash.near_duplicates(table_of(spark, rows)).collect()), key=str)
    assert got == expected(rows)


def test_upper_case_letters_only_are_lowered():
    assert simhash.shingle_hashes("É A\xa0b C".encode(), 3) == [xxhash.xxh64_intdigest("É a\xa0b c".encode(), 42)]


@pytest.mark.parametrize(("radius", "crowd"), [(1, 1), (1, 5), (2, 5), (2, 4096), (3, 4096)])
def test_links_of_crowded_fingerprints(checkpoints, spark, crowd, radius):
    """Clusters a few bits wide, so that keys are shared by many: split keys lose no link.  A crowd of 1 splits to the last bit."""
    rng = random.Random(radius)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(25):
            v = centre
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = simhash.link_edges(nodes, radius, crowd)
    for a, b in edges.collect():
        assert a != b
    found = {r["node"] & (1 << 64) - 1: r["root"] for r in simhash.components(edges).collect()}
    want = components(values, radius)
    for i in range(len(values)):
        for j in range(i):
            a, b = values[i], values[j]
            assert (want[i] == want[j]) == (found.get(a, a) == found.get(b, b) if a in found or b in found else False)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 200])
def test_bit_sliced_pairs(n):
    rng = np.random.default_rng(n)
    values = np.concatenate([rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, 1, dtype=np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))])
    ends = np.full(len(values), len(values))
    ends[: n // 2] = n // 2
    got = {(int(a), int(b)) for q, c in simhash.close_pairs(values, ends, 2) for a, b in zip(q, c, strict=True)}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, int(ends[i])) if int(values[i] ^ values[j]).bit_count() <= 2}
    assert got == want


@pytest.mark.parametrize("shape", ["path", "star", "cycle", "random"])
def test_components(checkpoints, spark, shape):
    rng = random.Random(7)
    n = 120
    names = rng.sample(range(10_000), n)
    pairs = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "cycle": [(i, (i + 1) % n) for i in range(n)], "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)]}[shape]
    edges = spark.createDataFrame([(names[a], names[b]) for a, b in pairs], "a long, b long")
    parent = {v: v for v in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(names[a]), find(names[b])
        parent[max(x, y)] = min(x, y)
    touched = {names[v] for p in pairs if p[0] != p[1] for v in p}
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {v: find(v) for v in touched}


def test_empty_table_and_keeping_one(checkpoints, spark):
    df = table_of(spark, odd_rows())
    assert simhash.near_duplicates(df.where("doc_id < 0")).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in expected(odd_rows())})


def test_keeping_one_is_by_component(checkpoints, spark):
    """Rows without a doc_id, or with one that repeats, stay once in each component they alone make up."""
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(50)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, ""), (1, None), (None, texts[2]), (2, texts[2]), (3, texts[3]), (3, texts[4]), (4, texts[4]), (None, texts[5])]
    kept = [(r["doc_id"], r["text"]) for r in simhash.keep_one(table_of(spark, rows)).collect()]
    want = [(None, texts[0]), (None, texts[1]), (None, texts[5]), (1, None), (2, texts[2]), (3, texts[3]), (3, texts[4])]
    assert sorted(kept, key=str) == sorted(want, key=str)
