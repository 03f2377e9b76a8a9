"""Small tables with nulls, blanks, repeats and very long texts."""

from __future__ import annotations

import random

import pytest

WORDS = "red blue green stone river cloud silver garden window market écoute straße naïve tree light dark over under".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(1000)) if rng.random() < 0.3 else "") for _ in range(n))


def odd_rows(seed: int = 1) -> list[tuple]:
    """doc_id, text and clashing columns: near copies, shared passages, nulls, blanks, repeats, a long text."""
    rng = random.Random(seed)
    shared = [prose(rng, 60) for _ in range(3)]
    rows: list[tuple] = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(5, 80))]
        if i % 3 == 0:
            parts.append(shared[i % 2])
        if i % 5 == 0:
            parts.append(shared[2][: 40 + 5 * i])
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    base = prose(rng, 120)
    rows += [(100 + k, base) for k in range(4)]
    words = base.split()
    for k in range(12):
        edited = list(words)
        edited[rng.randrange(len(words))] = f"edit{k}"
        rows.append((200 + k, " ".join(edited)))
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (304, "one"), (305, "x" * 450), (306, "ab" * 300), (307, "漢字" * 90 + "é"), (308, "tail " + base[-260:]), (309, base[:230])]
    rows += [(310, prose(rng, 9000)), (311, "y" * 199), (312, "y" * 200), (313, "y" * 201)]
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, block int, bucket string, n_bytes string, fp int, row string, tie string"


def table_of(spark, rows):
    return spark.createDataFrame([(d, t, 1, "b", "n", 2, "r", "t") for d, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def checkpoints(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ck")))
    return spark
