"""Near copies by SimHash among texts with a common min-hash key, each link checked by exact shingle similarity.

A text is the set of its hashed word runs (two texts without words are equal),
and texts with equal sets are one node.  Two nodes link when the Jaccard
similarity of their sets reaches the threshold.  Candidates share all `ROWS`
min-hashes of at least one of `BANDS` bands: at similarity 0.8 all but 7 in
100,000 pairs do, and fewer are missed above it.  Of these, a pair is a candidate when
the SimHash fingerprints of its sets differ in at most RADIUS bits; at
similarity 0.8 they differ in 9.6 on average.  Every candidate is checked on
the whole sets.

In a first round the nodes of a band key are compared with a centre only, a
key's nodes being dealt to `SALTS` centres that are compared with one centre in
turn, so a group of copies costs as many comparisons as it has nodes.  Where a
key's nodes are not all in one component then, they meet in a second round, 64
at a time as bit planes (`simhash.close_pairs`), with their sets.  A pair within
the radius is checked there while its components are not joined, so what leaves
is a forest of links, never a group's pairs.  A crowded key is dealt to pairs of
its parts; what is known of a key goes to its nodes by the shares of its salts.
No candidate is left out but those whose components are joined already.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import U64, by_batch, mix64, stored, utf8
from passrate.llm.simhash import close_pairs, components, grouped_rows, majority, one_a_component, row_keys, shingle_hashes

BANDS, ROWS, SALTS = 24, 5, 64
RADIUS = 24
#: Nodes, and shingle hashes, of one part of a crowded key; two parts meet in a task.
CROWD, MOST_HASHES = 1 << 15, 1 << 23
_FACTORS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U64(2) + U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    return [np.unique(np.array(shingle_hashes(data[a:b].tobytes(), words), U64)) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row of `BANDS` keys a set, none of which may be empty."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), BANDS), U64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) >> 16, prepend=0, append=-1)) if len(sets) else []
    begin = 0
    for stop in [*(int(c) for c in cuts if c), len(sets)]:
        if stop <= begin:
            continue
        hashes = np.concatenate(sets[begin:stop])
        starts = np.cumsum(sizes[begin:stop]) - sizes[begin:stop]
        for band in range(BANDS):
            key = np.full(stop - begin, band, U64)
            for f in _FACTORS[band * ROWS : (band + 1) * ROWS]:
                key = mix64(key ^ np.minimum.reduceat(hashes * f, starts))
            out[begin:stop, band] = key
        begin = stop
    return out


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted distinct arrays; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    either = len(x) + len(y) - both
    return both / either if either else 1.0


def _described(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, k1, k2, node (of the shingle set), size, SimHash and band keys of every row."""

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(*utf8(batch.column("text")), words)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [[]] * len(sets)
        for i, row in zip(some, band_keys([sets[i] for i in some]).view(np.int64).tolist(), strict=True):
            keys[i] = row
        node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], U64).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("k1"), batch.column("k2"), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(majority(sets).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "k1", "k2", "node", "size", "fp", "keys"],
        )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row_keys()).mapInArrow(by_batch(run), "doc_id long, k1 long, k2 long, node long, size long, fp long, keys array<long>")


def _sets_of(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """node and its sorted shingle hashes as bytes; `chosen` has node and the k1, k2 of one of its rows."""

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(*utf8(batch.column("text")), words)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "hashes"])

    rows = docs.select("text", *row_keys()).join(chosen, ["k1", "k2"]).select("node", "text")
    return rows.mapInArrow(by_batch(run), "node long, hashes binary").dropDuplicates(["node"])


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""

    def run(batch: pa.RecordBatch):
        good = [similarity(np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)) >= threshold for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
        yield batch.filter(pa.array(good)).select(["a", "b"])

    one = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    both = one.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(by_batch(run), "a long, b long")


def _alike(threshold: float):
    """Whether two sizes allow the threshold, and the fingerprints are within the radius."""
    return (F.least("m", "n") >= F.greatest("m", "n") * F.lit(threshold - 1e-9)) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("its_fp"))) <= RADIUS)


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _close(rows: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) of nodes with a common key, enough to join the roots that have one; `rows` has key, node, n, fp, root, parts."""
    dealt = rows.withColumn("part", F.pmod(F.hash("node"), F.col("parts")))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(j, F.col("part")).alias("i"), F.greatest(j, F.col("part")).alias("j")))
    dealt = dealt.select("key", F.explode(meets).alias("meet"), "node", "n", "fp", "root").select("key", "meet.i", "meet.j", "node", "n", "fp", "root").join(sets, "node")

    def work(rows: pa.Table, ends: np.ndarray):
        node, n, fp, root = (rows.column(c).to_numpy() for c in ("node", "n", "fp", "root"))
        hashes = rows.column("hashes").combine_chunks()
        joined = _Joined(np.unique(root, return_inverse=True)[1])
        for a, b in close_pairs(fp.view(U64), ends, RADIUS, slices=1 << 14):
            good = np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * (threshold - 1e-9)
            found = joined.links(a[good], b[good], lambda x, y: similarity(np.frombuffer(hashes[x].as_py(), U64), np.frombuffer(hashes[y].as_py(), U64)) >= threshold)
            if found:
                x, y = (node[np.array(k)] for k in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(grouped_rows(("key", "i", "j"), work, at_once=1 << 14), "a long, b long").distinct()


class _Joined:
    """What is joined so far of a task's components: a pair is checked only while its two are not."""

    def __init__(self, component: np.ndarray):
        self.component = component
        self.top = np.arange(int(component.max()) + 1)

    def links(self, a: np.ndarray, b: np.ndarray, linked) -> list[tuple[int, int]]:
        """The pairs that link, of those that join two components; of each two 1 pair is checked, then 2, 4 and so on."""
        out, take, k = [], 1, len(self.top)
        while True:
            while (self.top[self.top] != self.top).any():
                self.top = self.top[self.top]
            x, y = self.top[self.component[a]], self.top[self.component[b]]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                return out
            a, b, code = a[apart], b[apart], np.minimum(x, y)[apart] * k + np.maximum(x, y)[apart]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
            chosen = order[rank < take]
            for p in chosen.tolist():
                i, j = int(a[p]), int(b[p])
                x, y = self._find(self.component[i]), self._find(self.component[j])
                if x != y and linked(i, j):
                    self.top[max(x, y)] = min(x, y)
                    out.append((i, j))
            left = np.ones(len(a), bool)
            left[chosen] = False
            a, b, take = a[left], b[left], 2 * take

    def _find(self, x: int) -> int:
        while self.top[x] != x:
            x = self.top[x]
        return int(x)


def linked(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, k1, k2, root (equal in a component) and component_id (its smallest doc_id) per row."""
    rows = stored(_described(docs, words))
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("size").alias("n"), F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min(F.struct("k1", "k2")).alias("k"))
    keyed = nodes.select("node", "n", "fp", F.explode("keys").alias("key")).withColumn("salt", F.pmod("node", F.lit(SALTS)))
    member = F.struct("node", "n", "fp")
    near = keyed.groupBy("key", "salt").agg(F.min(member).alias("near"), F.count(F.lit(1)).alias("many"))
    far = near.groupBy("key").agg(F.min("near").alias("far"), F.sum("many").alias("all")).where(F.col("all") > 1)
    centres = stored(near.join(far, "key"))  # of the keys that nodes share
    keyed = stored(keyed.join(centres.select("key", "salt", "near"), ["key", "salt"]))
    stars = keyed.select("node", F.col("near.node").alias("other"), "n", F.col("near.n").alias("m"), "fp", F.col("near.fp").alias("its_fp"))
    stars = stars.unionByName(centres.select(F.col("near.node").alias("node"), F.col("far.node").alias("other"), F.col("near.n").alias("n"), F.col("far.n").alias("m"), F.col("near.fp").alias("fp"), F.col("far.fp").alias("its_fp")))
    stars = stored(stars.where(F.col("node") != F.col("other")).where(_alike(threshold)).select(*_pair("node", "other")).distinct())
    shared = keyed.select("node").distinct().join(nodes.select("node", "k.k1", "k.k2"), "node")
    sets = stored(_sets_of(docs, shared, words))
    edges = stored(_checked(stars, sets, threshold))
    roots = components(edges)

    known = keyed.join(roots, "node", "left").select("key", "salt", "node", "n", "fp", F.coalesce("root", "node").alias("root"))
    shares = known.groupBy("key", "salt").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("many"), F.sum("n").alias("hashes"))
    whole = shares.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("many").alias("many"), F.sum("hashes").alias("hashes")).where("low <> high")
    parts = whole.select("key", F.ceil(F.greatest(F.col("many") / F.lit(CROWD), F.col("hashes") / F.lit(MOST_HASHES))).cast("int").alias("parts"))
    open_ = stored(known.join(shares.select("key", "salt").join(parts, "key"), ["key", "salt"]).drop("salt"))
    more = stored(_close(open_, sets, threshold))
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    joined = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.join(named, "node").select("doc_id", "k1", "k2", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """`docs` in all its columns: of each component the row with the smallest doc_id, as in `simhash.keep_one`."""
    return one_a_component(docs, linked(docs, words, threshold))
