"""SimHash near-duplicates: bit-sliced comparison of fingerprints, and connected components.

Fingerprints are made per text, and equal ones become one node.  Two nodes
within `radius` differing bits agree on at least one of the ways to leave
`radius` of `radius + 2` bands out, so each node is keyed once per way by the
other bands and only nodes with a common key are compared.  A key held by more
than `crowd` nodes is split by the same argument over the bits it leaves free,
until no crowd is left or no more than `radius` bits are free, which at most
2**radius nodes can share; no pair is lost.

Within a key, 64 nodes at a time are held as 64 vertical bit planes.  A query
adds its difference from each plane, for all 64 at once, to bitwise counters
with carry-save adders, and leaves the block as soon as every lane has passed
the radius.  Linked nodes of one task leave it as a forest, not as pairs;
components are then found by alternating large-star and small-star rounds,
whose lineage is cut in the shared checkpoint folder.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import U64, by_batch, checkpointed, give_back, spans_of_rows, stored, utf8

SEED = 42


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of `words` space-joined words (fewer: of the whole sequence; none: nothing)."""
    found = text.lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(found) - words] + 1))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)]


def majority(hashes: list) -> np.ndarray:
    """One fingerprint a list of hashes: a bit is 1 if it is set in over half of them; without hashes all are 0."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), U64)
    some = np.flatnonzero(sizes)
    begin = 0
    while begin < len(some):  # some 2**17 hashes at a time; a longer list alone, piece by piece
        stop = begin + max(1, int(np.searchsorted(np.cumsum(sizes[some[begin:]]), 1 << 17, side="right")))
        rows = some[begin:stop]
        flat = np.concatenate([np.asarray(hashes[r], U64) for r in rows.tolist()])
        if len(rows) == 1:
            ones = sum(_bits(flat[i : i + (1 << 17)]).sum(axis=0, dtype=np.int64) for i in range(0, len(flat), 1 << 17))[None]
        else:
            ones = np.add.reduceat(_bits(flat), np.cumsum(sizes[rows]) - sizes[rows], axis=0, dtype=np.int32)
        out[rows] = np.packbits(2 * ones > sizes[rows][:, None], axis=1, bitorder="little").view(U64).ravel()
        begin = stop
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprints(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """The fingerprint of every row's shingles, repeats included."""
    out = np.zeros(len(offsets) - 1, U64)
    for a, b in spans_of_rows(offsets):
        out[a:b] = majority([shingle_hashes(data[x:y].tobytes(), words) for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)])
    return out


def with_fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fingerprint (a long with the 64 bits) of every row, with the further columns (longs) of `docs`."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batch: pa.RecordBatch):
        got = fingerprints(*utf8(batch.column("text")), words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got.view(np.int64)), *map(batch.column, more)], ["doc_id", "fp", *more])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more).mapInArrow(by_batch(run), ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def close_pairs(values: np.ndarray, ends: np.ndarray, radius: int, width: int = 64, slices: int = 1 << 18):
    """Index pairs i < j < ends[i] of values within `radius` bits, by bit-sliced blocks of 64.

    Yields arrays of pairs; `slices` bounds the queries times blocks at a time.
    """
    n = len(values)
    blocks = -(-n // 64)
    padded = np.zeros(blocks * 64, U64)
    padded[:n] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(blocks, 64, 8), axis=2, bitorder="little")  # block, lane, bit
    planes = np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(U64).reshape(width, blocks)
    query = np.flatnonzero(ends > np.arange(n) + 1)
    first, last = (query + 1) // 64, (ends[query] - 1) // 64
    counts = last - first + 1
    full = ~U64(0)
    cut = np.searchsorted(np.cumsum(counts), np.arange(slices, counts.sum() + slices, slices)) if len(query) else []
    begin = 0
    for stop in (min(int(c) + 1, len(query)) for c in cut):
        if stop <= begin:
            continue
        q = np.repeat(query[begin:stop], counts[begin:stop])
        b = np.arange(len(q)) - np.repeat(np.cumsum(counts[begin:stop]) - counts[begin:stop], counts[begin:stop]) + np.repeat(first[begin:stop], counts[begin:stop])
        low = np.clip(q + 1 - 64 * b, 0, 64)
        high = np.clip(ends[q] - 64 * b, 0, 64)
        lanes = _below(high) & ~_below(low)
        counters = [np.zeros(len(q), U64) for _ in range(max(1, (radius + 1).bit_length()))]
        over = ~lanes
        value = values[q]
        for bit in range(width):
            carry = planes[bit, b] ^ (U64(0) - (value >> U64(bit) & U64(1)))
            for k, counter in enumerate(counters):
                carry, counters[k] = counter & carry, counter ^ carry
            over |= carry | _exceeds(counters, radius)
            if bit % 8 == 7:
                alive = over != full
                if not alive.all():
                    q, b, over, value = q[alive], b[alive], over[alive], value[alive]
                    counters = [c[alive] for c in counters]
                if not len(q):
                    break
        if len(q):
            hit = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            yield q[row], 64 * b[row] + lane
        begin = stop


def _below(k: np.ndarray) -> np.ndarray:
    """The lanes under k, k from 0 to 64."""
    return np.where(k >= 64, ~U64(0), (U64(1) << np.minimum(k, 63).astype(U64)) - U64(1))


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is over the radius: a bitwise comparison with the constant."""
    above, equal = np.zeros_like(counters[0]), ~np.zeros_like(counters[0])
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | equal & counters[k]
            equal = equal & ~counters[k]
    return above


def forest(n: int, pairs) -> np.ndarray:
    """The smallest index each index is linked to through the pairs (arrays at a time)."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
    return root


def _bands(bits: list[int], parts: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.array(bits), parts)]


def _key(fp, kept: list[int]):
    """The kept bits of a fingerprint as a long: runs of bits, masked."""
    mask = sum(1 << b for b in kept)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))


def link_edges(nodes: DataFrame, radius: int, crowd: int) -> DataFrame:
    """(a, b) of distinct fingerprints, enough to connect all that link; `nodes` has one long column fp."""
    everything = list(range(64))
    bands = _bands(everything, radius + 2)
    ways = [sorted(b for i in kept for b in bands[i]) for kept in combinations(range(radius + 2), 2)]
    levels, done = ways, []
    keyed = nodes.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("way"), _key(F.col("fp"), w).alias("key")) for i, w in enumerate(ways)))).alias("k")).select("fp", "k.*")
    while True:
        open_ways = [i for i, kept in enumerate(levels) if 64 - len(kept) > radius]  # fewer free bits cannot be split, nor hold a crowd
        crowded = keyed.where(F.col("way").isin(open_ways)).groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
        crowded = checkpointed(crowded.select("way", "key"))
        if crowded.isEmpty():
            done.append(keyed)
            break
        done.append(keyed.join(crowded, ["way", "key"], "left_anti"))
        finer, table = [], []
        for i in open_ways:
            free = [b for b in everything if b not in levels[i]]
            for band in _bands(free, radius + 1):
                table.append((i, len(finer)))
                finer.append(sorted(levels[i] + band))
        sub = F.array(*(F.struct(F.lit(old).alias("old"), F.lit(new).alias("way"), _key(F.col("fp"), finer[new]).alias("key")) for old, new in table))
        keyed = checkpointed(keyed.join(crowded, ["way", "key"], "left_semi").select("fp", F.explode(F.filter(sub, lambda s: s["old"] == F.col("way"))).alias("k")).select("fp", F.col("k.way").alias("way"), F.col("k.key").alias("key")).distinct())
        levels = finer
    edges = None
    for part in done:
        found = part.repartition("way", "key").sortWithinPartitions("way", "key", "fp").mapInArrow(_linker(radius), "a long, b long")
        edges = found if edges is None else edges.unionByName(found)
    return edges.distinct()


def _linker(radius: int):
    """Whole groups of way and key are compared; the linked of a task's share leave it as a forest."""

    def linked(rows: pa.Table, ends: np.ndarray):
        fp = rows.column("fp").to_numpy()
        nodes, index = np.unique(fp, return_inverse=True)
        root = forest(len(nodes), ((index[a], index[b]) for a, b in close_pairs(fp.view(U64), ends, radius)))
        out = np.flatnonzero(root != np.arange(len(root)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["a", "b"])

    return grouped_rows(("way", "key"), linked)


def grouped_rows(by: tuple[str, ...], work, at_once: int = 1 << 18):
    """A mapInArrow function over rows sorted by these columns: whole groups, some `at_once` rows at a time, go to
    `work` with the end of each row's group; groups of one are left out."""

    def whole(rows: pa.Table):
        last = np.ones(rows.num_rows, bool)
        for c in by:
            values = rows.column(c).to_numpy()
            last[:-1] = (values[1:] != values[:-1]) if c == by[0] else last[:-1] | (values[1:] != values[:-1])
        ends = np.flatnonzero(last) + 1
        sizes = np.diff(ends, prepend=0)
        keep = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if len(keep):
            yield from work(rows.take(pa.array(keep)), np.searchsorted(keep, np.repeat(ends, sizes)[keep]))

    def run(batches):
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size >= at_once:
                rows = pa.concat_tables(held)
                columns = [rows.column(c).to_numpy() for c in by]
                other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in columns]))
                cut = int(other[-1]) + 1 if len(other) else 0
                if cut:
                    yield from whole(rows.slice(0, cut))
                    give_back()
                held, size = [rows.slice(cut)], rows.num_rows - cut
        if size:
            yield from whole(pa.concat_tables(held))
        held.clear()
        give_back()

    return run


def components(edges: DataFrame, limit: int = 100) -> DataFrame:
    """node, root (the smallest node of its component) for every node with an edge.

    Alternating star rounds: in a large-star round each node hands its larger
    neighbours to the smallest it knows, in a small-star round its smaller ones.
    """
    least, most = F.least("a", "b"), F.greatest("a", "b")
    edges = checkpointed(edges.select(least.alias("a"), most.alias("b")).where("a <> b").distinct())
    for _ in range(limit):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(small, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        lowest = large.groupBy("b").agg(F.min("a").alias("m"))
        met = large.join(lowest, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        met = checkpointed(met)
        # settled when no node is both a root and below another
        roots, leaves = met.select("a").distinct(), met.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        moving = leaves.where("n > 1").select("b").unionByName(leaves.select("b").join(roots, F.col("b") == F.col("a"), "left_semi"))
        edges = met
        if moving.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _linked(docs: DataFrame, words: int, radius: int, crowd: int) -> DataFrame:
    """doc_id, fp, root (equal in a component), component_id per row, with the further columns (longs) of `docs`."""
    rows = stored(with_fingerprints(docs, words))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = checkpointed(nodes)
    links = components(link_edges(nodes.select("fp"), radius, crowd))
    joined = nodes.join(links, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, crowd: int = 4096) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (the smallest doc_id linked, itself included).

    Null and blank texts have fingerprint zero and link like any other; null
    doc_ids take part but are never the smallest unless their component has no
    other; repeated rows each get a row; other columns are ignored; an empty
    table gives an empty result.
    """
    return _linked(docs.select("doc_id", "text"), words, radius, crowd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def row_keys() -> list:
    """Two columns, k1 and k2: 128 bits that tell rows apart by doc_id (null or not) and text."""
    parts = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.col("text").isNull(), F.col("text")]
    return [F.xxhash64(F.lit(i), *parts).alias(f"k{i}") for i in (1, 2)]


def one_a_component(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """`docs` in all its columns, whatever their names: the row with the smallest doc_id, then text, then other columns, of each component; a null doc_id comes last.

    `linked` has doc_id, k1, k2, root and component_id (the smallest doc_id under the root) per row.
    """
    kept = linked.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("k1", "k2", "root").distinct()
    names = docs.columns
    others = F.to_json(F.struct(*(n for n in names if n != "text"))) if len(names) > 1 else F.lit("")
    rows = docs.select(F.struct(*names).alias("row"), F.struct(F.coalesce("text", F.lit("")), others).alias("rank"), *row_keys())
    return rows.join(kept, ["k1", "k2"]).groupBy("root").agg(F.min_by("row", "rank").alias("row")).select("row.*")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, crowd: int = 4096) -> DataFrame:
    """`docs` in all its columns: of each component the row with the smallest doc_id.

    Of rows in one component that repeat this doc_id the smallest text stays;
    in different components both do.  Of rows without a doc_id one stays in
    every component that has no other.
    """
    return one_a_component(docs, _linked(docs.select("doc_id", "text", *row_keys()), words, radius, crowd))
