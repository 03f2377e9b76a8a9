"""Document fingerprints from closed syncmers.

A k-byte string is an anchor when the smallest of its s-byte substrings, by
hash, is its first or its last.  That depends on the k bytes alone, so a
passage has the same anchors wherever it stands: an edit moves or changes only
the anchors it touches.  A fingerprint holds, for each of `bins` classes of
anchor hashes, 16 bits of the smallest and its place in the text: two
fingerprints agree in a class about as often as their texts share anchors.
Matching is by position: of the classes that agree, those count that stand in
the same order in both texts, the longest such chain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import CHUNK_BYTES, U64, RollingHash, byte_codes, mix64, n_blocks, sliding_min, spans_of_rows, stored, utf8

K, S, BINS = 16, 8, 64
#: Bytes a step of an anchor's place: 16 bits reach 1 MB.
PLACE_BYTES = 16
_NONE = U64(0xFFFFFFFFFFFFFFFF)
PARTITION_BYTES = 64 << 20


def anchors(data: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every closed syncmer of one byte sequence."""
    rolling = RollingHash(byte_codes(3)[data], 9)
    small = mix64(rolling.all(s))
    least = sliding_min(small, k - s + 1)
    at = np.flatnonzero((small[: len(least)] == least) | (small[k - s :] == least)) if len(least) else np.zeros(0, np.int64)
    return at, mix64(rolling.ranges(at, at + k) ^ U64(0x5851F42D4C957F2D))


def fingerprints(texts: list[bytes], k: int = K, s: int = S, bins: int = BINS) -> np.ndarray:
    """For each text and class 16 bits of the smallest anchor hash and its place, 0 where there is no anchor of that class.

    Places count from 1 in steps of PLACE_BYTES; the last one, 65,535, is also
    that of whatever lies beyond.  A text without anchors has itself as its
    only one, so equal texts, empty ones too, have equal fingerprints.
    """
    n = len(texts)
    least = np.full(n * bins, _NONE, U64)
    place = np.zeros(n * bins, np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, n))))
    joined = np.frombuffer(b"".join(texts), np.uint8)
    for a, b in spans_of_rows(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        for start in range(lo, max(hi, lo + 1), CHUNK_BYTES) if b - a == 1 else (lo,):
            end = hi if b - a > 1 else min(hi, start + CHUNK_BYTES + k - 1)
            at, h = anchors(joined[start:end], k, s)
            row = np.searchsorted(offsets[a + 1 : b + 1], at + start, side="right") + a
            inside = at + start + k <= offsets[row + 1] if len(at) else np.zeros(0, bool)
            at, h, row = at[inside] + start, h[inside], row[inside]
            slot = row * bins + (h >> U64(40)).astype(np.int64) % bins
            before = least[a * bins : b * bins].copy()
            np.minimum.at(least, slot, h)
            new = np.flatnonzero((h == least[slot]) & (h != before[slot - a * bins]))[::-1]  # the first of equal ones is set last
            place[slot[new]] = at[new] - offsets[row[new]]
    least, place = least.reshape(n, bins), place.reshape(n, bins)
    for row in np.flatnonzero((least == _NONE).all(axis=1)).tolist():
        h = xxhash.xxh3_64_intdigest(texts[row])
        least[row, h % bins] = h >> 1
    values = np.maximum((mix64(least) >> U64(48)).astype(np.uint16), 1)
    places = np.minimum(place // PLACE_BYTES + 1, 65535)
    return np.where((least == _NONE)[:, :, None], 0, np.stack([values, places], axis=2)).astype(np.uint16)


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the classes held by either, the share in the longest chain of agreeing anchors whose order is the same in both, from 0 to 1."""
    out = np.zeros(len(x))
    for lo in range(0, len(x), 4096):
        p, q = x[lo : lo + 4096].astype(np.int64), y[lo : lo + 4096].astype(np.int64)
        same = (p[:, :, 0] == q[:, :, 0]) & (p[:, :, 0] != 0)
        order = np.argsort(np.where(same, p[:, :, 1] << 16 | q[:, :, 1], 1 << 40), axis=1, kind="stable")
        same, at = np.take_along_axis(same, order, axis=1), np.take_along_axis(q[:, :, 1], order, axis=1)
        best = same.astype(np.int64)  # the longest chain that ends here
        for i in range(1, same.shape[1]):
            if not same[:, i].any():
                break  # agreeing classes come first
            before = np.where(same[:, :i] & (at[:, :i] <= at[:, i : i + 1]), best[:, :i], 0).max(axis=1)
            best[:, i] += np.where(same[:, i], before, 0)
        either = ((p[:, :, 0] != 0) | (q[:, :, 0] != 0)).sum(axis=1)
        out[lo : lo + 4096] = best.max(axis=1) / np.maximum(either, 1)
    return out


def edited(text: str, following: str) -> str:
    """The last half, rounded down, gives way to as many of the next document's first characters, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "near_edited", "near_next", "part", "role", "text"]
_SCHEMA = pa.schema(list(zip(_COLUMNS, (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()), strict=True)))
_DDL = "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, near_edited double, near_next double, part int, role int, text string"
_DONE, _FIRST, _LAST = 0, 1, 2


def _compared(ids: pa.Array, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> pa.RecordBatch:
    changed = [edited(a, b).encode() for a, b in zip(texts, following, strict=True)]
    other = fingerprints(changed)
    n = len(texts)
    blank = pa.nulls(n, pa.string())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(map(len, texts), pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in changed]), pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([p.tobytes() for p in other], pa.binary()),
         pa.array(likeness(prints, other)), pa.array(likeness(prints, next_prints)), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, _DONE, np.int32)), blank],
        schema=_SCHEMA,
    )


def _edge(doc_id, text: str, part: int, role: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{"doc_id": doc_id, "part": part, "role": role, "text": text}], schema=_SCHEMA)


def _scan(batches):
    """In doc_id order: compare each row with the next; the partition's first and last rows go on for its neighbours."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        for a, b in spans_of_rows(utf8(batch.column("text"))[1], 2 * CHUNK_BYTES):
            ids = batch.column("doc_id").slice(a, b - a).to_pylist()
            texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
            prints = fingerprints([t.encode() for t in texts])
            if held is None:
                yield _edge(ids[0], texts[0], part, _FIRST)
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.vstack([held[2][None], prints])
            held = ids[-1], texts[-1], prints[-1]
            if len(ids) > 1:
                yield _compared(pa.array(ids[:-1], pa.int64()), texts[:-1], prints[:-1], texts[1:], prints[1:])
    if held is not None:
        yield _edge(held[0], held[1], part, _LAST)


def _join_edges(batches):
    for batch in batches:
        for row in batch.to_pylist():
            texts = [row["text"]], [row["following"]]
            yield _compared(pa.array([row["doc_id"]], pa.int64()), texts[0], fingerprints([texts[0][0].encode()]), texts[1], fingerprints([texts[1][0].encode()]))


def edit_likeness(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of `docs`.

    The next document is the next row by ascending doc_id, then text; after
    the last comes the first.  Null doc_ids come first; a null text is empty;
    repeated rows follow each other; one row follows itself; other columns are
    ignored; an empty table gives an empty result.  The texts are dealt once,
    by ranges of doc_id; only the first and last row of a range, two a
    partition, are joined with their neighbours afterwards.
    """
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("text")]
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_blocks(docs, PARTITION_BYTES))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order[:2]).sortWithinPartitions(*order)
    scanned = stored(rows.mapInArrow(_scan, _DDL))
    parts = sorted(r["part"] for r in scanned.where(F.col("role") == _FIRST).select("part").collect())  # one small number a partition
    following = scanned.sparkSession.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)] or [], "part int, next int")
    last = scanned.where(F.col("role") == _LAST).select("doc_id", "text", "part").join(following, "part")
    first = scanned.where(F.col("role") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))
    edges = last.join(first, "next").select("doc_id", "text", "following").mapInArrow(_join_edges, _DDL)
    every = scanned.where(F.col("role") == _DONE).unionByName(edges)
    return every.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")
