"""Token packing along a space-filling curve.

A document's byte 4-grams are hashed to a count vector, which a fixed random
matrix projects to three dimensions.  The place on the Hilbert curve through
that cube orders the documents: neighbours on the curve are alike, so the
pieces of one sequence come from similar texts.  Documents are dealt to ranges
of the curve, and each range is cut into sequences of `length` tokens as it
goes by; its last tokens make sequences of powers of two, which need no
padding.

The ranges' bounds come from the curve places of a bounded sample; they only
balance the work.  Equal places, as of copies, are told apart by a hash of
doc_id in the low bits, so a crowd at one place is cut by the bounds too.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import CHUNK_BYTES, U64, RollingHash, by_batch, byte_codes, give_back, spans_of_rows, utf8
from passrate.llm.tokens import byte_bpe, tokenizer_path

DIMENSIONS, BITS, TIE_BITS, FEATURES, GRAM = 3, 15, 18, 256, 4


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed byte 4-gram counts, square roots taken; no grams: zeros."""
    n = len(offsets) - 1
    counts = np.zeros(n * FEATURES)
    codes = byte_codes(13)
    for a, b in spans_of_rows(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        for start in range(lo, hi, CHUNK_BYTES) if b - a == 1 else (lo,):
            end = hi if b - a > 1 else min(hi, start + CHUNK_BYTES + GRAM - 1)
            bucket = (RollingHash(codes[data[start:end]], 17).all(GRAM) >> U64(56)).astype(np.int64)
            if len(bucket):
                if b - a > 1:  # grams over a border count for the row they start in
                    bucket += FEATURES * np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))[: len(bucket)]
                counts[a * FEATURES : b * FEATURES] += np.bincount(bucket, minlength=(b - a) * FEATURES)
    counts = np.sqrt(counts.reshape(n, FEATURES))
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)


def project(unit: np.ndarray) -> np.ndarray:
    """To a cube of integers of BITS bits a side."""
    matrix = np.random.default_rng(2024).standard_normal((FEATURES, DIMENSIONS))
    matrix -= matrix.mean(axis=0)
    return np.clip((unit @ matrix / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each point on the Hilbert curve (axes to transposed index, after Skilling)."""
    x = points.T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[dims - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(dims):
            place = place << 1 | x[i] >> bit & 1
    return place


def _placed(bounds: np.ndarray | None):
    def run(batch: pa.RecordBatch):
        place = hilbert(project(vectors(*utf8(batch.column("text")))))
        curve = place << TIE_BITS | batch.column("tie").to_numpy() & ((1 << TIE_BITS) - 1)
        if bounds is None:
            yield pa.RecordBatch.from_arrays([pa.array(curve), pa.array(np.diff(utf8(batch.column("text"))[1]))], ["curve", "size"])
        else:
            part = np.searchsorted(bounds, curve, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("tie"), pa.array(curve), pa.array(part)], ["doc_id", "text", "tie", "curve", "part"])

    return by_batch(run)


def along_curve(docs: DataFrame, partition_bytes: int = 64 << 20, sample_per_partition: int = 100, most_sampled: int = 1_000_000) -> DataFrame:
    """doc_id, text, curve: in partitions that are ranges of the curve, sorted within."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id())).alias("tie"))  # rows without a doc_id part by their place in the input
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / partition_bytes))
    parts = max(1, min(parts, count, most_sampled // 10))  # beyond, ranges grow: ten sampled documents a bound at least
    wanted = min(sample_per_partition * parts, most_sampled)
    sample = rows if wanted >= count else rows.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(1.2 * wanted / count * (1 << 30)))
    sampled = sample.mapInArrow(_placed(None), "curve long, size long").limit(2 * most_sampled).toArrow()
    found = np.stack([sampled.column(c).to_numpy() for c in ("curve", "size")], axis=1).astype(np.int64)
    found = found[np.argsort(found[:, 0], kind="stable")]
    weight = np.cumsum(found[:, 1] + 64)  # equal shares of text, not of documents
    bounds = found[np.searchsorted(weight, np.arange(1, parts) * (weight[-1] / parts)), 0] if len(found) else found[:, 0]
    placed = rows.mapInArrow(_placed(bounds), "doc_id long, text string, tie long, curve long, part int")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("curve", "doc_id", "tie").select("doc_id", "text", "curve")


class _Cutter:
    """Cuts a run of documents into sequences; holds the pieces of the one that is not yet full."""

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id, self.used = length, first_id, 0
        self.held: list[tuple[int | None, int, np.ndarray, int]] = []
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while at < total:
            take = min(total - at, self.length - self.used)
            self.held.append((doc_id, at, ids[at : at + take], total))
            at += take
            self.used += take
            if self.used == self.length:
                self._emit(self.held)
                self.held, self.used = [], 0

    def _emit(self, pieces) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, offset, ids))
            offset += len(ids)
        self.next_id += 1

    def finish(self) -> None:
        """What is left goes out in sequences of powers of two, the largest first."""
        pieces = self.held
        while self.used:
            size = 1 << (self.used.bit_length() - 1)
            out, room = [], size
            while room:
                doc_id, start, ids, total = pieces[0]
                take = min(room, len(ids))
                out.append((doc_id, start, ids[:take], total))
                room -= take
                if take < len(ids):
                    pieces[0] = (doc_id, start + take, ids[take:], total)
                else:
                    pieces = pieces[1:]
            self._emit(out)
            self.used -= size
        self.held = []

    def flush(self, keep_ids: bool) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(7)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if keep_ids:
            ends = np.concatenate(([0], np.cumsum([len(r[7]) for r in rows]))).astype(np.int32)
            ids = np.concatenate([r[7] for r in rows]).astype(np.int32) if rows else np.zeros(0, np.int32)
            columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names)


def packed(docs: DataFrame, length: int = 1024, end_id: int = 0, json_name: str = "byte_bpe_50k.json", ranks_name: str | None = "byte_bpe_50k.tiktoken", chunk_chars: int = 65536, overlap_chars: int = 256, keep_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids with `keep_ids`).

    A document's tokens are its ids and `end_id`; a null or empty text has that
    one alone.  Every token lies in exactly one piece; sequences hold `length`
    tokens or a power of two, so none is padded.  A null doc_id stays null;
    repeated rows are packed each for itself; other columns are ignored; an
    empty table gives an empty result.
    """

    def run(batches):
        bpe = byte_bpe(tokenizer_path(json_name), tokenizer_path(ranks_name) if ranks_name else None)
        cutter = _Cutter(length, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode(value.as_py() or "", chunk_chars, overlap_chars)
                cutter.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
                if len(cutter.rows) >= 4096:
                    yield cutter.flush(keep_ids)
        cutter.finish()
        if cutter.rows:
            yield cutter.flush(keep_ids)
        give_back()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * keep_ids
    return along_curve(docs).mapInArrow(run, schema)
