"""Repeated word windows: a count-min prefilter, then exact grouping of what it lets through.

First pass: each block of documents makes a sketch of its windows' hashes and
the buckets add the sketches up.  A cell's sum is never less than the count of
any window in it, so a window whose cell sums to 1 is surely unique and drops
out.  The sketch grows with the corpus (a bucket's share of the width is fixed,
the buckets are as many as the blocks) and travels as the sorted list of its
non-zero cells.  At a given volume one wide row lets less through than several
narrow ones, so the depth is 1.

Second pass: the windows that are left are grouped, and the earliest of each
group is found.  A window goes by 128 bits: XXH3 of each word, mixed again at
every doubling of the run, in two lanes.  A block sends each window once, at
its first place in the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from passrate.llm.blocks import Block, dealt, exchange, received
from passrate.llm.common import CHUNK_BYTES, U64, digests, window_hashes

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bits of a bucket's share of the sketch: some 50 cells for each window it is dealt.
CELL_BITS = 26


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and the row of every word: a run without space, tab, line feed, VT, FF or CR."""
    inside = ~_BLANK[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128 bits of every word, in two rows: XXH3 of each distinct word."""
    if not len(starts):
        return np.zeros((2, 0), U64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~_BLANK[data]])]).dictionary_encode()
    _, bounds, raw = words.dictionary.buffers()
    bounds = np.frombuffer(bounds, np.int64)[: len(words.dictionary) + 1]
    return digests(raw, bounds[:-1], bounds[1:])[words.indices.to_numpy()].T


class Windows:
    """The windows of a block: place, row and 128 bits of each."""

    def __init__(self, block: Block, width: int):
        self.starts, self.ends, self.rows = words_of(block.data, block.offsets)
        lanes = word_hashes(block.data, self.starts, self.ends)
        n = len(self.starts)
        whole = np.flatnonzero(self.rows[: n - width + 1] == self.rows[width - 1 :]) if n >= width else np.zeros(0, np.int64)
        self.at = whole  # index of the first word
        self.key, self.check = (_windows(lane, width)[whole] if n >= width else np.zeros(0, U64) for lane in lanes)
        base = np.searchsorted(self.rows, np.arange(len(block.offsets) - 1))
        self.start = (whole - base[self.rows[whole]]).astype(np.int64)  # counted in the document
        self.doc = block.ids[self.rows[whole]]


def _windows(lane: np.ndarray, width: int) -> np.ndarray:
    out = np.empty(len(lane) - width + 1, U64)
    for at in range(0, len(out), CHUNK_BYTES):
        out[at : at + CHUNK_BYTES] = window_hashes(lane[at : at + CHUNK_BYTES + width - 1], width)
    return out


def pack(values: np.ndarray) -> bytes:
    """Integers in order as the compressed byte planes of their differences."""
    deltas = np.diff(values.astype(U64), prepend=U64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view(U64).ravel(), dtype=U64)


def _cells(key: np.ndarray) -> np.ndarray:
    return key & U64((1 << CELL_BITS) - 1)


class WindowDedup:
    """The two passes over word windows, for `blocks.exchange`."""

    def __init__(self, width: int):
        self.width = width

    def sketch(self, block: Block, n: int) -> Iterator[tuple[int, int, int, bytes]]:
        key = Windows(block, self.width).key
        order, buckets, starts = dealt(key, n)
        cells = _cells(key[order])
        for i, bucket in enumerate(buckets.tolist()):
            cell, count = np.unique(cells[starts[i] : starts[i + 1]], return_counts=True)
            for kind in (1, 2):  # cells counted once here, and more often
                if len(part := cell[count == 1] if kind == 1 else cell[count > 1]):
                    yield bucket, block.number, kind, pack(part)

    def sketch_merge(self, table: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
        bucket = table.column("bucket")[0].as_py()
        got = [(b, kind, unpack(d)) for kind in (1, 2) for b, d in received(table, kind)]
        cell, count = np.unique(np.concatenate([c for _, _, c in got]), return_counts=True)
        often = cell[count > 1]
        by_block: dict[int, list[np.ndarray]] = {}
        for b, kind, c in got:
            by_block.setdefault(b, []).append(c if kind == 2 else c[np.isin(c, often, assume_unique=True)])
        for b, parts in by_block.items():
            if len(part := np.unique(np.concatenate(parts))):
                yield bucket, b, 3, pack(part)

    def _repeated(self, block: Block, answers: pa.Table, n: int) -> tuple[Windows, np.ndarray]:
        """The block's windows, and the indices of those estimated to repeat."""
        windows = Windows(block, self.width)
        cells = [U64(bucket) << U64(CELL_BITS) | unpack(d) for bucket, kind, d in zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("data").to_pylist(), strict=True) if kind == 3]
        if not cells:
            return windows, np.zeros(0, np.int64)
        known = np.sort(np.concatenate(cells))
        own = ((windows.key >> U64(32)) % U64(n)) << U64(CELL_BITS) | _cells(windows.key)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        return windows, np.flatnonzero(known[at] == own)

    def _grouped(self, windows: Windows, chosen: np.ndarray, n: int):
        """Distinct windows of the block by bucket and first place: index of each one's first, group of each chosen, bucket bounds."""
        key, check, doc, start = windows.key[chosen], windows.check[chosen], windows.doc[chosen], windows.start[chosen]
        order = np.lexsort((start, doc, check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        first = order[new]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        rank = np.lexsort((start[first], doc[first], (key[first] >> U64(32)) % U64(n)))
        place = np.empty(len(rank), np.int64)
        place[rank] = np.arange(len(rank))
        first = first[rank]
        buckets, starts = np.unique((key[first] >> U64(32)) % U64(n), return_index=True)
        return first, place[group], buckets.astype(np.int64), np.append(starts, len(first))

    def detail(self, block: Block, answers: pa.Table, n: int) -> Iterator[tuple[int, int, int, bytes]]:
        windows, chosen = self._repeated(block, answers, n)
        if not len(chosen):
            return
        first, _, buckets, bounds = self._grouped(windows, chosen, n)
        at = chosen[first]
        for i, bucket in enumerate(buckets.tolist()):
            part = at[bounds[i] : bounds[i + 1]]
            fields = [windows.key[part].tobytes(), windows.check[part].tobytes(), pack(windows.doc[part].astype(np.int64).view(U64)), pack(windows.start[part])]
            head = np.array([len(f) for f in fields], np.int64).tobytes()
            yield bucket, block.number, 4, head + b"".join(fields)

    def detail_merge(self, table: pa.Table) -> Iterator[tuple[int, int, int, bytes]]:
        bucket = table.column("bucket")[0].as_py()
        blocks, keys, checks, docs, starts = [], [], [], [], []
        for b, blob in received(table, 4):
            cut = np.cumsum(np.concatenate(([32], np.frombuffer(blob[:32], np.int64))))
            key, check, doc, start = (blob[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True))
            blocks.append(b)
            keys.append(np.frombuffer(key, U64))
            checks.append(np.frombuffer(check, U64))
            docs.append(unpack(doc).view(np.int64))
            starts.append(unpack(start).astype(np.int64))
        sizes = [len(k) for k in keys]
        key, check, doc, start = map(np.concatenate, (keys, checks, docs, starts))
        order = np.lexsort((start, doc, check, key))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (check[order][1:] != check[order][:-1])
        leader = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        earliest = np.zeros(len(order), bool)
        earliest[order] = (doc[order] == doc[leader]) & (start[order] == start[leader])
        at = 0
        for b, size in zip(blocks, sizes, strict=True):
            yield bucket, b, 5, np.packbits(earliest[at : at + size]).tobytes()
            at += size

    def removed(self, block: Block, answers: pa.Table, n: int) -> tuple[Windows, np.ndarray]:
        """Which words of the block are covered by a window that also starts earlier."""
        windows, chosen = self._repeated(block, answers, n)
        cover = np.zeros(len(windows.starts) + 1, np.int32)
        if len(chosen):
            first, group, buckets, bounds = self._grouped(windows, chosen, n)
            bits = {b: d for b, k, d in zip(answers.column("bucket").to_pylist(), answers.column("kind").to_pylist(), answers.column("data").to_pylist(), strict=True) if k == 5}
            here = np.concatenate([np.unpackbits(np.frombuffer(bits[b], np.uint8), count=int(bounds[i + 1] - bounds[i])) for i, b in enumerate(buckets.tolist())]).astype(bool)
            lead = chosen[first][group]
            same = (windows.doc[chosen] == windows.doc[lead]) & (windows.start[chosen] == windows.start[lead])
            gone = windows.at[chosen[~(same & here[group])]]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + self.width, -1)
        return windows, np.cumsum(cover)[:-1] > 0


def repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: what is left when each word covered by a window of `width`
    words whose sequence also starts earlier (smaller doc_id, or same doc_id and earlier start) is removed.

    Windows are judged on the input.  A null text has no words; a null doc_id
    counts as the smallest; of repeated rows with one doc_id none is earlier
    than another at the same start; other columns are ignored; an empty table
    gives an empty result.
    """
    return _run(docs, width, None)


def drop_repeated_windows(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id and the kept text: as `repeated_windows`, kept words joined by one space."""
    return _run(docs, width, "kept")


def _run(docs: DataFrame, width: int, kept: str | None) -> DataFrame:
    dedup = WindowDedup(width)

    def finish(block: Block, answers: pa.Table, n: int) -> pa.Table:
        windows, gone = dedup.removed(block, answers, n)
        rows = len(block.offsets) - 1
        bounds = np.searchsorted(windows.rows, np.arange(rows + 1))
        total = np.concatenate(([0], np.cumsum(gone)))
        texts, digests = [], []
        for r in range(rows):
            a, b = bounds[r], bounds[r + 1]
            raw = block.data[block.offsets[r] : block.offsets[r + 1]].tobytes()
            words = raw.split()
            if total[b] > total[a]:
                words = [w for w, x in zip(words, gone[a:b].tolist(), strict=True) if not x]
            text = b" ".join(words)
            digests.append(hashlib.sha256(text).hexdigest())
            if kept:
                texts.append(text.decode())
        out = {"doc_id": block.table.column("doc_id"), "n_words": pa.array(np.diff(bounds), pa.int64()), "n_removed": pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        return pa.table(out | ({kept: pa.array(texts, pa.string())} if kept else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (f", {kept} string" if kept else "")
    return exchange(docs, dedup.sketch, dedup.sketch_merge, dedup.detail, dedup.detail_merge, finish, schema)
