"""Helpers shared by the text operators: reading, Arrow buffers, hashing, checkpoints."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on at a time; bounds a worker's memory.
CHUNK_BYTES = 1 << 20
#: Bytes of text in one block of documents, the unit of the block exchanges.
BLOCK_BYTES = 8 << 20

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder, as spark.checkpoint.dir names it; where it is unset one is made, on a single machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="passrate-ckpt-"))
    return context.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it is deleted when the driver ends."""
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends here, and later branches read the columns they use."""
    folder = shared_folder(df.sparkSession, "table")
    df.write.mode("append").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def unused(name: str, columns: list[str]) -> str:
    """A column name that the table has not, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise a narrow table in the shared folder, so later branches neither recompute nor depend on an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def total_bytes(df: DataFrame, column: str = "text") -> int:
    return int(df.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def n_blocks(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    return max(1, math.ceil(total_bytes(df) / block_bytes))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_large_string(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_large_string(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_of_rows(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` consecutive values, by doubling: mixed at each step, so no sums cancel."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, power, size = None, 0, values.astype(U64), 1
    odd = U64(0xD6E8FEB86659FD93)
    while True:
        if width & size:
            piece = power[done : done + n]
            out = piece if out is None else mix64(out * odd + piece)
            done += size
        if 2 * size > width:
            return out
        power = mix64(power[:-size] * odd + power[size:])
        size *= 2


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH3 of each range of the data, two 64-bit halves a row."""
    view, known = memoryview(data), xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([known(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), U64).reshape(-1, 2)


class RollingHash:
    """Polynomial hash modulo 2**64 over a symbol sequence, by prefix sums.

    The hash of symbols[i:j] is the difference of two prefix sums divided by
    the power of the start, so it depends on the symbols alone and any range
    costs two look-ups.  Some unlike strings of 1,024 symbols and more have the
    same hash whatever the base: it picks places and features, and never says
    that two strings are equal.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, seed: int):
        base = (0x9E3779B97F4A7C15 * (2 * seed + 1) | 5) & 0xFFFFFFFFFFFFFFFF
        base = base & ~7 | 5
        n = len(symbols)
        if base not in self._powers or len(self._powers[base][0]) < n + 1:
            size = max(n + 1, CHUNK_BYTES + 4096)
            inverse = pow(base, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self._powers[base] = tuple(np.multiply.accumulate(np.concatenate(([U64(1)], np.full(size - 1, b, U64)))) for b in (base, inverse))
        self.up, self.down = self._powers[base]
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n + 1, U64)
            np.cumsum(symbols * self.up[:n], out=self.prefix[1:])

    def all(self, length: int) -> np.ndarray:
        """The hashes of every range of this length."""
        n = len(self.prefix) - length
        if n <= 0:
            return np.zeros(0, U64)
        with np.errstate(over="ignore"):
            return (self.prefix[length:] - self.prefix[:n]) * self.down[:n]

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.prefix[ends] - self.prefix[starts]) * self.down[starts]


def byte_codes(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` consecutive values, in linear time (block prefix and suffix minima)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand freed memory to the system: the Python worker of a task is kept for the next ones, and with it whatever its allocators hold."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def by_batch(rows: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A mapInArrow function from one that handles a batch; empty batches are passed over."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from rows(batch)
                give_back()

    return run
