"""Block exchanges: ask the whole corpus about what one block of documents holds.

A question that concerns single positions of every text (does this window occur
elsewhere?) is asked a block of documents at a time.  A block sends packed
arrays of keys to buckets, each bucket joins what all blocks sent it, and the
answers go back to the blocks by number.  Two such rounds make an operator:

    texts -> sketch -> [bucket] sketch_merge -> texts -> detail -> [bucket] detail_merge -> texts -> finish

A block holds about BLOCK_BYTES of text and is dealt by a hash of the document,
so no source, language or group of copies fills one; rows without a doc_id are
dealt by their place in the input besides, so that repeated ones part.  What a block sends is
distinct within the block: a key that a third of all documents share reaches
its bucket once a block, never once a row.  A block's content and order follow
from its rows alone, so a block made again after an executor's loss is equal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import give_back, n_blocks, utf8

#: Blocks that one task may be dealt on average; beyond it there are more tasks than spark.sql.shuffle.partitions.
BLOCKS_PER_TASK = 8
MESSAGE = "bucket long, block long, kind int, data binary"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])

Message = tuple[int, int, int, bytes]


class Block:
    """The rows of one block in an order that follows from their content."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((rows.column("row_key").to_numpy(), ids))
        rows = self.table = rows.take(pa.array(order, pa.int64()))
        self.number = int(rows.column("block")[0].as_py()) if rows.num_rows else -1
        self.ids = ids[order].astype(np.int64)  # a null doc_id comes first
        self.data, self.offsets = utf8(rows.column("text"))


def messages(items: Iterable[Message]) -> pa.Table:
    buckets, blocks, kinds, data = [], [], [], []
    for bucket, block, kind, blob in items:
        buckets.append(bucket)
        blocks.append(block)
        kinds.append(kind)
        data.append(blob)
    give_back()
    return pa.table([pa.array(buckets, pa.int64()), pa.array(blocks, pa.int64()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())], schema=_SCHEMA)


def received(table: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    """(block, blob) of this kind, by block and then content: independent of the order of arrival."""
    got = [(b, d) for b, k, d in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True) if k == kind]
    return sorted(got)


def dealt(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket (the key's high bits), and the buckets with their starts; keys must be well mixed."""
    bucket = (keys >> np.uint64(32)) % np.uint64(n)
    order = np.argsort(bucket, kind="stable")
    found, starts = np.unique(bucket[order], return_index=True)
    return order, found.astype(np.int64), np.append(starts, len(keys))


def exchange(
    docs: DataFrame,
    sketch: Callable[[Block, int], Iterable[Message]],
    sketch_merge: Callable[[pa.Table], Iterable[Message]],
    detail: Callable[[Block, pa.Table, int], Iterable[Message]],
    detail_merge: Callable[[pa.Table], Iterable[Message]],
    finish: Callable[[Block, pa.Table, int], pa.Table],
    schema: str,
    carry: list[str] | None = None,
) -> DataFrame:
    """Run both rounds over (doc_id, text); `carry` names further columns that `finish` gets under their own names."""
    n = n_blocks(docs)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / BLOCKS_PER_TASK))
    row_key = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.monotonically_increasing_id()), "text")
    packed = [F.struct(*carry).alias("carried")] if carry else []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), *packed).withColumn("row_key", row_key).withColumn("block", F.pmod(F.col("row_key"), F.lit(n)))
    texts = texts.repartition(parts, "block")  # all three passes read this one exchange

    def first(rows: pa.Table) -> pa.Table:
        return messages(sketch(Block(rows), n))

    def second(rows: pa.Table, answers: pa.Table) -> pa.Table:
        return messages(detail(Block(rows), answers, n) if rows.num_rows else ())

    def last(rows: pa.Table, answers: pa.Table) -> pa.Table:
        done = finish(Block(rows), answers, n)
        give_back()
        return done

    by = lambda df, key: df.repartition(parts, key).groupBy(key)
    answers = by(texts.groupBy("block").applyInArrow(first, MESSAGE), "bucket").applyInArrow(lambda t: messages(sketch_merge(t)), MESSAGE)
    details = texts.groupBy("block").cogroup(by(answers, "block")).applyInArrow(second, MESSAGE)
    details = by(details, "bucket").applyInArrow(lambda t: messages(detail_merge(t)), MESSAGE)
    return texts.groupBy("block").cogroup(by(answers.unionByName(details), "block")).applyInArrow(last, schema)
