"""Compression classifier: zstandard dictionaries of good and of bad text, and a calibrated score.

Two dictionaries are built from labelled text, one from either class.  A text
is compressed whole with both; the difference of the compressed sizes, over
the text's size, says which class's habits it shares.  Strongly repetitive text
compresses well under either dictionary, so the calibration, a logistic model
of the two normalised sizes, sees the smaller size beside the difference.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passrate.llm.common import by_batch, unused


def in_fold(doc_id, folds: int = 5):
    """crc32 of doc_id as text, modulo the folds; a null doc_id is the text 'null'."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % folds


@dataclass
class CompressionClassifier:
    good: bytes = b""
    bad: bytes = b""
    level: int = 3
    weights: list[float] = field(default_factory=list)
    prior: float = 0.5

    def _compressors(self):
        import zstandard

        make = lambda data: zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False, write_content_size=False, write_dict_id=False)
        return make(self.good), make(self.bad)

    def sizes(self, texts: list[bytes], compressors=None) -> np.ndarray:
        good, bad = compressors or self._compressors()
        return np.array([(len(good.compress(t)), len(bad.compress(t)), len(t)) for t in texts], np.float64).reshape(-1, 3)

    @staticmethod
    def features(sizes: np.ndarray) -> np.ndarray:
        good, bad, n = sizes.T
        difference, least = (bad - good) / (n + 1), np.minimum(good, bad) / (n + 1)
        return np.column_stack([np.ones(len(n)), 10 * difference, least, least**2, np.log(least + 0.01)])

    def score(self, sizes: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(sizes), self.prior)
        z = self.features(sizes) @ np.asarray(self.weights)
        score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return np.where(sizes[:, 2] == 0, self.prior, score)


def _dictionary(texts: list[bytes], size: int) -> bytes:
    import zstandard

    pieces = [t[i : i + 1024] for t in dict.fromkeys(texts) for i in range(0, len(t), 1024)]
    return zstandard.train_dictionary(size, pieces).as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]) * 1e-2
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - ridge * 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, max_text_bytes: int = 65536, dictionary_bytes: int = 32768, level: int = 3, held_out_fold: int = 0, folds: int = 5) -> CompressionClassifier:
    """Fit on at most `per_class` labelled rows of either class, the first in the order of a hash of doc_id.

    That bound, and `max_text_bytes` for a text of the sample, keep what reaches
    the driver under 2 * per_class * max_text_bytes whatever the corpus holds.
    Rows of the held-out fold are never used.  Half of the sample makes the
    dictionaries and the other half the calibration, which is weighted to the
    classes' shares among all labels that may be used.  Where a class has fewer
    than 8 usable rows the score is the share of label 1 (0.5 without labels).
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (in_fold("doc_id", folds) != held_out_fold)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    share = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(share.values())
    model = CompressionClassifier(level=level, prior=share.get(1, 0) / total if total else 0.5)
    sample = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    picked = F.broadcast(sample[0].unionByName(sample[1]))  # at most 2 * per_class rows of two numbers
    rows = docs.select(F.col("doc_id").alias("_id"), "text").where(F.octet_length("text") <= max_text_bytes).join(picked, F.col("_id") == F.col("doc_id")).groupBy("_id", "quality").agg(F.min("text").alias("text")).collect()  # one text a picked doc_id
    by_class: dict[int, list[bytes]] = {0: [], 1: []}
    for _, quality, text in sorted(rows, key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0], r[2]))[: 2 * per_class]:
        by_class[quality].append(text.encode())
    if min(map(len, by_class.values())) < 8:
        return model
    half = {q: len(t) // 2 for q, t in by_class.items()}
    try:
        model.good, model.bad = (_dictionary(by_class[q][: half[q]], dictionary_bytes) for q in (1, 0))
    except Exception as error:  # zstandard refuses samples that are too few or too small to train on
        if "dict" not in str(error).lower() and "sample" not in str(error).lower():
            raise
        return model
    held = {q: t[half[q] :] for q, t in by_class.items()}
    sizes = model.sizes(held[1] + held[0])
    y = np.repeat([1.0, 0.0], [len(held[1]), len(held[0])])
    weight = np.where(y == 1, share[1] / total / len(held[1]), share[0] / total / len(held[0])) * len(y)
    model.weights = _logistic(model.features(sizes), y, weight).tolist()
    return model


def with_scores(docs: DataFrame, model: CompressionClassifier, column: str = "score") -> DataFrame:
    """All columns of `docs` and the score of each row's whole text (null: empty)."""
    schema = docs.schema
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch):
        compressors = model._compressors() if model.weights else None
        texts = [(x.as_py() or "").encode() for x in batch.column(at)]
        sizes = model.sizes(texts, compressors) if model.weights else np.zeros((len(texts), 3))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(sizes))], [*names, column])

    return docs.mapInArrow(by_batch(run), _plus(schema, column))


def _plus(schema, column: str):
    from pyspark.sql.types import DoubleType, StructField, StructType

    return StructType([*schema.fields, StructField(column, DoubleType())])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`.

    Null and empty texts get the share of label 1 as their score.  Repeated
    rows each get a row; a null doc_id stays null and folds as the text 'null';
    other columns are ignored; empty tables give empty results.
    """
    model = fit(docs, labels, **params)
    scored = with_scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (in_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **params) -> DataFrame:
    """The rows of `docs`, in all their columns, whatever their names, whose score reaches the threshold.

    Null and empty texts have the share of label 1 as their score; repeated
    rows stay or go together; an empty table gives an empty result.
    """
    score = unused("score", docs.columns)
    scored = with_scores(docs, fit(docs.select("doc_id", "text"), labels, **params), score)
    return scored.where(F.col(score) >= threshold).select(*docs.columns)
