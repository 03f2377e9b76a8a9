"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passrate.llm import packing, pii, quality, similar, suffixes
from passrate.llm.common import shared_folder, table


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The changed texts' own n_chars."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores 0.3 or more stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays, the one with the smallest doc_id: SimHash candidates, linked at a 5-word shingle similarity of 0.8 or more."""
    return similar.keep_one(docs)


def without_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by 200-byte strings that occur elsewhere too are removed; every document stays."""
    return _measured(suffixes.drop_repeated_bytes(docs), docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers and the terms that disclose them are replaced; every document stays."""
    return _measured(pii.sanitise(docs), docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces along the Hilbert curve, with their ids."""
    return packing.packed(docs, keep_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", one_of_near_duplicates),
    ("suffix-array dedup", without_repeated_bytes),
    ("pii", without_personal_data),
    ("packing", packed_sequences),
]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
