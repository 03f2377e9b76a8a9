"""Rule sets over streams: each micro-batch is measured as a table and its report appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from passrate.config import DataQualityConfig
from passrate.report import DataQualityReport


def measure_batches(stream: DataFrame, config: DataQualityConfig, sink: Callable[[DataQualityReport, int], None], **options):
    """A stream writer that hands `sink` the report and number of every micro-batch; call start() on it.

    Spark may hand over a batch again after a failure, under the same number;
    a sink that keeps reports by that number counts each once.
    """

    def one(batch: DataFrame, number: int) -> None:
        sink(config.execute(batch), number)

    writer = stream.writeStream.foreachBatch(one)
    for key, value in options.items():
        writer = writer.option(key, value)
    return writer
