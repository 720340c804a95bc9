"""Continuous ingest: new files of a folder as a stream, records upserted per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import segments as sg


def document_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose key was not seen within the watermark; late copies are dropped with bounded state."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows and characters per window and group; a window closes when the watermark passes it."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def line_stream(stream: DataFrame, key: str, text: str) -> DataFrame:
    """Stateless segmentation works on streams unchanged."""
    return sg.line_rows(stream, key, text)


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """foreachBatch: the stored snapshot is read, merged with the batch and written under the batch id,
    so that a repeated batch overwrites its own result."""

    def step(batch: DataFrame, epoch: int) -> None:
        write(merge(read(), batch), epoch)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
