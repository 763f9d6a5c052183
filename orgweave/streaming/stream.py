"""Streams of affiliation texts: the batch stages on micro-batches, and windowed counts of what comes in.

The stages hold no state but the caches, so each micro-batch goes through the same plan; results of a batch are written before its offsets are committed, and
a batch that is repeated after a failure overwrites its own folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orgweave.functions import language as lang
from orgweave.plans.pipeline import Engine
from orgweave.plans.settle import released


def process_stream(engine: Engine, source: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """source: a stream of (source_index, raw_text). Writes one row per span to path/batch=n."""

    def batch(df: DataFrame, number: int) -> None:
        # a stream may run for long, so the stages' tables of a batch go with it
        with released(engine.spark):
            engine.spans_out(df).write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def detect_stream(source: DataFrame, column: str = "raw_text", compat: bool = True) -> DataFrame:
    """Language of each row of a stream, a stateless projection; texts are taken to be composed already."""
    return source.withColumn("language", lang.decide(F.col(column), compat=compat))


def windowed_counts(source: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows per key and window, with a watermark for late ones. The same expression runs over a table."""
    stream = source.withWatermark(time, late) if source.isStreaming else source
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_seen(source: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark: what a provider is asked for, once."""
    return source.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
