"""Streaming ingest: files in, deduplicated within a watermark, upserted batch by batch; windowed counts; custom state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need times with a zone; those without one are taken in the session's."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """Drops repeats of a key that arrive within the watermark; state is bounded by it."""
    return _timed(stream, time).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return _timed(stream, time).withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def upsert(stream: DataFrame, path: str, checkpoint: str, by: tuple[str, ...], mode: str = "append") -> StreamingQuery:
    """Appends each micro-batch's last row by key to a log partitioned by batch. A batch that is run again overwrites its own part, so a
    restart after a lost node adds nothing twice; readers take the latest version."""

    def write(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in by]
        last = batch.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*rest)).alias("_r")).select(*by, "_r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The whole result of an aggregation, written anew by each micro-batch."""
    write = lambda batch, number: batch.write.mode("overwrite").parquet(path)
    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) so far, by custom state: emitted whenever a key gets rows."""
    out = "key string, n long, total double"

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for b in batches:
            n, total = n + len(b), total + float(b[value].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [str(keys[0])], "n": [n], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(step, out, "n long, total double", "update", "NoTimeout")
