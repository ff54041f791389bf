"""Readers and writers of records: JSON lines, the counted JSON bundle, Arrow, transcripts, change logs."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
MAGIC = b"KESJSON\n"
BAD = "_corrupt_record"


def export_jsonl(records: DataFrame, path: str, namespace: str | None = None) -> None:
    """One JSON object a line, each with its schema version; many part files, written by the executors."""
    a = records if namespace is None else records.filter(F.col("namespace") == namespace)
    a.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, errors): blank lines are skipped, lines that are no such record are errors. One read serves both."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    full = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = F.col(f"r.{BAD}").isNotNull() | F.col("r.namespace").isNull() | F.col("r.key").isNull()
    return parsed.filter(~bad).select(*[f"r.{f.name}" for f in schema.fields]), parsed.filter(bad).select("value")


def import_report(store: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """(inserted, updated, errors) of an import into a store."""
    known = store.select("namespace", "key").distinct().withColumn("_k", F.lit(1))
    n = good.select("namespace", "key").distinct().join(known, ["namespace", "key"], "left").agg(F.count_if(F.col("_k").isNull()).alias("inserted"), F.count_if(F.col("_k").isNotNull()).alias("updated"))
    return n.crossJoin(F.broadcast(bad.agg(F.count("*").alias("errors"))))  # one row each


def bundle(rows: list[dict]) -> bytes:
    """A bulk file: magic line, version byte, count as eight bytes, JSON array."""
    return MAGIC + bytes([SCHEMA_VERSION]) + len(rows).to_bytes(8, "little") + json.dumps(rows).encode()


def import_bundles(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Bulk files of a folder, one task a file; a bad magic, version or count fails the read."""

    def run(batches):
        for b in batches:
            for data in b.column("content").to_pylist():
                head = len(MAGIC)
                if data[:head] != MAGIC or data[head] != SCHEMA_VERSION:
                    raise ValueError("not a bulk file of this version")
                rows = json.loads(data[head + 9 :])
                if len(rows) != int.from_bytes(data[head + 1 : head + 9], "little"):
                    raise ValueError("the bulk file's count differs")
                yield pa.RecordBatch.from_pydict({"row": [json.dumps(r) for r in rows]})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "row string")
    return raw.select(F.from_json("row", schema).alias("r")).select("r.*")


def arrow(records: DataFrame, limit: int) -> pa.Table:
    """At most ``limit`` rows as an Arrow table on the driver."""
    return records.limit(limit).toArrow()


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): text files by line."""
    lines = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return lines.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))


def segment_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"\s+"), ""))


def replay(log: DataFrame, until: Column, key: str = "key", time: str = "ts", order: str = "event_id") -> DataFrame:
    """The state that a change log gives up to a time: the last change of each key."""
    rest = [c for c in log.columns if c != key]
    last = log.filter(F.col(time) <= until).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, order)).alias("_r"))
    return last.select(key, "_r.*")
