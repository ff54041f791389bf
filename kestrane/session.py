"""Session defaults, bounds of Arrow batches, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter's configuration holds."""
    base = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def batches_bounded(spark: SparkSession, rows: int = 2000, size: int = 2 << 20) -> None:
    """Arrow batches hold a bounded number of rows and bytes (one longer row stands alone), so that a Python worker's memory follows neither
    the row count nor the length of texts. The settings stay lower for the session, as plans read them when they run."""
    conf = spark.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key, "10000")) <= rows:
        conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(key, "67108864").rstrip("bB")) <= size:
        conf.set(key, f"{size}b")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder that ``spark.checkpoint.dir`` names. A temporary folder serves only a session on one machine that
    names none (tests); elsewhere executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
        root = f"file://{tempfile.gettempdir()}/kestrane-kept"
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def kept(df: DataFrame, partition: str | None = None) -> DataFrame:
    """Writes a frame to the shared folder and reads it again: loops stay short-lined and survive lost executors.

    ``partition``: a column whose values get a folder each. Tables stay for whoever still reads them; the folder is the cluster's to clear.
    """
    path = scratch_path(df.sparkSession, "kept")
    out = df.write.partitionBy(partition) if partition else df.write
    out.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
