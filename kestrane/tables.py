"""Canonical views of the supplied tables: records, chat messages, and the foreign-key graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: ``namespace, key, payload`` and the metadata ``source, n_chars``."""
    d = load(spark, sf_dir, "documents")
    return d.select(F.col("lang").alias("namespace"), F.col("doc_id").cast("string").alias("key"), F.col("text").alias("payload"), "source", "n_chars", "doc_id")


def labelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the metadata ``quality, toxic``, absent for many."""
    return records(spark, sf_dir).join(load(spark, sf_dir, "labels"), "doc_id", "left")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, name, confidence, importance) of the foreign-key graph."""

    def one(table: str, letter: str, key: str, name: str, kind: str) -> DataFrame:
        return load(spark, sf_dir, table).select(F.concat(F.lit(f"{letter}:"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), F.col(name).cast("string").alias("name"))

    parts = [
        one("region", "R", "r_regionkey", "r_name", "region"),
        one("nation", "N", "n_nationkey", "n_name", "nation"),
        one("supplier", "S", "s_suppkey", "s_name", "supplier"),
        one("customer", "C", "c_custkey", "c_name", "customer"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, label, weight, reverse): forward rows and their mirrored reverse rows."""

    def one(table: str, a: str, key: str, b: str, to: str, label: str) -> DataFrame:
        return load(spark, sf_dir, table).select(
            F.concat(F.lit(f"{a}:"), F.col(key).cast("string")).alias("src"),
            F.concat(F.lit(f"{b}:"), F.col(to).cast("string")).alias("dst"),
            F.lit(label).alias("label"),
        )

    forward = (
        one("nation", "N", "n_nationkey", "R", "n_regionkey", "in_region")
        .unionByName(one("customer", "C", "c_custkey", "N", "c_nationkey", "in_nation"))
        .unionByName(one("supplier", "S", "s_suppkey", "N", "s_nationkey", "in_nation"))
        .withColumn("weight", F.lit(1.0))
        .withColumn("reverse", F.lit(False))
    )
    return mirrored(forward)


def mirrored(forward: DataFrame) -> DataFrame:
    """An edge is stored twice: as it points, and turned round with ``reverse`` set."""
    back = forward.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", "weight", F.lit(True).alias("reverse"))
    return forward.unionByName(back)


#: The same graph as CTEs for DuckDB.
EDGES_SQL = """f AS (
  SELECT 'N:' || n_nationkey AS src, 'R:' || n_regionkey AS dst, 'in_region' AS label FROM nation
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'in_nation' FROM customer
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'in_nation' FROM supplier),
e AS (SELECT src, dst, label, false AS reverse FROM f UNION ALL SELECT dst, src, label, true FROM f),
n AS (SELECT 'R:' || r_regionkey AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 'N:' || n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 'S:' || s_suppkey, 'supplier', s_name FROM supplier
  UNION ALL SELECT 'C:' || c_custkey, 'customer', c_name FROM customer)"""
