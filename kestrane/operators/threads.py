"""Message threads as two tables: threads (thread_id, title, created_at, updated_at, ttl, expires_at) and messages (thread_id, role, content, at).

Times and spans of life are whole seconds; a thread without a span (null or 0) never expires. Every change gives new frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _expiry(at: Column) -> Column:
    return F.when(F.col("ttl") > 0, at + F.col("ttl"))


def created(threads: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Threads with those of ``new`` (thread_id, title, ttl) added; an id that is taken stays as it is."""
    own = new.dropDuplicates(["thread_id"]).join(threads.select("thread_id"), "thread_id", "left_anti")
    own = own.select("thread_id", "title", now.alias("created_at"), now.alias("updated_at"), "ttl", _expiry(now).alias("expires_at"))
    return threads.unionByName(own)


def sent(threads: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(threads, messages, refused): messages appended and their threads' lives renewed; refused are those of threads that aren't there."""
    ids = threads.select("thread_id")
    good = new.join(ids, "thread_id", "left_semi")
    last = good.groupBy("thread_id").agg(F.max("at").alias("_at"))
    moved = threads.join(last, "thread_id", "left")
    later = F.greatest("updated_at", "_at")  # nulls are skipped
    moved = moved.withColumn("expires_at", F.when(F.col("_at").isNull(), F.col("expires_at")).otherwise(_expiry(later)))
    return moved.withColumn("updated_at", later).drop("_at"), messages.unionByName(good), new.join(ids, "thread_id", "left_anti")


def deleted(threads: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the threads whose ids ``gone`` lists."""
    ids = gone.select("thread_id").distinct()
    return threads.join(ids, "thread_id", "left_anti"), messages.join(ids, "thread_id", "left_anti")


def purged(threads: DataFrame, messages: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the threads that have expired by ``now``."""
    return deleted(threads, messages, threads.filter(F.col("expires_at") < now))
