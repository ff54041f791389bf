"""The record store on DataFrames: a log of versions, reads of its latest state, life cycle, statistics.

A store is an immutable frame of versions; every change gives a new frame. Latest states come from one aggregation by (namespace, key).
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import filters

NAMESPACE = re.compile(r"[A-Za-z0-9._/-]{1,128}")
RESERVED = "__kestrane_"


def check_namespace(name: str) -> str:
    if not NAMESPACE.fullmatch(name):
        raise ValueError(f"bad namespace {name!r}")
    return name


def check_key(key: str) -> str:
    if not 1 <= len(key.encode()) <= 512 or "\0" in key:
        raise ValueError(f"bad key {key!r}")
    return key


def check_metadata(names: Sequence[str]) -> None:
    for n in names:
        if n.startswith(RESERVED) or "\0" in n:
            raise ValueError(f"bad metadata key {n!r}")


def record_id(namespace: Column, key: Column) -> Column:
    """A text id that follows from (namespace, key)."""
    return F.md5(F.concat(namespace, F.lit("\0"), key))


def visible(df: DataFrame, now: Column, expires: str = "expires_at") -> DataFrame:
    """Hides expired rows: no expiry, a zero one, or one not yet passed stays."""
    return df.filter(F.col(expires).isNull() | (F.unix_millis(F.col(expires).cast("timestamp")) == 0) | (F.col(expires) >= now))


def purged(df: DataFrame, now: Column, expires: str = "expires_at") -> tuple[DataFrame, DataFrame]:
    """(what stays, what is purged)."""
    gone = F.coalesce((F.unix_millis(F.col(expires).cast("timestamp")) != 0) & (F.col(expires) < now), F.lit(False))
    return df.filter(~gone), df.filter(gone)


def latest(log: DataFrame, by: Sequence[str] = ("namespace", "key"), order: Sequence[str] = ("version",)) -> DataFrame:
    """The last version of each record. An aggregation (partial before the shuffle), so a record with very many versions is no hot spot."""
    rest = [c for c in log.columns if c not in by]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return log.groupBy(*by).agg(pick).select(*by, "_r.*")


def put(store: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Upserts (namespace, key, ...): version + 1 and the first creation time kept; new records begin at version 1."""
    old = store.groupBy("namespace", "key").agg(F.max("version").alias("_v"), F.min("created_at").alias("_c"))
    new = incoming.join(old, ["namespace", "key"], "left")
    new = new.withColumn("version", F.coalesce("_v", F.lit(0)) + 1).withColumn("created_at", F.coalesce("_c", now)).withColumn("updated_at", now).drop("_v", "_c")
    return store.unionByName(new, allowMissingColumns=True)


def delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("namespace", "key").distinct(), ["namespace", "key"], "left_anti")


def delete_by_filter(store: DataFrame, namespace: str, spec: Mapping[str, object]) -> DataFrame:
    if not spec:
        raise ValueError("a deletion needs a filter")
    return store.filter(~((F.col("namespace") == namespace) & filters.matches(store, spec)))


def get(store: DataFrame, namespace: str, key: str) -> DataFrame:
    return store.filter((F.col("namespace") == namespace) & (F.col("key") == key))


def get_many(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("namespace", "key").distinct(), ["namespace", "key"], "left_semi").orderBy("namespace", "key")


def list_page(store: DataFrame, namespace: str, limit: int = 100, cursor: int = 0, spec: Mapping[str, object] | None = None) -> DataFrame:
    """Rows ``cursor`` .. ``cursor + limit`` by key, after filtering. Offsets read what they skip; ``list_after`` doesn't."""
    a = store.filter(F.col("namespace") == namespace)
    a = a.filter(filters.matches(store, spec)) if spec else a
    return a.orderBy("key").offset(cursor).limit(limit)


def list_after(store: DataFrame, namespace: str, after: str | None, limit: int = 100, spec: Mapping[str, object] | None = None) -> DataFrame:
    """Keyset paging: the next rows after a key, as a pushed filter and a top-k."""
    a = store.filter(F.col("namespace") == namespace)
    a = a.filter(filters.matches(store, spec)) if spec else a
    a = a if after is None else a.filter(F.col("key") > after)
    return a.orderBy("key").limit(limit)


def namespaces(store: DataFrame) -> DataFrame:
    return store.select("namespace").filter("namespace is not null").distinct().orderBy("namespace")


def collection_stats(store: DataFrame, size: Column, vector: Column, created: Column) -> DataFrame:
    return store.groupBy("namespace").agg(
        F.count("*").alias("total_records"), F.sum(size).alias("total_bytes"), F.count_if(vector.isNotNull()).alias("vector_count"), F.min(created).alias("first_created")
    )


def snapshot(versions: DataFrame, at: Column, created: str = "created_at", deleted: str = "deleted_at") -> DataFrame:
    """What was there at a time: created by then and not yet deleted."""
    return versions.filter((F.col(created) <= at) & (F.col(deleted).isNull() | (F.col(deleted) > at)))


def collected(versions: DataFrame, before: Column, deleted: str = "deleted_at") -> DataFrame:
    """Drops versions deleted before the cutoff."""
    return versions.filter(F.col(deleted).isNull() | (F.col(deleted) >= before))


def restored(log: DataFrame, at: Column, time: str = "ts", by: Sequence[str] = ("key",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """Point-in-time recovery from a change log: the last change of each key up to a time."""
    return latest(log.filter(F.col(time) <= at), by, order)


def keep_score(hits: Column, confidence: Column, importance: Column, age_s: Column, weights: Sequence[float] = (1.0, 2.0, 3.0, 1.0)) -> Column:
    """Worth of keeping a row: weighted hits, confidence, importance and recency 1 / ln(1 + age)."""
    recency = 1 / F.log1p(F.greatest(age_s, F.lit(1.0)))
    return hits * weights[0] + confidence * weights[1] + importance * weights[2] + recency * weights[3]


def bayes_score(hits: Column, age_s: Column, alpha: float = 1.0, beta: float = 1.0) -> Column:
    up = hits + alpha
    return up / (up + beta + F.greatest(age_s, F.lit(0.0)))


def evict(df: DataFrame, score: Column, ratio: float, key: str) -> DataFrame:
    """The lowest ``ratio`` of all rows by score, ties by key: a top-k, not a full ranking."""
    n = int(df.count() * ratio)
    return df.withColumn("score", F.round(score, 6)).orderBy("score", key).limit(n)


#: Items of a session that one row holds, about; larger sessions are split by a hash of the item.
SESSION_BLOCK = 1000


#: Bits after the point in counts that are halved; a session more halvings old counts nothing.
AGE_BITS = 50


def aged(sessions: DataFrame, key: str, every: int) -> DataFrame:
    """Adds ``_age``: how often counts are halved after each session, once every ``every`` sessions in ascending order of ``key``.

    Sessions are numbered in ranges of the key, so no task orders them all; only the ranges' counts meet in one.
    """
    parted = kept(sessions.repartitionByRange(key).withColumn("_part", F.spark_partition_id()))
    counts = parted.groupBy("_part").agg(F.count("*").alias("_in"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_in").over(before), F.lit(0)).alias("_start"), F.sum("_in").over(Window.partitionBy()).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(key))) - 1 + F.col("_start")
    age = F.floor((F.col("_all") - 1) / every) - F.floor(F.col("_place") / every)
    return parted.join(starts, "_part").withColumn("_place", place).withColumn("_age", age).drop("_part", "_start", "_all", "_place")


def session_blocks(events: DataFrame, session: str, item: str, halve_every: int = 1000) -> DataFrame:
    """(_s, _blocks, _age, _block, _items): the distinct items of each session of two or more, in blocks of about ``SESSION_BLOCK``."""
    own = events.select(F.col(session).alias("_s"), F.col(item).alias("_x")).filter("_x is not null").distinct()
    sizes = own.groupBy(F.col("_s").alias("_of")).agg(F.count("*").alias("_n")).filter("_n > 1")
    sizes = aged(sizes.select("_of", F.ceil(F.col("_n") / SESSION_BLOCK).alias("_blocks")), "_of", halve_every)
    dealt = own.join(sizes, F.col("_s").eqNullSafe(F.col("_of"))).withColumn("_block", F.pmod(F.xxhash64("_x"), F.col("_blocks")))
    return dealt.groupBy("_s", "_blocks", "_age", "_block").agg(F.sort_array(F.collect_list("_x")).alias("_items"))


def co_access(events: DataFrame, session: str, item: str, least: int = 3, most: int = 8, halve_every: int = 1000) -> DataFrame:
    """(a, b, n): items seen together in sessions, counts of at least ``least``, the ``most`` most frequent for each a.

    Sessions are made distinct first and follow one another by their key; after every ``halve_every`` sessions of two items or more, all counts
    so far are halved and rounded down. Rounding down again and again equals rounding once at the end, so a count is one sum of whole
    numbers, each shifted by its session's age. Blocks of a session meet one another in pairs, dealt over tasks, so no row or task holds a
    large session and no session meets another.
    """
    blocks = session_blocks(events, session, item, halve_every)
    with_self = blocks.select(F.posexplode("_items").alias("_i", "a"), "_items", "_age")
    with_self = with_self.select("_age", "a", F.explode(F.slice("_items", F.col("_i") + 2, F.size("_items"))).alias("b"))
    others = blocks.filter("_blocks > 1").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).filter("_j <> _block")
    met = others.groupBy("_s", "_age", F.least("_block", "_j").alias("_lo"), F.greatest("_block", "_j").alias("_hi")).agg(F.collect_list("_items").alias("_two"))
    crossed = met.filter(F.size("_two") == 2).select("_age", F.explode(F.col("_two")[0]).alias("_x"), F.col("_two")[1].alias("_other"))
    crossed = crossed.select("_age", "_x", F.explode("_other").alias("_y"))
    pairs = with_self.unionByName(crossed.select("_age", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))
    share = F.when(F.col("_age") > AGE_BITS, F.lit(0)).otherwise(F.expr(f"shiftleft(1L, {AGE_BITS} - cast(_age as int))"))
    n = pairs.groupBy("a", "b").agg(F.shiftright(F.sum(share), AGE_BITS).alias("n")).filter(F.col("n") >= least)
    w = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    return n.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def friction(events: DataFrame, origin: str, confidence: str, order: str) -> DataFrame:
    """(origin, collisions, ema, friction): log2(n + 1) times a moving average (0.8 old, 0.2 new) that starts at the first confidence.

    The average after n events is 0.8^(n) c1 + sum of 0.2 * 0.8^(n-i) c_i over all i, so it's a sum over ranks rather than a fold.
    """
    w = Window.partitionBy(origin).orderBy(order)
    ranked = events.select(origin, confidence, F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy(origin)).alias("n"))
    part = F.col(confidence) * (0.2 * F.pow(F.lit(0.8), F.col("n") - F.col("i")) + F.when(F.col("i") == 1, F.pow(F.lit(0.8), F.col("n"))).otherwise(0.0))
    out = ranked.groupBy(origin).agg(F.max("n").alias("collisions"), F.round(F.sum(part), 6).alias("ema"))
    return out.withColumn("friction", F.round(F.log2(F.col("collisions") + 1) * F.col("ema"), 6))


def cardinality(df: DataFrame, fields: Sequence[str], most: int = 100) -> DataFrame:
    """(field, value, n, share): how often each field holds each value, as text, nulls included; the ``most`` most frequent values of a field.

    One scan for all fields; values are counted before they are ranked.
    """
    both = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    n = df.select(F.inline(both)).groupBy("field", "value").agg(F.count("*").alias("n"))
    n = n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    return n.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def compacted(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Rewrites a table in files of a bounded number of rows, clustered by namespace and key."""
    df.repartitionByRange("namespace", "key").sortWithinPartitions("namespace", "key").write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)


def recovered(archive: DataFrame, edges: DataFrame, summary: str) -> DataFrame:
    """Archived nodes that belonged to a summary."""
    own = edges.filter((F.col("label") == "belonged_to") & (F.col("dst") == summary)).select(F.col("src").alias("id"))
    return archive.join(own.distinct(), "id", "left_semi")


def bitset_superset(df: DataFrame, bits: str, mask: int) -> DataFrame:
    return df.filter(F.col(bits).bitwiseAND(F.lit(mask)) == mask)


def role_rows(df: DataFrame, role: str, owner: str = "_owner_role") -> DataFrame:
    """Rows of a role; ``admin`` sees all."""
    return df if role == "admin" else df.filter(F.col(owner) == role)


def threads(messages: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    out = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))
    return out.orderBy("conv_id").offset(offset).limit(limit)


def thread(messages: DataFrame, conv_id: int) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def any_of(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))
