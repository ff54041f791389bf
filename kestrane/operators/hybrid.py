"""Hybrid retrieval: routes, candidate budgets, reciprocal rank fusion, searches over several namespaces, and ranking quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import knn, text_index

RRF_K = 60


def route(text: str | None, vector: Sequence[float] | None) -> str:
    has = bool(text and text.strip())
    return "hybrid" if has and vector else "text" if has else "vector" if vector else "empty"


def budget(k: int) -> int:
    return max(k, min(max(4 * k, 32), 256))


def fused(*arms: DataFrame, k: int, offset: int = 1, constant: int = RRF_K) -> DataFrame:
    """Sum of 1 / (constant + place from 0 + offset) over the arms: (namespace, key, rrf_score). Arms: (namespace, key, score), each at most a
    candidate budget long, so ranking them in one task is bounded."""
    out = None
    for i, arm in enumerate(arms):
        w = Window.orderBy(F.desc("score"), "key", "namespace")
        ranked = arm.select("namespace", "key", (F.row_number().over(w) - 1).alias("place")).withColumn("arm", F.lit(i))
        out = ranked if out is None else out.unionByName(ranked)
    assert out is not None
    each = out.groupBy("namespace", "key").agg(
        F.round(F.sum(1.0 / (constant + F.col("place") + offset)), 6).alias("rrf_score"),
        *[F.max(F.when(F.col("arm") == i, F.col("place") + 1)).alias(f"rank_{i}") for i in range(len(arms))],
    )
    return each.orderBy(F.desc("rrf_score"), "key", "namespace").limit(k)


def search(records: DataFrame, text: str | None, vector: Sequence[float] | None, k: int, keep: Column | None = None, metric: str = "cosine", vector_column: str = "embedding") -> DataFrame:
    """(namespace, key, score ...) by the route that the request has. Filters hold in both arms."""
    kind = route(text, vector)
    if kind == "empty" or k <= 0:
        return records.select("namespace", "key", F.lit(0.0).alias("score")).limit(0)
    wide = budget(k) if kind == "hybrid" else k
    lexical = text_index.bm25(records, text, wide, keep).select("namespace", "key", "score") if kind in ("text", "hybrid") else None
    near = knn.top(records.filter(F.col(vector_column).isNotNull()), vector, wide, "key", vector_column, metric, keep).select("namespace", "key", "score") if kind in ("vector", "hybrid") else None
    if kind == "text":
        return lexical
    if kind == "vector":
        return near
    return fused(lexical, near, k=k).withColumnRenamed("rrf_score", "score")


def fusion_report(lexical: DataFrame, near: DataFrame) -> DataFrame:
    """Candidates of each arm, and of both together."""
    both = lexical.select("namespace", "key", F.lit(1).alias("t"), F.lit(0).alias("v")).unionByName(near.select("namespace", "key", F.lit(0).alias("t"), F.lit(1).alias("v")))
    each = both.groupBy("namespace", "key").agg(F.max("t").alias("t"), F.max("v").alias("v"))
    return each.agg(F.sum("t").alias("text_candidates"), F.sum("v").alias("vector_candidates"), F.count("*").alias("fused_candidates"), F.lit(RRF_K).alias("rrf_k"))


def search_multi(records: DataFrame, namespaces: Sequence[str] | None, text: str, k: int) -> DataFrame:
    """Top k within each namespace (None: all), merged by raw score, top k of all. The inner top-k is pruned before the shuffle."""
    a = records if namespaces is None else records.filter(F.col("namespace").isin(*namespaces))
    hits = text_index.scored(a, text_index.plan(text))
    w = Window.partitionBy("namespace").orderBy(F.desc("score"), "key")
    per = hits.select("namespace", "key", "score").withColumn("ns_rank", F.row_number().over(w)).filter(F.col("ns_rank") <= k)
    return per.orderBy(F.desc("score"), "namespace", "key").limit(k)


def relevance(distance: Column) -> Column:
    return 1 - distance / 2


def quality(ranked: DataFrame, judged: DataFrame, k: int, total: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg, mrr, recall) with binary relevance. ``ranked``: (query_id, key, rank); ``judged``: (query_id, key), the relevant ones.

    Where ``total`` (query_id, relevant) gives the number of relevant ones, ``judged`` needs to hold those among the ranked only.
    """
    total = judged.groupBy("query_id").agg(F.count("*").alias("relevant")) if total is None else total
    hit = ranked.filter(F.col("rank") <= k).join(judged.withColumn("_hit", F.lit(1)), ["query_id", "key"], "left")
    gain = F.when(F.col("_hit") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = hit.groupBy("query_id").agg(F.sum(gain).alias("dcg"), F.min(F.when(F.col("_hit") == 1, F.col("rank"))).alias("first"), F.sum(F.coalesce("_hit", F.lit(0))).alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = got.join(total, "query_id")
    return out.select("query_id", F.round(F.col("dcg") / ideal, 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / F.col("relevant"), 6).alias("recall"))
