"""Graph-augmented retrieval: seeds, expansion over all edges, ranking, edges among the best, and a context text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept
from . import graph

SEEDS, HOPS, NODES, BEST = 10, 2, 100, 20


def expanded(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int = NODES) -> DataFrame:
    """(id, hop): at most ``most`` nodes by hop, then id. The cap is this operator's feature; it is a top-k, taken level by level."""
    found = graph.bfs(edges, seeds.select("id"), hops, "both")
    return found.select("id", F.col("depth").alias("hop")).orderBy("hop", "id").limit(most)


def ranked(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, found: DataFrame, k: int = BEST) -> DataFrame:
    """(id, content, hop, score): 0.6 seed + 0.3 / (1 + hop) + 0.1 degree / (degree + 10)."""
    degree = edges.join(found.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    a = found.join(nodes, "id").join(seeds.select("id", F.col("score").alias("seed")), "id", "left").join(degree, "id", "left")
    d = F.coalesce("degree", F.lit(0))
    score = F.round(0.6 * F.coalesce("seed", F.lit(0.0)) + 0.3 / (1 + F.col("hop")) + 0.1 * d / (d + 10), 6)
    return a.select("id", content(a), "hop", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def content(df: DataFrame) -> Column:
    """The first text among content, payload, text, description, name."""
    there = [c for c in ("content", "payload", "text", "description", "name") if c in df.columns]
    return F.coalesce(*[F.col(c).cast("string") for c in there], F.lit("")).alias("content")


def among(edges: DataFrame, best: DataFrame, found: DataFrame) -> DataFrame:
    """Edges from the best nodes into what was found."""
    inside = found.select("id").unionByName(best.select("id")).distinct()
    own = edges.join(best.select(F.col("id").alias("src")), "src", "left_semi")
    return own.join(inside.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "label", "dst")


def context(best: DataFrame, own: DataFrame) -> DataFrame:
    """One row ``context``: the nodes with their lines, then each related pair once. Both inputs are capped by the search."""
    lines = F.array_join(F.transform(F.filter(F.transform(F.split("content", "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("\n  "), x)), "")
    node = F.concat(F.format_string("- Node %s (score: %.4f, hop_distance: %d)", "id", "score", F.col("hop").cast("int")), lines)
    nodes = best.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", node.alias("t")))), lambda x: x["t"]), "\n").alias("n"), F.count("*").alias("c"))
    w = Window.partitionBy("src", "dst").orderBy("label")
    one = own.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    edge = F.format_string("- Node %s --[%s]--> Node %s", "src", "label", "dst")
    edges = one.agg(F.array_join(F.sort_array(F.collect_list(edge)), "\n").alias("e"), F.count("*").alias("m"))
    both = nodes.crossJoin(F.broadcast(edges))  # one row each
    tail = F.when(F.col("m") > 0, F.concat(F.lit("\n\n## Graph Relationships\n"), "e")).otherwise("")
    return both.select(F.when(F.col("c") > 0, F.concat(F.lit("## Relevant Nodes\n"), "n", tail)).otherwise("").alias("context"))


def stats(seeds: DataFrame, found: DataFrame) -> DataFrame:
    f = found.agg(F.count("*").alias("expanded"), F.max("hop").alias("max_hop"))
    s = seeds.agg(F.count("*").alias("seeds"))
    return s.crossJoin(F.broadcast(f)).select("seeds", "expanded", (F.col("seeds") + F.col("expanded")).alias("candidates"), "max_hop")  # one row each


def search(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int = NODES, k: int = BEST) -> dict[str, DataFrame]:
    """``seeds`` (id, score) to ``nodes``, ``edges``, ``context`` and ``stats``. No seeds give empty results."""
    found = kept(expanded(edges, seeds, hops, most))
    best = kept(ranked(nodes, edges, seeds, found, k))
    own = among(edges, best, found)
    return {"nodes": best, "edges": own, "context": context(best, own), "stats": stats(seeds, found)}
