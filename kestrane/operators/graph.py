"""Graph traversal and analytics over ``edges(src, dst, label, weight, reverse)``.

Loops run on the driver, one job a level; each level is written to the shared folder, so plans stay short. A frontier is made distinct before
it is joined, so a hub is expanded once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept

#: Levels after which their tables are written as one.
MERGE_EVERY = 8


def directed(edges: DataFrame, direction: str = "forward", labels: Sequence[str] = ()) -> DataFrame:
    """Edges to follow: by their stored ``reverse`` flag, and by label if any is given."""
    out = edges
    if direction == "forward":
        out = out.filter(~F.col("reverse"))
    elif direction == "reverse":
        out = out.filter(F.col("reverse"))
    elif direction != "both":
        raise ValueError(f"unknown direction {direction}")
    return out.filter(F.col("label").isin(*labels)) if labels else out


def _roots(spark: SparkSession, roots: Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(roots, DataFrame):
        return roots.select(F.col(roots.columns[0]).cast("string").alias("id"))
    return spark.createDataFrame([(r,) for r in roots], "id string")


def bfs(edges: DataFrame, roots: Sequence[str] | DataFrame, max_depth: int | None = None, direction: str = "forward", labels: Sequence[str] = ()) -> DataFrame:
    """(id, depth): everything reachable within ``max_depth`` (None: at any depth); roots at 0, ids without a row of their own included."""
    step = directed(edges, direction, labels).select("src", "dst")
    seen = kept(_roots(edges.sparkSession, roots).distinct().withColumn("depth", F.lit(0)))
    front = seen
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        reached = front.select(F.col("id").alias("src")).join(step, "src").select(F.col("dst").alias("id")).distinct()
        front = kept(reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if depth % MERGE_EVERY == 0:
            seen = kept(seen)
    return seen


def traverse(edges: DataFrame, nodes: DataFrame, start: str, label: str | None, least: int, most: int) -> DataFrame:
    """(id, depth) between two depths, start excluded; a start that isn't there is an error."""
    if nodes.filter(F.col("id") == start).isEmpty():
        raise KeyError(f"node {start} not found")
    found = bfs(edges, [start], most, labels=[label] if label else ())
    return found.filter((F.col("depth") >= max(least, 1)) & (F.col("depth") <= most))


def discovered(edges: DataFrame, roots: Sequence[str] | DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """(src, dst, label, weight): the outgoing edges of everything reachable from the roots, to be kept ready for later walks."""
    step = directed(edges, "forward", labels)
    found = bfs(edges, roots, labels=labels).select(F.col("id").alias("src"))
    return step.join(found, "src", "left_semi").select("src", "dst", "label", "weight")


def dfs(edges: DataFrame, root: str, max_depth: int, labels: Sequence[str] = (), limit: int = 1_000_000) -> DataFrame:
    """(id, preorder): depth-first order of the sub-graph found within ``max_depth``, neighbours in ascending order.

    Which nodes are reached is found distributed; preorder is sequential by nature, so the found edges are walked in one task. A sub-graph of
    more than ``limit`` edges is refused.
    """
    step = directed(edges, "forward", labels)
    found = bfs(edges, [root], max_depth, labels=labels)
    own = step.join(found.filter(F.col("depth") < max_depth).select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").distinct()
    own = kept(own)
    if own.count() > limit:
        raise ValueError("sub-graph too large for a preorder")

    def run(batches):
        import pyarrow as pa

        out: dict[str, list[str]] = {}
        for b in batches:
            for r in b.to_pylist():
                out.setdefault(r["src"], []).append(r["dst"])
        order, seen, stack = [], set(), [root]
        while stack:
            now = stack.pop()
            if now in seen:
                continue
            seen.add(now)
            order.append(now)
            stack.extend(x for x in sorted(out.get(now, ()), reverse=True) if x not in seen)
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.string()), pa.array(range(len(order)), pa.int32())], names=["id", "preorder"])

    return own.coalesce(1).mapInArrow(run, "id string, preorder int")


def topo_levels(edges: DataFrame, roots: Sequence[str] | DataFrame | None = None) -> tuple[DataFrame, bool]:
    """((id, level), is it acyclic): layers of Kahn's algorithm on the forward edges (of what roots reach, if given), however many.

    Level = the longest path to a node. Nodes on or behind a cycle get no level.
    """
    step = directed(edges).select("src", "dst").distinct()
    if roots is not None:
        inside = bfs(edges, roots).select("id")
        step = step.join(inside.select(F.col("id").alias("src")), "src", "left_semi")
        all_ids = inside
    else:
        all_ids = step.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    left, open_ = kept(all_ids), kept(step)
    done = left.withColumn("level", F.lit(0)).limit(0)
    for level in count():
        free = kept(left.join(open_.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            return done, left.isEmpty()
        done = done.unionByName(free)
        left = kept(left.join(free.select("id"), "id", "left_anti"))
        open_ = kept(open_.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
        if (level + 1) % MERGE_EVERY == 0:
            done = kept(done)  # one table instead of one for each level


def is_dag(edges: DataFrame, roots: Sequence[str] | DataFrame | None = None) -> bool:
    return topo_levels(edges, roots)[1]


def accumulated(edges: DataFrame, roots: Sequence[str], max_depth: int, delta: Column, direction: str = "forward") -> DataFrame:
    """(id, acc): for every expanded node (not the last level) the sum of ``delta`` over its out-edges."""
    found = bfs(edges, roots, max_depth, direction)
    own = directed(edges, direction).join(found.filter(F.col("depth") < max_depth).select(F.col("id").alias("src")), "src", "left_semi")
    return own.groupBy(F.col("src").alias("id")).agg(F.sum(delta).alias("acc"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6, checkpoint_every: int = 5, roots: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """(id, rank): parallel edges count each; nodes without out-edges spread their rank evenly. ``tolerance``: stop at that L1 change (None: never).
    ``roots``: only the sub-graph that forward edges reach from them is ranked.

    The sum over dangling nodes is taken in the same job as the contributions, as a row for a node that doesn't exist.
    """
    if roots is not None:
        nodes = kept(nodes.join(bfs(edges, roots).select("id"), "id", "left_semi"))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    step = directed(edges).select("src", "dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    degree = step.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out"))
    step = kept(step)
    rank = kept(nodes.select("id").distinct().join(degree, "id", "left").withColumn("rank", F.lit(1.0 / n)))
    for i in range(rounds):
        given = rank.filter("out is not null").select(F.col("id").alias("src"), (F.col("rank") / F.col("out")).alias("part")).join(step, "src")
        got = given.groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        loose = rank.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        new = rank.withColumnRenamed("rank", "old").join(got, "id", "left").crossJoin(F.broadcast(loose))  # one row
        new = new.select("id", "out", "old", (F.lit((1 - damping) / n) + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        check = tolerance is not None
        new = kept(new) if check or (i + 1) % checkpoint_every == 0 else new
        if check and new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).head()[0] < tolerance:
            return new.select("id", "rank")
        rank = new.select("id", "out", "rank")
    return rank.select("id", "rank")


def degrees(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) within a set of ids, in one aggregation."""
    step = directed(edges).select("src", "dst").join(inside.select(F.col("id").alias("src")), "src", "left_semi")
    ends = step.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    zero = inside.select("id", F.lit(0).alias("i"), F.lit(0).alias("o"))
    return ends.unionByName(zero).groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def neighbours(edges: DataFrame, nodes: DataFrame, start: str) -> DataFrame:
    """(id, label, type, name) one hop away."""
    own = edges.filter(F.col("src") == start).select(F.col("dst").alias("id"), "label")
    return own.join(nodes, "id", "left")


def page(nodes: DataFrame, after: str | None, limit: int = 100) -> DataFrame:
    """The next nodes by id after one: a pushed filter and a top-k."""
    return (nodes if after is None else nodes.filter(F.col("id") > after)).orderBy("id").limit(limit)


def engine_stats(nodes: DataFrame, edges: DataFrame, records: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row of counts over the whole store. Each table is scanned once, for the columns that it counts."""
    one = nodes.agg(F.count("*").alias("nodes"))
    two = edges.agg(F.count("*").alias("edges"))
    three = records.agg(F.count("*").alias("records"), F.countDistinct("namespace").alias("namespaces"))
    four = vectors.agg(F.count(vector).alias("vectors"))
    return one.crossJoin(F.broadcast(two)).crossJoin(F.broadcast(three)).crossJoin(F.broadcast(four)).select("nodes", "edges", "records", "vectors", "namespaces")  # one row each


def integrity(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: dangling edges, self loops, nodes without an edge, mean out-degree."""
    ids = nodes.select("id").distinct()
    there = edges.select("src", "dst").join(ids.select(F.col("id").alias("src"), F.lit(1).alias("a")), "src", "left").join(ids.select(F.col("id").alias("dst"), F.lit(1).alias("b")), "dst", "left")
    e = there.agg(F.count("*").alias("edges"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("dangling"), F.count_if(F.col("src") == F.col("dst")).alias("self_loops"))
    touched = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.join(touched.withColumn("t", F.lit(1)), "id", "left").agg(F.count("*").alias("nodes"), F.count_if(F.col("t").isNull()).alias("orphans"))
    both = e.crossJoin(F.broadcast(n))  # one row each
    return both.select("nodes", "edges", "dangling", "self_loops", "orphans", F.round(F.col("edges") / F.col("nodes"), 6).alias("mean_degree"))


def add_edge(edges: DataFrame, src: str, dst: str, label: str, weight: float = 1.0) -> DataFrame:
    """Writes the edge and its mirrored row."""
    new = edges.sparkSession.createDataFrame([(src, dst, label, weight, False), (dst, src, label, weight, True)], "src string, dst string, label string, weight double, reverse boolean")
    return edges.unionByName(new)


def remove_edge(edges: DataFrame, src: str, dst: str, label: str) -> DataFrame:
    own = (F.col("label") == label) & (((F.col("src") == src) & (F.col("dst") == dst) & ~F.col("reverse")) | ((F.col("src") == dst) & (F.col("dst") == src) & F.col("reverse")))
    return edges.filter(~own)


def without_node(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter((F.col("src") != node) & (F.col("dst") != node))


def map_accumulate(deltas: DataFrame, node: str, delta: str, fold: Callable[[Column], Column] = F.sum) -> DataFrame:
    return deltas.groupBy(node).agg(fold(F.col(delta)).alias("acc"))
