"""Statements to DataFrames. Catalyst does the rest: no filter is dropped or reordered here, aliases resolve everywhere.

An entity is a frame of the catalogue, read as rows of that type. ``X#id`` is the row of that id, whatever its type. ``*`` is the frame named
``*``, if the catalogue has one.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import filters, graph, knn
from . import parser as P

HOT, DEEPEST_WHEN_HOT = 0.8, 3
NEAR_K = 5
CONFIDENT = 0.4


@dataclass
class Catalogue:
    """``entities``: name to frame; ``ids``: name to its id column; ``edges`` for SIGUE; ``embed`` turns text into a vector for ``~``."""

    entities: Mapping[str, DataFrame]
    ids: Mapping[str, str] = field(default_factory=dict)
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    embed: Callable[[str], list[float]] | None = None
    vector: str = "embedding"
    subquery_empty_passes: bool = True


class Planner:
    def __init__(self, catalogue: Catalogue):
        self.c = catalogue

    def run(self, text: str) -> DataFrame:
        s = P.parse(text)
        if isinstance(s, P.Select):
            return self.select(s)
        if isinstance(s, P.From):
            return self.from_(s)
        raise TypeError("a change: use Store.apply")

    def scan(self, entity: str) -> DataFrame:
        if entity.startswith("Conflict#"):
            raise ValueError("conflict entities cannot be scanned")
        if "#" in entity:
            kind, key = entity.split("#", 1)
            frames = {kind: self.c.entities[kind]} if kind in self.c.entities else self.c.entities
            for name, df in frames.items():
                column = self.c.ids.get(name, "id")
                if column in df.columns:
                    return df.filter(F.col(column).cast("string") == key)
            raise KeyError(entity)
        if entity not in self.c.entities:
            raise KeyError(f"no entity {entity}")
        return self.c.entities[entity]

    @staticmethod
    def _bare(name: str, aliases: set[str]) -> str:
        head, _, tail = name.partition(".")
        return tail if tail and head in aliases else name

    def _where(self, df: DataFrame, items: tuple, aliases: set[str]) -> DataFrame:
        for c in items:
            if isinstance(c, P.Condition):
                df = df.filter(filters.language_compare(self._bare(c.field, aliases), c.op, c.value, df))
            elif isinstance(c, P.SubqueryCondition):
                df = self._subquery(df, c, aliases)
        near = [c for c in items if isinstance(c, P.Near)]
        plain = any(not isinstance(c, P.Near) for c in items)
        for c in near:
            df = self._near(df, c, filtered=plain)
        return df

    def _near(self, df: DataFrame, c: P.Near, filtered: bool) -> DataFrame:
        """With other conditions: exact refinement of what they keep. Alone: the nearest few of all rows, cut at the least score."""
        if self.c.embed is None:
            return df if filtered else df.limit(0)
        q = self.c.embed(c.text)
        if filtered:
            return df.filter(V.cosine(F.col(self.c.vector), V.literal(q)) >= c.least)
        key = next(x for x in df.columns if x != self.c.vector)
        return knn.top(df, q, NEAR_K, key, self.c.vector, least=c.least).drop("score")

    def _subquery(self, df: DataFrame, c: P.SubqueryCondition, aliases: set[str]) -> DataFrame:
        """The first row's value, as a one-row side; an empty subquery lets all rows pass (or none, by the catalogue's setting)."""
        sub = self.select(c.query)
        if len(sub.columns) != 1:
            raise ValueError("a subquery has one field")
        value = sub.toDF("_sub")
        value = value.filter("_sub is not null").orderBy("_sub").limit(1).withColumn("_one", F.lit(1))
        side = df.sparkSession.range(1, numPartitions=1).select(F.lit(1).alias("_one")).join(value, "_one", "left").drop("_one")  # one row
        name = self._bare(c.field, aliases)
        hit = self._against(name, c.op)
        if self.c.subquery_empty_passes:
            hit = F.col("_sub").isNull() | hit
        return df.crossJoin(F.broadcast(side)).filter(hit).drop("_sub")

    @staticmethod
    def _against(name: str, op: str):
        a, b = F.col(f"`{name}`"), F.col("_sub")
        got = {"=": a == b, "!=": a != b, ">": a > b, ">=": a >= b, "<": a < b, "<=": a <= b}[op]
        return F.coalesce(got, F.lit(op == "!="))

    def from_(self, s: P.From) -> DataFrame:
        df = self.scan(s.entity)
        aliases = {x for x in (s.alias, s.entity, s.walk.alias if s.walk else None) if x}
        if s.walk:
            df = self._walk(df, s)
        df = self._where(df, s.where, aliases)
        if s.role is not None and s.role != "admin":
            df = df.filter(F.col("_owner_role") == s.role) if "_owner_role" in df.columns else df.limit(0)
        if {"type", "confidence"} <= set(df.columns):
            df = df.filter(~F.coalesce((F.col("type") == "SemanticSummary") & (F.col("confidence") < CONFIDENT), F.lit(False)))
        if s.rank_by:
            c = F.col(f"`{self._bare(s.rank_by, aliases)}`")
            df = df.orderBy(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
        if s.fetch:
            df = df.select(*[F.col(f"`{x}`") for x in dict.fromkeys(self._bare(f, aliases) for f in s.fetch) if x in df.columns])
        return df

    def _walk(self, df: DataFrame, s: P.From) -> DataFrame:
        """Nodes reached from the scanned rows, between two depths. A high temperature caps the depth."""
        if self.c.edges is None or self.c.nodes is None:
            raise ValueError("the catalogue has no graph")
        most = min(s.walk.most, DEEPEST_WHEN_HOT) if (s.temperature or 0) > HOT else s.walk.most
        column = self.c.ids.get(s.entity.split("#")[0], "id")
        found = graph.bfs(self.c.edges, df.select(F.col(column).cast("string")), most, labels=[s.walk.label] if s.walk.label else ())
        found = found.filter((F.col("depth") >= max(s.walk.least, 1)) & (F.col("depth") <= most))
        out = self.c.nodes.join(found, "id")
        return out.filter(F.col("type") == s.walk.kind) if s.walk.kind else out

    def select(self, s: P.Select) -> DataFrame:
        aliases = {x for x in (s.entity, s.alias, *(j.entity for j in s.joins), *(j.alias for j in s.joins)) if x}
        own = {s.alias or s.entity: self.scan(s.entity)}
        df = own[s.alias or s.entity]
        for j in s.joins:
            right = self.scan(j.entity)
            name = j.alias or j.entity
            a, b = j.left, j.right
            if a.partition(".")[0] == name and "." in a:
                a, b = b, a
            left_key, right_key = self._bare(a, aliases), self._bare(b, aliases)
            # a null equals a null here; names that clash keep the left side's value
            rest = [c for c in right.columns if c not in df.columns]
            r = right.select(F.col(f"`{right_key}`").alias("_right"), *[F.col(f"`{c}`") for c in rest])
            df = df.join(r, F.col(f"`{left_key}`").eqNullSafe(F.col("_right"))).drop("_right")
        df = self._where(df, s.where, aliases)
        if s.fields != ("*",):
            df = df.select(*[F.col(f"`{x}`") for x in dict.fromkeys(self._bare(f, aliases) for f in s.fields) if x in df.columns])
        return df


@dataclass
class Store:
    """Nodes, edges and messages that statements change; each change gives new frames (nothing is written in place)."""

    nodes: DataFrame
    edges: DataFrame
    messages: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Store:
        return cls(
            spark.createDataFrame([], "id string, type string, fields map<string,string>, embedding array<double>"),
            spark.createDataFrame([], "src string, dst string, label string, weight double, reverse boolean"),
            spark.createDataFrame([], "thread string, seq long, role string, text string"),
        )

    def _has(self, node: str) -> bool:
        return not self.nodes.filter(F.col("id") == node).isEmpty()

    def apply(self, text: str) -> int:
        """Number of rows that a change affected."""
        s = P.parse(text)
        spark = self.nodes.sparkSession
        if isinstance(s, P.InsertNode):
            fields = {k: None if v is None else str(v) for k, v in s.fields.items()}
            new = spark.createDataFrame([(s.id, s.kind, fields, list(s.vector) if s.vector else None)], self.nodes.schema)
            self.nodes = self.nodes.filter(F.col("id") != s.id).unionByName(new)
            return 1
        if isinstance(s, P.UpdateNode):
            if not self._has(s.id):
                raise KeyError(f"node {s.id} not found")
            own = F.col("id") == s.id
            if s.vector is not None:
                self.nodes = self.nodes.withColumn("embedding", F.when(own, V.literal(s.vector)).otherwise(F.col("embedding")))
            else:
                add = F.create_map(*[F.lit(x) for k, v in s.fields.items() for x in (k, None if v is None else str(v))])
                kept = F.map_filter("fields", lambda k, v: ~k.isin(*s.fields))
                self.nodes = self.nodes.withColumn("fields", F.when(own, F.map_concat(kept, add)).otherwise(F.col("fields")))
            return 1
        if isinstance(s, P.DeleteNode):
            there = self._has(s.id)
            self.nodes = self.nodes.filter(F.col("id") != s.id)
            self.edges = graph.without_node(self.edges, s.id)
            return int(there)
        if isinstance(s, P.Relate):
            for node in (s.src, s.dst):
                if not self._has(node):
                    raise KeyError(f"node {node} not found")
            self.edges = graph.add_edge(self.edges, s.src, s.dst, s.label, s.weight)
            return 1
        if isinstance(s, P.InsertMessage):
            seq = self.messages.filter(F.col("thread") == s.thread).count()
            node = f"message:{s.thread}:{seq}"
            row = (node, "message", {"role": s.role, "content": s.text}, None)
            self.nodes = self.nodes.unionByName(spark.createDataFrame([row], self.nodes.schema))
            self.messages = self.messages.unionByName(spark.createDataFrame([(s.thread, seq, s.role, s.text)], self.messages.schema))
            self.edges = graph.add_edge(self.edges, node, f"thread:{s.thread}", "belongs_to_thread")
            return 2
        raise TypeError("not a change")
