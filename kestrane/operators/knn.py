"""Vector search. Single queries are one scan with a top-k; batches of queries meet the table in numpy blocks, each partition keeping k a query.

Scores are higher for nearer: cosine, or minus the Euclidean distance. Rows whose vector is null or of another length are skipped. A query
batch is broadcast only up to about ``MAX_QUERIES`` vectors or ``MAX_VALUES`` numbers; a larger one is worked off in blocks of that size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import batches_bounded, kept

MAX_QUERIES = 10_000
#: Numbers that a block of queries and its results hold at most (one query alone may hold more); queries and rows that are scored at once.
MAX_VALUES, TILE = 1_000_000, (512, 2048)


def similarity(vector: Column, query: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return V.cosine(vector, query)
    if metric in ("euclidean", "l2"):
        return -V.l2(vector, query)
    raise ValueError(f"unknown metric {metric}")


def top(df: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine", keep: Column | None = None, least: float | None = None) -> DataFrame:
    """The k nearest rows, exactly; filters run before the search."""
    a = df if keep is None else df.filter(keep)
    a = a.withColumn("score", F.round(similarity(F.col(vector), V.literal(query), metric), 6)).filter("score is not null")
    if least is not None:
        a = a.filter(F.col("score") >= least)
    return a.orderBy(F.desc("score"), key).limit(max(k, 0))


class Nearest:
    """The k best rows so far of each of some queries of one length, whatever number of rows comes.

    Scores of ``TILE`` queries and rows are in memory at once, and what may be among the k best of them: nearer than the k-th less what rounding
    can move. Only for those is the score worked out as ``similarity`` says, so Euclidean distances are exact where norms are large.
    """

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_self: bool):
        self.ids, self.q, self.k, self.metric, self.skip_self = ids, q, k, metric, skip_self
        with np.errstate(all="ignore"):
            self.near, self.size = self._prepared(q)
        self.keys, self.scores = np.zeros((len(q), k), np.int64), np.full((len(q), k), -np.inf)
        self.have = np.zeros(len(q), np.int64)

    def _prepared(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What products are formed of, and lengths: unit vectors and lengths for cosines, else vectors and squared lengths."""
        if self.metric != "cosine":
            return x, (x**2).sum(1)
        size = np.linalg.norm(x, axis=1)
        return np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] != 0), size

    def add(self, keys: np.ndarray, x: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            for j in range(0, len(x), TILE[1]):
                own = slice(j, j + TILE[1])
                near, size = self._prepared(x[own])
                for i in range(0, len(self.q), TILE[0]):
                    self._tile(slice(i, min(i + TILE[0], len(self.q))), keys[own], x[own], near, size)

    def _tile(self, at: slice, keys: np.ndarray, x: np.ndarray, near: np.ndarray, size: np.ndarray) -> None:
        s, slack = self.near[at] @ near.T, 1.1e-6
        if self.metric != "cosine":  # by norms, so that no array holds queries x rows x dimensions
            s *= -2
            s += self.size[at][:, None]
            s += size
            slack += 2 * np.sqrt(1e-15 * x.shape[1] * (_largest(self.size[at]) + _largest(size)))
            s = -np.sqrt(np.maximum(s, 0.0, out=s), out=s)
        odd = ~np.isfinite(s)  # vectors that aren't finite: all of their pairs are looked at
        some = bool(odd.any())
        if some:
            s[odd] = -np.inf
        same = self.ids[at][:, None] == keys if self.skip_self else None
        if same is not None:
            s[same] = -np.inf
        least = np.where(self.have[at] == self.k, self.scores[at, -1], -np.inf) - slack
        may = s >= least[:, None]
        if s.shape[1] > self.k and np.count_nonzero(may) > 4 * self.k * len(s):
            least = np.maximum(least, np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k] - slack)
            may = s >= least[:, None]
        if some:
            may |= odd
        if same is not None:
            may &= ~same
        qi, ri = np.nonzero(may)
        if len(qi):
            self._merge(qi + at.start, keys[ri], np.round(self._scores(qi + at.start, x, ri, s[qi, ri], size), 6))

    def _scores(self, qi: np.ndarray, x: np.ndarray, ri: np.ndarray, s: np.ndarray, size: np.ndarray) -> np.ndarray:
        again = np.flatnonzero(np.isneginf(s)) if self.metric == "cosine" else np.arange(len(s))
        step = max(1, (1 << 20) // max(1, x.shape[1]))
        for i in range(0, len(again), step):
            n = again[i : i + step]
            a, b = self.q[qi[n]], x[ri[n]]
            s[n] = (a * b).sum(1) / (self.size[qi[n]] * size[ri[n]]) if self.metric == "cosine" else -np.sqrt(((a - b) ** 2).sum(1))
        return s

    def _merge(self, qi: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        scores[np.isnan(scores)] = np.inf  # as Spark and SQL order them; no score is infinite upwards
        touched = np.unique(qi)
        old, place = np.nonzero(np.arange(self.k) < self.have[touched][:, None])
        old = touched[old]
        qi, keys, scores = np.concatenate([old, qi]), np.concatenate([self.keys[old, place], keys]), np.concatenate([self.scores[old, place], scores])
        order = np.lexsort((keys, -scores, qi))
        qi, keys, scores = qi[order], keys[order], scores[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        best = place < self.k
        qi, place = qi[best], place[best]
        self.keys[qi, place], self.scores[qi, place] = keys[best], scores[best]
        self.have[touched] = np.bincount(np.searchsorted(touched, qi), minlength=len(touched))

    def rows(self) -> pa.RecordBatch:
        qi, place = np.nonzero(np.arange(self.k) < self.have[:, None])
        scores = self.scores[qi, place]
        scores[np.isposinf(scores)] = np.nan
        return pa.RecordBatch.from_arrays([pa.array(self.ids[qi]), pa.array(self.keys[qi, place]), pa.array(scores)], names=["query_id", "key", "score"])


def _largest(x: np.ndarray) -> float:
    """The largest of the finite values."""
    return float(np.max(x, initial=0.0, where=np.isfinite(x)))


def batch(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "embedding", metric: str = "cosine", skip_self: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the k nearest of every query, exactly.

    Rows are dealt evenly over the cluster's cores; each task meets them with a block of queries in tiles (``Nearest``), so its memory follows
    neither table, and hands on k rows a query. Rows without a key, and vectors with a null within, are skipped.
    """
    if metric not in ("cosine", "euclidean", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = df.sparkSession
    if k <= 0:
        return spark.createDataFrame([], "query_id long, key long, score double, rank int")
    batches_bounded(spark)

    def vectors(a: DataFrame, name: str, value: str) -> DataFrame:
        a = a.select(F.col(name).cast("long").alias("key"), V.doubles(F.col(value)).alias("v"))
        return a.filter(F.col("key").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull()))

    wanted = vectors(queries, query_key, query_vector)
    n, dims = wanted.agg(F.count("*"), F.max(F.size("v"))).head()
    parts = max(1, -(-n // max(1, min(MAX_QUERIES, MAX_VALUES // ((dims or 0) + 2 * k)))))
    table = vectors(df, key, vector).repartition(2 * spark.sparkContext.defaultParallelism, "key")  # one exchange for all blocks
    local = None
    for i in range(parts):
        rows = wanted.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == i).collect()
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        shared = spark.sparkContext.broadcast([(np.array([r["key"] for r in own], np.int64), np.array([r["v"] for r in own], np.float64)) for own in by_dim.values()])
        one = table.mapInArrow(_nearest(shared, k, metric, skip_self), "query_id long, key long, score double")
        local = one if local is None else local.unionByName(one)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _nearest(shared: Broadcast, k: int, metric: str, skip_self: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Nearest(ids, q, k, metric, skip_self) for ids, q in shared.value]
        for b in batches:
            keys, col = b.column("key").to_numpy(), b.column("v")
            sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            for one in best:
                dim = one.q.shape[1]
                own = np.flatnonzero(sizes == dim)
                if len(own):
                    of = col if len(own) == len(sizes) else col.take(pa.array(own))
                    one.add(keys[own], of.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        for one in best:
            yield one.rows()

    return run


def similar_to_key(df: DataFrame, key_value: int, k: int, key: str = "vec_id", vector: str = "embedding", keep: Column | None = None) -> DataFrame:
    """The k rows nearest to a stored row, itself left out before the top-k. The row is read alone; absent rows have no neighbours."""
    own = df.filter(F.col(key) == key_value).select(vector).head()
    if own is None or own[0] is None:
        return df.withColumn("score", F.lit(0.0)).limit(0)
    other = F.col(key) != key_value
    return top(df, own[0], k, key, vector, keep=other if keep is None else other & keep)


def two_stage(df: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", vector: str = "embedding", factor: int = 10) -> DataFrame:
    """Candidates by 8-bit codes, ``factor`` times as many as wanted, then exact scores for those alone."""
    coded = df.withColumn("_coarse", V.sq8_dot(V.sq8(F.col(vector)), V.sq8(V.literal(query))) / V.norm(F.col(vector)))
    near = coded.orderBy(F.desc_nulls_last(F.round("_coarse", 9)), key).limit(k * factor)
    return top(near.drop("_coarse"), query, k, key, vector)


def format_actions(vectors: DataFrame, accesses: DataFrame, now: int, key: str = "vec_id", cold: int = 100, hot: int = 5) -> DataFrame:
    """(key, action) by an access log (key, tick): ``quantize`` what is whole and was last read more than ``cold`` ticks ago or never,
    ``promote`` what is quantised and was read ``hot`` times or more, ``none`` otherwise. ``vectors`` holds (key, quantized)."""
    seen = accesses.groupBy(key).agg(F.count("*").alias("_hits"), F.max("tick").alias("_last"))
    a = vectors.select(key, "quantized").join(seen, key, "left")
    is_cold = F.col("_last").isNull() | (F.lit(now) - F.col("_last") > cold)
    action = F.when(~F.col("quantized") & is_cold, "quantize").when(F.col("quantized") & (F.col("_hits") >= hot), "promote").otherwise("none")
    return a.select(key, action.alias("action"))


def ranges(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(dim, lo, hi): each dimension's range, for codes by dimension."""
    return df.select(F.posexplode(V.doubles(F.col(vector))).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def range_coded(df: DataFrame, bounds: list, vector: str = "embedding") -> DataFrame:
    """Adds ``codes`` in 0..255 by each dimension's range; ``bounds``: (lo, hi) by dimension."""
    lo, wide = V.literal([b[0] for b in bounds]), V.literal([(b[1] - b[0]) or 1.0 for b in bounds])
    share = F.zip_with(F.zip_with(V.doubles(F.col(vector)), lo, lambda x, a: x - a), wide, lambda x, w: x / w)
    return df.withColumn("codes", F.transform(share, lambda x: F.greatest(F.least(F.round(x * 255).cast("int"), F.lit(255)), F.lit(0))))


class Inverted:
    """IVF: k-means cells as a partition column. A search reads the ``probes`` nearest cells; every row is indexed.

    Where no number of probes is given it is the least that reaches the wanted recall against exact search (``probes_for``), so it follows the
    number of cells; as many probes as cells are an exact search.
    """

    def __init__(self, centers: np.ndarray, table: DataFrame, key: str, vector: str):
        self.centers, self.table, self.key, self.vector = centers, table, key, vector
        self._probes: dict[tuple[int, float], int] = {}

    @classmethod
    def build(cls, df: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int | None = None, seed: int = 42, sample: int = 100_000) -> Inverted:
        """Centers are fitted on at most about ``sample`` rows (a documented bound); then all rows are assigned to their nearest one."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        own = df.filter(F.col(vector).isNotNull())
        n = own.count()
        cells = cells or int(n**0.5) + 1
        fit = own if n <= sample else own.filter(F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53) < sample / n)
        model = KMeans(k=cells, seed=seed, maxIter=20, tol=1e-4, distanceMeasure="cosine", featuresCol="_x", predictionCol="cell").fit(fit.select(array_to_vector(V.doubles(F.col(vector))).alias("_x")))
        table = model.transform(own.withColumn("_x", array_to_vector(V.doubles(F.col(vector))))).drop("_x")
        table = kept(table.repartition("cell"), partition="cell")  # a search opens the folders of its cells alone
        return cls(np.array(model.clusterCenters()), table, key, vector)

    def _order(self, queries: np.ndarray) -> np.ndarray:
        """For each query all cells, nearest first."""
        norms = np.linalg.norm(self.centers, axis=1)
        return np.argsort(-(queries @ self.centers.T) / np.where(norms > 0, norms, 1.0), axis=1, kind="stable")

    def probes_for(self, k: int, recall: float = 0.9, most: int = 1000) -> int:
        """The least number of probes whose mean recall of the k nearest other rows reaches ``recall``.

        Recall is measured by brute force for the rows with keys divisible by 20; of more than ``most`` of them, those first by hash.
        """
        if (k, recall) not in self._probes:
            own = self.table.filter((F.col(self.key) % 20 == 0) & (F.size(self.vector) == self.centers.shape[1]))
            rows = own.select(F.col(self.key).cast("long").alias("query_id"), V.doubles(F.col(self.vector)).alias("v")).orderBy(F.xxhash64("query_id"), "query_id").limit(most).collect()
            queries = self.table.sparkSession.createDataFrame([(r["query_id"], r["v"]) for r in rows], "query_id long, v array<double>")
            near = batch(self.table, queries, k, self.key, self.vector, query_vector="v", skip_self=True)
            cells = self.table.select(F.col(self.key).cast("long").alias("key"), "cell")
            found = near.join(cells, "key").select("query_id", "cell").collect()  # most * k rows at most
            needed = np.full(0, 0)
            if found:
                at = {r["query_id"]: i for i, r in enumerate(rows)}
                rank = np.argsort(self._order(np.array([r["v"] for r in rows], np.float64)), axis=1)
                needed = np.sort([rank[at[r["query_id"]], r["cell"]] for r in found]) + 1
            self._probes[k, recall] = int(needed[max(0, int(np.ceil(recall * len(needed))) - 1)]) if len(needed) else len(self.centers)
        return self._probes[k, recall]

    def search(self, query: Sequence[float], k: int, probes: int | None = None, recall: float = 0.9) -> DataFrame:
        order = self._order(np.asarray(query, np.float64)[None])[0][: probes or self.probes_for(k, recall)]
        return top(self.table.filter(F.col("cell").isin(*[int(i) for i in order])), query, k, self.key, self.vector)


class Flat:
    """No structure: a search is one exact scan."""

    def __init__(self, table: DataFrame, key: str, vector: str, metric: str):
        self.table, self.key, self.vector, self.metric = table, key, vector, metric

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        return top(self.table, query, k, self.key, self.vector, metric=self.metric)


class RangeCoded(Flat):
    """Eight bits a dimension, by each dimension's range: the nearest ``factor`` * k rows by their codes are ranked again by whole vectors."""

    def __init__(self, table: DataFrame, key: str, vector: str, metric: str, factor: int = 10):
        self.bounds = [(r["lo"], r["hi"]) for r in ranges(table, vector).sort("dim").collect()]  # as many as dimensions
        super().__init__(kept(range_coded(table, self.bounds, vector)), key, vector, metric)
        self.factor = factor

    def search(self, query: Sequence[float], k: int) -> DataFrame:
        lo, step = V.literal([b[0] for b in self.bounds]), V.literal([(b[1] - b[0]) / 255 for b in self.bounds])
        about = F.zip_with(F.zip_with("codes", step, lambda c, w: c * w), lo, lambda x, a: x + a)
        coarse = self.table.withColumn("_coarse", similarity(about, V.literal(query), self.metric)).filter("_coarse is not null")
        near = coarse.orderBy(F.desc(F.round("_coarse", 9)), self.key).limit(max(k, 0) * self.factor)
        return top(near.drop("_coarse", "codes"), query, k, self.key, self.vector, metric=self.metric)


def make_index(kind: str, df: DataFrame, key: str = "vec_id", vector: str = "embedding", metric: str = "cosine") -> Flat | Inverted:
    """An index by its kind's name; all have ``search(query, k)``. A graph of neighbours is walked a node at a time, which a scan of
    partitions beats here, so the graph kinds search exactly."""
    if kind in ("flat", "hnsw", "diskann"):
        return Flat(df, key, vector, metric)
    if kind == "scann":
        return RangeCoded(df, key, vector, metric)
    if kind == "ivf" and metric == "cosine":
        return Inverted.build(df, key, vector)
    raise ValueError(f"no index of kind {kind} for {metric}")


def mmr(df: DataFrame, query: Sequence[float], k: int = 4, fetch: int = 20, weight: float = 0.5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Greedy re-ranking of the ``fetch`` nearest rows by maximal marginal relevance; relevance is 1 - score / 2 of a distance 1 - cosine.

    The greedy choice is sequential over at most ``fetch`` rows, so one task sees those alone.
    """
    near = top(df, query, fetch, key, vector).select(F.col(key).cast("long").alias("key"), "score", V.doubles(F.col(vector)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (-r["score"], r["key"]))
        if not rows:
            return
        x = np.array([r["v"] for r in rows])
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sims = unit @ unit.T
        gain = np.array([1 - (1 - r["score"]) / 2 for r in rows])
        taken: list[int] = []
        scores = []
        while len(taken) < min(k, len(rows)):
            value = weight * gain - ((1 - weight) * sims[:, taken].max(1) if taken else 0)
            value[taken] = -np.inf
            best = int(np.argmax(np.round(value, 9)))
            taken.append(best)
            scores.append(round(float(value[best]), 6))
        yield pa.RecordBatch.from_pylist([{"rank": i + 1, "key": rows[j]["key"], "mmr_score": s} for i, (j, s) in enumerate(zip(taken, scores, strict=True))], schema=pa.schema([("rank", pa.int32()), ("key", pa.int64()), ("mmr_score", pa.float64())]))

    return near.coalesce(1).mapInArrow(run, "rank int, key long, mmr_score double")
