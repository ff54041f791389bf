r"""Near-duplicate groups: banded MinHash, sequential Bayesian verification, exact confirmation.

A text's set: its distinct shingles of ``width`` words (``[^\x20\x09-\x0D]+`` after lower-casing A-Z), as 64-bit hashes; with fewer words
the whole sequence is one shingle; without words the set is empty and the text is linked with nothing. Texts whose sets have a Jaccard
similarity of at least ``percent`` / 100 are linked; a group is a connected component of links, named by its smallest id.

1. Equal sets (128-bit digest) are one class from the start, represented by its smallest id, however many rows it has.
2. Signatures of ``BANDS * ROWS`` minima; classes that agree in a whole band share a bucket.
3. The first ``FIRST`` bands' buckets are dealt in blocks of bounded size, a member in one block of each bucket. A block's task prunes its
   pairs by the sequential test, confirms survivors on full sets and returns a forest: at most m - 1 links for m members. Most of a
   large group is one component after that.
4. Members of buckets that still hold several components meet in pairs of blocks. A first pass returns only which members have a pair
   of different components that passes the test (a pair counts in the first bucket that it shares); these members' full sets are then
   sent to their blocks, which confirm and return a forest again. So nothing that leaves a task grows with the square of a group.
5. The sequential test compares signatures in batches. A pair is pruned as soon as the posterior probability (uniform prior) that its
   similarity reaches the threshold falls below ``MISS``. That bounds each checkpoint, not their sum: the README states the whole miss rate.
6. Components of the links: alternating large-star and small-star steps; links never leave the executors.

Ids may be of any type with an order. Null ids are dropped by ``components`` (they can name no group) and kept by ``keep_one``. Rows of
equal id are one document, which is linked with whatever one of its texts is linked with; its set size is the largest of its texts'.
Written tables in the shared folder cut the lineage, so a lost executor costs the tasks it held.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, batches_bounded, lean, no_memo

BANDS, ROWS = 32, 5
BAND_BITS = 5  # low bits of a bucket's key: the band
HASHES = BANDS * ROWS
MISS = 1e-6
BATCH = 16
FIRST = 4
BLOCK = 512  # members of a block at most
BLOCK_BYTES = 8 << 20  # of a block's sets, about (a larger set stands alone)

_rng = np.random.default_rng(20240607)
_A = (_rng.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)


#: Odd multipliers of the hashes.
_M, _MIX, _LAST = 0x5851F42D4C957F2D, np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_PIECE = 1 << 20
_bytes = np.arange(256, dtype=np.uint64)
_LOWER = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + np.uint64(33), _bytes + np.uint64(1))  # A-Z as a-z; one more, so that none is 0
_WORD = ~(((_bytes >= 9) & (_bytes <= 13)) | (_bytes == 32))
_SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the multiplier and of its inverse mod 2^64."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, m, np.uint64)]) for m in (_M, pow(_M, -1, 1 << 64))]
    return _powers


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word in order: a polynomial over its bytes, from differences of running sums, in pieces cut between words."""
    data, out, at = text.encode("utf-8", "surrogatepass"), [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(len(data), at + _PIECE)
        if end < len(data):
            found = _SEPARATOR.search(data, end)
            end = found.start() if found else len(data)
        b = np.frombuffer(data, np.uint8, end - at, at)
        edges = np.flatnonzero(np.diff(np.r_[False, _WORD[b], False]))
        starts, ends = edges[::2], edges[1::2]
        up, down = _power_tables(len(b) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(_LOWER[b] * up[: len(b)], out=sums[1:])
            h = (sums[ends] - sums[starts]) * down[starts]
            h ^= h >> np.uint64(32)
            out.append(h * _MIX + (ends - starts).astype(np.uint64))
        at = end
    return np.concatenate(out)


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text. A text of fewer words has one, which also depends on how many they are."""
    h = word_hashes(text)
    if not len(h):
        return h
    short = len(h) < width
    n, steps = (1, len(h)) if short else (len(h) - width + 1, width)
    with np.errstate(over="ignore"):
        out = np.full(n, steps if short else 0, np.uint64)
        for j in range(steps):
            out = (out ^ h[j : j + n]) * _MIX
            out ^= out >> np.uint64(29)
        out *= _LAST
        out ^= out >> np.uint64(32)
    out.sort()
    first = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=first[1:])
    return out[first]


def signature(s: np.ndarray) -> np.ndarray:
    """The minima of ``HASHES`` linear permutations of the shingles' hashes."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        out = np.minimum(out, (_A[:, None] * x[None, i : i + 512] + _B[:, None]).min(axis=1))
    return out


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """For each batch's end: the fewest agreeing bytes at which P(similarity >= threshold | agreements) is at least ``miss``.

    One byte of each minimum is kept; unequal minima agree in it by chance once in 256 times.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    high = s >= threshold
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        like = np.exp(log - log.max(1, keepdims=True))
        posterior = like[:, high].sum(1) / like.sum(1)
        out.append(int(np.argmax(posterior >= miss)))
    return np.array(out)


def survives(low: np.ndarray, p: np.ndarray, other: np.ndarray, q: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (row p of ``low``, row q of ``other``) pass every batch. Pruned pairs are compared no further."""
    alive = np.arange(len(p))
    same = np.zeros(len(p), np.int64)
    for k, least_k in enumerate(least):
        if not len(alive):
            break
        part = slice(k * BATCH, (k + 1) * BATCH)
        same[alive] += (low[p[alive], part] == other[q[alive], part]).sum(1)
        alive = alive[same[alive] >= least_k]
    out = np.zeros(len(p), bool)
    out[alive] = True
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band: a hash of its minima, and the band's number in the low bits."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            key = (key ^ sig.reshape(BANDS, ROWS)[:, j].astype(np.uint64)) * _MIX
            key ^= key >> np.uint64(29)
        return ((key << np.uint64(BAND_BITS)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _features(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no_memo()
        for batch in batches:
            n, digest, bands, low = [], [], [], []
            for text in batch.column("t"):
                s = shingles(text.as_py(), width)
                n.append(len(s))
                digest.append(_digest(s))
                sig = signature(s) if len(s) else None
                low.append((sig >> np.uint32(12)).astype(np.uint8).tobytes() if len(s) else None)
                bands.append(_band_keys(sig) if len(s) else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*bands, np.zeros(0, np.int64)])))],
                names=["id", "n", "digest", "low", "bands"],
            )

    return docs.mapInArrow(lean(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, digest binary, low binary, bands array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(digest, elements) of each row: its set in full, made anew from the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), width) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["digest", "elements"])

    return docs.mapInArrow(lean(run), "digest binary, elements binary")


class Members:
    """Members of buckets, as arrays: consecutive rows of equal (key, x, y) are a group, which compares its sides x and y."""

    def __init__(self, rows: pa.Table):
        longs = lambda c: rows.column(c).to_numpy().astype(np.int64, copy=False)
        self.key, self.x, self.y, self.side, self.c, self.n = map(longs, ("key", "x", "y", "side", "c", "n"))
        self.id = rows.column("id").combine_chunks()
        self.comp = rows.column("comp").combine_chunks().dictionary_encode().indices.to_numpy()
        self.low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, HASHES)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        self.elements = [np.frombuffer(x, np.uint64) for x in rows.column("elements").to_pylist()] if "elements" in rows.column_names else []

    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.r_[True, (self.key[1:] != self.key[:-1]) | (self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1])])

    def pairs(self, s: int, e: int, percent: int, least: np.ndarray, once: bool) -> tuple[np.ndarray, np.ndarray]:
        """The group's pairs of different components that their sizes allow and that pass the sequential test; with ``once``, only those
        that share no band before this bucket's."""
        if self.x[s] == self.y[s]:
            p, q = np.triu_indices(e - s, 1)
        else:
            one, two = np.flatnonzero(self.side[s:e] == self.x[s]), np.flatnonzero(self.side[s:e] == self.y[s])
            p, q = np.repeat(one, len(two)), np.tile(two, len(one))
        p, q = p + s, q + s
        near = (self.comp[p] != self.comp[q]) & (100 * np.minimum(self.n[p], self.n[q]) >= percent * np.maximum(self.n[p], self.n[q]))
        p, q = p[near], q[near]
        kept = survives(self.low, p, self.low, q, least)
        p, q = p[kept], q[kept]
        if once and len(p):
            band = int(self.key[s]) & (BANDS - 1)
            own = ~(self.bands[p, :band] == self.bands[q, :band]).any(1)
            p, q = p[own], q[own]
        return p, q

    def forest(self, p: np.ndarray, q: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """Of the pairs, confirmed on full sets, enough to join all that they join. ``p`` ascends."""
        used = np.unique(np.r_[p, q])
        parts = [self.elements[i] for i in used]
        _, names = np.unique(np.concatenate(parts), return_inverse=True)
        ends = np.cumsum([0, *map(len, parts)])
        at_p, at_q = np.searchsorted(used, p), np.searchsorted(used, q)
        comp, mark = self.comp[used].copy(), np.zeros(int(names.max()) + 1, bool)
        size = np.diff(ends)
        cuts = np.flatnonzero(np.r_[True, at_p[1:] != at_p[:-1]])
        for s, e in zip(cuts, np.r_[cuts[1:], len(at_p)], strict=True):
            i = at_p[s]
            others = at_q[s:e][comp[at_q[s:e]] != comp[i]]
            if not len(others):
                continue
            own = names[ends[i] : ends[i + 1]]
            mark[own] = True
            both = np.array([np.count_nonzero(mark[names[ends[j] : ends[j + 1]]]) for j in others])
            mark[own] = False
            for j in others[100 * both >= percent * (size[i] + size[others] - both)]:
                if comp[j] != comp[i]:
                    comp[comp == comp[j]] = comp[i]
                    yield int(used[i]), int(used[j])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Members]:
    """Members of whole groups, about a batch at a time."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
        end = [rows.column(c)[-1].as_py() for c in ("key", "x", "y")]
        same = np.logical_and.reduce([rows.column(c).to_numpy() == v for c, v in zip(("key", "x", "y"), end, strict=True)])
        cut = int(np.argmax(same))  # the last group may go on
        held = rows.slice(cut)
        if cut:
            yield Members(rows.slice(0, cut))
    if held is not None:
        yield Members(held)


def _links(rows: DataFrame, percent: int, least: np.ndarray, once: bool) -> DataFrame:
    """Confirmed links (a, b) within the groups of ``rows``: a forest of each."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _groups(batches):
            a, b, new = [], [], m.starts()
            for s, e in zip(new, np.r_[new[1:], len(m.key)], strict=True):
                p, q = m.pairs(s, e, percent, least, once)
                for i, j in m.forest(p, q, percent) if len(p) else ():
                    a.append(i)
                    b.append(j)
            if a:
                yield pa.RecordBatch.from_arrays([m.id.take(pa.array(a)), m.id.take(pa.array(b))], names=["a", "b"])

    return rows.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _likely(rows: DataFrame, percent: int, least: np.ndarray) -> DataFrame:
    """(key, x, y, side, c): the members that have a pair which passes the test, once in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in _groups(batches):
            found, new = [np.zeros(0, np.int64)], m.starts()
            for s, e in zip(new, np.r_[new[1:], len(m.key)], strict=True):
                found.append(np.unique(np.concatenate(m.pairs(s, e, percent, least, True))))
            at = np.concatenate(found)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(v[at]) for v in (m.key, m.x, m.y, m.side, m.c)], names=["key", "x", "y", "side", "c"])

    return rows.mapInArrow(lean(run), "key long, x long, y long, side long, c long")


def _together(rows: DataFrame) -> DataFrame:
    """Groups side by side, each in one task."""
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "c")


def connected(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, comp) for each id of links (a, b): ``comp`` is the smallest id it is connected with.

    Alternating stars until nothing changes; each step's table has at most as many rows as there are links.
    """

    def large(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        return out.select("x.a", "x.b").filter("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())

    now = scratch.keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = mark(now)
    while seen[0]:
        new = scratch.keep(small(large(now)))
        scratch.drop(now)
        now, before, seen = new, seen, mark(new)
        if seen == before:
            break
    members = now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    out = scratch.keep(members.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()))
    scratch.drop(now)
    return out


#: Ids are broadcast up to this number (8 bytes each); beyond it rows meet by a shuffle.
BROADCAST_IDS = 2_000_000


def _by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, n: int) -> DataFrame:
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, comp) for each distinct id: the size of its set and the smallest id of its group."""
    spark: SparkSession = df.sparkSession
    batches_bounded(spark)
    scratch = Scratch(spark)
    least = least_matches(percent / 100)
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).filter("id is not null")
    features = scratch.keep(_features(docs, width))
    own = [F.first(c).alias(c) for c in ("n", "low", "bands")]  # a class's rows have these in common
    classes = features.filter("n > 0").groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("size"), *own)
    classes = scratch.keep(classes.withColumn("c", F.monotonically_increasing_id()))  # a number of each class, fixed as it is written
    copies = classes.filter("size > 1").select("digest", F.col("id").alias("rep"))
    member = scratch.keep(features.select("id", "n", "digest").join(copies, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    scratch.drop(features)

    keys = classes.select("c", F.col("n").cast("int").alias("n"), F.explode("bands").alias("key"))
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("long").alias("blocks")
    sizes = keys.groupBy("key").agg(F.count("*").alias("members"), blocks).filter("members > 1").select("key", "blocks")
    buckets = scratch.keep(keys.select("c", "key").join(sizes, "key"))  # members of buckets that have company; what follows reads it and ``reps``
    company = classes.join(buckets.select("c").distinct(), "c", "left_semi").select("c", "id", "n", "digest", "low", "bands")
    ids = scratch.keep(company.select("id").distinct())
    sets = _sets(_by_ids(docs, ids, "id", "left_semi", ids.count()), width).groupBy("digest").agg(F.first("elements").alias("elements"))
    reps = scratch.keep(company.join(sets, "digest").drop("digest"))
    scratch.drop(classes, ids)

    side = F.pmod(F.xxhash64("c"), F.col("blocks"))
    band = F.col("key").bitwiseAND(BANDS - 1)
    first = buckets.filter(band < FIRST).withColumn("side", side).select("key", F.col("side").alias("x"), F.col("side").alias("y"), "side", "c")
    first = _together(first.join(reps, "c").withColumn("comp", F.col("id")))
    links = scratch.keep(_links(first, percent, least, once=False))
    # rows of one id with unlike texts
    several = member.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a")
    several = member.join(several, "id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()
    begun = connected(links.unionByName(several), scratch)

    # buckets of the first bands that had one block have been dealt with
    now = buckets.filter((band >= FIRST) | (F.col("blocks") > 1)).join(reps.drop("elements"), "c")
    now = now.join(begun, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    span = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    now = now.join(span, "key", "left_semi").withColumn("side", side)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    now = now.select("*", other).withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})
    likely = scratch.keep(_likely(_together(now.select("key", "x", "y", "side", "c", "id", "n", "low", "bands", "comp")), percent, least))
    rest = likely.join(reps, "c").join(begun, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    more = scratch.keep(_links(_together(rest), percent, least, once=True))
    comp = connected(begun.select(F.col("id").alias("a"), F.col("comp").alias("b")).unionByName(more), scratch)
    out = member.join(comp.withColumnRenamed("id", "rep"), "rep", "left")
    out = scratch.keep(out.groupBy("id").agg(F.max("n").alias("n_shingles"), F.min(F.coalesce("comp", "rep")).alias("comp")))
    scratch.drop(buckets, reps, member, links, likely, more, begun, comp)
    return out


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of which each stands for its group (the smallest id), with the columns they came with.

    Rows with a null id stay; rows of equal id stay or go together.
    """
    names = df.columns
    found = components(df, key, text, width, percent)
    gone = found.filter("id <> comp").select(F.col("id").alias(key))
    return _by_ids(df, gone, key, "left_anti", gone.count()).select(*names)
