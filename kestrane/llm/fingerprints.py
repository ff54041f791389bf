"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes sets chunk boundaries wherever it is -1 modulo the block size; each chunk gives one of 64 characters.
A fingerprint is ``block:signature:signature at twice the block``. Block sizes are 3 * 2^k. Fingerprints are compared by edit
distance (built-in ``levenshtein``) where they have a block size in common, else their likeness is 0. The block size starts from the length
and goes down while there are few boundaries, then up while there are more than a signature holds, so every part of a text counts.

A null text counts as empty; the empty text's fingerprint is ``3::``. Equal texts have equal fingerprints and likeness 1. Texts are
hashed whole. A fingerprint needs its own row alone; all hashing is vectorised in numpy over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_bounded, beside, lean

ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
LENGTH = 64  # of a signature at most, with the last chunk's character
LEAST = 3
WINDOW = 7
ROLL = np.uint32(0x9E3779B1)
M = 0x5851F42D4C957F2D | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    """Powers of M and of its inverse mod 2^64, for texts of n bytes."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), 1 << 16)
        inv = pow(M, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _powers = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, M, np.uint64)])
            _inverse = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, inv, np.uint64)])


def _rolling(b: np.ndarray) -> np.ndarray:
    """A mixed hash of the last seven bytes at each place."""
    x = b.astype(np.uint32) + np.uint32(1)
    r = np.zeros(len(b), np.uint32)
    for j in range(min(WINDOW, len(b))):
        r[j:] = r[j:] + x[: len(b) - j] * np.uint32(pow(int(ROLL), j + 1, 1 << 32))
    r ^= r >> np.uint32(15)
    r *= np.uint32(0x85EBCA6B)
    r ^= r >> np.uint32(13)
    return r


def _signature(prefix: np.ndarray, ends: np.ndarray, n: int) -> bytes:
    """A character for each chunk; chunks end after each place in ``ends``. What follows the last boundary is one more chunk."""
    stops = ends + 1
    if not len(stops) or stops[-1] != n:
        stops = np.r_[stops, n]
    starts = np.r_[0, stops[:-1]]
    h = (prefix[stops] - prefix[starts]) * _inverse[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)].tobytes()


def fingerprint(text: bytes) -> str:
    """The fingerprint of a text's UTF-8 bytes."""
    n = len(text)
    if not n:
        return f"{LEAST}::"
    _grow(n + 1)
    with np.errstate(over="ignore"):
        b = np.frombuffer(text, np.uint8)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=prefix[1:])
        r = _rolling(b)
        k = 0
        while LEAST * (1 << k) * LENGTH < n:
            k += 1
        # r = -1 mod 3 * 2^k implies the same mod 3 * 2^(k-1): each block size's boundaries are among the smaller one's
        least = np.flatnonzero(r % np.uint32(LEAST) == LEAST - 1)
        own = r[least].astype(np.int64)
        bounds = lambda k: least[own % (LEAST << k) == (LEAST << k) - 1]
        ends = bounds(k)
        while k and len(ends) < LENGTH // 2 - 1:
            k -= 1
            ends = bounds(k)
        while len(ends) > LENGTH - 1:  # ends by the block that exceeds every hash
            k += 1
            ends = bounds(k)
        block, twice = LEAST << k, bounds(k + 1)
        return f"{block}:{_signature(prefix, ends, n).decode()}:{_signature(prefix, twice, n).decode()}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: one minus edit distance over the longer signature, at the best block size that both have; 1 if equal."""
    x, y = F.split(a, ":"), F.split(b, ":")
    size = lambda c: c[0].cast("long")

    def near(s: Column, t: Column) -> Column:
        longest = F.greatest(F.char_length(s), F.char_length(t))
        return F.when(longest > 0, 1 - F.levenshtein(s, t) / longest).otherwise(F.lit(0.0))

    return (
        F.when(a == b, F.lit(1.0))
        .when(size(x) == size(y), F.greatest(near(x[1], y[1]), near(x[2], y[2])))
        .when(size(x) == 2 * size(y), near(x[1], y[2]))
        .when(2 * size(x) == size(y), near(x[2], y[1]))
        .otherwise(F.lit(0.0))
        .cast("double")
    )


def fingerprinted(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each row's whole text."""
    return beside(df, [out], [], lambda inner, name: _fingerprinted(inner, name(text), out))


def _fingerprinted(df: DataFrame, text: str, out: str) -> DataFrame:
    batches_bounded(df.sparkSession)
    schema = df.select("*", F.lit("").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((x.as_py() or "").encode()) for x in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(lean(run), schema)


RANGE_BYTES = 8 << 20  # of the texts of a range, about (a longer text stands alone)
CUTS = 1023  # from quantiles; beyond them the keys between two cuts are divided evenly
BROADCAST_RANGES = 2_000_000  # first keys, 12 bytes each, go to every executor; more meet the rows by a shuffle


def _range_of(key: str, cuts: list[int], lo: int, hi: int, parts: int) -> Column:
    """The number of a key's range; ranges ascend with the keys, and null keys are in the first. Cuts make ``len(cuts) + 1`` intervals of
    about equal rows, each divided into ``parts``. Halving keeps the expression as deep as the logarithm of the cuts."""

    def between(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        mid = (a + b) // 2
        return F.when(F.col(key) > cuts[mid], between(mid + 1, b)).otherwise(between(a, mid))

    interval = between(0, len(cuts))
    if parts == 1:
        return interval
    edges = [lo - 1, *cuts, hi]
    start = F.element_at(F.array([F.lit(float(x)) for x in edges[:-1]]), interval + 1)
    width = F.element_at(F.array([F.lit(float(max(b - a, 1))) for a, b in zip(edges, edges[1:])]), interval + 1)
    part = F.floor((F.col(key).cast("double") - start) / width * parts).cast("int")
    return interval * parts + F.coalesce(F.least(F.greatest(part, F.lit(0)), F.lit(parts - 1)), F.lit(0))


def with_next(df: DataFrame, key: str, text: str, schema: str, use: Callable[[object, str, object, str], tuple], rows_each: int = 4000) -> DataFrame:
    """``use(key, text, next key, next text)`` for each row and its successor by ascending key; the first row follows the last.

    The texts are shuffled once, by key range, a range to a task; there are as many ranges as rows and bytes call for. Range bounds and each
    range's first key come from the keys alone. A range's task gets, besides its rows, the first row of the range after it. Keys are integers;
    rows of equal key are ordered by text.
    """
    spark = df.sparkSession
    batches_bounded(spark, 1000)
    a = df.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    whole = a.agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("size"), F.min("k").alias("lo"), F.max("k").alias("hi")).head()
    count = max(1, -(-whole["n"] // rows_each), -(-(whole["size"] or 0) // RANGE_BYTES))
    cuts, parts = [], 1
    if count > 1 and whole["lo"] is not None:
        parts = -(-count // (CUTS + 1))
        share = -(-count // parts)
        found = a.select(F.percentile_approx("k", [i / share for i in range(1, share)], 20 * share).alias("p")).head() if share > 1 else None
        cuts = sorted({int(x) for x in (found[0] if found else [])})
    count = (len(cuts) + 1) * parts
    a = a.withColumn("p", _range_of("k", cuts, whole["lo"], whole["hi"], parts) if whole["lo"] is not None else F.lit(0))
    least = F.min(F.struct(F.col("k").isNotNull().alias("known"), "k")).alias("x")  # a null key is the first
    firsts = [(r["p"], r["x"]["k"]) for r in a.groupBy("p").agg(least).sort("p").collect()]
    before = [(k, firsts[i - 1][0]) for i, (_, k) in enumerate(firsts)]  # first key of a range, and the range before it
    lenders = spark.createDataFrame(before, "first long, _lent int")
    lenders = F.broadcast(lenders) if len(before) <= BROADCAST_RANGES else lenders
    own = F.struct(F.col("p").alias("p"), F.lit(0).alias("lent"))
    b = a.join(lenders, F.col("k").eqNullSafe(F.col("first")), "left")
    b = b.withColumn("_to", F.when(F.col("_lent").isNotNull(), F.array(own, F.struct(F.col("_lent").alias("p"), F.lit(1).alias("lent")))).otherwise(F.array(own)))
    b = b.select("k", "t", F.inline("_to"))
    b = b.repartitionById(count, "p").sortWithinPartitions("p", "lent", F.col("k").asc_nulls_first(), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (range, lent, key, text) of the row before; lent rows of equal key beyond the first of a range are not its successor
        last = None
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        for batch in batches:
            out = []
            for p, is_lent, k, t in zip(*(batch.column(c).to_pylist() for c in ("p", "lent", "k", "t")), strict=True):
                if last is not None and last[0] == p and not last[1]:
                    out.append(use(last[2], last[3], k, t))
                last = (p, is_lent, k, t)
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=pa_schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = spark.createDataFrame([], schema).schema
    pa_schema = to_arrow_schema(spark_schema)
    return b.mapInArrow(lean(run), spark_schema)
