"""Vector expressions over ``array<float|double>``. One rule for odd inputs: unequal lengths give null, a zero norm gives cosine 0."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    under = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(under == 0, F.lit(0.0)).otherwise(dot(a, b) / under)


def squared_l2(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), _fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def squared_l2_from_norms(norm_a: Column, norm_b: Column, product: Column) -> Column:
    return norm_a * norm_a + norm_b * norm_b - 2 * product


def squared_l2_of_units(cos: Column) -> Column:
    return 2 * (1 - cos)


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def _scale(v: Column) -> Column:
    m = max_abs(v)
    return F.when(m < 1.1920929e-07, F.lit(1.0)).otherwise(m)


def _half_away(x: Column) -> Column:
    """Rounds half away from zero, as a signed integer."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("int")


def sq8(v: Column) -> Column:
    """(codes in -127..127, largest magnitude)."""
    m = _scale(v)
    return F.struct(F.transform(doubles(v), lambda x: F.greatest(F.least(_half_away(x * 127 / m), F.lit(127)), F.lit(-127))).alias("codes"), m.alias("scale"))


def sq8_dot(a: Column, b: Column) -> Column:
    return dot(a["codes"], b["codes"]) * a["scale"] * b["scale"] / (127.0 * 127.0)


def four_bit(v: Column) -> Column:
    """(codes in -8..7, largest magnitude)."""
    m = _scale(v)
    return F.struct(F.transform(doubles(v), lambda x: F.greatest(F.least(_half_away(x * 7 / m), F.lit(7)), F.lit(-8))).alias("codes"), m.alias("scale"))


def four_bit_dot(a: Column, b: Column) -> Column:
    return dot(a["codes"], b["codes"]) * a["scale"] * b["scale"] / 49.0


def sign_bits(v: Column) -> Column:
    """Bits x > 0 packed into longs of 64, the last one padded with zeros."""
    bits = F.transform(doubles(v), lambda x: (x > 0).cast("int"))
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 64).cast("int"))
    return F.transform(
        words,
        lambda w: F.aggregate(F.slice(bits, w * 64 + 1, F.lit(64)), F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).alias("i")), lambda z, b: F.struct(z["x"].bitwiseOR(F.call_function("shiftleft", b.cast("long"), z["i"])).alias("x"), (z["i"] + 1).alias("i")), lambda z: z["x"]),
    )


def sign_likeness(a: Column, b: Column) -> Column:
    """1 - hamming / (64 * words)."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return 1 - apart / (64.0 * F.size(a))


def hashed(tokens: DataFrame, key: str, token: str, dims: int = 64) -> DataFrame:
    """(key, embedding): an offline stand-in for an embedding model. Each token adds 1 or -1 to one dimension, both from its MD5; the sum has
    length 1. ``tokens`` holds a row per token; keys without tokens get no row."""
    code = F.md5(F.encode(token, "UTF-8"))
    at = F.conv(F.substr(code, F.lit(1), F.lit(6)), 16, 10).cast("long") % dims
    sign = F.when(F.conv(F.substr(code, F.lit(7), F.lit(1)), 16, 10).cast("int") < 8, 1).otherwise(-1)
    sums = tokens.filter(F.col(token).isNotNull()).groupBy(key, at.alias("_at")).agg(F.sum(sign).cast("double").alias("_v"))
    by = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_v"))).alias("_m"), F.sqrt(F.sum(F.col("_v") * F.col("_v"))).alias("_norm"))
    value = lambda i: F.coalesce(F.try_element_at(F.col("_m"), i), F.lit(0.0)) / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)
    return by.select(key, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), value).alias("embedding"))


@F.pandas_udf(ArrayType(DoubleType()))
def fwht(v: pd.Series) -> pd.Series:
    """The orthonormal fast Walsh-Hadamard transform; vectors whose length is no power of two come back as they are."""

    def one(x):
        if x is None:
            return None
        x = np.asarray(x, np.float64)
        n = len(x)
        if n == 0 or n & (n - 1):
            return x
        h = 1
        while h < n:
            y = x.reshape(-1, 2, h)
            x = np.stack([y[:, 0] + y[:, 1], y[:, 0] - y[:, 1]], axis=1).reshape(-1)
            h *= 2
        return x / np.sqrt(n)

    return v.map(one)
