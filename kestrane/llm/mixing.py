"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Cells' token sums are raked in turn to the targets of each dimension until the marginals
agree; a cell's weight times its tokens is its share of the mixture. Inclusion probabilities are proportional to weights, calibrated so that
the expected token count is the budget; cells that would exceed probability 1 are held at 1 and the others scaled up to make good.

A document is taken if a hash of its key and the seed lies below its probability, so a sample doesn't depend on partitioning.
Cells are few as a rule; up to ``MAX_CELLS`` they are raked on the driver (a checked size). Beyond that the same steps run as joins and
sums of a distributed table.

Null dimensions form values of their own (``?``); null and empty texts have no tokens, weigh nothing in targets and are taken with their
cell's probability (1 for a cell without tokens). Rows of equal key are taken or left together. A target for an absent value is shared out
among the present ones; a present value without a target gets none; where no target names a present value, the dimension is left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, Scratch, free

MAX_CELLS = 200_000
SWEEPS = 50
TOLERANCE = 1e-9
UNKNOWN = "?"


def tokens(text: Column) -> Column:
    r"""Words (maximal runs of ``[^\x20\x09-\x0D]``) of a text: places where a word begins."""
    t = F.translate(F.coalesce(text, F.lit("")), SEPARATORS[1:], " " * (len(SEPARATORS) - 1))
    return F.size(F.array_remove(F.split(t, " "), "")).cast("long")


def topic(text: Column) -> Column:
    """A coarse kind of content, for tables that have no topic column: tabular, marked-up, emphatic, numeric or prose."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    often = lambda c, share: n - F.char_length(F.replace(t, F.lit(c), F.lit(""))) > n * share
    return (
        F.when(often("|", 0.02), F.lit("tabular"))
        .when(often("#", 0.005) | often("&", 0.005) | often("*", 0.005), F.lit("markup"))
        .when(often("!", 0.01), F.lit("emphatic"))
        .when(t.rlike(r"\d{3}"), F.lit("numeric"))
        .otherwise(F.lit("prose"))
    )


def tempered(sums: Mapping[str, float], power: float = 0.7) -> dict[str, float]:
    """Target shares proportional to a power of the token sums: small values weigh more than they do by nature."""
    up = {k: v**power for k, v in sums.items() if v > 0}
    total = sum(up.values())
    return {k: v / total for k, v in up.items()} if total else {}


def rake(cells: pd.DataFrame, dims: Sequence[str], targets: Mapping[str, Mapping[str, float]], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The mixture's share of each cell: ``n_tokens`` raked to the targets of each dimension in turn."""
    x = cells["n_tokens"].to_numpy(np.float64).copy()
    if not x.sum():
        return x
    x /= x.sum()
    codes, wanted = [], []
    for d in dims:
        code, names = pd.factorize(cells[d], sort=True)
        have = np.bincount(code, x, len(names)) > 0
        want = np.array([targets[d].get(n, 0.0) for n in names]) * have
        if want.sum():
            codes.append(code)
            wanted.append(want / want.sum())
    for _ in range(sweeps):
        off = 0.0
        for code, want in zip(codes, wanted, strict=True):
            now = np.bincount(code, x, len(want))
            off = max(off, float(np.abs(now - want).max()))
            x = x * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[code]
        if off < tolerance:
            break
    return x


def probabilities(share: np.ndarray, n_tokens: np.ndarray, budget: float) -> np.ndarray:
    """Inclusion probability of each cell: min(1, c * share / tokens) with c such that the expected tokens are the budget (as far as cells suffice)."""
    p = np.ones(len(share))
    full = n_tokens <= 0
    open_ = ~full
    while open_.any():
        left = budget - n_tokens[~open_].sum()
        total = share[open_].sum()
        if total <= 0:
            p[open_] = 0.0
            break
        p[open_] = max(left, 0.0) * share[open_] / total / n_tokens[open_]
        over = open_ & (p >= 1)
        if not over.any():
            break
        p[over] = 1.0
        open_ &= ~over
    return p


def _raked_far(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame], sweeps: int, scratch: Scratch, tolerance: float = TOLERANCE) -> DataFrame:
    """``rake`` for more cells than a driver should hold. ``targets``: tables (value, want). Adds ``share``.

    A dimension's factors are a join of its sums with its targets; what a sum over all values needs is one row.
    """
    total = cells.agg(F.sum("n_tokens")).head()[0] or 1
    now = scratch.keep(cells.withColumn("share", F.col("n_tokens") / F.lit(float(total))))
    for _ in range(sweeps):
        off, wide = [], now
        for d in dims:
            sums = wide.groupBy(d).agg(F.sum("share").alias("s"))
            sums = sums.join(targets[d].select(F.col("value").alias(d), "want"), d, "left").withColumn("want", F.when(F.col("s") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0))
            sums = scratch.keep(sums)
            all_want = sums.agg(F.sum("want")).head()[0] or 0.0
            if not all_want:
                scratch.drop(sums)
                continue
            to = F.col("want") / F.lit(all_want)
            off.append(sums.agg(F.max(F.abs(F.col("s") - to))).head()[0] or 0.0)
            factor = sums.select(d, F.when(F.col("s") > 0, to / F.col("s")).otherwise(0.0).alias("f"))
            after = scratch.keep(wide.join(factor, d).withColumn("share", F.col("share") * F.col("f")).drop("f"))
            scratch.drop(sums, wide)
            wide = after
        now = wide
        if max(off, default=0.0) < tolerance:
            break
    return now


def mixed(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    dims: Mapping[str, Column] | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    power: float = 0.7,
    fraction: float = 0.5,
    seed: int = 11,
    sweeps: int = SWEEPS,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """Adds a struct ``_mix`` (under a free name): the dimensions' values, ``n_tokens``, ``weight`` (mixture share over own share), ``probability`` and ``sampled``.

    ``targets`` default to each dimension's token shares to the ``power``. The budget is ``fraction`` of all tokens.
    """
    dims = dims or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col(text))}
    own = df.columns
    at: dict[str, str] = {}
    for d in dims:
        at[d] = free([*own, *at.values()], f"_{d}")
    n_, weight_, p_ = (free([*own, *at.values()], c) for c in ("_n", "_weight", "_p"))
    keys = list(at.values())
    a = df.withColumns({at[d]: F.coalesce(c.cast("string"), F.lit(UNKNOWN)) for d, c in dims.items()} | {n_: tokens(F.col(text))})
    scratch = Scratch(df.sparkSession)
    cells = scratch.keep(a.groupBy(*keys).agg(F.sum(n_).alias("n_tokens"), F.count("*").alias("n_docs")))
    if cells.count() <= max_cells:
        c = cells.toPandas().sort_values(keys, ignore_index=True)
        full = {at[d]: (targets or {}).get(d) or tempered(c.groupby(at[d])["n_tokens"].sum().to_dict(), power) for d in dims}
        share = rake(c, keys, full, sweeps)
        mass = c["n_tokens"].to_numpy(np.float64)
        c[p_] = probabilities(share, mass, fraction * mass.sum())
        c[weight_] = np.divide(share * mass.sum(), mass, out=np.zeros(len(c)), where=mass > 0)
        if len(c):
            table = df.sparkSession.createDataFrame(c[[*keys, weight_, p_]], ", ".join(f"`{x}` string" for x in keys) + f", `{weight_}` double, `{p_}` double")
            out = a.join(F.broadcast(table), keys, "left")  # at most ``max_cells`` rows
        else:
            out = a.withColumns({weight_: F.lit(0.0), p_: F.lit(1.0)})
    else:
        want = {}
        for d in dims:
            if targets and targets.get(d):
                want[at[d]] = df.sparkSession.createDataFrame([(k, float(v)) for k, v in targets[d].items()], "value string, want double")
            else:
                want[at[d]] = scratch.keep(cells.groupBy(F.col(at[d]).alias("value")).agg(F.sum("n_tokens").alias("s")).select("value", F.pow("s", F.lit(power)).alias("want")))
        far = _raked_far(cells, keys, want, sweeps, scratch)
        total = float(cells.agg(F.sum("n_tokens")).head()[0] or 0)
        budget = factor = fraction * total
        chance = lambda c: F.when(F.col("n_tokens") > 0, F.least(F.lit(1.0), F.lit(c) * F.col("share") / F.col("n_tokens"))).otherwise(1.0)
        while True:  # raise the factor until the expectation meets the budget: each turn but the last fills another cell
            got, open_ = far.agg(F.sum(chance(factor) * F.col("n_tokens")), F.sum(F.when(chance(factor) < 1, chance(factor) * F.col("n_tokens")))).head()
            if not open_ or abs(got - budget) <= 1e-9 * budget:
                break
            factor *= (budget - (got - open_)) / open_
        weight = F.when(F.col("n_tokens") > 0, F.col("share") * total / F.col("n_tokens")).otherwise(0.0)
        table = scratch.keep(far.select(*keys, weight.alias(weight_), chance(factor).alias(p_)))
        scratch.drop(far, *want.values())
        out = a.join(table, keys, "left")
    scratch.drop(cells)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    fields = [F.col(at[d]).alias(d) for d in dims]
    mix = F.struct(*fields, F.col(n_).alias("n_tokens"), F.col(weight_).alias("weight"), F.col(p_).alias("probability"), (u < F.col(p_)).alias("sampled"))
    return out.select(*own, mix.alias(free(own, "_mix")))


def sample(df: DataFrame, **options) -> DataFrame:
    """The documents that the calibrated probabilities take, with the columns they came with."""
    return mixed(df, **options).filter(F.col(f"{free(df.columns, '_mix')}.sampled")).select(*df.columns)
