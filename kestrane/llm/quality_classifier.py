"""Quality classifier by positive-unlabelled learning.

A linear model over a text's word shapes, hashed words and repetition is trained in numpy to minimise the non-negative unbiased risk
``prior * E_p[loss(f)] + max(0, E_u[loss(-f)] - prior * E_p[loss(-f)])`` with logistic loss, from trusted positives, unlabelled
texts and an estimated class prior. The negative part never goes below zero: where a batch would push it there, the step is reversed.

The prior is estimated from positives and unlabelled texts alone. Half of them trains a discriminator between the two; on the other half
the share of unlabelled texts over the share of positives above a score is, at its least over all scores, the prior, since what scores
highest is positive. The score is chosen where a confidence bound is least.

The model is fitted on a bounded sample: about ``positives`` texts labelled 1 and ``unlabelled`` texts without regard to labels, one for each
id (documented bounds, both of them); every text is scored whole. As the model is linear in word counts, a word's share of the score is computed once for each distinct word that a worker meets.
Null and empty texts have no words and get the score of the bare model, between 0 and 1. Equal texts get equal scores.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, batches_bounded, beside, hash_share, lean, worker_memo

SHAPES, WORDS, LENGTHS, SHARES = 256, 512, 6, 10
CELLS = (LENGTHS + 1) * (SHARES + 1)
WIDTH = SHAPES + WORDS + CELLS + SHARES + 1
_SHAPE = str.maketrans({**{chr(c): "X" for c in range(65, 91)}, **{chr(c): "x" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}})
_RUN = re.compile(r"(.)\1+")


def _upper(c: str) -> str:
    return "X" if c.isupper() else "x" if c.isalpha() else c


def shape(word: str) -> str:
    """Letters become X or x, digits 9; runs of a sign become two."""
    out = word.translate(_SHAPE)
    if not out.isascii():
        out = "".join(map(_upper, out))
    return _RUN.sub(r"\1\1", out)[:12]


def buckets(words: list[str]) -> np.ndarray:
    """For each word the numbers of its shape's and its own feature."""
    out = np.empty((len(words), 2), np.int64)
    for i, w in enumerate(words):
        out[i, 0] = zlib.crc32(shape(w).encode("utf-8", "surrogatepass")) % SHAPES
        out[i, 1] = SHAPES + zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
    return out


def cells(words: list[list[str]]) -> np.ndarray:
    """For each text the numbers of two features: its length with its share of distinct words, and its share of words equal to the one before."""
    n = np.array([len(w) for w in words], np.int64)
    distinct = np.array([len(set(w)) for w in words], np.int64)
    again = np.array([sum(map(eq, w, islice(w, 1, None))) for w in words], np.int64)
    length = np.minimum(np.log2(1 + n).astype(np.int64) // 2, LENGTHS)
    share = lambda k: SHARES * k // np.maximum(n, 1)
    return SHAPES + WORDS + np.c_[length * (SHARES + 1) + share(distinct), CELLS + share(again)]


def vectors(texts: list[str], memo: WordMemo) -> np.ndarray:
    """Feature vectors, for training."""
    words = [t.split() for t in texts]
    numbers, ends = memo.numbers(words)
    out = np.zeros((len(texts), WIDTH), np.float32)
    n = np.diff(ends)
    at = np.repeat(np.arange(len(texts)), n)
    for j in (0, 1):
        np.add.at(out, (at, memo.rows[numbers][:, j] if len(numbers) else numbers), 1.0)
    out[:, : SHAPES + WORDS] /= np.maximum(n, 1)[:, None]
    out[np.arange(len(texts))[:, None], cells(words)] = 1.0
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.weights[buckets(words)].sum(1, keepdims=True)

    def scores(self, texts: list[str], memo: WordMemo) -> np.ndarray:
        words = [t.split() for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        f = memo.sums(words, 1)[:, 0] / np.maximum(n, 1)
        f = f + self.bias + self.weights[cells(words)].sum(1)
        return 1 / (1 + np.exp(-np.clip(f, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = 40, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Model:
    """Minimises the non-negative risk by Adam on mini-batches."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(WIDTH), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1), 0
    if not len(positive) or not len(unlabelled):
        return Model(w, b, prior)
    scale = np.sqrt(WIDTH) / 4
    parts = max(1, len(unlabelled) // 512)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        ps, us = np.array_split(rng.permutation(len(positive)), parts), np.array_split(rng.permutation(len(unlabelled)), parts)
        for pi, ui in zip(ps, us, strict=True):
            if not len(pi):
                continue
            p, u = positive[pi] * scale, unlabelled[ui] * scale
            fp, fu = p @ w + b, u @ w + b
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            gu, gp = sig(fu) / len(u), -prior * sig(fp) / len(p)
            grad = np.r_[gu @ u + gp @ p, gu.sum() + gp.sum()]
            if negative >= 0:
                g = -prior * sig(-fp) / len(p)
                grad = grad + np.r_[g @ p, g.sum()]
            else:
                grad = -grad
            grad[:-1] += decay * w
            step += 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
    return Model(w * scale, float(b), prior)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 5, epochs: int = 60, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled, from both alone: mean over two halves that swap roles. 0.5 without data."""
    if min(len(positive), len(unlabelled)) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    ps, us = np.array_split(rng.permutation(len(positive)), 2), np.array_split(rng.permutation(len(unlabelled)), 2)
    found = []
    for i in (0, 1):
        a, b = positive[ps[i]], unlabelled[us[i]]
        x = np.concatenate([a, b]) * np.sqrt(WIDTH) / 4
        y = np.r_[np.ones(len(a)), np.zeros(len(b))]
        share = np.where(y == 1, 0.5 / len(a), 0.5 / len(b))
        w, c = np.zeros(WIDTH), 0.0
        m, v = np.zeros(WIDTH + 1), np.zeros(WIDTH + 1)
        for step in range(1, epochs + 1):
            g = share * (1 / (1 + np.exp(-np.clip(x @ w + c, -30, 30))) - y)
            grad = np.r_[x.T @ g + 1e-4 * w, g.sum()]
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w, c = w - move[:-1], c - move[-1]
        p, u = np.sort(positive[ps[1 - i]] @ w), np.sort(unlabelled[us[1 - i]] @ w)
        at = np.unique(p)
        over_p, over_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
        margin = np.sqrt(np.log(4 / doubt) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
        best = int(np.argmin((over_u + margin) / over_p))
        found.append(float(over_u[best] / over_p[best]))
    return float(np.mean(found))


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", positives: int = 3000, unlabelled: int = 6000) -> Model:
    """Fits on rows of ``df`` with labels of ``labels`` (both already restricted to what may be learnt from; labels of other rows don't count).

    Positives: about so many ids labelled 1; unlabelled: about so many ids of ``df``, whatever their labels. Both are picked by a hash of the
    key; of rows of equal id the least text counts, so a key with very many rows is one text. No label but 1 is used. The ids of positives
    are bounded by the parameter, so they are broadcast.
    """
    known = labels.filter((F.col(label) == 1) & F.col(key).isNotNull()).select(F.col(key).alias("_id")).distinct()
    own = df.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ones = known.join(own.select("_id"), "_id", "left_semi").count()
    if not ones:
        return Model(np.zeros(WIDTH), 0.0, 0.5)
    total = df.count()
    ids = known.filter(hash_share(F.col("_id"), F.lit(3)) < positives / ones).withColumn("_one", F.lit(1))
    u = hash_share(F.col("_id"), F.lit(4)) < unlabelled / max(total, 1)
    picked = own.withColumn("u", u).join(F.broadcast(ids), "_id", "left").filter("_one is not null or u")
    picked = picked.groupBy("_id").agg(F.min("t").alias("t"), F.max(F.coalesce("_one", F.lit(0))).alias("one"), F.max("u").alias("u"))
    batches_bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(buckets)
        for batch in batches:
            x = vectors([t.as_py() or "" for t in batch.column("t")], memo)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("one"), batch.column("u")], names=["x", "one", "u"])

    rows = picked.mapInArrow(lean(run), "x binary, one int, u boolean").toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, WIDTH).astype(np.float64)
    raw = rows.column("x").to_pylist()
    order = np.array(sorted(range(len(raw)), key=raw.__getitem__), int)  # an order that no scheduling changes
    x, one, in_u = x[order], np.array(rows.column("one").to_pylist())[order], np.array(rows.column("u").to_pylist(), bool)[order]
    prior = min(max(estimated_prior(x[one == 1], x[in_u]), 0.01), 0.99)
    return train(x[one == 1], x[in_u], prior)


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``_score``: the probability of quality, from the whole text."""
    return beside(df, ["_score"], [], lambda inner, name: _scored(inner, model, name(text)))


def _scored(df: DataFrame, model: Model, text: str) -> DataFrame:
    spark = df.sparkSession
    batches_bounded(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        memo = worker_memo(m.uid, lambda: WordMemo(m.word_scores))
        for batch in batches:
            s = m.scores([x.as_py() or "" for x in batch.column(text)], memo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "_score"])

    return df.mapInArrow(lean(run), df.select("*", F.lit(0.0).alias("_score")).schema)
