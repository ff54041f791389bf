"""Language identification: an interpolated Kneser-Ney character model for each language.

A text's words are its runs of letters, in lower case. Each model gives a word's characters, between word marks, their probabilities
from up to ``order - 1`` characters before. The language with the lowest cross-entropy per character wins. Scores are calibrated:
a temperature fitted on part of the training texts turns cross-entropies into probabilities, and a rejection threshold is the
cross-entropy that only a small share of true texts exceeds.

Models live in sorted arrays of 64-bit n-gram hashes with a column for each language (binary search, no dictionaries).
Training texts are a bounded sample (``docs_per_language``) of the labelled rows; whatever is predicted is read whole.
A text that is null or has no letter gets ``und`` with score 0. Equal texts get equal predictions. Ties go to the first language by name.
Without a training row every text is ``und``.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WordMemo, batches_bounded, beside, hash_share, lean, worker_memo

UNKNOWN = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


_RUNS = re.compile(r"[^\W\d_]+")


def letter_runs(text: str) -> list[str]:
    """The text's runs of letters in lower case."""
    return _RUNS.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words one after the other, each word between zeros, and where each begins."""
    joined = "\0" + "\0\0".join(words) + "\0" if words else ""
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum([0, *(len(w) + 2 for w in words)])
    return codes, starts


def _grams(codes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For k = 1.. order the hash of the k characters that end at each place; 0 where a word has fewer before. Place 0 of a word is its mark."""
    place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    out, h = [], np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        weight = np.uint64(1)
        for k in range(1, order + 1):
            shifted = np.zeros_like(codes)
            shifted[k - 1 :] = codes[: len(codes) - k + 1]
            h = h + (shifted + np.uint64(1)) * weight
            weight = weight * _MIX
            x = h ^ (h >> np.uint64(31))
            x = x * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(k)
            out.append(np.where(place >= k - 1, x | np.uint64(1), np.uint64(0)))
    return out


@dataclass
class Model:
    """``grams[k]``: sorted hashes of (k+1)-grams and, by language, the discounted share; ``contexts[k]``: sorted hashes of k+1
    characters before, and the weight of the lower order after them."""

    languages: list[str]
    order: int
    floor: np.ndarray = field(default_factory=lambda: np.zeros(0))
    grams: list = field(default_factory=list)
    contexts: list = field(default_factory=list)
    rest: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    reject_above: np.ndarray = field(default_factory=lambda: np.zeros(0))
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def _at(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        hashes, values = table
        if not len(hashes):
            return np.full((len(keys), values.shape[1]), missing)
        i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where((hashes[i] == keys)[:, None], values[i], missing)

    def logs(self, words: list[str]) -> np.ndarray:
        """For each word: its summed natural log-probability by language, and its number of predicted characters."""
        codes, starts = _codes(words)
        width = len(self.languages)
        if not len(codes):
            return np.zeros((len(words), width + 1))
        hashes = _grams(codes, starts, self.order)
        place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
        # one evaluation for each distinct longest gram; shorter ones near a word's start count by their own length
        longest = hashes[0].copy()
        for k in range(1, self.order):
            longest = np.where(hashes[k] > 0, hashes[k], longest)
        _, first, back = np.unique(longest, return_index=True, return_inverse=True)
        p = np.broadcast_to(self.floor, (len(first), width)).copy()
        for k in range(self.order):
            key = hashes[k][first]
            if k:
                before = np.where(first > 0, hashes[k - 1][first - 1], 0)
                lower = np.where((key > 0)[:, None], self._at(self.contexts[k - 1], before, 1.0), 1.0)
            else:
                lower = self.rest
            own = np.where((key > 0)[:, None], self._at(self.grams[k], key, 0.0), 0.0)
            p = own + lower * p
        logs = np.log(p)[back]
        logs[place == 0] = 0.0  # word marks at a start are given, not predicted
        out = np.add.reduceat(logs, starts[:-1], axis=0)
        return np.c_[out, np.diff(starts) - 1.0]

    def rows(self, words: list[str]) -> np.ndarray:
        """As ``logs``; signs that count as word characters without being letters are left out, and a word of nothing else is zeros."""
        clean = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in words]
        full = np.array([i for i, w in enumerate(clean) if w], int)
        if len(full) == len(words):
            return self.logs(clean)
        out = np.zeros((len(words), len(self.languages) + 1))
        out[full] = self.logs([clean[i] for i in full])
        return out


def train(counts: dict[str, dict[str, int]], order: int = 5) -> Model:
    """Kneser-Ney models from word counts by language. The longest grams count as they occur, shorter ones by distinct characters before."""
    languages = sorted(counts)
    m = Model(languages, order)
    stats = []  # by language: for k the grams' hashes, counts, contexts' hashes
    alphabet = {c for words in counts.values() for w in words for c in w}
    size = len(alphabet) + 2
    for lang in languages:
        words = [w for w in counts[lang] if w]
        weight = np.array([counts[lang][w] for w in words], np.float64)
        codes, starts = _codes(words)
        place = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts)) if len(codes) else np.zeros(0, int)
        weight = np.repeat(weight, np.diff(starts)) if len(codes) else weight
        hashes = _grams(codes, starts, order)
        by_order, above = [], None
        for k in range(order, 0, -1):
            key = hashes[k - 1]
            there = (key > 0) & (place > 0)
            uniq, first, back = np.unique(key[there], return_index=True, return_inverse=True)
            at = np.flatnonzero(there)[first]
            c = np.zeros(len(uniq))
            if k == order:
                np.add.at(c, back, weight[there])
            else:
                # distinct longer grams that end in this one; a gram that begins its word has none before it and counts as it occurs
                uniq_up, first_up = above
                np.add.at(c, np.searchsorted(uniq, hashes[k - 1][first_up]), 1.0)
                opening = there & (place == k - 1)
                np.add.at(c, np.searchsorted(uniq, key[opening]), weight[opening])
            before = hashes[k - 2][at - 1] if k > 1 else np.zeros(len(uniq), np.uint64)
            by_order.append((uniq, c, before))
            above = (uniq, at)
        stats.append(by_order[::-1])
    for k in range(order):
        keys = np.unique(np.concatenate([s[k][0] for s in stats]))
        values = np.zeros((len(keys), len(languages)))
        heads = np.unique(np.concatenate([s[k][2] for s in stats]))
        lower = np.ones((len(heads), len(languages)))
        for i, s in enumerate(stats):
            uniq, c, before = s[k]
            if not len(uniq):
                continue
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            at = np.searchsorted(heads, before)
            total, kinds = np.zeros(len(heads)), np.zeros(len(heads))
            np.add.at(total, at, c)
            np.add.at(kinds, at, 1.0)
            values[np.searchsorted(keys, uniq), i] = np.maximum(c - d, 0) / total[at]
            seen = total > 0
            lower[seen, i] = d * kinds[seen] / total[seen]
        m.grams.append((keys, values))
        if k:
            m.contexts.append((heads, lower))
        else:
            m.rest = lower[:1] if len(heads) else np.ones((1, len(languages)))
    m.floor = np.full(len(languages), 1.0 / size)
    m.reject_above = np.full(len(languages), np.inf)
    return m


def calibrated(m: Model, sums: np.ndarray, languages: list[str], miss: float = 0.001) -> Model:
    """Fits the temperature (least log-loss over a grid) and each language's rejection threshold. ``sums``: what ``Model.rows`` gives for the
    words of each calibration text, added up; ``languages``: the texts' own."""
    known = np.array([lang in m.languages for lang in languages], bool) & (sums[:, -1] > 0)
    if not known.any():
        return m
    y = np.array([m.languages.index(lang) for lang, k in zip(languages, known, strict=True) if k])
    x = -sums[known, :-1] / sums[known, -1:]

    def loss(t: float) -> float:
        z = -x / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]))

    m.temperature = min((float(t) for t in np.geomspace(0.05, 5, 40)), key=loss)
    for i in range(len(m.languages)):
        if (y == i).any():
            m.reject_above[i] = np.quantile(x[y == i, i], 1 - miss) * 1.05
    return m


def _text_sums(rows: DataFrame, m: Model) -> tuple[np.ndarray, list[str]]:
    """The sums and languages of ``rows`` (t, l). Texts stay on the executors; a row of fixed size for each comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(m)
    width = len(m.languages) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordMemo(shared.value.rows)
        for batch in batches:
            s = memo.sums([letter_runs(x.as_py()) for x in batch.column("t")], width)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in s], pa.binary()), batch.column("l")], names=["s", "l"])

    got = sorted(rows.select("t", F.col("l").cast("string").alias("l")).mapInArrow(lean(run), "s binary, l string").collect())
    return np.frombuffer(b"".join(r["s"] for r in got), np.float64).reshape(-1, width), [r["l"] for r in got]


def fit(df: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 400, order: int = 5) -> Model:
    """Trains on a bounded sample: about ``docs_per_language`` distinct whole texts for each language, picked by a hash of the text.

    Words are counted on the executors; their counts are what reaches the driver. A quarter of the sample calibrates. A language whose texts
    would all calibrate trains on them instead; without texts to calibrate with, a language rejects nothing.
    """
    known = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    sizes = {r[0]: r[1] for r in known.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t"))).collect()}
    if not sizes:
        return Model([], order)
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("l") == name, F.lit(docs_per_language / max(n, 1))).otherwise(share)
    a = known.filter(hash_share(F.col("t"), F.lit(17)) < share).distinct()  # copies meet before the shuffle
    own = F.xxhash64("t", F.lit(5)) % 4 != 0
    counts: dict[str, dict[str, int]] = {}

    def count(rows: DataFrame) -> None:
        words = rows.select("l", F.explode(F.split(F.lower("t"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
        for r in words.groupBy("l", "w").count().collect():
            counts.setdefault(r[0], {})[r[1]] = r[2]

    count(a.filter(own))
    rest = a.filter(~own)
    late = sorted(sizes.keys() - counts.keys())
    if late:
        count(rest.filter(F.col("l").isin(late)))
        rest = rest.filter(~F.col("l").isin(late))
    if not counts:
        return Model([], order)
    m = train(counts, order)
    batches_bounded(df.sparkSession)
    return calibrated(m, *_text_sums(rest, m))


def predicted(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``_lang`` (the best language or ``und``), ``_score`` (its calibrated probability), ``_entropy`` (nats per character) and
    ``_rejected`` (that entropy exceeds the language's threshold, or there is no letter)."""
    return beside(df, ["_lang", "_score", "_entropy", "_rejected"], [], lambda inner, name: _predicted(inner, model, name(text)))


def _predicted(df: DataFrame, model: Model, text: str) -> DataFrame:
    spark = df.sparkSession
    batches_bounded(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by the training sample
    more = [("_lang", pa.string()), ("_score", pa.float64()), ("_entropy", pa.float64()), ("_rejected", pa.bool_())]
    kinds: list[Column] = [F.lit("").alias("_lang"), F.lit(0.0).alias("_score"), F.lit(None).cast("double").alias("_entropy"), F.lit(False).alias("_rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        width = len(m.languages)
        memo = worker_memo(m.uid, lambda: WordMemo(m.rows))
        for batch in batches:
            n = batch.num_rows
            best, score, entropy, known = np.zeros(n, int), np.zeros(n), np.full(n, np.nan), np.zeros(n, bool)
            if width:
                sums = memo.sums([letter_runs(x.as_py() or "") for x in batch.column(text)], width + 1)
                known = sums[:, -1] > 0
                x = -sums[:, :-1] / np.maximum(sums[:, -1:], 1)
                best = x.argmin(1)
                z = -(x - x.min(1, keepdims=True)) / m.temperature
                score = np.where(known, 1 / np.exp(z).sum(1), 0.0)
                entropy = np.where(known, x.min(1), np.nan)
            langs = [m.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            out = [~k or e > m.reject_above[i] for i, k, e in zip(best, known, entropy, strict=True)]
            own = [langs, score, pa.array(entropy, from_pandas=True), [bool(x) for x in out]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) if not isinstance(v, pa.Array) else v for v, (_, t) in zip(own, more, strict=True))], names=[*batch.schema.names, *(k for k, _ in more)])

    return df.mapInArrow(lean(run), df.select("*", *kinds).schema)
