"""LM scoring by masked pseudo-likelihood.

A window network predicts every token from the three before and the three after it: embeddings of the six neighbours, a hidden layer, a
softmax over all tokens. A text's score is the sum of its tokens' conditional log-probabilities. Tokens are the 256 most frequent characters
of the corpus, as they stand, and the UTF-8 bytes of every other character, so no two texts look alike. A byte is predicted from what stands
outside its character and from the bytes before it, so a character's log-probability is the sum of its bytes'. The softmax has two levels:
the 63 most frequent characters and one sum of all others, then the others among themselves.

Training covers the whole corpus: every window of every text is counted on the executors and the counts are summed over the corpus. Their
number follows the corpus. The network is trained in numpy on those counts: in rounds, each part of the table starts from the same weights,
trains on every one of its windows and returns its weights, which are averaged by window counts. Within a pass a window is met as often as
its count is of the mean, once at least, and its weight is shared among the meetings. A part is worked off in groups of bounded size.

Scoring needs the network once for each distinct window that a worker meets; results are kept in a table of fixed size.
Null and empty texts have no characters and score 0. Equal texts get equal scores (given the same weights). An empty corpus leaves the network
untrained, which predicts all tokens alike within a level.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batches_bounded, beside, lean, pieces, worker_memo

BITS, SIDE, EMBED, HIDDEN = 9, 3, 12, 48
CLASSES = 1 << BITS  # bytes, then characters
CHARS = CLASSES - 256
MASK, EDGE = 0xFF, 0xFE  # no byte of UTF-8: what is hidden, and what stands beyond a text's ends
HEAD = 63  # characters of the first level
PARTS = 12
LEAST_STEPS = 300  # of a part in a round, on average, so that small corpora are learnt too
SIZE = 1024  # of a mini-batch
RUN = 1 << 14  # characters coded at a time
LOOK = 1 << 18  # windows looked up at a time
STEP = 1 << 11  # windows scored at a time
STRIDE = 1 << 13  # weights moved at a time
GROUP = 1 << 19  # windows that a task trains on at a time
PIECE = 2 << 20  # bytes of text that a task works on at a time
SLOTS = 22  # bits of the number of results that a worker keeps
KEPT = 16 << 20  # freed memory that a worker keeps within a task


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def alphabet(df: DataFrame, text: str) -> np.ndarray:
    """The most frequent characters of the whole corpus, most frequent first (ties by code point)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for piece in pieces(batch, "t", PIECE):
                seen = np.bincount(_points([x.as_py() or "" for x in piece.column("t")]))
                total[: len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["c", "n"])

    found = df.select(F.col(text).alias("t")).mapInArrow(lean(count, KEPT), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "c").limit(CHARS).collect()
    return np.array([r["c"] for r in top], np.int64)


class Coder:
    """Tokens of texts and their window codes."""

    def __init__(self, chars: np.ndarray):
        self.token = np.full(0x110000, -1, np.int16)
        self.token[chars] = 256 + np.arange(len(chars))

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The window code of every token of all texts, and where each text's begin. A code's middle digit is the token itself.
        Texts are coded in runs short enough for a core's cache."""
        ends = np.cumsum([0, *map(len, texts)])
        runs, i = [], 0
        while i < len(texts) or not runs:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + RUN, "right")) - 1)
            runs.append(self._windows(texts[i:j]))
            i = j
        before = np.cumsum([0, *(len(codes) for codes, _ in runs)])
        starts = [s[:-1] + b for (_, s), b in zip(runs, before, strict=False)]
        return np.concatenate([codes for codes, _ in runs]), np.concatenate([*starts, before[-1:]])

    def _windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = _points(texts)
        tokens = self.token[points].astype(np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        rare = tokens < 0
        some = bool(rare.any())
        if some:
            width = np.where(rare, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
            begin = np.cumsum(np.r_[0, width])
            char = np.repeat(np.arange(len(points)), width)
            left = width[char] - 1 - (np.arange(len(char)) - begin[char])  # bytes that follow in the character
            first, point = left == width[char] - 1, points[char].astype(np.int64)
            byte = np.where(first, np.array([0, 0, 0xC0, 0xE0, 0xF0])[width[char]] | (point >> 6 * left), 0x80 | ((point >> 6 * left) & 0x3F))
            tokens = np.where(rare[char], byte, tokens[char])
            lengths = np.diff(begin[np.cumsum(np.r_[0, lengths])])
        starts = np.cumsum(np.r_[0, lengths])
        padded = np.full(len(tokens) + SIDE * (1 + len(texts)), EDGE, np.int64)
        place = np.arange(len(tokens)) + np.repeat(SIDE * (1 + np.arange(len(texts))), lengths)
        padded[place] = tokens
        # windows at every place, those of edges too, by doubling; then the tokens' own are taken
        place -= SIDE
        pairs = padded[:-1] << BITS
        pairs |= padded[1:]
        three = pairs[:-1] << BITS
        three |= padded[2:]
        out = three[: len(padded) - 2 * SIDE] << BITS
        out |= padded[SIDE : len(padded) - SIDE]
        out <<= SIDE * BITS
        after = three[SIDE + 1 :]
        if some:
            for k in range(SIDE):  # bytes that follow in the character are hidden
                shift = BITS * (SIDE - 1 - k)
                at = place[left > k]
                after[at] = after[at] & ~((CLASSES - 1) << shift) | MASK << shift
        out |= after
        return out[place], starts


def digit(codes: np.ndarray, k: int) -> np.ndarray:
    """A window's token at place ``k``: 0 to 2 before its middle, 4 to 6 after it."""
    return (codes >> (BITS * (2 * SIDE - k))) & (CLASSES - 1)


NEAR = [k for k in range(2 * SIDE + 1) if k != SIDE]
_EACH = np.arange(CLASSES)
_FIRST = np.where((_EACH >= 256) & (_EACH < 256 + HEAD), _EACH - 256, HEAD)
_SECOND = np.where(_EACH < 256, _EACH, _EACH - HEAD)


def _levels(middle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's number in the first level, the places of tokens of the second, and their numbers there."""
    first = _FIRST[middle]
    at = np.flatnonzero(first == HEAD)
    return first, at, _SECOND[middle[at]]


def _softmax(z: np.ndarray) -> np.ndarray:
    """Of each column, in place."""
    z -= z.max(0)
    np.exp(z, out=z)
    z /= z.sum(0)
    return z


def _log_softmax_at(z: np.ndarray, i: np.ndarray) -> np.ndarray:
    """One value of each column, without the others'; ``z`` is used up."""
    z -= z.max(0)
    own = z[i, np.arange(z.shape[1])]
    np.exp(z, out=z)
    return own - np.log(z.sum(0))


@dataclass
class Network:
    """``embed``: (6, classes, EMBED); ``inner``: (6 * EMBED, HIDDEN); ``outer``: (HIDDEN, HEAD + 1); ``rest``: (HIDDEN, classes - HEAD)."""

    embed: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    outer_bias: np.ndarray
    rest: np.ndarray
    rest_bias: np.ndarray

    @staticmethod
    def new(seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        o = lambda *shape: np.zeros(shape, np.float32)
        return Network(f(2 * SIDE, CLASSES, EMBED), f(2 * SIDE * EMBED, HIDDEN), o(HIDDEN), o(HIDDEN, HEAD + 1), o(HEAD + 1), o(HIDDEN, CLASSES - HEAD), o(CLASSES - HEAD))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.inner, self.inner_bias, self.outer, self.outer_bias, self.rest, self.rest_bias]

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """The log-probability of each window's middle given its neighbours."""
        return Scorer(self).logs(codes)


class Scorer:
    """Log-probabilities by a network that stays as it is. Windows are worked off in steps whose arrays are small and used again: fresh pages
    for each step cost more than the arithmetic."""

    def __init__(self, network: Network):
        self.network = net = network
        # each neighbour's share of the hidden layer, so that a window's is a sum of six rows
        self.shares = [net.embed[k] @ net.inner[k * EMBED : (k + 1) * EMBED] for k in range(2 * SIDE)]
        self.shares[0] += net.inner_bias
        self.h, self.one, self.z = (np.empty(STEP * width, np.float32) for width in (HIDDEN, HIDDEN, HEAD + 1))

    def logs(self, codes: np.ndarray) -> np.ndarray:
        net, out = self.network, np.empty(len(codes), np.float32)
        for i in range(0, len(codes), STEP):
            part = codes[i : i + STEP]
            n = len(part)
            h, one = (x[: n * HIDDEN].reshape(n, HIDDEN) for x in (self.h, self.one))
            z = self.z[: n * (HEAD + 1)].reshape(HEAD + 1, n)
            # digits are numbers of rows, so "clip" changes none; it writes without a copy between
            np.take(self.shares[0], digit(part, NEAR[0]), axis=0, out=h, mode="clip")
            for share, k in zip(self.shares[1:], NEAR[1:], strict=True):
                h += np.take(share, digit(part, k), axis=0, out=one, mode="clip")
            np.tanh(h, out=h)
            head, at, rest = _levels(digit(part, SIDE))
            np.matmul(net.outer.T, h.T, out=z)
            z += net.outer_bias[:, None]
            own = _log_softmax_at(z, head)
            if len(at):
                z = h[at] @ net.rest
                z += net.rest_bias
                own[at] += _log_softmax_at(z.T, rest)
            out[i : i + n] = own
        return out


class Trainer:
    """Adam on mini-batches of windows. All weights, slopes and moments stand in one array each, and a batch's arrays are used again."""

    def __init__(self, net: Network, rate: float, seed: int):
        self.rate, self.rng, self.step = rate, np.random.default_rng(seed), 0
        flat = np.concatenate([a.ravel() for a in net.arrays()])
        ends = np.cumsum([a.size for a in net.arrays()])[:-1]
        parts = lambda x: Network(*[p.reshape(a.shape) for p, a in zip(np.split(x, ends), net.arrays(), strict=True)])
        self.flat, self.slopes, self.m, self.v = flat, *(np.zeros_like(flat) for _ in range(3))
        self.net, self.grad = parts(self.flat), parts(self.slopes)  # views
        self.x, self.gx = (np.empty(SIZE * 2 * SIDE * EMBED, np.float32) for _ in range(2))
        self.h, self.gh, self.bent = (np.empty(SIZE * HIDDEN, np.float32) for _ in range(3))
        self.z, self.t = np.empty(SIZE * (HEAD + 1), np.float32), np.empty(STRIDE, np.float32)
        self.near = np.empty(SIZE * 2 * SIDE, np.int64)
        self.cells = np.empty(SIZE * 2 * SIDE * EMBED, np.int64)

    def learn(self, codes: np.ndarray, counts: np.ndarray, mean: float, passes: int) -> None:
        """Every window, as often as its count is of ``mean`` (once at least); a window's meetings in a pass weigh its count together."""
        times = np.maximum(1, np.round(counts / mean)).astype(np.int64)
        weight = (counts / times / mean).astype(np.float32)
        for _ in range(passes):
            at = self.rng.permutation(np.repeat(np.arange(len(codes)), times))
            for i in range(0, len(at), SIZE):
                part = at[i : i + SIZE]
                self.batch(codes[part], weight[part])

    def batch(self, codes: np.ndarray, weight: np.ndarray) -> None:
        net, grad, n, sides = self.net, self.grad, len(codes), 2 * SIDE
        near = self.near[: n * sides].reshape(n, sides)  # rows of the six tables, one below the other
        for j, k in enumerate(NEAR):
            np.add(digit(codes, k), CLASSES * j, out=near[:, j])
        x, gx = (a[: n * sides * EMBED].reshape(n, sides * EMBED) for a in (self.x, self.gx))
        h, gh, bent = (a[: n * HIDDEN].reshape(n, HIDDEN) for a in (self.h, self.gh, self.bent))
        z = self.z[: n * (HEAD + 1)].reshape(HEAD + 1, n)
        np.take(net.embed.reshape(-1, EMBED), near, axis=0, out=x.reshape(n, sides, EMBED), mode="clip")
        np.matmul(x, net.inner, out=h)
        h += net.inner_bias
        np.tanh(h, out=h)
        head, at, rest = _levels(digit(codes, SIDE))
        w = weight / np.float32(SIZE)
        np.matmul(net.outer.T, h.T, out=z)
        z += net.outer_bias[:, None]
        g = _softmax(z)
        g[head, np.arange(n)] -= 1
        g *= w
        np.matmul(g.T, net.outer.T, out=gh)
        np.matmul(h.T, g.T, out=grad.outer)
        g.sum(1, out=grad.outer_bias)
        if len(at):
            hr = h[at]
            z = hr @ net.rest
            z += net.rest_bias
            gr = _softmax(z.T)
            gr[rest, np.arange(len(at))] -= 1
            gr *= w[at]
            gh[at] += gr.T @ net.rest.T
            np.matmul(hr.T, gr.T, out=grad.rest)
            gr.sum(1, out=grad.rest_bias)
        else:
            grad.rest[:], grad.rest_bias[:] = 0, 0
        np.multiply(h, h, out=bent)
        np.subtract(1, bent, out=bent)
        gh *= bent
        np.matmul(x.T, gh, out=grad.inner)
        gh.sum(0, out=grad.inner_bias)
        np.matmul(gh, net.inner.T, out=gx)
        near *= EMBED
        cells = self.cells[: gx.size].reshape(n * sides, EMBED)
        np.add(near.reshape(-1, 1), np.arange(EMBED), out=cells)
        grad.embed[:] = 0
        np.add.at(grad.embed.reshape(-1), cells.reshape(-1), gx.reshape(-1))
        self.step += 1
        rate, root = self.rate / (1 - 0.9**self.step), (1 - 0.999**self.step) ** -0.5
        for i in range(0, self.flat.size, STRIDE):
            a, d, m, v = (x[i : i + STRIDE] for x in (self.flat, self.slopes, self.m, self.v))
            t = self.t[: len(a)]
            np.multiply(d, d, out=t)
            t -= v
            t *= 0.001
            v += t
            d -= m
            d *= 0.1
            m += d
            np.sqrt(v, out=t)
            t *= root
            t += 1e-8
            np.divide(m, t, out=t)
            t *= rate
            a -= t


@dataclass
class Model:
    chars: np.ndarray
    network: Network
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)


def window_counts(df: DataFrame, text: str, chars: np.ndarray, most: int = 6_000_000) -> DataFrame:
    """(code, n): every window of every text. Windows are summed within a task before they are shuffled; a task holds about ``most``."""

    def summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(codes, kind="stable")  # each part is in order, so this merges
        codes, n = codes[order], n[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
        return codes[first], np.add.reduceat(n, first) if len(first) else n

    def tallied(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes.sort()
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
        return codes[first], np.diff(first, append=len(codes))

    def rows(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + (1 << 16)]), pa.array(n[i : i + (1 << 16)])], names=["code", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(chars)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for piece in pieces(batch, "t", PIECE):
                held.append(tallied(coder.windows([x.as_py() or "" for x in piece.column("t")])[0]))
                size += len(held[-1][0])
                if size > most:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > most // 2:
                        yield from rows(*held[0])
                        held, size = [], 0
        if held:
            yield from rows(*summed(held))

    # tasks have summed their windows already, so the shuffle comes before the engine's own summing and not between its halves
    own = df.select(F.col(text).alias("t")).mapInArrow(lean(count, KEPT), "code long, n long")
    return own.repartition("code").groupBy("code").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", rounds: int = 3, rate: float = 0.01) -> Model:
    """Trains on the whole corpus."""
    spark = df.sparkSession
    batches_bounded(spark)
    scratch = Scratch(spark)
    chars = alphabet(df, text)
    counts = scratch.keep(window_counts(df, text, chars))
    size, total = counts.agg(F.count("*"), F.sum("n")).head()
    net = Network.new()
    if not size:
        scratch.drop(counts)
        return Model(chars, net)
    mean = total / size
    passes = max(1, -(-LEAST_STEPS * PARTS * SIZE // (2 * size)))
    parts = min(240, max(PARTS, size // 2_000_000))
    for turn in range(rounds):
        step = rate * 0.5**turn

        def local(batches: Iterator[pa.RecordBatch], net: Network = net, turn: int = turn, step: float = step) -> Iterator[pa.RecordBatch]:
            trainer, held, n, weight = None, [], 0, 0

            def learn() -> None:
                codes, own = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("code", "n"))
                trainer.learn(codes, own, mean, passes)

            for b in batches:
                if not b.num_rows:
                    continue
                if trainer is None:
                    trainer = Trainer(net, step, 100 * turn + b.column("code")[0].as_py() % 97)
                held.append(b)
                n += b.num_rows
                weight += int(b.column("n").to_numpy().sum())
                if n >= GROUP:
                    learn()
                    held, n = [], 0
            if held:
                learn()
            if trainer is not None:
                yield pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([b"".join(a.tobytes() for a in trainer.net.arrays())], pa.binary())], names=["w", "x"])

        # the order within a part is one that no scheduling changes, and unlike that of the codes
        dealt = counts.repartition(parts, F.xxhash64("code")).sortWithinPartitions(F.xxhash64("code", F.lit(1)), "code")
        got = sorted(dealt.mapInArrow(lean(local, KEPT), "w double, x binary").collect(), key=lambda r: r["x"])  # a row of fixed size for each part
        all_w = sum(r["w"] for r in got)
        flat = sum(np.frombuffer(r["x"], np.float32).astype(np.float64) * (r["w"] / all_w) for r in got).astype(np.float32)
        ends = np.cumsum([a.size for a in net.arrays()])
        net = Network(*[f.reshape(a.shape) for f, a in zip(np.split(flat, ends[:-1]), net.arrays(), strict=True)])
    scratch.drop(counts)
    return Model(chars, net)


class Known:
    """Results by window, in a table of fixed size where a later window may take another's place; results don't depend on it."""

    def __init__(self, network: Network):
        self.network = Scorer(network)
        self.codes, self.values = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.float32)
        self.owner = np.zeros(1 << SLOTS, np.int32)
        self.hashed, self.held = np.empty(LOOK, np.uint64), np.empty(LOOK, np.int64)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.float32)
        for i in range(0, len(codes), LOOK):
            self._look(codes[i : i + LOOK], out[i : i + LOOK])
        return out

    def _look(self, codes: np.ndarray, out: np.ndarray) -> None:
        """Writes the windows' results to ``out``."""
        hashed, held = self.hashed[: len(codes)], self.held[: len(codes)]
        np.multiply(codes.view(np.uint64), np.uint64(0x9E3779B97F4A7C15), out=hashed)
        hashed >>= np.uint64(64 - SLOTS)
        slot = hashed.view(np.int64)
        np.take(self.values, slot, out=out, mode="clip")
        missed = np.flatnonzero(np.take(self.codes, slot, out=held, mode="clip") != codes)
        if len(missed):
            # of equal windows one is worked out: the last that claimed the slot, or each by itself where another window did
            own, at, i = codes[missed], slot[missed], np.arange(len(missed), dtype=np.int32)
            self.owner[at] = i
            of = self.owner[at]
            same = own[of] == own
            new = np.flatnonzero((of == i) | ~same)
            found = np.empty(len(own), np.float32)
            found[new] = self.network.logs(own[new])
            out[missed] = np.where(same, found[of], found)
            self.values[at[new]] = found[new]
            self.codes[at[new]] = own[new]  # of windows that share a slot both arrays keep the last


def scored(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``_n_chars`` (predicted characters), ``_log_likelihood`` (their summed log-probabilities) and ``_per_char``."""
    return beside(df, ["_n_chars", "_log_likelihood", "_per_char"], [], lambda inner, name: _scored(inner, model, name(text)))


def _scored(df: DataFrame, model: Model, text: str) -> DataFrame:
    spark = df.sparkSession
    batches_bounded(spark)
    shared = spark.sparkContext.broadcast(model)  # a fixed number of weights
    schema = df.select("*", F.lit(0).cast("long").alias("_n_chars"), F.lit(0.0).alias("_log_likelihood"), F.lit(0.0).alias("_per_char")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        coder = Coder(m.chars)
        known = worker_memo(m.uid, lambda: Known(m.network))
        for whole in batches:
            for batch in pieces(whole, text, PIECE):
                texts = [x.as_py() or "" for x in batch.column(text)]
                n, score = np.array([len(t) for t in texts], np.int64), np.zeros(batch.num_rows)
                codes, starts = coder.windows(texts)
                full = np.flatnonzero(n)
                if len(full):
                    score[full] = np.add.reduceat(known.logs(codes).astype(np.float64), starts[full])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), pa.array(score), pa.array(score / np.maximum(n, 1))], names=[*batch.schema.names, "_n_chars", "_log_likelihood", "_per_char"])

    return df.mapInArrow(lean(run, KEPT), schema)
