"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space: each U+0020 becomes the marker U+2581, and a marker is put before the text. A text is cut where a marker follows something
else; as no piece holds a marker after another character, the best segmentation of the whole is the best one of each part. Parts are
segmented once for each distinct part that a worker meets, all of a batch side by side in numpy. What no piece covers becomes byte
pieces; so does a marker character that stands in the text itself, which keeps decoding exact.

Pieces come from a published model file (never trained here). Its scores are ranks; ``scores="zipf"`` takes the log-probability
``-log(rank + 1) - log(sum of 1 / rank)`` for them, ``scores="file"`` takes them as they stand.

A null text counts as empty; the empty text has no pieces. Texts are encoded whole. Equal texts get equal pieces. Ties between
segmentations go to the one whose last piece is longer.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordIndex, batches_bounded, beside, lean, worker_memo

MARK = "▁"
_MARK = MARK.encode()
NORMAL, BYTE = 1, 6
#: A text's parts: a run of spaces (or none, at the start) and what follows up to the next space.
_PARTS = re.compile(r" *[^ ]+| +")
LONG = 40  # bytes beyond which a part is segmented on its own


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol buffer message: number and value."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a model file's bytes."""
    out = []
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):  # type: ignore[arg-type]
                if k == 1:
                    piece = v.decode()  # type: ignore[union-attr]
                elif k == 2:
                    score = float(np.frombuffer(v, "<f4")[0])  # type: ignore[call-overload]
                elif k == 3:
                    kind = int(v)  # type: ignore[call-overload]
            out.append((piece, score, kind))
    return out


@dataclass
class Trie:
    """A double array: from state s by byte c to ``base[s] + c`` if ``check`` there is s. ``value``: the piece that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @staticmethod
    def build(keys: list[tuple[bytes, int]]) -> Trie:
        tree: dict = {}
        for key, v in keys:
            node = tree
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = v
        size = 1 << 17
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        used = bytearray(size)
        used[0] = 1
        # a lone child takes the lowest free place; several children are placed near the top, so that no search is long
        todo, free, top = [(0, tree)], 257, 257
        while todo:
            state, node = todo.pop()
            value[state] = node.get(-1, -1)
            cs = sorted(c for c in node if c >= 0)
            if not cs:
                continue
            if len(cs) == 1:
                while used[free]:
                    free += 1
                at = free - cs[0]
            else:
                at = max(1, top - 128 - cs[0])
                while any(used[at + c] for c in cs):
                    at += 1
            top = max(top, at + cs[-1] + 1)
            if top + 1024 > size:
                base, check, value = (np.concatenate([x, np.full(size, f, np.int32)]) for x, f in ((base, 0), (check, -1), (value, -1)))
                used.extend(bytes(size))
                size *= 2
            base[state] = at
            for c in cs:
                used[at + c] = 1
                check[at + c] = state
                todo.append((at + c, node[c]))
        return Trie(base, check, value)


@dataclass
class Encoder:
    trie: Trie
    scores: np.ndarray
    pieces: list[bytes]
    byte_ids: np.ndarray
    byte_score: float
    longest: int
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def of(model: list[tuple[str, float, int]], scores: str = "zipf") -> Encoder:
        normal = [(p, s, i) for i, (p, s, kind) in enumerate(model) if kind == NORMAL and p]
        if any(MARK in p.lstrip(MARK) for p, _, _ in normal):
            raise ValueError("a piece holds the marker after another character")
        score = np.full(len(model), -np.inf)
        ranked = sorted(normal, key=lambda x: (-x[1], x[2]))
        if scores == "zipf":
            rank = np.arange(1, len(ranked) + 1)
            score[[i for _, _, i in ranked]] = -np.log(rank) - np.log((1 / rank).sum())
        elif scores == "file":
            score[[i for _, _, i in ranked]] = [s for _, s, _ in ranked]
        else:
            raise ValueError(f"scores: {scores}")
        byte_ids = np.full(256, -1)
        for i, (p, _, kind) in enumerate(model):
            if kind == BYTE:
                byte_ids[int(p[3:5], 16)] = i
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte pieces")
        raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.encode() if kind == NORMAL else b"" for p, _, kind in model]
        least = float(np.min(score[np.isfinite(score)], initial=0.0))
        keys = [(p.encode(), i) for p, _, i in normal]
        return Encoder(Trie.build(keys), score, raw, byte_ids, least - 10.0, max((len(k) for k, _ in keys), default=1))

    def _matches(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length: the places from which a piece of that many bytes begins, and the piece. ``ends``: where each place's part ends."""
        at, state = np.arange(len(data)), np.zeros(len(data), np.int64)
        for n in range(1, self.longest + 1):
            inside = at + n <= ends[at]
            at, state = at[inside], state[inside]
            to = self.trie.base[state] + data[at + n - 1]
            ok = self.trie.check[to] == state
            ok &= self.trie.base[state] > 0
            at, state = at[ok], to[ok]
            if not len(at):
                return
            v = self.trie.value[state]
            hit = v >= 0
            yield n, at[hit], v[hit]

    def segment(self, parts: list[bytes]) -> list[np.ndarray]:
        """The ids of each part (bytes with markers for white space; 0xFF stands for a marker that is a text's own character)."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(parts)
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        start = 0
        while start < len(order):
            # parts side by side, of like length; a long one alone
            stop = start + 1
            if len(parts[order[start]]) <= LONG:
                while stop < len(order) and stop - start < 20_000 and len(parts[order[stop]]) <= max(LONG // 4, 2 * len(parts[order[start]])) and len(parts[order[stop]]) <= LONG:
                    stop += 1
            chosen = order[start:stop]
            for i, ids in zip(chosen, self._viterbi([parts[i] for i in chosen]), strict=True):
                out[i] = ids
            start = stop
        return out

    def _viterbi(self, parts: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(p) for p in parts])
        offsets = np.cumsum(np.r_[0, lengths])
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        if not len(data):
            return [np.zeros(0, np.int32)] * len(parts)
        ends = np.repeat(offsets[1:], lengths)
        n = len(data)
        # a character that no piece covers: one step of the byte score over the whole character
        lead = (data & 0xC0) != 0x80
        place = np.flatnonzero(lead)
        width = np.minimum(np.diff(np.r_[place, n]), ends[place] - place)
        single, full = np.zeros(n, bool), np.zeros(n, np.int64)
        full[place] = width
        starts, sizes, ids = [], [], []
        for size, at, v in self._matches(data, ends):
            starts.append(at)
            sizes.append(np.full(len(at), size))
            ids.append(v)
            single[at[full[at] == size]] = True
        bare = ~single[place]
        starts.append(place[bare])
        sizes.append(width[bare])
        ids.append(np.full(int(bare.sum()), -1))
        start, size, piece = (np.concatenate(x) for x in (starts, sizes, ids))
        score = np.where(piece >= 0, self.scores[piece], self.byte_score)
        # by place within the part: all parts take the same step at once
        where = start - np.repeat(offsets[:-1], lengths)[start]
        order = np.lexsort((size, where))
        start, size, piece, score, where = (x[order] for x in (start, size, piece, score, where))
        # best[k + part number]: places of a part are one longer than its bytes
        shift = np.repeat(np.arange(len(parts)), lengths)
        node = start + shift[start]
        to = node + size
        best = np.full(n + len(parts), -np.inf)
        best[offsets[:-1] + np.arange(len(parts))] = 0.0
        back, back_piece = np.zeros(n + len(parts), np.int64), np.zeros(n + len(parts), np.int64)
        key = where * (self.longest + 8) + size
        steps = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for s, e in zip(steps, np.r_[steps[1:], len(key)], strict=True):
            f, t = node[s:e], to[s:e]
            new = best[f] + score[s:e]
            better = new > best[t]
            t = t[better]
            best[t] = new[better]
            back[t] = f[better]
            back_piece[t] = piece[s:e][better]
        # all parts walk back at once
        now = offsets[1:] + np.arange(len(parts))
        first = offsets[:-1] + np.arange(len(parts))
        walked, whose = [], []
        live = np.flatnonzero(now > first)
        raw = np.r_[data, 0]
        while len(live):
            f = back[now[live]]
            got = back_piece[now[live]]
            for k in np.flatnonzero(got < 0):
                i = live[k]
                b = raw[f[k] - i : now[i] - i]
                b = np.frombuffer(_MARK, np.uint8) if len(b) == 1 and b[0] == 0xFF else b
                for c in b[::-1]:
                    walked.append(np.array([self.byte_ids[c]]))
                    whose.append(np.array([i]))
            plain = got >= 0
            walked.append(got[plain])
            whose.append(live[plain])
            now[live] = f
            live = live[f > first[live]]
        got, who = np.concatenate(walked)[::-1], np.concatenate(whose)[::-1]
        by = np.argsort(who, kind="stable")
        cuts = np.cumsum(np.bincount(who, minlength=len(parts)))[:-1]
        return np.split(got[by].astype(np.int32), cuts)

    def parts(self, text: str) -> list[str]:
        """The parts of a text with a space before it."""
        return _PARTS.findall(" " + text) if text else []

    @staticmethod
    def raw(part: str) -> bytes:
        own = part.encode("utf-8", "surrogatepass")
        return own.replace(_MARK, b"\xff").replace(b" ", _MARK) if _MARK in own else own.replace(b" ", _MARK)

    def encode(self, text: str) -> list[int]:
        found = self.segment([self.raw(p) for p in self.parts(text)])
        return np.concatenate([np.zeros(0, np.int32), *found]).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of pieces; bytes that are no UTF-8 become U+FFFD. Own markers come from byte pieces, so they don't turn into spaces."""
        text = b"".join(map(self.spaced.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    @property
    def spaced(self) -> list[bytes]:
        if not hasattr(self, "_spaced"):
            self._spaced = [p.replace(_MARK, b" ") for p in self.pieces]
        return self._spaced


class _Memo:
    """Ids by distinct part, as one array with offsets; begins anew beyond ``limit`` parts or ``size`` characters of them."""

    def __init__(self, encoder: Encoder, limit: int = 200_000, size: int = 8 << 20):
        self.encoder, self.limit, self.size = encoder, limit, size
        self.clear()

    def clear(self) -> None:
        self.index = WordIndex()
        self.ids, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.n = self.held = 0  # parts known, their characters

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more entry at the end)."""
        if len(self.index) > self.limit or self.held > self.size:
            self.clear()
        parts = [self.encoder.parts(t) for t in texts]
        counts = np.array([len(p) for p in parts], np.int64)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
        if fresh := self.index.take():
            self.held += sum(map(len, fresh))
            found = self.encoder.segment([self.encoder.raw(p) for p in fresh])
            ends = self.ends[self.n] + np.cumsum([len(f) for f in found])
            while self.n + len(found) + 1 > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            while ends[-1] > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.ids[self.ends[self.n] : ends[-1]] = np.concatenate(found)
            self.ends[self.n + 1 : self.n + 1 + len(found)] = ends
            self.n += len(found)
        begin, size = self.ends[numbers], self.ends[numbers + 1] - self.ends[numbers]
        total = np.cumsum(np.r_[0, size])
        out = self.ids[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.cumsum(np.r_[0, counts])]


def load(spark: SparkSession, path: str, scores: str = "zipf") -> Encoder:
    """The encoder of a model file on the driver's disk (a published vocabulary of fixed size), or of one that only Spark can read."""
    try:
        with open(path, "rb") as f:
            data = f.read()
    except OSError:
        data = bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
    return Encoder.of(read_model(data), scores)


def encoded(df: DataFrame, encoder: Encoder, text: str = "text") -> DataFrame:
    """Adds ``_ids`` (array of int) and ``_decoded`` (what they decode to)."""
    return beside(df, ["_ids", "_decoded"], [], lambda inner, name: _encoded(inner, encoder, name(text)))


def _encoded(df: DataFrame, encoder: Encoder, text: str) -> DataFrame:
    spark = df.sparkSession
    batches_bounded(spark)
    shared = spark.sparkContext.broadcast(encoder)  # the vocabulary: a fixed size
    schema = df.select("*", F.array().cast("array<int>").alias("_ids"), F.lit("").alias("_decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e: Encoder = shared.value
        memo = worker_memo(e.uid, lambda: _Memo(e))
        for batch in batches:
            ids, ends = memo.encode([x.as_py() or "" for x in batch.column(text)])
            back = [e.decode(ids[s:t].tolist()) for s, t in zip(ends[:-1], ends[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(back, pa.string())], names=[*batch.schema.names, "_ids", "_decoded"])

    return df.mapInArrow(lean(run), schema)


def decoded(df: DataFrame, encoder: Encoder, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of each row's pieces; null ids decode to the empty text."""
    return beside(df, [out], [], lambda inner, name: _decoded(inner, encoder, name(ids), out))


def _decoded(df: DataFrame, encoder: Encoder, ids: str, out: str) -> DataFrame:
    spark = df.sparkSession
    batches_bounded(spark)
    shared = spark.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [shared.value.decode(x.as_py() or []) for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(lean(run), df.select("*", F.lit("").alias(out)).schema)
