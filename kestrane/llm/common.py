"""What several operators share: free column names, scratch tables, Arrow batches and the word memo.

Operators that add columns keep all columns they get. Where the name of an added column is taken, the added one gets the next free name
(``free``: underscores at its end); names that an operator uses within itself clash with nothing (``beside``).
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import batches_bounded  # noqa: F401 - operators take it from here

#: ``[^\x20\x09-\x0D]+`` is a word; this is what stands between words.
SEPARATORS = " \t\n\x0b\f\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(columns: Iterable[str], name: str) -> str:
    """The name, with as many underscores after it as make it differ from all columns (case aside, as Spark compares)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, added: Sequence[str], used: Sequence[str], work: Callable[[DataFrame, Callable[[str], str]], DataFrame]) -> DataFrame:
    """``work(frame, name_of)`` adds the columns ``added`` to a frame of which no column is called like them or like ``used``; ``name_of``
    tells what a column of ``df`` is called there. Returns ``df``'s columns under their own names, and the added ones under free names."""
    apart = {c.lower() for c in (*added, *used)}
    moved: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in apart:
            moved[c] = free([*df.columns, *moved.values(), *apart], f"_own_{c}")
    if not moved:
        return work(df, lambda c: c)
    by_case = {c.lower(): to for c, to in moved.items()}
    out = work(df.withColumnsRenamed(moved), lambda c: by_case.get(c.lower(), c))
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return out.select(*[quoted(moved.get(c, c)).alias(c) for c in df.columns], *[quoted(c).alias(free(df.columns, c)) for c in added])


class Scratch:
    """Tables in the folder that the cluster names in ``spark.checkpoint.dir``; a temporary folder serves only a session on one machine
    that names none, as in tests. A result's own last table stays, since the result is read from it; the folder is the cluster's to clear.

    ``keep`` cuts the lineage: it writes a frame and returns it as read again, so a lost executor costs no recomputation.
    ``drop`` removes tables that nothing needs any longer.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            held = spark.sparkContext.getCheckpointDir()
            if not held and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("spark.checkpoint.dir is not set: executors share no other folder")
            root = held or f"file://{tempfile.gettempdir()}/kestrane-scratch"
        self.root = f"{root.rstrip('/')}/kestrane-{uuid.uuid4().hex}"
        self.number = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.number += 1
        path = f"{self.root}/{self.number}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path  # type: ignore[attr-defined]
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hash_share(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


class WordIndex(dict):
    """Gives each distinct word a row number; ``fresh`` are the words since the last ``take``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list = []

    def __missing__(self, word):
        n = self[word] = len(self)
        self.fresh.append(word)
        return n

    def take(self) -> list:
        out, self.fresh = self.fresh, []
        return out


class WordMemo:
    """Rows of floats by distinct word, computed once for each word that a worker meets.

    ``rows_of`` maps a list of words to an array with a row each. Beyond ``limit`` words or ``size`` characters of them the memo starts anew
    (between batches, which are bounded in bytes), so its memory is bounded; results don't depend on it.
    """

    def __init__(self, rows_of: Callable[[list], np.ndarray], limit: int = 200_000, size: int = 8 << 20):
        self.rows_of, self.limit, self.size = rows_of, limit, size
        self.clear()

    def clear(self) -> None:
        self.index, self.rows, self.n, self.held = WordIndex(), None, 0, 0

    def numbers(self, texts_words: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, and where each text begins (one more entry at the end)."""
        if len(self.index) > self.limit or self.held > self.size:
            self.clear()
        get = self.index.__getitem__
        ends = np.cumsum([0, *map(len, texts_words)])
        out = np.fromiter(map(get, chain.from_iterable(texts_words)), np.int64, int(ends[-1]))
        if fresh := self.index.take():
            self.held += sum(map(len, fresh))
            new = self.rows_of(fresh)
            if self.rows is None:
                self.rows = np.zeros((max(2 * len(new), 1024), *new.shape[1:]), new.dtype)
            while self.n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.n : self.n + len(new)] = new
            self.n += len(new)
        return out, ends

    def sums(self, texts_words: list[list], width: int) -> np.ndarray:
        """For each text the sum of its words' rows."""
        numbers, ends = self.numbers(texts_words)
        out = np.zeros((len(texts_words), width))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            out[full] = np.add.reduceat(self.rows[numbers].astype(np.float64), ends[full], axis=0)
        return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each (a single longer text stands alone)."""
    lengths = np.array([x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if len(lengths) > start:
        yield batch.slice(start)


M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3  # of mallopt


def lean(run: Callable[[Iterator], Iterator], kept: int = 1 << 17) -> Callable[[Iterator], Iterator]:
    """A worker's function that gives memory back: arrays beyond a size get pages of their own, and what a task has freed is returned at its
    end, beyond ``kept`` bytes at once (the C library's own default). Workers live on between tasks, and an executor's limit counts the idle
    ones, too."""

    def inner(batches: Iterator) -> Iterator:
        libc = None
        try:
            libc = ctypes.CDLL("libc.so.6")
            libc.mallopt(M_MMAP_THRESHOLD, 1 << 18)
            libc.mallopt(M_TRIM_THRESHOLD, kept)
        except (OSError, AttributeError):  # another C library: nothing to tune
            pass
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return inner


_memos: dict[str, object] = {}


def worker_memo(name: str, make: Callable[[], object]):
    """The worker's memo of that name, which later tasks in the same worker go on with. A worker holds one: another name replaces it."""
    if name not in _memos:
        _memos.clear()
        _memos[name] = make()
    return _memos[name]


def no_memo() -> None:
    """For tasks that need none: frees what earlier tasks of the worker have left."""
    _memos.clear()
