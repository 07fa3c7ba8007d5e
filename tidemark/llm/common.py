"""Shared helpers: reading tables, cutting lineage, and words of whole texts as arrays."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and tab to carriage return.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). Where that setting is missing, a
    local session gets a temporary one, as in tests, and a cluster an error, before any work."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not set_dir and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(set_dir or tempfile.mkdtemp(prefix="tidemark-"))
    return set_dir or context.getCheckpointDir()


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(frame: DataFrame) -> DataFrame:
    """The frame, computed once into the shared checkpoint folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


#: Rows of an Arrow batch where rows carry whole texts or sets.
HEAVY_ROWS = 1_000


@contextmanager
def heavy_rows(spark: SparkSession, most: int = HEAVY_ROWS) -> Iterator[None]:
    """Arrow batches of few rows for the actions within, whose rows carry whole texts or sets. A
    batch stands in the executor's memory outside of the heap and in its Python worker, for each
    task and on the way back again. Steers memory, never results; a session's lower limit stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Scratch:
    """Tables written into the shared folder on the way to a result, and deleted at its end.

    They stand on shared storage, so lost executors don't take them along."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders, self.shared = spark, [], []

    def keep(self, frame: DataFrame, label: str = "part") -> DataFrame:
        """The frame, computed once and read again."""
        self.folders.append(folder := new_folder(self.spark, label))
        frame.write.parquet(folder)
        return self.spark.read.schema(frame.schema).parquet(folder)

    def share(self, value):
        """The value, broadcast until the tables go."""
        self.shared.append(self.spark.sparkContext.broadcast(value))
        return self.shared[-1]

    def forget(self) -> None:
        """Takes back what was broadcast so far; tables that needed it are written."""
        for value in self.shared:
            value.destroy()
        self.shared = []

    def drop(self) -> None:
        """Deletes all tables; nothing that is still to be computed may read them."""
        self.forget()
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []


#: Characters other than these may have a lower case of their own besides A-Z.
SETTLED = r"\x00-\x7F\p{Ll}\p{Lo}\p{Lm}\p{M}\p{Nd}\p{P}\p{Z}\p{Sc}"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. lower() does just that for texts of SETTLED characters
    and is faster."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike(f"[^{SETTLED}]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def hash_share(key: Column, wanted: int, there: int) -> Column:
    """Whether a key falls in the share of hashes that holds about ``wanted`` of ``there`` keys."""
    if there <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * wanted / there)


def most_frequent(counts: DataFrame, most: int, column: str, key: str) -> DataFrame:
    """About the ``most`` rows of the highest counts, read off a histogram of sixteenths of octaves
    (a thousand bins at most reach the driver): all above a bin, and of that bin as large a share
    of the keys' hashes as still fits."""
    level = F.floor(F.log2(F.col(column)) * 16)
    taken, low, there = 0, None, 0
    for b, n in sorted(map(tuple, counts.groupBy(level).count().collect()), reverse=True):
        low, there = b, n
        if taken + n > most:
            break
        taken += n
        there = 0
    if low is None:
        return counts.where(F.lit(False))
    return counts.where((level > low) | ((level == low) & (F.lit(True) if there == 0 else hash_share(F.col(key), most - taken, there))))


# ---- words as arrays, inside tasks ----

_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Texts are laid end to end up to this many bytes (a longer text stands alone).
PIECE = 1 << 20
#: The same where a byte takes 50 or more on the way; a worker keeps the most it ever took.
SMALL_PIECE = 1 << 18


class _Powers:
    """Powers of a base modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.of = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.of) < n:
            step = np.uint64(pow(int(self.base), len(self.of), 1 << 64))
            self.of = np.concatenate([self.of, self.of * step])
        return self.of[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts. first: per text, plus one; where its words begin in the arrays."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def text(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()


def words_of(texts: list[bytes], between: np.ndarray = _IS_BLANK) -> Words:
    """Lower-cased (A-Z) words between blanks (or other bytes; a line break must be one), each
    with a 64-bit hash.

    A word's hash is a polynomial over its bytes, read off running sums for all words at once.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    gap = between[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap])))
    start, end = edge[0::2], edge[1::2]
    runs = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP.upto(len(data)), out=runs[1:])
    hashed = mix((runs[end] - runs[start]) * _DOWN.upto(len(data))[start] + (end - start).astype(np.uint64))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    first = np.searchsorted(start, np.concatenate([[0], np.cumsum(sizes)]))
    return Words(data, start, end, hashed, first)


def hash_of(word: str) -> int:
    """The hash that words_of gives a single word."""
    return int(words_of([word.encode()]).hash[0])


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """The texts of an Arrow column (null: empty), a few rows at a time, so that a batch of long
    texts is never copied whole."""
    for k in range(0, len(column), 256):
        for text in column.slice(k, 256).to_pylist():
            yield text.encode() if isinstance(text, str) else text or b""


def pieces(texts: Iterable[bytes], most: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about ``most`` bytes each."""
    part: list[bytes] = []
    size = at = 0
    for k, text in enumerate(texts):
        if part and size + len(text) > most:
            yield at, part
            part, size, at = [], 0, k
        part.append(text)
        size += len(text)
    if part:
        yield at, part


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
