"""Pieces that several operators share: word hashing, Arrow batch mapping, checkpoints."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries that a worker's word table may hold before it starts afresh.
WORD_TABLE = 250_000
#: Checkpoints after which the driver is tidied.
TIDY = 4


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; empties itself when full, so memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_TABLE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim
except (OSError, AttributeError):  # another C library
    _libc = None


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def ascii_words(raw: bytes | None) -> list[bytes]:
    """A-Z lower-cased, then maximal runs without \\x20 and \\x09-\\x0D: what bytes.split() cuts at."""
    return raw.lower().split() if raw else []


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, on uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive words, in order of position."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out)


def raw_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def give_back() -> None:
    """At a task's end: what a worker kept goes, and free memory back to the system. Workers are used again and again."""
    _hashes.clear()
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what one output batch holds stays small whatever the input setting is."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)
    give_back()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, size: int = 2000) -> DataFrame:
    """fn over every Arrow batch of at most size rows."""

    def run(batches):
        for b in slices(batches, size):
            out = fn(b)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def has_checkpoints(spark: SparkSession) -> None:
    """Uses the cluster's shared spark.checkpoint.dir. Where it is unset, one machine may take a folder of its own; a cluster may not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "querysieve-checkpoints"))


_cuts = itertools.count(1)


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder now and reads it from there afterwards."""
    has_checkpoints(df.sparkSession)
    if next(_cuts) % TIDY == 0:
        tidy(df.sparkSession)
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """The driver's garbage goes, and with it what Spark keeps for frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(df: DataFrame) -> None:
    """Deletes what cut() wrote for df, which nothing may read from now on."""
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where df has such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def crc_bucket(column: str, n: int):
    """crc32 of the column's decimal text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def schema_of(df: DataFrame, *columns: str) -> str:
    """DDL of some of df's columns."""
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in columns)
