"""What the corpus operators share: words of Arrow text columns as numpy arrays, hash splits, scratch tables.

Texts are handled as the UTF-8 buffer of an Arrow column, in chunks of whole rows of about half a megabyte, so
memory stays bounded by the chunk or by the longest single text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lower-cases A-Z, byte by byte; other bytes, those of non-ASCII letters included, stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes of the words [^\x20\x09-\x0D]+.
INK = np.ones(256, dtype=bool)
INK[[0x20, *range(0x09, 0x0E)]] = False

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n + 1, 1 << 19), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def powers(n: int) -> np.ndarray:
    """Powers 0 to n of the base of polynomial hashes."""
    return _powers(n)[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finaliser of MurmurHash3)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def aliased(docs: DataFrame, asked: set[str]) -> tuple[DataFrame, list]:
    """docs with all columns but those asked for renamed, so that none clashes on its way, and the columns that undo it."""
    names = {c: c if c in asked else f"carried_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def in_batches(df: DataFrame) -> DataFrame:
    """df, whose Python tasks now get a thousand rows at a time: whole texts need more room than the usual rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df


def text_array(column: pa.Array) -> pa.Array:
    """The column as large strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def chunks(column: pa.Array, budget: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and row offsets of consecutive rows of at most budget bytes together (or one row)."""
    texts = text_array(column)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


class Words:
    """Start, end, row and hash of each word of a chunk; rows never share a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        n = len(data)
        w = inside[data]
        before, after = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
            filled = offsets[1:] > offsets[:-1]
            before[offsets[:-1][filled]] = False
            after[offsets[1:][filled] - 1] = False
        self.data, self.rows = data, len(offsets) - 1
        self.start = np.flatnonzero(w & ~before)
        self.end = np.flatnonzero(w & ~after) + 1
        #: Of each row, its first word.
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self.prefix = prefix_hash(data)
        self.hash = span_hash(self.prefix, self.start, self.end)

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of so many consecutive words of one row."""
        n = len(self.hash)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.row[: n - size + 1] == self.row[size - 1 :])
        if not len(at):
            return at, np.zeros(0, np.uint64)
        total = np.zeros(n - size + 1, np.uint64)
        for j in range(size):
            total = total * _BASE + self.hash[j : n - size + 1 + j]
        return at, mix(total[at])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    powers = _powers(len(data))[0]
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((prefix[end] - prefix[start]) * _powers(len(prefix))[1][start] ^ (end - start).astype(np.uint64))


def id_mod(column: str, k: int):
    """crc32 of the id written as text, modulo k; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes on disk of a written table that is broadcast, at most.
SMALL_BYTES = 12 << 20


class Scratch:
    """Tables written to the shared folder of spark.checkpoint.dir, to cut lineage in a way that survives lost executors.

    Where no such folder is set, a session of one machine gets one of its own; a cluster gets an error.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = f"file://{tempfile.mkdtemp(prefix='faultline-')}"
            spark.conf.set("spark.checkpoint.dir", base)
        self.path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def _store(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def hint(self, df: DataFrame, name: str, most: int = SMALL_BYTES) -> DataFrame:
        """df, made of the table kept under this name: to be broadcast if that has no more than these bytes on disk."""
        path, store = self._store(name)
        return F.broadcast(df) if store.getContentSummary(path).getLength() <= most else df

    def drop(self, pattern: str) -> None:
        """Deletes the tables whose names the pattern (with * and ?) matches, once nothing reads them any more."""
        path, store = self._store(pattern)
        for found in store.globStatus(path) or []:
            store.delete(found.getPath(), True)

    def settle(self) -> None:
        """Spark deletes the files of shuffles that nothing reads any more when the driver collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()
