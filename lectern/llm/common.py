"""Shared pieces: stored tables, bounded text pieces, word hashes over whole byte buffers."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1 << 20


class Scratch:
    """Tables written to the shared folder (`spark.checkpoint.dir`) that cut lineage and survive lost executors.

    A session that names no folder gets one of its own only where driver and executors are one process.  `drop` deletes
    a table that nothing reads any more; what a result still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        name = "spark.checkpoint.dir"
        top = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name, None)
        if not top:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError(f"set {name} to a folder that all executors share")
            top = tempfile.mkdtemp(prefix="spark-")
            spark.conf.set(name, top)
        self.top = f"{top.rstrip('/')}/llm"

    def store(self, df: DataFrame) -> DataFrame:
        path = f"{self.top}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df))[0])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        """Delete all tables stored through this object."""
        self.drop(*(kept for _, kept in self.paths.values()))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text",
           limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of record batches with about `limit` text bytes (a longer text comes alone): slice, bytes, offsets."""
    for batch in batches:
        text = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at), data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
            at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_STEP = 0x5851F42D4C957F2D


class _Local(list):
    """A list that each process fills for itself: empty when sent to a task."""

    def __reduce__(self):
        return _Local, ()


_powers = _Local()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, np.uint64(k))]), dtype=np.uint64)
                      for k in (_STEP, pow(_STEP, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` reads the hash of any byte span."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
NOT_WORD = np.zeros(256, bool)
NOT_WORD[[*range(0, 48), *range(58, 97), *range(123, 128)]] = True


def words(data: np.ndarray, offsets: np.ndarray, stop: np.ndarray = BLANK):
    """Word hashes of lower-cased texts, with the row and the byte span of each; `stop` marks the bytes between words."""
    low = LOWER[data]
    inside = ~stop[low]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]]) & ~first[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~first[1:]
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    return span_hash(prefix_sums(low), start, end), row, start, end


def shingles(word: np.ndarray, row: np.ndarray, size: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size` words in succession, sorted by row; a shorter text's words are one shingle."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    whole = np.concatenate([word, np.zeros(size, np.uint64)])
    keys, rows = [], []
    n = len(word) - size + 1
    if n > 0:
        same = row[:n] == row[size - 1:]
        made = np.zeros(n, np.uint64)
        for k in range(size):
            made = made * np.uint64(_STEP) + word[k:k + n]
        keys.append(mix(made[same]))
        rows.append(row[:n][same])
    for few in range(1, size):
        at = np.flatnonzero(count == few)
        made = np.full(len(at), few, np.uint64)
        for k in range(few):
            made = made * np.uint64(_STEP) + whole[begin[at] + k]
        keys.append(mix(made))
        rows.append(at)
    key, of = np.concatenate(keys), np.concatenate(rows).astype(np.int64)
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    return key[new], of[new]
