"""Helpers shared by the operators: reading tables, stored intermediate tables, byte-level numpy work on Arrow batches.

Tasks get whole documents as Arrow batches. A batch is cut into chunks of a few
megabytes (a longer document is a chunk of its own), so the working memory of a
task follows the longest document and not the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sourceweave.session import shared_path

CHUNK_BYTES = 2 << 20
#: fixed values: white space that parts words, and A-Z to a-z on bytes
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: word bytes after lower-casing: digits, a-z and all of non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: short plans, nothing lost with an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings (dots as __) for the jobs started inside."""
    old = {k.replace("__", "."): spark.conf.get(k.replace("__", "."), None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k.replace("__", "."), v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def mixed_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], _U))[0])


class Roller:
    """Hashes of arbitrary byte ranges of one buffer, equal for equal bytes wherever they stand.

    S is the running sum of table[byte] * base**i modulo 2**64; a range is the
    difference of two sums, moved to position 0 by the inverse power.
    """

    def __init__(self, seed: int = 1):
        base = (mixed_int(seed) & ~7) | 5
        self.table = mix(np.arange(256, dtype=_U) + _U(seed * 1000003 + 17))
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, _U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.ones(n, _U)
                done = 1
                while done < n:  # doubling: p[done:2 done] = p[:done] * b**done
                    k = min(done, n - done)
                    p[done : done + k] = p[:k] * _U(pow(b, done, 2**64))
                    done += k
                setattr(self, name, p)

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, _U)
        np.cumsum(self.table[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))

    def one(self, data: bytes) -> int:
        n = np.array([0]), np.array([len(data)])
        return int(self.spans(self.sums(np.frombuffer(data, np.uint8)), *n)[0])


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, offs = binary_parts(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked bytes that never cross a document: (starts, ends, index of each document's first run)."""
    n = len(inside)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offs)


def owner(first: np.ndarray) -> np.ndarray:
    """Document number of each run, from the index of first runs."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each document's slice."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def ragged(flat_first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that gather variable-length slices one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(flat_first, lengths)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of n places that lie in any of the ranges."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as Spark's signed long."""
    return x.view(np.int64)
