"""Helpers shared by the text operators: table reads, staged tables, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cohortlens.session import scratch_path
from cohortlens.sources.snapshot import file_system

BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_MULT = 0x9E3779B97F4A7C15                 # odd, so it has an inverse modulo 2^64
_MULT_INV = pow(_MULT, -1, 1 << 64)


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (local masters; on a
    cluster it is installed or shipped with --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    # a batch is bounded by its bytes, so that long texts don't make it large
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def give_back() -> None:
    """Return freed memory to the machine at a task's end: a worker is kept for later tasks, also of
    queries that need the room elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):       # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, and a
    lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the folder of a ``staged`` table. Only for one that no later plan reads: whatever was
    derived from it must be staged itself, so that nothing is computed from it again."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path, _ = file_system(df.sparkSession, folder)
        fs.delete(path, True)


def append_columns(df: DataFrame, fields: list[T.StructField],
                   fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Every row of ``df`` plus the columns that ``fn`` computes per Arrow batch."""
    importable(df.sparkSession)
    schema = T.StructType(list(df.schema.fields) + fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(list(batch.columns) + fn(batch), names=names)
        give_back()

    return df.mapInArrow(run, schema)


def text_array(column: pa.Array) -> pa.Array:
    """A string column with nulls read as empty text."""
    return pc.fill_null(column, "")


def row_blocks(texts: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text each; a longer text is a block of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(texts)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
        yield at, min(to, n)
        at = to


def joined_bytes(texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one byte array, each followed by the byte ``end``, and their n + 1 bounds."""
    raw = pa.array([], pa.large_binary()) if not len(texts) else \
        pc.binary_join_element_wise(texts.cast(pa.large_string()).cast(pa.large_binary()),
                                    pa.scalar(b"", pa.large_binary()), pa.scalar(end, pa.large_binary()))
    if isinstance(raw, pa.ChunkedArray):
        raw = raw.combine_chunks()
    if not len(raw):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, m in enumerate((_MULT, _MULT_INV)):
            steps = np.full(n, m, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and row number of every word of ``texts``, in order.

    Words are runs of letters, digits, ``_`` and non-ASCII characters, in lower
    case. A word's hash is a polynomial in its bytes, taken from prefix sums
    modulo 2^64, so no word becomes a Python object.
    """
    data, bounds = joined_bytes(pc.utf8_lower(texts), b"\n")
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _WORD[data]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]              # the last byte is a newline
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        s0 = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, s0 + BLOCK_BYTES, side="right")))
        size = int(ends[to - 1] - s0)
        powers, inverse = _powers(max(size, 1))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum((data[s0:s0 + size].astype(np.uint64) + np.uint64(1)) * powers[:size], out=sums[1:])
        s, e = starts[at:to] - s0, ends[at:to] - s0
        out[at:to] = (sums[e] - sums[s]) * inverse[s]
        at = to
    return mix(out), np.searchsorted(bounds, starts, side="right") - 1


def parities(h: np.ndarray, row: np.ndarray, n: int, longs: int) -> np.ndarray:
    """(n, longs): a bitmap for each row, a bit of which says whether an odd number of the row's distinct hashes fall on it.

    What two rows have in common cancels out, however much that is: as many bits as differ, as many hashes at least
    are in one row only."""
    cells = row * np.int64(longs * 64) + (mix(h) & np.uint64(longs * 64 - 1)).astype(np.int64)
    odd = (np.bincount(cells, minlength=n * longs * 64) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, longs * 64), axis=1, bitorder="little").view(np.int64)


def shingles(h: np.ndarray, row: np.ndarray, n: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``n`` words within one row; a row of 1 to n - 1
    words has one shingle of all its words, a row without words none."""
    if not len(h):
        return h, row
    k = min(n, len(h))
    acc = np.zeros(len(h), np.uint64)
    same = np.zeros(len(h), bool)
    full = len(h) - n + 1
    if full > 0:
        run = h[:full].copy()
        for j in range(1, k):
            run = run * np.uint64(_MULT) + h[j:full + j]
        acc[:full] = mix(run)
        same[:full] = row[:full] == row[n - 1:]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.concatenate([first, [len(h)]]))
    for at, size in zip(first[sizes < n], sizes[sizes < n], strict=True):
        run = h[at:at + 1].copy()
        for j in range(1, size):
            run = run * np.uint64(_MULT) + h[at + j:at + j + 1]
        acc[at], same[at] = mix(run + np.uint64(size))[0], True
    return acc[same], row[same]
