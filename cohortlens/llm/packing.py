"""Harmonic packing of token streams into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cohortlens.llm.common import give_back, importable, text_array
from cohortlens.llm.tokens import encoder

CAPACITY = 4096
PIECES = T.StructType([T.StructField("doc_id", T.LongType())] + [
    T.StructField(n, T.LongType()) for n in
    ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class")])


def classes(capacity: int = CAPACITY, waste: float = 0.01) -> dict[int, int]:
    """Class lengths (longest first) and how many pieces fill a bin of each.

    Class k takes pieces of floor(capacity / k) tokens, k to a bin. Classes
    whose bins would leave more than ``waste`` of the capacity empty are left
    out, except that every power of two is a class: those leave nothing.
    """
    found = {capacity // k: k for k in range(capacity, 0, -1)
             if capacity - k * (capacity // k) <= waste * capacity}
    found |= {1 << j: capacity >> j for j in range(capacity.bit_length())}
    return {n: capacity // n for n in sorted(found, reverse=True)}


class Packer:
    """Bins of one worker. A document's stream is cut into pieces of class lengths,
    longest first, and each piece goes to the open bin of its class. A bin is
    full after its class's fixed count; no other worker is asked."""

    def __init__(self, worker: int, capacity: int = CAPACITY):
        if capacity & (capacity - 1):
            raise ValueError("the capacity must be a power of two")
        self.capacity, self.per_bin = capacity, classes(capacity)
        self.lengths = np.array(list(self.per_bin))
        self.floor = np.zeros(capacity + 1, np.int64)          # longest class up to each length
        for n in sorted(self.per_bin):
            self.floor[n:] = n
        self.worker, self.opened = worker, 0
        self.open: dict[int, list] = {}

    def _next(self) -> int:
        self.opened += 1
        return (self.worker << 40) + self.opened - 1

    def cut(self, n: int) -> list[int]:
        """Class lengths that make up ``n`` tokens."""
        whole, rest = divmod(n, self.capacity)
        out = [self.capacity] * whole
        while rest:
            out.append(int(self.floor[rest]))
            rest -= out[-1]
        return out

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        at, n = 0, len(ids)
        for size in self.cut(n):
            piece = (doc_id, at, size, ids[at:at + size], n)
            at += size
            if size == self.capacity:
                yield self.row(piece, self._next(), 0, size)
                continue
            waiting = self.open.setdefault(size, [])
            waiting.append((doc_id, piece[1], size, piece[3].copy(), n))       # a waiting piece holds its own ids, not its document's
            if len(waiting) == self.per_bin[size]:
                number = self._next()
                for i, p in enumerate(waiting):
                    yield self.row(p, number, i * size, size)
                del self.open[size]

    @staticmethod
    def row(piece, sequence: int, offset: int, size: int) -> tuple:
        doc_id, at, n, ids, total = piece
        return doc_id, at, n, zlib.crc32(ids.astype("<u4").tobytes()), total, sequence, offset, size

    def close(self) -> Iterator[tuple]:
        """The worker's unfilled bins: their pieces are cut into powers of two, and each
        length's pieces go out in sequences whose totals are powers of two (no padding)."""
        small: dict[int, list] = {}
        for pieces in self.open.values():
            for doc_id, at, n, ids, total in pieces:
                done = 0
                while done < n:
                    size = 1 << ((n - done).bit_length() - 1)
                    small.setdefault(size, []).append((doc_id, at + done, size, ids[done:done + size], total))
                    done += size
        self.open = {}
        for size, pieces in sorted(small.items(), reverse=True):
            at = 0
            while at < len(pieces):
                count = min(self.capacity // size, 1 << ((len(pieces) - at).bit_length() - 1))
                number = self._next()
                for i, p in enumerate(pieces[at:at + count]):
                    yield self.row(p, number, i * size, size)
                at += count


def pack(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id",
         capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents, packed: one row per piece (see ``PIECES``).

    A null or empty text has the single id 2. A repeated row is packed as often as
    it occurs; a null doc_id stays null. Other columns are not read. An empty
    table gives no rows. There is no shuffle: every input partition fills its
    own bins, numbered from its partition index, so a partition that is run
    again gives the same rows, and ``sequence_id`` is unique. A worker holds at
    most one unfilled bin for each class (about a hundred), whatever it reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        packer = Packer(TaskContext.get().partitionId(), capacity)
        types = [pa.int64()] * len(PIECES)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=PIECES.names)

        rows: list[tuple] = []
        for batch in batches:
            keys, at = batch.column(0).to_pylist(), 0
            for ids, bounds in encoder(tokenizer).encode(text_array(batch.column(1))):
                for i in range(len(bounds) - 1):
                    rows += packer.add(keys[at + i], ids[bounds[i]:bounds[i + 1]])
                at += len(bounds) - 1
                if len(rows) > 20_000:
                    yield batch_of(rows)
                    rows = []
        rows += packer.close()
        if rows:
            yield batch_of(rows)
        give_back()

    importable(docs.sparkSession)
    return docs.select(docs[doc_id].cast("long"), docs[text].cast("string")).mapInArrow(run, PIECES)
