"""Token ids on disk: Arrow files of fixed-size lists, read back by memory position."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.llm.common import give_back, importable, staged, text_array
from cohortlens.llm.tokens import encoder

LENGTH = 2048
SEQUENCES = 256                               # in a record batch
MANIFEST = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("path", T.StringType()),
                         T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType())])
DOCUMENTS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")])


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.uint32() if wide else pa.uint16(), length)),
                      ("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class Writer:
    """One pair of files: ``<path>.arrow`` has equal-length sequences of ids and masks (the
    mask is false where the last one is padded), ``<path>.docs.arrow`` each document's
    place. Both are Arrow IPC files: every record batch has as many sequences, so
    sequence i is row i % SEQUENCES of batch i // SEQUENCES, and a reader that maps the
    file copies nothing. They get their names when complete, so a task that dies
    leaves nothing that is read, and one that is run again replaces the same files."""

    def __init__(self, path: str, attempt: int, length: int, wide: bool):
        from pyarrow import fs
        self.length, self.wide = length, wide
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = [f"{self.path}.{attempt}{end}" for end in (".arrow", ".docs.arrow")]
        self.schema = sequence_schema(length, wide)
        self.sinks = [self.fs.open_output_stream(p) for p in self.temporary]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, INDEX), strict=True)]
        self.waiting: list[np.ndarray] = []
        self.n_waiting, self.n_ids, self.n_docs = 0, 0, 0

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        self.files[1].write_batch(pa.RecordBatch.from_arrays(
            [pa.array(doc_ids, pa.int64()), pa.array(bounds[:-1] + self.n_ids, pa.int64()),
             pa.array(np.diff(bounds), pa.int64())], schema=INDEX))
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        full = self.length * SEQUENCES
        if self.n_waiting >= full:
            flat = np.concatenate(self.waiting)
            cut = len(flat) // full * full
            for at in range(0, cut, full):
                self._put(flat[at:at + full], full)
            self.waiting, self.n_waiting = [flat[cut:]], len(flat) - cut

    def _put(self, ids: np.ndarray, size: int) -> None:
        kind = np.uint32 if self.wide else np.uint16
        if len(ids) and int(ids.max()) > np.iinfo(kind).max:
            raise ValueError(f"id {ids.max()} doesn't fit into 16 bits; write wide files")
        flat, mask = np.zeros(size, kind), np.zeros(size, bool)
        flat[:len(ids)], mask[:len(ids)] = ids, True
        self.files[0].write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(flat), self.length),
             pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            self._put(flat, -(-len(flat) // self.length) * self.length)
        for f, s in zip(self.files, self.sinks, strict=True):
            f.close()
            s.close()
        for p, end in zip(self.temporary, (".arrow", ".docs.arrow"), strict=True):
            self.fs.move(p, self.path + end)


def write(docs: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id",
          length: int = LENGTH, wide: bool = False) -> DataFrame:
    """Encode ``docs`` into files under ``folder`` (shared by all executors) in ascending
    doc_id order; returns the manifest, one row per file in order, already written.

    Null and empty texts have the single id 2. Rows with one doc_id follow each
    other in the order of their texts' hashes; repeated rows are all kept; a null
    doc_id comes first. Other columns are not read. An empty table has no files.
    ``wide``: 32-bit ids, for vocabularies of more than 65,536; a larger id ends a run without it. One range shuffle
    of the texts; ties are split over partitions by row number, and a task holds
    one record batch and one Arrow batch.
    """
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        task, writer = TaskContext.get(), None
        path = f"{folder}/part-{task.partitionId():07d}"
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or Writer(path, task.taskAttemptId(), length, wide)
            keys, at = batch.column(0).to_pylist(), 0
            for ids, bounds in encoder(tokenizer).encode(text_array(batch.column(1))):
                n = len(bounds) - 1
                writer.add(keys[at:at + n], ids, bounds)
                at += n
        give_back()
        if writer:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([task.partitionId()], pa.int32()), pa.array([path]),
                 pa.array([writer.n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], names=MANIFEST.names)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("n", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("doc_id", "h", "n").sortWithinPartitions("doc_id", "h", "n")
    return staged(ordered.select("doc_id", "text").mapInArrow(run, MANIFEST), "token-manifest")


class Sequences:
    """Random access to the sequences of files in order (the manifest's paths): ``reader[i]`` is (ids, mask).

    A file is opened when first asked for; a local one is mapped, and ids and mask are views of it. Of
    another file the one record batch is read. Sequence numbers count over all files; each file's last
    sequence may be padded (mask false), since files are written apart."""

    def __init__(self, paths: list[str], sizes: list[int]):
        """``sizes``: the manifest's n_ids."""
        self.paths, self.files = paths, {}
        self.length = self._file(0).schema.field("ids").type.list_size if paths else 1
        self.first = np.cumsum([0] + [-(-n // self.length) for n in sizes])

    def __len__(self) -> int:
        return int(self.first[-1])

    def _file(self, k: int):
        if k not in self.files:
            from pyarrow import fs
            store, local = fs.FileSystem.from_uri(f"{self.paths[k]}.arrow")
            self.files[k] = pa.ipc.open_file(pa.memory_map(local) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(local))
        return self.files[k]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        batch, at = divmod(i - int(self.first[k]), SEQUENCES)
        rows = self._file(k).get_batch(batch)
        ids, mask = (rows.column(c).flatten().slice(at * self.length, self.length) for c in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """One row per document from the files alone: its id, the number of ids before it in
    all files, its own number of ids and their crc32 (little-endian, 32 bits each).

    A document without rows in an index file has no row. The files are dealt out
    one by one; a task reads a file batch by batch.
    """
    importable(spark)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        for batch in batches:
            for path, base, n_ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, local = fs.FileSystem.from_uri(path)
                with store.open_input_file(f"{local}.arrow") as f, store.open_input_file(f"{local}.docs.arrow") as g:
                    yield from read_file(pa.ipc.open_file(f), pa.ipc.open_file(g), base, n_ids)

    chosen = files.select("path", "base", "n_ids").repartition(F.col("path"))
    return chosen.mapInArrow(run, DOCUMENTS)


def read_file(sequences, index, base: int, n_ids: int) -> Iterator[pa.RecordBatch]:
    def chunks():
        seen = 0
        for i in range(sequences.num_record_batches):
            batch = sequences.get_batch(i)
            flat = batch.column("ids").flatten().to_numpy()          # a view of the file's buffer
            seen += batch.column("mask").flatten().true_count
            yield flat
        if seen != n_ids:
            raise ValueError(f"{n_ids} ids expected, {seen} found")

    source = chunks()
    have, at = np.zeros(0, np.uint32), 0
    for i in range(index.num_record_batches):
        part = index.get_batch(i)
        sums = []
        for n in part.column("n_tokens").to_pylist():
            crc = 0
            while n:
                if at == len(have):
                    have, at = next(source).astype("<u4"), 0
                piece = have[at:at + n]
                crc = zlib.crc32(piece, crc)
                at += len(piece)
                n -= len(piece)
            sums.append(crc)
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.compute.add(part.column("offset"), base), part.column("n_tokens"),
             pa.array(sums, pa.int64())], names=DOCUMENTS.names)
    for _ in source:                                                 # the mask count covers the whole file
        pass
