"""Append-only log of prediction updates, resolved against the snapshot on read.

Rewriting the whole student snapshot for every micro-batch of predictions
would make each batch cost as much as the table. Instead each batch is
written once to a folder of its own, ``<writer>-<batch id>`` (a replay of a
batch overwrites its folder, so replays are idempotent; a stream with a fresh
checkpoint is another writer and touches no earlier batch). Readers fold the
committed batches (those with ``_SUCCESS``) into the snapshot with one
latest-per-key aggregate and one equi-join (merge on read). ``compact``
publishes that view as a new snapshot version and records the exact batches
it holds; a load clears predictions, so all batches committed before it are done with,
whether it was told of the log or not.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.operators.updates import apply_predictions
from cohortlens.sources.snapshot import SnapshotStore, file_system

# order of updates across batches and writers: when the batch was written, then its own numbering
ARRIVAL = "struct<written: timestamp, writer: string, batch: bigint, seq: bigint>"


class PredictionLog:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def append_batch(self, batch: DataFrame, batch_id: int, writer: str = "batch", ordered: bool = False) -> None:
        """Write ``batch`` (with ``seq``, its order within the writer) as the folder of (writer, batch_id).

        ``ordered``: ``seq`` orders the updates of all batches by itself (arrival numbers given by
        the source); otherwise a later batch wins over an earlier one.
        """
        if not re.fullmatch(r"[A-Za-z0-9_.]+", writer):
            raise ValueError("a writer's name is letters, digits, _ and .")
        written = F.lit(None).cast("timestamp") if ordered else F.current_timestamp()
        number = F.lit(None).cast("long") if ordered else F.lit(batch_id).cast("long")
        own = F.lit(None).cast("string") if ordered else F.lit(writer)
        arrival = F.struct(written.alias("written"), own.alias("writer"), number.alias("batch"),
                           F.col("seq").cast("long").alias("seq"))
        batch.withColumn("arrival", arrival.cast(ARRIVAL)).write.mode("overwrite").parquet(
            f"{self.base}/{writer}-{batch_id}")

    def _committed(self) -> dict[str, int]:
        """Committed batches with the time of their commit; a folder that is still being written is none."""
        fs, p, jvm = file_system(self.spark, self.base)
        marks = [jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS") for s in fs.listStatus(p)] if fs.exists(p) else []
        return {m.getParent().getName(): fs.getFileStatus(m).getModificationTime() for m in marks if fs.exists(m)}

    def batches(self) -> list[str]:
        """Names of the committed batches."""
        return sorted(self._committed())

    def next_batch(self, writer: str = "batch") -> int:
        """One more than the writer's greatest batch number, committed or not."""
        fs, p, _ = file_system(self.spark, self.base)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        own = [n.rsplit("-", 1) for n in names if "-" in n]
        return max((int(b) for w, b in own if w == writer and b.isdigit()), default=-1) + 1

    def read(self, without: frozenset[str] = frozenset()) -> DataFrame | None:
        """Updates of the committed batches that are not in ``without``, or None."""
        names = [n for n in self.batches() if n not in without]
        return self.spark.read.parquet(*[f"{self.base}/{n}" for n in names]) if names else None

    # the batches that a snapshot version already holds (or, after a load, has cleared)
    def _marker(self, version: int) -> str:
        return f"{self.base}_folded/v={version}"

    def mark_folded(self, version: int, batches: list[str]) -> None:
        self.spark.createDataFrame([(b,) for b in batches], "batch string").write.mode("overwrite").json(self._marker(version))

    def folded(self, store: SnapshotStore) -> frozenset[str]:
        """Batches that the current version holds or has cleared. A compaction and a load that knows the log
        leave a marker; a version without one comes from a load, which clears what was committed before it."""
        versions = store.versions()
        if not versions:
            return frozenset()
        fs, mark, jvm = file_system(self.spark, self._marker(versions[-1]))
        if fs.exists(jvm.org.apache.hadoop.fs.Path(mark, "_SUCCESS")):
            rows = self.spark.read.schema("batch string").json(self._marker(versions[-1])).collect()   # one per batch
            return frozenset(r["batch"] for r in rows)
        fs, done, _ = file_system(self.spark, f"{store.base}/v={versions[-1]}/_SUCCESS")
        loaded = fs.getFileStatus(done).getModificationTime()
        return frozenset(name for name, at in self._committed().items() if at <= loaded)


def current(store: SnapshotStore, log: PredictionLog) -> DataFrame:
    """Snapshot with every logged prediction applied (latest ``arrival`` wins per student)."""
    snap = store.read().drop("created_at")
    upd = log.read(log.folded(store))
    return snap if upd is None else apply_predictions(snap, upd, seq="arrival", keep_seq=True)


def compact(store: SnapshotStore, log: PredictionLog, cluster_by: tuple[str, ...] | None = None) -> int:
    """Publish the merged view, laid out by ``cluster_by``, as a new snapshot version and record
    the batches it holds. A batch committed meanwhile is not among them and is read on."""
    folded = log.folded(store)
    now = [b for b in log.batches() if b not in folded]
    snap = store.read().drop("created_at")
    if now:
        upd = log.spark.read.parquet(*[f"{log.base}/{n}" for n in now])
        snap = apply_predictions(snap, upd, seq="arrival", keep_seq=True)
    v = store.replace(snap, reject_empty=False, cluster_by=cluster_by,
                      before_commit=lambda version: log.mark_folded(version, sorted(folded | set(now))))
    return v


def cleared(log: PredictionLog):
    """``before_commit`` of a load: the loaded version holds no prediction, so all batches so far are done with."""
    return lambda version: log.mark_folded(version, log.batches())
