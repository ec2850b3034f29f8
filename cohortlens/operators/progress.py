"""Progress log operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.ordering import global_positions, ordered_changes

SERIES = ["attendance", "average_score"]


def history(log: DataFrame, student_id: str) -> DataFrame:
    """One student's records in time order (arrival ``seq`` breaks timestamp ties)."""
    return log.filter(F.col("student_id") == F.lit(student_id)).orderBy("timestamp", "seq")


def timeline(log: DataFrame) -> DataFrame:
    """Two series per record in long form: (student, time, seq, series, value)."""
    return log.unpivot(["student_id", "timestamp", "seq"], SERIES, "series", "value")


def trend(log: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Change of each series since the student's previous and first record."""
    ch = ordered_changes(log, "student_id", ["timestamp", "seq"], SERIES, num_partitions)
    cols = {}
    for v in SERIES:
        cols[f"{v}_change_prev"] = F.col(v) - F.col(f"prev_{v}")
        cols[f"{v}_change_first"] = F.col(v) - F.col(f"first_{v}")
    return ch.withColumns(cols).drop(*[f"{p}_{v}" for p in ("prev", "first") for v in SERIES])


def with_arrival(records: DataFrame) -> DataFrame:
    """Stamp records with the arrival time and number when they carry none, and a date partition.
    The number is the position in the batch, which breaks ties of its one arrival time."""
    if "timestamp" not in records.columns:
        records = records.withColumn("timestamp", F.current_timestamp())
    if "seq" not in records.columns:
        records = records.withColumn("seq", F.monotonically_increasing_id())
    return records.withColumn("dt", F.to_date("timestamp"))


def append(records: DataFrame, path: str) -> None:
    """Append records to the log, partitioned by date and batch (existing files are never rewritten). The
    rows of a date are brought together in files of the size that AQE aims at: a small date
    is one file, a large one is split."""
    write_batch(with_arrival(records), path, uuid.uuid4().hex)


def write_batch(records: DataFrame, path: str, batch: str) -> None:
    """Write ``records`` (with ``dt``) as the folders ``dt=.../batch=<batch>``, which a replay of the batch replaces."""
    named = records.withColumn("batch", F.lit(batch))
    named.hint("rebalance", "dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch").parquet(path)


ARRIVED = ["file_modification_time", "file_path", "file_block_start"]


def numbered(records: DataFrame, batch_id: int) -> DataFrame:
    """``records`` with ``seq`` filled where it is NULL: the batch's number, then the record's place in it.

    Places follow the files' time and name (columns ARRIVED) and the line in the file, however the files were
    split. So a replayed batch gets the same numbers, and they rise from batch to batch."""
    order = [*ARRIVED, "_line"]
    placed = global_positions(records.withColumn("_line", F.monotonically_increasing_id()), order)
    number = F.lit(batch_id << 40) + F.col("_pos")
    return placed.withColumn("seq", F.coalesce(F.col("seq").cast("long"), number)).drop(*order, "_pos", "_pid")
