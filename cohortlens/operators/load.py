"""Snapshot load: source -> checks -> derived columns -> key policy -> new version.

The two reference load paths differ only in their checks and duplicate policy:
the CSV path has no required-column check and fails the whole load on a
repeated key (the old snapshot stays); the external-table path requires the
six columns and lets the last row of a key win. Both are one plan ending in
one versioned write; the duplicate check looks at the written rows before
they are published.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators import features, validate
from cohortlens.sources.files import ARRIVAL, CORRUPT
from cohortlens.sources.snapshot import SnapshotStore


def prepare(df: DataFrame, on_duplicate: str = "error", require: bool = False,
            seq: str | None = None, check: bool = True) -> DataFrame:
    """``on_duplicate``: "error" (reject the load) or "last" (greatest ``seq`` wins).

    Spark rows have no inherent order, so "last" needs an arrival column: ``seq``, or the file and
    position that ``read_students_csv(arrival=True)`` adds. ``check=False`` leaves the "error"
    check to the caller.
    """
    if require:
        validate.require_columns(df)
    src = features.clean_nan(df)
    if on_duplicate == "error":
        if check:
            validate.assert_unique_key(src)
    elif on_duplicate == "last":
        order = seq or ARRIVAL
        if order not in src.columns:
            raise ValueError("'last' needs an arrival column: name one, or read files with arrival=True")
        src = validate.dedupe_last(src, "student_id", order)
    else:
        raise ValueError("on_duplicate must be 'error' or 'last'")
    return features.to_snapshot_columns(features.ingest_features(src))


CLUSTER_BY = ("faculty_id", "student_id")


def load(store: SnapshotStore, df: DataFrame, on_duplicate: str = "error", require: bool = False,
         seq: str | None = None, cluster_by: tuple[str, ...] | None = None,
         before_commit: Callable[[int], None] | None = None) -> int:
    """Publish the prepared rows as a new snapshot version; returns the version
    (``store.rows_written`` is the number of rows). The input is computed once."""
    check = validate.assert_unique_key if on_duplicate == "error" else None
    return store.replace(prepare(df, on_duplicate, require, seq, check=False), cluster_by=cluster_by,
                         before_commit=before_commit, check=check)


def split_corrupt(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows, ``line`` as it stood in the file) of a read with ``keep_corrupt``."""
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT), df.where(F.col(CORRUPT).isNotNull()).withColumnRenamed(CORRUPT, "line")
