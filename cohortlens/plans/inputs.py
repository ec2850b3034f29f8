"""Input tables of every registered query, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortlens.operators.features import clean_nan, ingest_features, to_snapshot_columns
from cohortlens.sources import bridge


def students(spark: SparkSession, sf_dir: str, student_ids=None, faculty_ids=None) -> DataFrame:
    """The stored snapshot as a fresh ingest would produce it (prediction columns NULL);
    ``student_ids`` / ``faculty_ids`` push a lookup down to the source scans."""
    raw = clean_nan(bridge.students_raw(spark, sf_dir, student_ids, faculty_ids))
    return to_snapshot_columns(ingest_features(raw))


def students_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_nan(bridge.students_raw(spark, sf_dir))


def progress(spark: SparkSession, sf_dir: str, student_ids=None) -> DataFrame:
    return bridge.progress_log(spark, sf_dir, student_ids)
