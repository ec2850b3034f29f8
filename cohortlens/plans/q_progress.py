"""Progress log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import progress as P
from cohortlens.plans import inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import with_progress
from cohortlens.session import scratch_path

LOOKUP_ID = "STU00000001"
_LOG = 'student_id, "timestamp", attendance, average_score, risk_level, seq'


@register("progress_history", with_progress(f"SELECT {_LOG} FROM progress WHERE student_id = '{LOOKUP_ID}'"))
def progress_history(spark, sf_dir):
    return P.history(inputs.progress(spark, sf_dir, student_ids=[LOOKUP_ID]), LOOKUP_ID)


@register("progress_timeline", with_progress("""
SELECT student_id, "timestamp", seq, series, value
FROM progress UNPIVOT (value FOR series IN (attendance, average_score))"""))
def progress_timeline(spark, sf_dir):
    return P.timeline(inputs.progress(spark, sf_dir))


@register("progress_trend", with_progress("""
SELECT student_id, "timestamp", seq, attendance, average_score,
       attendance - lag(attendance) OVER w AS attendance_change_prev,
       attendance - first_value(attendance) OVER w AS attendance_change_first,
       average_score - lag(average_score) OVER w AS average_score_change_prev,
       average_score - first_value(average_score) OVER w AS average_score_change_first
FROM progress WINDOW w AS (PARTITION BY student_id ORDER BY "timestamp", seq)"""))
def progress_trend(spark, sf_dir):
    log = inputs.progress(spark, sf_dir).select("student_id", "timestamp", "seq", "attendance",
                                                "average_score")
    return P.trend(log)


@register("progress_append", with_progress(f"""
SELECT {_LOG}, cast(cast("timestamp" AS date) AS varchar) AS dt FROM progress"""))
def progress_append(spark, sf_dir):
    path = scratch_path(spark, "progress-log")
    P.append(inputs.progress(spark, sf_dir), path)
    return spark.read.parquet(path).select("student_id", "timestamp", "attendance", "average_score",
                                           "risk_level", "seq", F.col("dt").cast("string").alias("dt"))
