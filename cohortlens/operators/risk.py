"""Risk labelling operators (each rule set of the reference, by name)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions import rules
from cohortlens.operators.features import generator_features


def label_ingest(df: DataFrame, out: str = "risk_level") -> DataFrame:
    return df.withColumn(out, rules.risk_ingest())


def label_points(df: DataFrame, out: str = "risk_level") -> DataFrame:
    """Training-label rule on the generator's unrounded features."""
    g = generator_features(df)
    pts = rules.risk_points_total()
    return (g.withColumn("risk_points", pts)
             .withColumn(out, rules.risk_points(F.col("risk_points"))))


def label_progress(df: DataFrame, out: str = "risk_level") -> DataFrame:
    return df.withColumn(out, rules.risk_progress())


def category_counts(df: DataFrame) -> DataFrame:
    """Risk category of the external sample's check query, with counts."""
    return (df.groupBy(rules.risk_category().alias("category"))
              .agg(F.count(F.lit(1)).alias("count")))


def bands(df: DataFrame) -> DataFrame:
    """good/watch/poor grades for attendance, average and each single score."""
    a_hi, a_mid = S.BANDS["attendance"]
    v_hi, v_mid = S.BANDS["average_score"]
    s_hi, s_mid = S.BANDS["score"]
    cols = {"attendance_band": rules.band("attendance", a_hi, a_mid),
            "average_band": rules.band("average_score", v_hi, v_mid)}
    for c in ["assignment_score", "internal_marks", "quiz_score", "previous_semester_marks"]:
        cols[f"{c}_band"] = rules.band(c, s_hi, s_mid)
    return df.withColumns(cols)


def difficulty(df: DataFrame, out: str = "difficulty_types") -> DataFrame:
    return df.withColumn(out, rules.difficulty_types(df.columns))


def class_alerts(df: DataFrame) -> DataFrame:
    """High Risk rows with short difficulty tags, worst average first."""
    hr = df.filter(F.col("risk_level") == S.HIGH)
    cols = [c for c in S.ALERT_COLS if c in df.columns]
    return (hr.select(*cols, rules.alert_tags(df.columns).alias("difficulty"))
              .orderBy(F.col("average_score").asc_nulls_last(), "student_id"))
