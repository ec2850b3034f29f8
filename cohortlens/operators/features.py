"""Derived student features (ingest path and scoring path).

Ingest rule: a derived column is computed only when the column is *absent*
from the input; a present column is kept as is, even when NULL. The decision
is taken at plan time from ``df.columns``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions.rowstats import (nan_to_null, row_mean, row_var_population,
                                           row_var_sample)
from cohortlens.functions.rules import risk_ingest


def clean_nan(df: DataFrame, cols=None) -> DataFrame:
    """Turn NaN into NULL in the given (default: all double) columns."""
    cols = cols or [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in cols if c in df.columns})


def ingest_features(df: DataFrame, label: bool = True) -> DataFrame:
    """faculty default, average, ratio, drop, sample variance and ingest risk label."""
    cols = set(df.columns)
    out = df
    if "faculty_id" not in cols:
        out = out.withColumn("faculty_id", F.lit(S.DEFAULT_FACULTY))
    scores = [c for c in S.SCORE_COLS if c in cols]
    if "average_score" not in cols and scores:
        out = out.withColumn("average_score", F.round(row_mean(scores), 2))
    if "attendance_ratio" not in cols and "attendance" in cols:
        out = out.withColumn("attendance_ratio", F.round(F.col("attendance") / 100, 4))
    if ("performance_drop" not in cols and "previous_semester_marks" in cols
            and "average_score" in out.columns):
        out = out.withColumn("performance_drop",
                             F.round(F.col("previous_semester_marks") - F.col("average_score"), 2))
    if "score_variance" not in cols and len(scores) >= 2:
        out = out.withColumn("score_variance", F.round(row_var_sample(scores), 2))
    if label and "risk_level" not in cols:
        att = F.col("attendance") if "attendance" in out.columns else F.lit(None).cast("double")
        avg = F.col("average_score") if "average_score" in out.columns else F.lit(None).cast("double")
        out = out.withColumn("risk_level", risk_ingest(att, avg))
    return out


PREDICTION_COLS = ("predicted_risk", "confidence", "difficulty_type")


def to_snapshot_columns(df: DataFrame, keep_predictions: bool = False) -> DataFrame:
    """Project to the fixed stored column list (without ``created_at``); absent columns
    become NULL, so a fresh load leaves the prediction columns NULL."""
    sel = []
    for f in S.STUDENTS.fields[:-1]:
        keep = f.name in df.columns and (keep_predictions or f.name not in PREDICTION_COLS)
        sel.append(F.col(f.name).cast(f.dataType) if keep
                   else F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(sel)


def scoring_features(df: DataFrame) -> DataFrame:
    """Scoring path: missing values are 0, population variance, drop from the unrounded mean."""
    vals = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            for c in S.REQUEST_FIELDS}
    z = df.withColumns(vals)
    mean = (F.col("assignment_score") + F.col("internal_marks") + F.col("quiz_score")) / 3
    return z.withColumns({
        "average_score": F.round(mean, 2),
        "attendance_ratio": F.round(F.col("attendance") / 100, 4),
        "performance_drop": F.round(F.col("previous_semester_marks") - mean, 2),
        "score_variance": F.round(row_var_population(S.SCORE_COLS), 2),
    })


def generator_features(df: DataFrame) -> DataFrame:
    """Unrounded features of the data generator (input of the points rule)."""
    mean = (F.col("assignment_score") + F.col("internal_marks") + F.col("quiz_score")) / 3
    return df.withColumns({
        "average_score": mean,
        "attendance_ratio": F.col("attendance") / 100,
        "performance_drop": F.col("previous_semester_marks") - mean,
        "score_variance": row_var_population(S.SCORE_COLS),
    })


def project_existing(df: DataFrame, cols) -> DataFrame:
    """Select only the listed columns that exist, in the listed order."""
    return df.select([c for c in cols if c in df.columns])
