"""Features, risk rules, bands and difficulty tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions.exact import exact_mean
from cohortlens.operators import features, risk
from cohortlens.plans import inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import (RISK_INGEST, emean, points_label_sql, points_sql, sround,
                                      with_gen, with_progress, with_students)

_ALL = ("student_id, faculty_id, attendance, assignment_score, internal_marks, quiz_score, "
        "previous_semester_marks, average_score, attendance_ratio, performance_drop, "
        "score_variance, risk_level, predicted_risk, confidence, difficulty_type")


def risk_by_class_df(spark, sf_dir):
    st = inputs.students(spark, sf_dir)
    return (st.groupBy("faculty_id", "risk_level")
              .agg(F.count(F.lit(1)).alias("n_students"),
                   F.round(exact_mean("average_score"), 4).alias("avg_score"),
                   F.round(exact_mean("attendance"), 4).alias("avg_attendance")))


register("risk_by_class", with_students(f"""
SELECT faculty_id, risk_level, count(*) AS n_students,
       {sround(emean('average_score'), 4)} AS avg_score, {sround(emean('attendance'), 4)} AS avg_attendance
FROM students GROUP BY faculty_id, risk_level"""))(risk_by_class_df)


@register("ingest_features", with_students(f"SELECT {_ALL} FROM students"))
def ingest_features(spark, sf_dir):
    return inputs.students(spark, sf_dir)


_DERIVED = ["average_score", "attendance_ratio", "performance_drop", "score_variance", "risk_level"]


@register("ingest_default_class", with_students(
    f"SELECT student_id, '{S.DEFAULT_FACULTY}' AS faculty_id, {', '.join(_DERIVED)} FROM students"))
def ingest_default_class(spark, sf_dir):
    """Derived columns of rows that come without a class: all get the default one."""
    raw = inputs.students_raw(spark, sf_dir).drop("faculty_id")
    return features.ingest_features(raw).select("student_id", "faculty_id", *_DERIVED)


# Deterministic NULL injection on every row's key (no rows are removed): scores
# go missing on different residues so one, two and three missing values occur.
def _with_nulls(df):
    key = F.substring("student_id", 4, 8).cast("bigint")
    return df.withColumns({
        "assignment_score": F.when(key % 7 != 0, F.col("assignment_score")),
        "internal_marks": F.when(key % 5 != 0, F.col("internal_marks")),
        "quiz_score": F.when(key % 3 != 0, F.col("quiz_score")),
    })


_NULLS_SQL = """
SELECT student_id, faculty_id, attendance,
       CASE WHEN cast(substr(student_id, 4, 8) AS bigint) % 7 <> 0 THEN assignment_score END AS assignment_score,
       CASE WHEN cast(substr(student_id, 4, 8) AS bigint) % 5 <> 0 THEN internal_marks END AS internal_marks,
       CASE WHEN cast(substr(student_id, 4, 8) AS bigint) % 3 <> 0 THEN quiz_score END AS quiz_score,
       previous_semester_marks
FROM students_base"""


@register("row_mean_nulls", with_students("""
SELECT student_id, average_score, performance_drop, score_variance, risk_level FROM students""",
                                          raw_from_base=_NULLS_SQL))
def row_mean_nulls(spark, sf_dir):
    raw = _with_nulls(inputs.students_raw(spark, sf_dir))
    st = features.ingest_features(raw)
    return st.select("student_id", "average_score", "performance_drop", "score_variance", "risk_level")


@register("scoring_features", with_gen("""
SELECT student_id, round(g_avg, 2) AS average_score, round(attendance / 1e2, 4) AS attendance_ratio,
       round(g_drop, 2) AS performance_drop, round(g_var, 2) AS score_variance
FROM gen"""))
def scoring_features(spark, sf_dir):
    raw = inputs.students_raw(spark, sf_dir)
    return features.scoring_features(raw).select(
        "student_id", "average_score", "attendance_ratio", "performance_drop", "score_variance")


@register("risk_ingest", with_students(f"""
SELECT student_id, attendance, average_score, {RISK_INGEST} AS risk_level FROM features"""))
def risk_ingest(spark, sf_dir):
    st = features.ingest_features(inputs.students_raw(spark, sf_dir), label=False)
    return risk.label_ingest(st).select("student_id", "attendance", "average_score", "risk_level")


@register("risk_points", with_gen(f"""
SELECT student_id, {points_sql()} AS risk_points, {points_label_sql()} AS risk_level
FROM gen"""))
def risk_points(spark, sf_dir):
    return risk.label_points(inputs.students_raw(spark, sf_dir)).select(
        "student_id", "risk_points", "risk_level")


@register("risk_progress", with_progress("""
SELECT student_id, seq, attendance, average_score, risk_level FROM progress"""))
def risk_progress(spark, sf_dir):
    return risk.label_progress(inputs.progress(spark, sf_dir).drop("risk_level")).select(
        "student_id", "seq", "attendance", "average_score", "risk_level")


@register("risk_category_counts", with_students("""
SELECT CASE WHEN attendance >= 85 AND assignment_score >= 80 THEN 'Low Risk (High Performers)'
            WHEN attendance >= 70 AND assignment_score >= 65 THEN 'Medium Risk'
            ELSE 'High Risk (Low Performers)' END AS category, count(*) AS count
FROM students_raw GROUP BY 1"""))
def risk_category_counts(spark, sf_dir):
    return risk.category_counts(inputs.students_raw(spark, sf_dir))


def _band_sql(c, hi, mid):
    return f"CASE WHEN {c} >= {hi} THEN 'good' WHEN {c} >= {mid} THEN 'watch' ELSE 'poor' END"


_BAND_COLS = ("attendance_band", "average_band", "assignment_score_band", "internal_marks_band",
              "quiz_score_band", "previous_semester_marks_band")


@register("score_bands", with_students("SELECT student_id, "
          + f"{_band_sql('attendance', '75e0', '60e0')} AS attendance_band, "
          + f"{_band_sql('average_score', '65e0', '50e0')} AS average_band, "
          + ", ".join(f"{_band_sql(c, '70e0', '50e0')} AS {c}_band"
                      for c in ["assignment_score", "internal_marks", "quiz_score",
                                "previous_semester_marks"])
          + " FROM students"))
def score_bands(spark, sf_dir):
    return risk.bands(inputs.students(spark, sf_dir)).select("student_id", *_BAND_COLS)


_DIFF_SQL = """
concat_ws(', ',
  CASE WHEN coalesce(attendance, 1e2) < 60 THEN 'Attendance Issue' END,
  CASE WHEN coalesce(internal_marks, 1e2) < 50 OR coalesce(quiz_score, 1e2) < 50 THEN 'Conceptual Weakness' END,
  CASE WHEN coalesce(assignment_score, 1e2) < 50 THEN 'Practice Inconsistency' END,
  CASE WHEN coalesce(score_variance, 0e0) > 300 OR abs(coalesce(performance_drop, 0e0)) > 15
       THEN 'Performance Fluctuation' END)"""


@register("difficulty_types", with_students(f"""
SELECT student_id,
       CASE WHEN {_DIFF_SQL} = '' THEN 'General Improvement Needed' ELSE {_DIFF_SQL} END AS difficulty_types,
       cast(CASE WHEN {_DIFF_SQL} = '' THEN 1
                 ELSE length({_DIFF_SQL}) - length(replace({_DIFF_SQL}, ',', '')) + 1 END AS integer)
         AS n_types
FROM students"""))
def difficulty_types(spark, sf_dir):
    st = risk.difficulty(inputs.students(spark, sf_dir), out="tags")
    return st.select("student_id", F.concat_ws(", ", "tags").alias("difficulty_types"),
                     F.size("tags").alias("n_types"))


_ALERT_SQL = """
concat_ws(', ',
  CASE WHEN coalesce(attendance, 1e2) < 60 THEN 'Attendance' END,
  CASE WHEN coalesce(internal_marks, 1e2) < 50 THEN 'Conceptual' END,
  CASE WHEN coalesce(assignment_score, 1e2) < 50 THEN 'Practice' END,
  CASE WHEN abs(coalesce(performance_drop, 0e0)) > 15 THEN 'Fluctuation' END)"""


@register("class_alerts", with_students(f"""
SELECT student_id, attendance, assignment_score, internal_marks, quiz_score, average_score,
       CASE WHEN {_ALERT_SQL} = '' THEN 'General' ELSE {_ALERT_SQL} END AS difficulty
FROM students WHERE risk_level = 'High Risk'"""))
def class_alerts(spark, sf_dir):
    return risk.class_alerts(inputs.students(spark, sf_dir))

