"""Schemas, column lists and the fixed output vocabulary."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the reference's output vocabulary and
# thresholds for results to match (labels, tags, categories, priorities).
# ---------------------------------------------------------------------------
HIGH = "High Risk"
MEDIUM = "Medium Risk"
LOW = "Low Risk"
RISK_LABELS = [HIGH, MEDIUM, LOW]              # display order
RISK_LABELS_ALPHA = [HIGH, LOW, MEDIUM]        # label-encoder (alphabetical) order
CATEGORY_LABELS = ["Low Risk (High Performers)", "Medium Risk", "High Risk (Low Performers)"]

DIFFICULTY_TAGS = ["Attendance Issue", "Conceptual Weakness", "Practice Inconsistency",
                   "Performance Fluctuation"]
DIFFICULTY_FALLBACK = "General Improvement Needed"
ALERT_TAGS = ["Attendance", "Conceptual", "Practice", "Fluctuation"]
ALERT_FALLBACK = "General"

DEFAULT_FACULTY = "FAC001"
ROLES = ["admin", "faculty", "student"]
DEFAULT_ACCOUNTS = [("admin", "admin", None, None),
                    ("faculty1", "faculty", None, "FAC001"),
                    ("faculty2", "faculty", None, "FAC002")]

SCORE_COLS = ["assignment_score", "internal_marks", "quiz_score"]
REQUIRED_COLS = ["student_id", "attendance", "assignment_score", "internal_marks",
                 "quiz_score", "previous_semester_marks"]
REQUEST_FIELDS = ["attendance", "assignment_score", "internal_marks", "quiz_score",
                  "previous_semester_marks"]
PROGRESS_FIELDS = ["student_id", "attendance", "average_score", "risk_level"]
FEATURE_COLS = ["attendance", "assignment_score", "internal_marks", "quiz_score",
                "previous_semester_marks", "average_score", "attendance_ratio",
                "performance_drop", "score_variance"]
PROFILE_COLS = ["attendance", "assignment_score", "internal_marks", "quiz_score",
                "previous_semester_marks"]
DISPLAY_COLS = ["student_id", "faculty_id", "attendance", "assignment_score", "internal_marks",
                "quiz_score", "previous_semester_marks", "average_score", "risk_level"]
ALERT_COLS = ["student_id", "attendance", "assignment_score", "internal_marks", "quiz_score",
              "average_score"]
CORRELATION_COLS = ["attendance", "assignment_score", "internal_marks", "quiz_score",
                    "previous_semester_marks", "average_score", "performance_drop",
                    "score_variance"]
MEAN_COLS = ["attendance", "assignment_score", "internal_marks", "quiz_score", "average_score"]

# Three-band cut points (hi, mid) per metric.
BANDS = {"attendance": (75.0, 60.0), "average_score": (65.0, 50.0),
         "score": (70.0, 50.0), "model_metric": (0.85, 0.70)}

SAMPLE_SIZE_ADMIN = 300
SAMPLE_SIZE_CLASS = 250
SEED = 42

# ---------------------------------------------------------------------------
# Struct types
# ---------------------------------------------------------------------------
_D = T.DoubleType()
_S = T.StringType()

STUDENTS_CSV = T.StructType(
    [T.StructField("student_id", _S), T.StructField("faculty_id", _S)]
    + [T.StructField(c, _D) for c in FEATURE_COLS]
    + [T.StructField("risk_level", _S)])

STUDENTS = T.StructType(
    STUDENTS_CSV.fields
    + [T.StructField("predicted_risk", _S), T.StructField("confidence", _D),
       T.StructField("difficulty_type", _S), T.StructField("created_at", T.TimestampType())])

PROGRESS = T.StructType([
    T.StructField("student_id", _S, False), T.StructField("timestamp", T.TimestampType()),
    T.StructField("attendance", _D), T.StructField("average_score", _D),
    T.StructField("risk_level", _S), T.StructField("seq", T.LongType())])

ACCOUNTS = T.StructType([
    T.StructField("username", _S), T.StructField("role", _S),
    T.StructField("linked_student_id", _S), T.StructField("linked_faculty_id", _S),
    T.StructField("created_at", T.TimestampType())])

# Requests keep every value as a string so that bad input survives to validation.
SCORE_REQUEST = T.StructType([T.StructField("student_id", _S)]
                             + [T.StructField(c, _S) for c in REQUEST_FIELDS])
PROGRESS_REQUEST = T.StructType([T.StructField(c, _S) for c in PROGRESS_FIELDS])
