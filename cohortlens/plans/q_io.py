"""Sources, sinks, validation and table changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions.rules import alert_tags, risk_progress
from cohortlens.operators import load, updates, validate, views
from cohortlens.plans import inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import (GEN_FEATURES, points_label_sql, risk_progress_sql, sround,
                                      with_progress, with_students)
from cohortlens.session import scratch_path
from cohortlens.sources import files, generator
from cohortlens.sources.bridge import table
from cohortlens.sources.snapshot import SnapshotStore

_SNAP = ("student_id, faculty_id, attendance, assignment_score, internal_marks, quiz_score, "
         "previous_semester_marks, average_score, attendance_ratio, performance_drop, "
         "score_variance, risk_level, predicted_risk, confidence, difficulty_type")


# ---------------------------------------------------------------- CSV round trips
@register("csv_scan", with_students(f"SELECT {_SNAP} FROM students"))
def csv_scan(spark, sf_dir):
    """Six-column file -> declared-schema scan -> derived columns -> stored columns."""
    path = scratch_path(spark, "students-csv")
    files.write_csv(inputs.students_raw(spark, sf_dir), path)
    return load.prepare(files.read_students_csv(spark, path), on_duplicate="error")


@register("export_csv", with_students(f"SELECT {_SNAP} FROM students WHERE risk_level = 'High Risk'"))
def export_csv(spark, sf_dir):
    path = scratch_path(spark, "high-risk-export")
    st = inputs.students(spark, sf_dir)
    files.write_csv(st.filter(F.col("risk_level") == S.HIGH), path)
    return files.read_students_csv(spark, path)


@register("export_all_csv", with_students(f"SELECT {_SNAP} FROM students"))
def export_all_csv(spark, sf_dir):
    """Admin export: every row of the snapshot, read back with the declared schema."""
    path = scratch_path(spark, "all-export")
    files.write_csv(inputs.students(spark, sf_dir), path)
    return files.read_students_csv(spark, path)


@register("export_class_csv", with_students(f"SELECT {_SNAP} FROM students WHERE faculty_id = 'FAC001'"))
def export_class_csv(spark, sf_dir):
    """Faculty export: the scoped rows of one class."""
    path = scratch_path(spark, "class-export")
    st = inputs.students(spark, sf_dir, faculty_ids=["FAC001"])
    files.write_csv(views.scope(st, "faculty", faculty_id="FAC001"), path)
    return files.read_students_csv(spark, path)


# ---------------------------------------------------------------- requests
def _key():
    return F.substring("student_id", 4, 8).cast("bigint")


def score_requests(spark, sf_dir) -> DataFrame:
    """One request per student, values as strings, with deterministic bad input on some keys."""
    raw = inputs.students_raw(spark, sf_dir)
    k = _key()
    s = lambda c: F.col(c).cast("string")
    return raw.select(
        F.when(k % 29 != 0, F.col("student_id")).alias("student_id"),
        F.when(k % 11 == 0, F.lit("abc")).when(k % 31 == 0, F.lit("-0.1")).otherwise(s("attendance"))
         .alias("attendance"),
        F.when(k % 13 != 0, s("assignment_score")).alias("assignment_score"),
        F.when(k % 17 == 0, F.lit("100.5")).otherwise(s("internal_marks")).alias("internal_marks"),
        F.when(k % 19 == 0, F.lit("NaN")).otherwise(s("quiz_score")).alias("quiz_score"),
        F.when(k % 23 == 0, F.lit("")).otherwise(s("previous_semester_marks"))
         .alias("previous_semester_marks"),
    )


_K = "cast(substr(student_id, 4, 8) AS bigint)"
REQUESTS_SQL = f"""
requests AS (
  SELECT CASE WHEN {_K} % 29 <> 0 THEN student_id END AS student_id,
         CASE WHEN {_K} % 11 = 0 THEN 'abc' WHEN {_K} % 31 = 0 THEN '-0.1'
              ELSE cast(attendance AS varchar) END AS attendance,
         CASE WHEN {_K} % 13 <> 0 THEN cast(assignment_score AS varchar) END AS assignment_score,
         CASE WHEN {_K} % 17 = 0 THEN '100.5' ELSE cast(internal_marks AS varchar) END AS internal_marks,
         CASE WHEN {_K} % 19 = 0 THEN 'NaN' ELSE cast(quiz_score AS varchar) END AS quiz_score,
         CASE WHEN {_K} % 23 = 0 THEN '' ELSE cast(previous_semester_marks AS varchar) END
           AS previous_semester_marks
  FROM students_raw)
"""


def _with_requests(body: str) -> str:
    return with_students("") + ",\n" + REQUESTS_SQL.strip() + "\n" + body


@register("json_requests", _with_requests(
    "SELECT student_id, " + ", ".join(S.REQUEST_FIELDS) + " FROM requests"))
def json_requests(spark, sf_dir):
    path = scratch_path(spark, "score-requests-json")
    files.write_json(score_requests(spark, sf_dir), path)
    return files.read_score_requests_json(spark, path)


def _validation_sql():
    missing = " OR ".join(f"{c} IS NULL" for c in S.REQUEST_FIELDS)
    miss_list = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in S.REQUEST_FIELDS) + ")"
    kind, field = ["CASE WHEN " + missing + " THEN 'missing'"], ["CASE WHEN " + missing + f" THEN {miss_list}"]
    for c in S.REQUEST_FIELDS:
        v = f"try_cast({c} AS double)"
        kind.append(f"WHEN {v} IS NULL THEN 'not_numeric' "
                    f"WHEN isnan({v}) OR {v} < 0 OR {v} > 100 THEN 'out_of_range'")
        field.append(f"WHEN {v} IS NULL OR isnan({v}) OR {v} < 0 OR {v} > 100 THEN '{c}'")
    kind_sql, field_sql = " ".join(kind) + " END", " ".join(field) + " END"
    vals = ", ".join(f"CASE WHEN ({kind_sql}) IS NULL THEN try_cast({c} AS double) END AS {c}"
                     for c in S.REQUEST_FIELDS)
    return _with_requests(f"""
SELECT student_id, {vals}, ({kind_sql}) IS NULL AS is_valid, {kind_sql} AS error_kind,
       {field_sql} AS error_field
FROM requests""")


@register("validate_requests", _validation_sql())
def validate_requests(spark, sf_dir):
    v = validate.check_score_requests(score_requests(spark, sf_dir))
    vals = [F.when(F.col("is_valid"), F.col(c)).alias(c) for c in S.REQUEST_FIELDS]
    return v.select("student_id", *vals, "is_valid", "error_kind", "error_field")


def progress_requests(spark, sf_dir) -> DataFrame:
    """Progress records as a client sends them (values as strings, the label computed by
    the client with the progress rule), with missing and malformed fields on some keys."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "props")
    k = F.col("event_id")
    sid = F.concat(F.lit("STU"), F.lpad(F.col("user_id").cast("string"), 8, "0"))
    att = F.least(F.col("value"), F.lit(100.0))
    avg = F.get_json_object("props", "$.k")
    return ev.select(
        k.alias("seq"),
        F.when(k % 37 != 0, sid).alias("student_id"),
        F.when(k % 41 == 0, F.lit("x")).otherwise(att.cast("string")).alias("attendance"),
        avg.alias("average_score"),
        F.when(k % 43 != 0, risk_progress(att, avg.try_cast("double"))).alias("risk_level"))


PROGRESS_REQUESTS_SQL = f"""
, pr AS (SELECT event_id AS seq,
               CASE WHEN event_id % 37 <> 0 THEN concat('STU', lpad(cast(user_id AS varchar), 8, '0')) END
                 AS student_id,
               CASE WHEN event_id % 41 = 0 THEN 'x' ELSE cast(least(value, 1e2) AS varchar) END AS attendance,
               json_extract_string(props, '$.k') AS average_score,
               CASE WHEN event_id % 43 <> 0 THEN
                 {risk_progress_sql("least(value, 1e2)", "cast(json_extract_string(props, '$.k') AS double)")}
               END AS risk_level
        FROM events)"""


@register("validate_progress", with_progress(PROGRESS_REQUESTS_SQL + """
SELECT seq, student_id, try_cast(attendance AS double) AS attendance,
       try_cast(average_score AS double) AS average_score, risk_level,
       CASE WHEN student_id IS NULL OR attendance IS NULL OR average_score IS NULL OR risk_level IS NULL
            THEN 'missing'
            WHEN try_cast(attendance AS double) IS NULL OR try_cast(average_score AS double) IS NULL
            THEN 'not_numeric' END AS error_kind
FROM pr"""))
def validate_progress(spark, sf_dir):
    v = validate.check_progress_requests(progress_requests(spark, sf_dir))
    return v.select("seq", "student_id", "attendance", "average_score", "risk_level", "error_kind")


# ---------------------------------------------------------------- keys
@register("key_checks", with_progress("""
SELECT student_id, count(*) AS n_rows, student_id IS NULL AS null_key, count(*) > 1 AS duplicate
FROM progress GROUP BY student_id"""))
def key_checks(spark, sf_dir):
    return validate.key_checks(inputs.progress(spark, sf_dir))


@register("dedupe_last", with_progress("""
SELECT student_id, arg_max("timestamp", seq) AS "timestamp", arg_max(attendance, seq) AS attendance,
       arg_max(average_score, seq) AS average_score, arg_max(risk_level, seq) AS risk_level, max(seq) AS seq
FROM progress WHERE student_id IS NOT NULL GROUP BY student_id"""))
def dedupe_last(spark, sf_dir):
    return validate.dedupe_last(inputs.progress(spark, sf_dir))


def keyless(progress: DataFrame) -> DataFrame:
    """Progress records of which every eleventh has lost its key."""
    return progress.withColumn("student_id", F.when(F.col("seq") % 11 != 0, F.col("student_id")))


_KEYLESS = """(SELECT seq, "timestamp", attendance, average_score, risk_level,
       CASE WHEN seq % 11 <> 0 THEN student_id END AS student_id FROM progress)"""


@register("key_checks_null", with_progress(f"""
SELECT student_id, count(*) AS n_rows, student_id IS NULL AS null_key, count(*) > 1 AS duplicate
FROM {_KEYLESS} GROUP BY student_id"""))
def key_checks_null(spark, sf_dir):
    """Rows by key where keys are missing: those without one are a group, marked as such."""
    return validate.key_checks(keyless(inputs.progress(spark, sf_dir)))


@register("dedupe_last_null", with_progress(f"""
SELECT student_id, arg_max("timestamp", seq) AS "timestamp", arg_max(attendance, seq) AS attendance,
       arg_max(average_score, seq) AS average_score, arg_max(risk_level, seq) AS risk_level, max(seq) AS seq
FROM {_KEYLESS} WHERE student_id IS NOT NULL GROUP BY student_id"""))
def dedupe_last_null(spark, sf_dir):
    """The last record of each key; records without a key are refused."""
    return validate.dedupe_last(keyless(inputs.progress(spark, sf_dir)))


# ---------------------------------------------------------------- predictions write-back
def prediction_updates(spark, sf_dir) -> DataFrame:
    """Prediction results keyed by student, one per progress record (many per id, and
    ids with no student row): label by the progress rule, confidence from the score."""
    log = inputs.progress(spark, sf_dir)
    return log.select("student_id", "seq", F.col("risk_level").alias("predicted_risk"),
                      F.round(F.col("average_score") / 100, 4).alias("confidence"),
                      alert_tags(["attendance"]).alias("difficulty_type"))


_UPDATES_SQL = """
, u AS (SELECT student_id, arg_max(risk_level, seq) AS predicted_risk,
               arg_max(round(average_score / 1e2, 4), seq) AS confidence,
               arg_max(CASE WHEN attendance < 60 THEN 'Attendance' ELSE 'General' END, seq) AS difficulty_type
        FROM progress GROUP BY student_id)
SELECT s.student_id, s.faculty_id, s.attendance, s.assignment_score, s.internal_marks, s.quiz_score,
       s.previous_semester_marks, s.average_score, s.attendance_ratio, s.performance_drop,
       s.score_variance, s.risk_level,
       CASE WHEN u.student_id IS NOT NULL THEN u.predicted_risk ELSE s.predicted_risk END AS predicted_risk,
       CASE WHEN u.student_id IS NOT NULL THEN u.confidence ELSE s.confidence END AS confidence,
       CASE WHEN u.student_id IS NOT NULL THEN u.difficulty_type ELSE s.difficulty_type END AS difficulty_type
FROM students s LEFT JOIN u ON s.student_id = u.student_id"""


@register("apply_predictions", with_students(_UPDATES_SQL, progress=True))
def apply_predictions(spark, sf_dir):
    return updates.apply_predictions(inputs.students(spark, sf_dir), prediction_updates(spark, sf_dir))


@register("snapshot_replace", with_students(_UPDATES_SQL, progress=True))
def snapshot_replace(spark, sf_dir):
    """Load, then publish the updated table as a new version; read the current one."""
    store = SnapshotStore(spark, scratch_path(spark, "students-snapshot"))
    load.load(store, inputs.students_raw(spark, sf_dir), on_duplicate="last", require=True, seq="student_id")
    store.replace(updates.apply_predictions(store.read(), prediction_updates(spark, sf_dir)))
    return store.read().drop("created_at")


# ---------------------------------------------------------------- generator
def _generator_sql() -> str:
    seed = S.SEED
    us = ", ".join(
        f"((('0x' || substr(md5(cast(i AS varchar) || '#{seed}#{k}'), 1, 13))::BIGINT + 0.5e0)"
        f" / 4503599627370496e0) AS u{k}" for k in range(2 * len(generator.SCORE_PARAMS)))
    scores = ", ".join(
        f"least(greatest(sqrt(-2e0 * ln(u{2 * k})) * cos(2e0 * pi() * u{2 * k + 1}) * {sd}e0 + {mean}e0, "
        f"{lo}e0), {hi}e0) AS {c}"
        for k, (c, (mean, sd, lo, hi)) in enumerate(generator.SCORE_PARAMS.items()))
    cols = ", ".join(f"{sround(c, 1)} AS {c}" for c in generator.SCORE_PARAMS)
    return f"""
WITH cnt AS (SELECT count(*) AS n FROM orders),
u AS (SELECT i, n, {us} FROM cnt, range(1, n + 1) t(i)),
students_raw AS (SELECT i, n, {scores} FROM u),
gen AS ({GEN_FEATURES})
SELECT concat('STU', lpad(cast(i AS varchar), cast(greatest(4, length(cast(n AS varchar))) AS integer), '0')) AS student_id,
       CASE WHEN i <= n // 2 THEN 'FAC001' ELSE 'FAC002' END AS faculty_id,
       {cols},
       {sround('g_avg', 2)} AS average_score, {sround('attendance / 1e2', 3)} AS attendance_ratio,
       {sround('g_drop', 2)} AS performance_drop, {sround('g_var', 2)} AS score_variance,
       {points_label_sql()} AS risk_level
FROM gen"""


@register("generate_students", _generator_sql())
def generate_students(spark, sf_dir):
    """As many synthetic students as there are orders (so the work grows with the data)."""
    n = table(spark, sf_dir, "orders").count()
    return generator.generate_students(spark, n=n)
