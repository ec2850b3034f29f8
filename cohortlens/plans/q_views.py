"""Lookups, scope, sorts, sample and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import features, updates, views
from cohortlens.plans import inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import with_students

LOOKUP_ID = "STU00000001"   # order key 1 exists at every scale factor
CLASS_ID = "FAC001"
_SNAP = ("student_id, faculty_id, attendance, assignment_score, internal_marks, quiz_score, "
         "previous_semester_marks, average_score, attendance_ratio, performance_drop, "
         "score_variance, risk_level, predicted_risk, confidence, difficulty_type")

ACCOUNTS_SQL = """
accounts AS (
  SELECT * FROM (VALUES ('admin', 'admin', cast(NULL AS varchar), cast(NULL AS varchar)),
                        ('faculty1', 'faculty', cast(NULL AS varchar), 'FAC001'),
                        ('faculty2', 'faculty', cast(NULL AS varchar), 'FAC002'))
         t(username, role, linked_student_id, linked_faculty_id)
  UNION ALL
  SELECT username, 'student', linked_student_id, cast(NULL AS varchar)
  FROM (SELECT lower(student_id) AS username, min(student_id) AS linked_student_id
        FROM students WHERE student_id IS NOT NULL GROUP BY 1) c
  WHERE username NOT IN ('admin', 'faculty1', 'faculty2'))
"""


def _with_accounts(body: str) -> str:
    sql = with_students("")
    return sql + ",\n" + ACCOUNTS_SQL.strip() + "\n" + body


@register("all_students", with_students(f"SELECT {_SNAP} FROM students"))
def all_students(spark, sf_dir):
    return views.all_students(inputs.students(spark, sf_dir))


@register("student_lookup", with_students(f"SELECT {_SNAP} FROM students WHERE student_id = '{LOOKUP_ID}'"))
def student_lookup(spark, sf_dir):
    return views.student_lookup(inputs.students(spark, sf_dir, student_ids=[LOOKUP_ID]), LOOKUP_ID)


@register("class_students", with_students(f"SELECT {_SNAP} FROM students WHERE faculty_id = '{CLASS_ID}'"))
def class_students(spark, sf_dir):
    return views.class_students(inputs.students(spark, sf_dir, faculty_ids=[CLASS_ID]), CLASS_ID)


@register("class_ids", with_students(f"SELECT student_id FROM students WHERE faculty_id = '{CLASS_ID}'"))
def class_ids(spark, sf_dir):
    return views.class_ids(inputs.students(spark, sf_dir, faculty_ids=[CLASS_ID]), CLASS_ID)


# Display list with one column that does not exist: it is skipped, order kept.
_CLASS_LIST = S.DISPLAY_COLS[:8] + ["predicted_label"] + S.DISPLAY_COLS[8:]


@register("class_list", with_students(
    "SELECT " + ", ".join(c for c in _CLASS_LIST if c != "predicted_label") + " FROM students"))
def class_list(spark, sf_dir):
    return features.project_existing(inputs.students(spark, sf_dir), _CLASS_LIST)


@register("high_risk", with_students(f"SELECT {_SNAP} FROM students WHERE risk_level = 'High Risk'"))
def high_risk(spark, sf_dir):
    return views.high_risk(inputs.students(spark, sf_dir))


@register("high_risk_priority", with_students("""
SELECT student_id, faculty_id, average_score, attendance FROM students WHERE risk_level = 'High Risk'"""))
def high_risk_priority(spark, sf_dir):
    return views.high_risk_priority(inputs.students(spark, sf_dir)).select(
        "student_id", "faculty_id", "average_score", "attendance")


@register("fixed_sample", with_students(
    f"SELECT {_SNAP} FROM students ORDER BY md5(student_id || '#{S.SEED}'), student_id "
    f"LIMIT {S.SAMPLE_SIZE_ADMIN}"))
def fixed_sample(spark, sf_dir):
    return views.fixed_sample(inputs.students(spark, sf_dir), S.SAMPLE_SIZE_ADMIN)


@register("class_sample", with_students(
    f"SELECT {_SNAP} FROM students WHERE faculty_id = '{CLASS_ID}' "
    f"ORDER BY md5(student_id || '#{S.SEED}'), student_id LIMIT {S.SAMPLE_SIZE_CLASS}"))
def class_sample(spark, sf_dir):
    """The class view's fixed sample: min(250, class size) rows of one class."""
    cls = views.class_students(inputs.students(spark, sf_dir, faculty_ids=[CLASS_ID]), CLASS_ID)
    return views.fixed_sample(cls, S.SAMPLE_SIZE_CLASS)


@register("accounts", _with_accounts(
    "SELECT username, role, linked_student_id, linked_faculty_id FROM accounts"))
def accounts(spark, sf_dir):
    acc = updates.accounts_table(spark, inputs.students(spark, sf_dir))
    return acc.orderBy("username")


@register("accounts_upsert", _with_accounts("""
SELECT username, role, linked_student_id, linked_faculty_id FROM accounts WHERE role = 'student'"""))
def accounts_upsert(spark, sf_dir):
    """Rows created by seeding student accounts after the defaults exist."""
    existing = updates.default_accounts(spark)
    _, created = updates.insert_if_absent(existing, updates.student_accounts(inputs.students(spark, sf_dir)))
    return created


@register("accounts_role_domain", _with_accounts("""
SELECT username, role, linked_student_id, linked_faculty_id FROM accounts
WHERE role = 'student' AND cast(substr(linked_student_id, 4) AS bigint) % 5 <> 0
  AND cast(substr(linked_student_id, 4) AS bigint) % 7 <> 0"""))
def accounts_role_domain(spark, sf_dir):
    """Rows created from candidates of which some have an unknown role or none: those are refused."""
    candidates = updates.student_accounts(inputs.students(spark, sf_dir))
    number = F.substring("linked_student_id", 4, 8).cast("long")
    role = F.when(number % 5 == 0, "guest").when(number % 7 != 0, F.col("role"))
    _, created = updates.insert_if_absent(updates.default_accounts(spark), candidates.withColumn("role", role))
    return created


@register("scoped_counts", _with_accounts("""
SELECT a.username, a.role,
       CASE WHEN a.role = 'admin' THEN (SELECT count(*) FROM students)
            WHEN a.role = 'faculty' THEN (SELECT count(*) FROM students s WHERE s.faculty_id = a.linked_faculty_id)
            ELSE (SELECT count(*) FROM students s WHERE s.student_id = a.linked_student_id) END AS n_visible
FROM accounts a"""))
def scoped_counts(spark, sf_dir):
    st = inputs.students(spark, sf_dir)
    return views.scoped_counts(updates.accounts_table(spark, st), st)

