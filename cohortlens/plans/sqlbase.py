"""Oracle SQL building blocks (DuckDB dialect, driver-registered views).

These strings are the independent statement of each query's meaning used by
the correctness gate; they never run on Spark. Keep exponent literals: they
are DOUBLE in DuckDB, while ``10.0`` would be DECIMAL and change result types.
"""

from __future__ import annotations

STUDENTS_RAW = """
SELECT concat('STU', lpad(cast(o.o_orderkey AS varchar), 8, '0'))      AS student_id,
       concat('FAC', lpad(cast(c.c_nationkey + 1 AS varchar), 3, '0')) AS faculty_id,
       m.attendance, m.assignment_score, m.internal_marks, m.quiz_score, m.previous_semester_marks
FROM orders o
JOIN (SELECT l_orderkey,
        2e0*max(l_quantity)                                             AS attendance,
        1e1*max(cast(round(l_discount*100) AS int))                     AS assignment_score,
        round(2e1 + 8e1*sum(cast(l_quantity AS int))/(5e1*count(*)), 1) AS internal_marks,
        round(1.25e1*max(cast(round(l_tax*100) AS int)), 1)             AS quiz_score,
        round(3e1 + 7e1*sum(cast(round(l_discount*100) AS int))/(1e1*count(*)), 1)
                                                                        AS previous_semester_marks
      FROM lineitem GROUP BY l_orderkey) m ON m.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
"""

def sround(expr: str, digits: int) -> str:
    """Spark's ``round`` on a double: half-up on the shortest decimal form of the value.

    DuckDB's own ``round`` scales in binary first and can move a value such as
    1794.0049999999999 across the tie; going through the decimal text does not.
    """
    return f"cast(round(cast(cast(({expr}) AS varchar) AS decimal(38, 20)), {digits}) AS double)"


def emean(col: str) -> str:
    """Mean of the plain values, summed exactly so that a tie rounds alike on both sides."""
    return f"(cast(sum(cast({col} AS decimal(28, 15))) AS double) / count({col}))"


_N = ("(CASE WHEN assignment_score IS NULL THEN 0 ELSE 1 END"
      " + CASE WHEN internal_marks IS NULL THEN 0 ELSE 1 END"
      " + CASE WHEN quiz_score IS NULL THEN 0 ELSE 1 END)")
_SUM = "(coalesce(assignment_score, 0e0) + coalesce(internal_marks, 0e0) + coalesce(quiz_score, 0e0))"
_MEAN = f"({_SUM} / cast(nullif({_N}, 0) AS double))"
_SS = (f"(coalesce((assignment_score - {_MEAN}) * (assignment_score - {_MEAN}), 0e0)"
       f" + coalesce((internal_marks - {_MEAN}) * (internal_marks - {_MEAN}), 0e0)"
       f" + coalesce((quiz_score - {_MEAN}) * (quiz_score - {_MEAN}), 0e0))")

INGEST_FEATURES = f"""
SELECT r.*,
       round(previous_semester_marks - average_score, 2) AS performance_drop
FROM (SELECT student_id, faculty_id, attendance, assignment_score, internal_marks, quiz_score,
             previous_semester_marks,
             round({_MEAN}, 2) AS average_score,
             round(attendance / 1e2, 4) AS attendance_ratio,
             CASE WHEN {_N} >= 2 THEN {sround(f"{_SS} / cast({_N} - 1 AS double)", 2)} END AS score_variance
      FROM students_raw) r
"""

RISK_INGEST = """CASE WHEN attendance >= 85 AND average_score >= 75 THEN 'Low Risk'
     WHEN attendance >= 70 AND average_score >= 55 THEN 'Medium Risk'
     ELSE 'High Risk' END"""

STUDENTS = f"""
SELECT student_id, faculty_id, attendance, assignment_score, internal_marks, quiz_score,
       previous_semester_marks, average_score, attendance_ratio, performance_drop, score_variance,
       {RISK_INGEST} AS risk_level,
       cast(NULL AS varchar) AS predicted_risk, cast(NULL AS double) AS confidence,
       cast(NULL AS varchar) AS difficulty_type
FROM features
"""

GEN_FEATURES = """
SELECT s.*, (assignment_score + internal_marks + quiz_score) / 3e0 AS g_avg,
       previous_semester_marks - (assignment_score + internal_marks + quiz_score) / 3e0 AS g_drop,
       ((assignment_score - (assignment_score + internal_marks + quiz_score) / 3e0)
          * (assignment_score - (assignment_score + internal_marks + quiz_score) / 3e0)
        + (internal_marks - (assignment_score + internal_marks + quiz_score) / 3e0)
          * (internal_marks - (assignment_score + internal_marks + quiz_score) / 3e0)
        + (quiz_score - (assignment_score + internal_marks + quiz_score) / 3e0)
          * (quiz_score - (assignment_score + internal_marks + quiz_score) / 3e0)) / 3e0 AS g_var
FROM students_raw s
"""

PROGRESS = """
SELECT concat('STU', lpad(cast(user_id AS varchar), 8, '0')) AS student_id,
       ts AS "timestamp",
       least(value, 1e2) AS attendance,
       cast(json_extract_string(props, '$.k') AS double) AS average_score,
       event_id AS seq
FROM events
"""

def risk_progress_sql(att: str = "attendance", avg: str = "average_score") -> str:
    return (f"CASE WHEN {att} < 60 OR {avg} < 45 THEN 'High Risk' "
            f"WHEN {att} < 75 OR {avg} < 60 THEN 'Medium Risk' ELSE 'Low Risk' END")


RISK_PROGRESS = risk_progress_sql()


def points_sql(att: str = "attendance", avg: str = "g_avg", drop: str = "g_drop", var: str = "g_var") -> str:
    """Points of the training-label rule over the generator's unrounded features."""
    return (f"(CASE WHEN {att} < 60 THEN 3 WHEN {att} < 75 THEN 1 ELSE 0 END"
            f" + CASE WHEN {avg} < 45 THEN 3 WHEN {avg} < 60 THEN 1 ELSE 0 END"
            f" + CASE WHEN {drop} > 15 THEN 2 WHEN {drop} > 5 THEN 1 ELSE 0 END"
            f" + CASE WHEN {var} > 300 THEN 1 ELSE 0 END)")


def points_label_sql(**kw) -> str:
    p = points_sql(**kw)
    return f"CASE WHEN {p} >= 5 THEN 'High Risk' WHEN {p} >= 2 THEN 'Medium Risk' ELSE 'Low Risk' END"

PROGRESS_LOG = f"""
SELECT student_id, "timestamp", attendance, average_score, {RISK_PROGRESS} AS risk_level, seq
FROM progress_raw
"""


def with_students(body: str, progress: bool = False, raw_from_base: str | None = None,
                  extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``body`` with the CTE chain students_raw -> features -> students.

    ``raw_from_base`` rewrites the raw rows (it reads ``students_base``, the plain
    bridge); ``extra`` adds (name, sql) CTEs after the raw rows.
    """
    ctes = ([("students_base", STUDENTS_RAW), ("students_raw", raw_from_base)] if raw_from_base
            else [("students_raw", STUDENTS_RAW)])
    ctes += list(extra) + [("features", INGEST_FEATURES), ("students", STUDENTS)]
    if progress:
        ctes += [("progress_raw", PROGRESS), ("progress", PROGRESS_LOG)]
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + body


def with_progress(body: str) -> str:
    return ("WITH " + f"progress_raw AS ({PROGRESS}),\nprogress AS ({PROGRESS_LOG})\n" + body)


def with_gen(body: str) -> str:
    return ("WITH " + f"students_raw AS ({STUDENTS_RAW}),\ngen AS ({GEN_FEATURES})\n" + body)
