"""Recommendation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.operators import recommend as R
from cohortlens.plans import example_catalogue, inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import with_students

_ITEMS = """
, f AS (
  SELECT student_id, risk_level, list_filter([
    CASE WHEN coalesce(attendance, 1e2) < 60 THEN 'Attendance Management|Critical'
         WHEN coalesce(attendance, 1e2) < 75 THEN 'Attendance Management|High' END,
    CASE WHEN coalesce(internal_marks, 1e2) < 50 OR coalesce(quiz_score, 1e2) < 50
         THEN 'Concept Reinforcement|Critical'
         WHEN coalesce(internal_marks, 1e2) < 65 THEN 'Concept Reinforcement|Medium' END,
    CASE WHEN coalesce(assignment_score, 1e2) < 50 THEN 'Practice Improvement Plan|High' END,
    CASE WHEN coalesce(score_variance, 0e0) > 300 OR abs(coalesce(performance_drop, 0e0)) > 15
         THEN 'Performance Stabilisation|High' END,
    CASE WHEN risk_level = 'High Risk' THEN 'Intensive Remedial Programme|Critical'
         WHEN risk_level = 'Medium Risk' THEN 'Targeted Support Plan|Medium'
         ELSE 'Excellence Enhancement|Low' END], lambda x: x IS NOT NULL) AS items
  FROM students),
e AS (SELECT student_id, unnest(generate_series(1, len(items))) AS pos, unnest(items) AS item FROM f)
"""


def _recs(spark, sf_dir):
    return R.recommend(inputs.students(spark, sf_dir), example_catalogue.rules(spark), example_catalogue.methods(spark))


@register("recommendations", with_students(_ITEMS + """
SELECT student_id, cast(pos AS integer) AS pos, split_part(item, '|', 1) AS category,
       split_part(item, '|', 2) AS priority FROM e"""))
def recommendations(spark, sf_dir):
    return R.explode_items(_recs(spark, sf_dir))


@register("priority_action", with_students(_ITEMS + """
SELECT student_id, split_part(items[1], '|', 1) AS priority_action FROM f"""))
def priority_action(spark, sf_dir):
    return _recs(spark, sf_dir).select("student_id", F.col("recommendation.priority_action")
                                       .alias("priority_action"))


@register("top3_recommendations", with_students(_ITEMS + """
SELECT student_id, array_to_string(list_transform(items[1:3], lambda x: split_part(x, '|', 1)), ' | ')
       AS top_recommendations FROM f"""))
def top3_recommendations(spark, sf_dir):
    recs = _recs(spark, sf_dir)
    return recs.select("student_id", R.top_items(recs, 3).alias("top_recommendations"))


_SUPPORT = R.METHODS_SUPPORT
_ENRICH = R.METHODS_ENRICH


@register("teaching_methods", with_students(f"""
, m AS (SELECT * FROM (VALUES {', '.join(f"('support', {i + 1}, '{m}')" for i, m in enumerate(_SUPPORT))},
                              {', '.join(f"('enrich', {i + 1}, '{m}')" for i, m in enumerate(_ENRICH))})
        t(risk_group, pos, method))
SELECT s.student_id, cast(m.pos AS integer) AS pos, m.method
FROM students s JOIN m
  ON m.risk_group = CASE WHEN s.risk_level IN ('High Risk', 'Medium Risk') THEN 'support' ELSE 'enrich' END"""))
def teaching_methods(spark, sf_dir):
    return R.explode_methods(_recs(spark, sf_dir))


@register("recommendation_records")
def recommendation_records(spark, sf_dir):
    """The full nested record per student (struct of arrays of structs)."""
    return _recs(spark, sf_dir).select("student_id", "risk_level", "recommendation")
