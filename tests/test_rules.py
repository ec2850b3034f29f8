"""Boundary rows on each side of every threshold, and the README worked example."""

import math

import pytest

from cohortlens import schema as S
from cohortlens.functions import rules
from cohortlens.operators import features, risk


def one(spark, row, schema):
    return spark.createDataFrame([row], schema)


@pytest.mark.parametrize("att,avg,want", [
    (85.0, 75.0, S.LOW), (84.9, 75.0, S.MEDIUM), (85.0, 74.99, S.MEDIUM),
    (70.0, 55.0, S.MEDIUM), (69.9, 55.0, S.HIGH), (70.0, 54.99, S.HIGH),
    (None, 90.0, S.HIGH), (90.0, None, S.HIGH),
])
def test_ingest_rule(spark, att, avg, want):
    df = one(spark, (att, avg), "attendance double, average_score double")
    assert df.select(rules.risk_ingest().alias("r")).first()["r"] == want


@pytest.mark.parametrize("att,avg,want", [
    (59.9, 80.0, S.HIGH), (60.0, 80.0, S.MEDIUM), (74.9, 80.0, S.MEDIUM), (75.0, 80.0, S.LOW),
    (80.0, 44.99, S.HIGH), (80.0, 45.0, S.MEDIUM), (80.0, 59.99, S.MEDIUM), (80.0, 60.0, S.LOW),
])
def test_progress_rule(spark, att, avg, want):
    df = one(spark, (att, avg), "attendance double, average_score double")
    assert df.select(rules.risk_progress().alias("r")).first()["r"] == want


@pytest.mark.parametrize("drop,var,pts", [(5.0, 300.0, 0), (5.01, 300.0, 1), (15.0, 300.01, 2),
                                          (15.01, 0.0, 2), (-15.01, 0.0, 0)])
def test_points_drop_is_signed(spark, drop, var, pts):
    df = one(spark, (90.0, 90.0, drop, var),
             "attendance double, average_score double, performance_drop double, score_variance double")
    assert df.select(rules.risk_points_total().alias("p")).first()["p"] == pts


@pytest.mark.parametrize("att,asg,want", [(85.0, 80.0, 0), (84.9, 80.0, 1), (85.0, 79.9, 1),
                                          (70.0, 65.0, 1), (70.0, 64.9, 2), (69.9, 65.0, 2)])
def test_category_rule(spark, att, asg, want):
    df = one(spark, (att, asg), "attendance double, assignment_score double")
    assert df.select(rules.risk_category().alias("c")).first()["c"] == S.CATEGORY_LABELS[want]


def test_bands(spark):
    df = spark.createDataFrame([(75.0,), (74.9,), (60.0,), (59.9,)], "attendance double")
    got = [r[0] for r in df.select(rules.band("attendance", 75, 60)).collect()]
    assert got == ["good", "watch", "watch", "poor"]


def test_worked_example(spark):
    """55, 42, 38, 45, 60 -> average 41.67, ratio 0.55, drop 18.33, variance 8.22, High Risk."""
    req = spark.createDataFrame([("55", "42", "38", "45", "60")],
                                ", ".join(f"{c} string" for c in S.REQUEST_FIELDS))
    f = features.scoring_features(req).first()
    assert (f["average_score"], f["attendance_ratio"], f["performance_drop"], f["score_variance"]) == \
        (41.67, 0.55, 18.33, 8.22)
    d = risk.difficulty(features.scoring_features(req)).first()["difficulty_types"]
    assert d == S.DIFFICULTY_TAGS
    raw = spark.createDataFrame([(55.0, 42.0, 38.0, 45.0, 60.0)],
                                ", ".join(f"{c} double" for c in S.REQUEST_FIELDS))
    p = risk.label_points(raw).first()
    assert p["risk_points"] == 8 and p["risk_level"] == S.HIGH


@pytest.mark.parametrize("vals,want", [
    ((59.9, 100.0, 100.0, 100.0, 0.0, 0.0), ["Attendance Issue"]),
    ((60.0, 49.9, 100.0, 100.0, 0.0, 0.0), ["Conceptual Weakness"]),
    ((60.0, 100.0, 100.0, 49.9, 0.0, 0.0), ["Conceptual Weakness"]),
    ((60.0, 100.0, 49.9, 100.0, 0.0, 0.0), ["Practice Inconsistency"]),
    ((60.0, 100.0, 100.0, 100.0, 300.01, 0.0), ["Performance Fluctuation"]),
    ((60.0, 100.0, 100.0, 100.0, 300.0, -15.01), ["Performance Fluctuation"]),
    ((60.0, 50.0, 50.0, 50.0, 300.0, 15.0), [S.DIFFICULTY_FALLBACK]),
    ((None, None, None, None, None, None), [S.DIFFICULTY_FALLBACK]),
])
def test_difficulty_types(spark, vals, want):
    df = one(spark, vals, "attendance double, internal_marks double, assignment_score double, "
                          "quiz_score double, score_variance double, performance_drop double")
    assert df.select(rules.difficulty_types(df.columns).alias("t")).first()["t"] == want


def test_alert_tags_ignore_quiz_and_variance(spark):
    df = one(spark, (80.0, 80.0, 80.0, 10.0, 900.0, 0.0),
             "attendance double, internal_marks double, assignment_score double, quiz_score double, "
             "score_variance double, performance_drop double")
    assert df.select(rules.alert_tags(df.columns).alias("t")).first()["t"] == "General"


def test_nan_becomes_null_before_rules(spark):
    df = spark.createDataFrame([(float("nan"), 90.0)], "attendance double, average_score double")
    cleaned = features.clean_nan(df)
    assert cleaned.first()["attendance"] is None
    assert cleaned.select(rules.risk_ingest().alias("r")).first()["r"] == S.HIGH
    assert math.isnan(df.first()["attendance"])


def test_replaced_catalogue_is_used(spark):
    from pyspark.sql import functions as F

    from cohortlens.operators import recommend as R
    from cohortlens.plans import example_catalogue
    cat = example_catalogue.rules(spark).withColumn(
        "category", F.when(F.col("rule_id") == "plan_low", "Own plan").otherwise(F.col("category")))
    df = spark.createDataFrame([("a", 90.0, 90.0, 90.0, 90.0, 0.0, 0.0, S.LOW)],
                               "student_id string, attendance double, internal_marks double, "
                               "assignment_score double, quiz_score double, score_variance double, "
                               "performance_drop double, risk_level string")
    rec = R.recommend(df, catalogue=cat).first()["recommendation"]
    assert [x["category"] for x in rec["recommendations"]] == ["Own plan"]
    assert rec["priority_action"] == "Own plan" and len(rec["innovative_methods"]) == 3
    default = R.recommend(df).first()["recommendation"]
    assert default["recommendations"][0]["category"] == "Excellence Enhancement"
    assert default["recommendations"][0]["strategies"] == []
    with pytest.raises(ValueError, match="attendance_high"):
        R.recommend(df, catalogue=cat.filter("rule_id <> 'attendance_high'"))


@pytest.mark.parametrize("vals,risk,want", [
    ((59.9, 100.0, 100.0, 100.0, 0.0, 0.0), S.LOW, ["attendance_critical", "plan_low"]),
    ((60.0, 100.0, 100.0, 100.0, 0.0, 0.0), S.LOW, ["attendance_high", "plan_low"]),
    ((74.9, 100.0, 100.0, 100.0, 0.0, 0.0), S.LOW, ["attendance_high", "plan_low"]),
    ((75.0, 100.0, 100.0, 100.0, 0.0, 0.0), S.LOW, ["plan_low"]),
    ((90.0, 49.9, 100.0, 100.0, 0.0, 0.0), S.MEDIUM, ["concept_critical", "plan_medium"]),
    ((90.0, 64.9, 100.0, 100.0, 0.0, 0.0), S.MEDIUM, ["concept_medium", "plan_medium"]),
    ((90.0, 65.0, 100.0, 49.9, 0.0, 0.0), S.MEDIUM, ["concept_critical", "plan_medium"]),
    ((90.0, 65.0, 49.9, 100.0, 0.0, 0.0), S.HIGH, ["practice_high", "plan_high"]),
    ((90.0, 65.0, 50.0, 100.0, 300.01, 0.0), S.HIGH, ["stability_high", "plan_high"]),
    ((90.0, 65.0, 50.0, 100.0, 300.0, -15.01), S.HIGH, ["stability_high", "plan_high"]),
    ((90.0, 65.0, 50.0, 100.0, 300.0, 15.0), None, ["plan_low"]),
])
def test_recommendation_rule_boundaries(spark, vals, risk, want):
    from cohortlens.operators import recommend as R
    df = spark.createDataFrame([vals + (risk,)],
                               "attendance double, internal_marks double, assignment_score double, "
                               "quiz_score double, score_variance double, performance_drop double, "
                               "risk_level string")
    assert df.select(R.fired_rules(df.columns).alias("r")).first()["r"] == want
