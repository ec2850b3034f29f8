from cohortlens.operators import features


def test_presence_rule_keeps_present_null_columns(spark):
    df = spark.createDataFrame([("S1", 80.0, 70.0, 60.0, 50.0, 65.0, None)],
                               "student_id string, attendance double, assignment_score double, "
                               "internal_marks double, quiz_score double, previous_semester_marks double, "
                               "average_score double")
    out = features.ingest_features(df).first()
    assert out["average_score"] is None          # present column is never recomputed
    assert out["faculty_id"] == "FAC001"
    assert out["attendance_ratio"] == 0.8
    assert out["score_variance"] == 100.0        # sample variance of 70, 60, 50


def test_null_skipping_mean_and_sample_variance(spark):
    rows = [("a", 80.0, 70.0, None, None, 60.0), ("b", 80.0, None, None, None, 60.0),
            ("c", 80.0, None, None, None, None)]
    df = spark.createDataFrame(rows, "student_id string, attendance double, assignment_score double, "
                                     "internal_marks double, quiz_score double, previous_semester_marks double")
    got = {r["student_id"]: r for r in features.ingest_features(df).collect()}
    assert got["a"]["average_score"] == 70.0 and got["a"]["score_variance"] is None
    assert got["b"]["average_score"] is None and got["b"]["performance_drop"] is None
    assert got["c"]["risk_level"] == "High Risk"


def test_two_values_sample_variance(spark):
    df = spark.createDataFrame([("a", 80.0, 70.0, 60.0, None, 60.0)],
                               "student_id string, attendance double, assignment_score double, "
                               "internal_marks double, quiz_score double, previous_semester_marks double")
    r = features.ingest_features(df).first()
    assert r["average_score"] == 65.0 and r["score_variance"] == 50.0 and r["performance_drop"] == -5.0


def test_absent_score_columns(spark):
    df = spark.createDataFrame([("a", 80.0, 70.0)], "student_id string, attendance double, quiz_score double")
    r = features.ingest_features(df).first()
    assert r["average_score"] == 70.0
    assert "score_variance" not in features.ingest_features(df).columns   # needs two score columns


def test_project_existing_keeps_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "c int, a int, b int")
    assert features.project_existing(df, ["a", "zz", "c"]).columns == ["a", "c"]
