"""The spark-submit jobs end to end on sf0.001-derived inputs."""

from pyspark.sql import functions as F

from cohortlens import jobs
from cohortlens.plans import inputs
from cohortlens.plans.q_io import progress_requests, score_requests
from cohortlens.session import scratch_path
from cohortlens.sources import files
from cohortlens.sources.snapshot import SnapshotStore
from tests.conftest import SF001


def test_jobs_round_trip(spark):
    csv, store, model = (scratch_path(spark, n) for n in ("job-csv", "job-store", "job-model"))
    files.write_csv(inputs.students_raw(spark, SF001), csv)
    assert jobs.main(["load-csv", "--store", store, "--csv", csv], spark)["version"] == 1
    m = jobs.main(["train", "--store", store, "--model", model, "--trees", "5"], spark)
    assert 0 < m["accuracy"] <= 1 and m["cv_mean"] is not None

    req, out = scratch_path(spark, "job-req"), scratch_path(spark, "job-out")
    files.write_json(score_requests(spark, SF001), req)
    assert jobs.main(["score", "--store", store, "--model", model, "--requests", req, "--out", out],
                     spark)["version"] == 2
    snap = SnapshotStore(spark, store).read()
    scored = spark.read.parquet(f"{out}/predictions").filter(F.col("student_id").isNotNull())
    assert snap.filter(F.col("predicted_risk").isNotNull()).count() == scored.select("student_id").distinct().count()

    an = scratch_path(spark, "job-analytics")
    jobs.main(["analytics", "--store", store, "--out", an, "--role", "faculty", "--faculty-id", "FAC001"], spark)
    total = spark.read.parquet(f"{an}/summary").first()["total_students"]
    assert total == snap.filter(F.col("faculty_id") == "FAC001").count()

    preq, log = scratch_path(spark, "job-preq"), scratch_path(spark, "job-log")
    files.write_json(progress_requests(spark, SF001).drop("seq"), preq)
    jobs.main(["progress", "--log", log, "--requests", preq], spark)
    assert spark.read.parquet(log).count() > 0


def test_student_role_limits(spark):
    from cohortlens.operators import views
    req = spark.createDataFrame([("S9", "50", "50", "50", "50", "50")],
                                "student_id string, attendance string, assignment_score string, "
                                "internal_marks string, quiz_score string, previous_semester_marks string")
    assert views.force_own_id(req, "student", "S1").first()["student_id"] == "S1"
    assert views.force_own_id(req, "admin", None).first()["student_id"] == "S9"
    recs = spark.createDataFrame([("S1",), ("S2",), (None,)], "student_id string")
    ok, denied = views.split_own_rows(recs, "student", "S1")
    assert [r[0] for r in ok.collect()] == ["S1"] and denied.count() == 2
    ok, denied = views.split_own_rows(recs, "faculty", None)
    assert ok.count() == 3 and denied.count() == 0


def test_stream_score_job(spark):
    from cohortlens.operators import ml
    model = scratch_path(spark, "job-model-2")
    r = ml.train_and_evaluate(ml.training_frame(inputs.students_raw(spark, SF001)),
                              ml.ForestParams(num_trees=5, max_depth=4), with_cv=False)
    ml.save(r, model)
    req, out, ck = (scratch_path(spark, n) for n in ("s-req", "s-out", "s-ck"))
    files.write_json(score_requests(spark, SF001), req)
    jobs.main(["stream-score", "--store", "unused", "--model", model, "--requests", req, "--out", out,
               "--checkpoint", ck], spark)
    got = spark.read.parquet(out)
    from cohortlens.operators.validate import check_score_requests
    want = check_score_requests(files.read_score_requests_json(spark, req)).filter("is_valid").count()
    assert got.count() == want and got.filter(F.col("predicted_risk").isNull()).count() == 0


def test_score_into_log_then_compact(spark):
    from cohortlens.operators import ml
    store, model, log = (scratch_path(spark, n) for n in ("lg-store", "lg-model", "lg-log"))
    csv = scratch_path(spark, "lg-csv")
    files.write_csv(inputs.students_raw(spark, SF001), csv)
    jobs.main(["load-csv", "--store", store, "--csv", csv], spark)
    r = ml.train_and_evaluate(ml.training_frame(inputs.students_raw(spark, SF001)),
                              ml.ForestParams(num_trees=5, max_depth=4), with_cv=False)
    ml.save(r, model)
    req = scratch_path(spark, "lg-req")
    files.write_json(score_requests(spark, SF001), req)
    for i in range(2):
        out = scratch_path(spark, f"lg-out{i}")
        assert jobs.main(["score", "--store", store, "--model", model, "--requests", req, "--out", out,
                          "--log", log], spark) == {"log_batch": i}
    assert SnapshotStore(spark, store).versions() == [1]          # scoring did not rewrite the table
    v = jobs.main(["compact", "--store", store, "--log", log], spark)["version"]
    snap = SnapshotStore(spark, store).read(v)
    assert snap.filter(F.col("predicted_risk").isNotNull()).count() > 0


def test_progress_job_batches_read_back_in_order(spark):
    cols = "student_id string, attendance string, average_score string, risk_level string"
    log, out = scratch_path(spark, "pj-log"), scratch_path(spark, "pj-out")
    for i, rows in enumerate([[("S1", "50", "60", "High Risk"), ("S1", "55", "60", "High Risk"), ("S2", "bad", "1", "Low Risk")],
                              [("S1", "70", "60", "Medium Risk"), ("S1", "75", "60", "Low Risk")]]):
        req, bad = scratch_path(spark, f"pj-req{i}"), scratch_path(spark, f"pj-bad{i}")
        files.write_json(spark.createDataFrame(rows, cols).coalesce(1), req)
        got = jobs.main(["progress", "--log", log, "--requests", req, "--rejects", bad], spark)
        assert got["rejected"] == (1 if i == 0 else 0)
    jobs.main(["history", "--log", log, "--student-id", "S1", "--out", out], spark)
    assert [r["attendance"] for r in spark.read.json(out).orderBy("timestamp", "seq").collect()] == [50.0, 55.0, 70.0, 75.0]


def test_export_and_accounts_jobs(spark):
    csv, store, out, acc = (scratch_path(spark, n) for n in ("ex-csv", "ex-store", "ex-out", "ex-acc"))
    files.write_csv(inputs.students_raw(spark, SF001), csv)
    rows = jobs.main(["load-csv", "--store", store, "--csv", csv], spark)["rows"]
    jobs.main(["export", "--store", store, "--out", out, "--high-risk"], spark)
    snap = SnapshotStore(spark, store).read()
    assert spark.read.option("header", True).csv(out).count() == snap.where("risk_level = 'High Risk'").count() > 0
    jobs.main(["accounts", "--store", store, "--out", acc], spark)
    assert spark.read.parquet(acc).count() == rows + 3


def test_history_is_for_those_who_may_read_it(spark):
    import pytest

    log = scratch_path(spark, "history-log")
    preq = scratch_path(spark, "history-req")
    files.write_json(progress_requests(spark, SF001).drop("seq"), preq)
    jobs.main(["progress", "--log", log, "--requests", preq], spark)
    who = spark.read.parquet(log).first()["student_id"]
    for role, own, allowed in (("student", who, True), ("student", "another", False), ("student", None, False), ("faculty", None, True), ("guest", None, False)):
        out = scratch_path(spark, "history-out")
        args = ["history", "--log", log, "--student-id", who, "--out", out, "--role", role] + (["--own-id", own] if own else [])
        if allowed:
            jobs.main(args, spark)
            assert {r["student_id"] for r in spark.read.json(out).collect()} == {who}
        else:
            with pytest.raises(PermissionError):
                jobs.main(args, spark)
