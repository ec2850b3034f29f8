import pytest

from cohortlens.operators import updates
from cohortlens.plans import inputs, registry
from cohortlens.plans.q_io import prediction_updates
from cohortlens.session import scratch_path
from cohortlens.sources.snapshot import SnapshotStore
from tests.conftest import SF001

registry.load_all()


def test_stream_write_back_equals_batch(spark):
    stream = registry.QUERIES["stream_apply"](spark, SF001)
    batch = updates.apply_predictions(inputs.students(spark, SF001), prediction_updates(spark, SF001))
    assert sorted(stream.collect()) == sorted(batch.select(stream.columns).collect())


def test_stream_progress_keeps_only_valid(spark):
    out = registry.QUERIES["stream_progress"](spark, SF001)
    from cohortlens.operators.validate import check_progress_requests
    from cohortlens.plans.q_io import progress_requests
    valid = check_progress_requests(progress_requests(spark, SF001)).filter("is_valid")
    assert out.count() == valid.count()


def test_snapshot_empty_source_keeps_old_version(spark):
    store = SnapshotStore(spark, scratch_path(spark, "snap-test"))
    st = inputs.students(spark, SF001)
    v1 = store.replace(st)
    with pytest.raises(ValueError):
        store.replace(st.limit(0))
    assert store.current_version() == v1
    assert store.read().count() == st.count()


def test_generator_is_partition_independent(spark):
    from cohortlens.sources.generator import generate_students
    a = generate_students(spark, 500, num_partitions=1).collect()
    b = generate_students(spark, 500, num_partitions=7).collect()
    assert sorted(a) == sorted(b)
    fac = {r["faculty_id"] for r in a[:250]}
    assert fac == {"FAC001"} and len(a) == 500
    assert all(20 <= r["attendance"] <= 100 for r in a)


def test_fixed_sample_size_and_stability(spark):
    s1 = registry.QUERIES["fixed_sample"](spark, SF001)
    st = inputs.students(spark, SF001)
    s2 = __import__("cohortlens.operators.views", fromlist=["x"]).fixed_sample(st.repartition(13), 300)
    assert s1.count() == min(300, st.count())
    assert sorted(r["student_id"] for r in s1.collect()) == sorted(r["student_id"] for r in s2.collect())


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_load_policies(spark):
    from cohortlens.operators import load, validate
    store = SnapshotStore(spark, scratch_path(spark, "load-test"))
    cols = "student_id string, attendance double, assignment_score double, internal_marks double, " \
           "quiz_score double, previous_semester_marks double, seq long"
    good = spark.createDataFrame([("A", 90.0, 80.0, 80.0, 80.0, 70.0, 1), ("B", 50.0, 40.0, 40.0, 40.0, 60.0, 2)],
                                 cols)
    v1 = load.load(store, good.drop("seq"), require=True)
    dup = spark.createDataFrame([("A", 90.0, 80.0, 80.0, 80.0, 70.0, 1), ("A", 60.0, 50.0, 50.0, 50.0, 70.0, 5)],
                                cols)
    with pytest.raises(validate.ValidationError):
        load.load(store, dup.drop("seq"), on_duplicate="error")
    assert store.current_version() == v1                      # old snapshot stays
    load.load(store, dup, on_duplicate="last", seq="seq")
    rows = store.read().collect()
    assert len(rows) == 1 and rows[0]["attendance"] == 60.0 and rows[0]["risk_level"] == "High Risk"
    with pytest.raises(validate.ValidationError):
        load.load(store, good.drop("quiz_score"), require=True)


def test_fixed_sample_is_hash_rank_top_n(spark):
    from cohortlens.operators import views
    st = inputs.students(spark, SF001)
    got = sorted(r["student_id"] for r in views.fixed_sample(st, 300, seed=42).collect())
    import hashlib
    allh = st.select("student_id").toPandas()
    allh["h"] = [hashlib.md5(f"{s}#42".encode()).hexdigest() for s in allh["student_id"]]
    want = sorted(allh.sort_values(["h", "student_id"]).head(300)["student_id"])
    assert got == want


def test_clustered_snapshot_files_hold_key_ranges(spark):
    from pyspark.sql import functions as F
    store = SnapshotStore(spark, scratch_path(spark, "clustered"))
    st = inputs.students(spark, SF001)
    store.replace(st, cluster_by=("faculty_id", "student_id"), num_files=6)
    files_ = store.read().withColumn("f", F.input_file_name())
    per_file = files_.groupBy("f").agg(F.countDistinct("faculty_id").alias("k")).collect()
    assert len(per_file) > 1
    # contiguous ranges: the number of (file, class) pairs is at most classes + files - 1
    classes = st.select("faculty_id").distinct().count()
    assert sum(r["k"] for r in per_file) <= classes + len(per_file) - 1
    assert sorted(store.read().drop("created_at").collect()) == sorted(st.collect())


def test_generator_distribution(spark):
    from pyspark.sql import functions as F

    from cohortlens.sources.generator import generate_students
    g = generate_students(spark, 20000).agg(
        F.avg("internal_marks").alias("m"), F.stddev("internal_marks").alias("s"),
        F.min("attendance").alias("lo"), F.avg(F.col("risk_level").isin("High Risk").cast("int")).alias("h")
    ).first()
    assert 59.5 < g["m"] < 60.5 and 14.5 < g["s"] < 15.5 and g["lo"] >= 20.0 and 0 < g["h"] < 0.5


def test_apply_stream_restart_is_idempotent(spark):
    """A restarted write-back stream (same checkpoint) neither re-applies nor loses batches,
    a replayed batch id overwrites its own log folder, and compaction changes nothing."""
    from cohortlens.operators import updates
    from cohortlens.plans.q_io import prediction_updates
    from cohortlens.sources import files, prediction_log
    from cohortlens.streaming import streams
    store = SnapshotStore(spark, scratch_path(spark, "restart-store"))
    store.replace(inputs.students(spark, SF001))
    log = prediction_log.PredictionLog(spark, scratch_path(spark, "restart-log"))
    upd = prediction_updates(spark, SF001)
    src, ck = scratch_path(spark, "restart-src"), scratch_path(spark, "restart-ck")
    files.write_json(upd.repartition(3, "student_id"), src)
    streams.run_apply_stream(spark, src, log, ck, upd.schema, max_files=1, ordered=True)
    batches = log.batches()
    merged = sorted(prediction_log.current(store, log).drop("prediction_seq").collect())
    streams.run_apply_stream(spark, src, log, ck, upd.schema, max_files=1, ordered=True)    # restart: nothing new
    assert log.batches() == batches
    b0 = spark.read.parquet(f"{log.base}/stream-0").drop("arrival")
    again = spark.createDataFrame(b0.collect(), b0.schema)               # the replayed batch's rows
    streams.apply_batch(log, ordered=True)(again, 0)                     # replay of batch 0
    assert sorted(prediction_log.current(store, log).drop("prediction_seq").collect()) == merged
    batch = updates.apply_predictions(inputs.students(spark, SF001), upd)
    assert merged == sorted(batch.collect())
    prediction_log.compact(store, log)
    assert log.folded(store) == set(batches)
    assert sorted(prediction_log.current(store, log).drop("prediction_seq").collect()) == merged


def _log_fixture(spark, name):
    from cohortlens.sources.prediction_log import PredictionLog
    store = SnapshotStore(spark, scratch_path(spark, f"{name}-store"))
    store.replace(inputs.students(spark, SF001))
    ids = [r[0] for r in store.read().select("student_id").orderBy("student_id").limit(3).collect()]
    batch = lambda i, risk, seq=0: spark.createDataFrame([(ids[i], risk, 0.5, "General", seq)], (
        "student_id string, predicted_risk string, confidence double, difficulty_type string, seq long"))
    predicted = lambda df: {r["student_id"]: r["predicted_risk"] for r in df.where("predicted_risk is not null").collect()}
    return store, PredictionLog(spark, scratch_path(spark, f"{name}-log")), ids, batch, predicted


def test_log_reads_committed_batches_only_and_later_those_that_were_open(spark):
    from cohortlens.sources import prediction_log as pl
    from cohortlens.sources.snapshot import file_system
    store, log, ids, batch, predicted = _log_fixture(spark, "open")
    log.append_batch(batch(0, "Low Risk"), 0)
    log.append_batch(batch(1, "High Risk"), 7)
    fs, mark, _ = file_system(spark, f"{log.base}/batch-7/_SUCCESS")
    fs.delete(mark, False)                                              # batch 7 is still being written
    assert predicted(pl.current(store, log)) == {ids[0]: "Low Risk"}
    pl.compact(store, log)
    assert log.folded(store) == {"batch-0"} and log.next_batch() == 8
    fs.create(mark).close()                                             # now it is committed
    assert predicted(pl.current(store, log)) == {ids[0]: "Low Risk", ids[1]: "High Risk"}


def test_log_writers_do_not_meet_and_later_batches_win(spark):
    from cohortlens.sources import prediction_log as pl
    store, log, ids, batch, predicted = _log_fixture(spark, "writers")
    log.append_batch(batch(0, "Low Risk", 1 << 50), 40_000, "run")
    pl.compact(store, log)
    log.append_batch(batch(0, "High Risk", 0), 0, "other")              # a fresh checkpoint counts from 0 again
    assert predicted(pl.current(store, log)) == {ids[0]: "High Risk"}
    pl.compact(store, log, cluster_by=("faculty_id", "student_id"))
    assert predicted(pl.current(store, log)) == {ids[0]: "High Risk"}
    log.append_batch(batch(0, "Medium Risk", 0), 40_001, "run")
    assert predicted(pl.current(store, log)) == {ids[0]: "Medium Risk"}


def test_reload_clears_logged_predictions(spark):
    from cohortlens.operators import load
    from cohortlens.sources import prediction_log as pl
    store, log, ids, batch, predicted = _log_fixture(spark, "reload")
    log.append_batch(batch(0, "Low Risk"), 0)
    load.load(store, inputs.students_raw(spark, SF001), before_commit=pl.cleared(log))
    assert predicted(pl.current(store, log)) == {}
    log.append_batch(batch(1, "High Risk"), 1)
    assert predicted(pl.current(store, log)) == {ids[1]: "High Risk"}


def test_reload_without_the_log_clears_too(spark):
    from cohortlens.operators import load
    from cohortlens.sources import prediction_log as pl
    store, log, ids, batch, predicted = _log_fixture(spark, "reload2")
    log.append_batch(batch(0, "Low Risk"), 0)
    pl.compact(store, log)
    log.append_batch(batch(1, "High Risk"), 1)
    assert len(predicted(pl.current(store, log))) == 2
    load.load(store, inputs.students_raw(spark, SF001))                 # a load that isn't given the log
    assert predicted(pl.current(store, log)) == {}
    log.append_batch(batch(2, "Medium Risk"), 2)
    assert predicted(pl.current(store, log)) == {ids[2]: "Medium Risk"}
    pl.compact(store, log)
    assert predicted(pl.current(store, log)) == {ids[2]: "Medium Risk"}


def test_streams_return_accepted_and_rejected(spark):
    from cohortlens.plans.q_io import progress_requests
    from cohortlens.sources import files
    from cohortlens.streaming import streams
    src, sink, bad, ck = (scratch_path(spark, n) for n in ("rj-in", "rj-out", "rj-bad", "rj-ck"))
    requests = progress_requests(spark, SF001)
    files.write_json(requests, src)
    streams.run_progress_stream(spark, src, sink, ck, rejects=bad)
    rejected = spark.read.json(bad)
    assert rejected.count() > 0 and rejected.where("error_kind is null").count() == 0
    assert spark.read.parquet(sink).count() + rejected.count() == requests.count()


def test_progress_stream_numbers_arrivals_and_replays_alike(spark):
    import shutil
    from urllib.parse import urlparse

    from cohortlens.operators import progress
    from cohortlens.session import scratch_path
    from cohortlens.streaming import streams
    src, sink, ck = (scratch_path(spark, n) for n in ("arrivals", "arrivals-log", "arrivals-ck"))
    made = lambda a: spark.createDataFrame([("S1", float(i), 50.0, "Low Risk") for i in a],
                                           "student_id string, attendance double, average_score double, risk_level string")
    made(range(40)).coalesce(1).write.mode("append").json(src)
    streams.run_progress_stream(spark, src, sink, ck)
    made(range(40, 50)).coalesce(1).write.mode("append").json(src)
    streams.run_progress_stream(spark, src, sink, ck)
    first = sorted(spark.read.parquet(sink).select("seq", "attendance", "timestamp").collect())
    assert [r["attendance"] for r in first] == [float(i) for i in range(50)]
    assert len({r["seq"] for r in first}) == 50 and None not in {r["seq"] for r in first}
    assert [r["attendance"] for r in progress.history(spark.read.parquet(sink), "S1").collect()] == [float(i) for i in range(50)]
    # the commit of the last batch is lost: it runs again
    base = urlparse(ck).path
    for name in ("1", ".1.crc"):
        shutil.move(f"{base}/commits/{name}", f"{base}/lost-{name}")
    streams.run_progress_stream(spark, src, sink, ck)
    assert sorted(spark.read.parquet(sink).select("seq", "attendance", "timestamp").collect()) == first
