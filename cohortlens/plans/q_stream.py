"""Streaming queries: the batch inputs replayed as file streams."""

from __future__ import annotations

from cohortlens.plans import inputs
from cohortlens.plans.q_io import (_UPDATES_SQL, PROGRESS_REQUESTS_SQL, prediction_updates,
                                   progress_requests, score_requests)
from cohortlens.plans.sqlbase import with_progress, with_students
from cohortlens.plans.q_ml import trained
from cohortlens.plans.registry import register
from cohortlens.session import scratch_path
from cohortlens.sources import files
from cohortlens.sources import prediction_log
from cohortlens.sources.prediction_log import PredictionLog
from cohortlens.sources.snapshot import SnapshotStore
from cohortlens.streaming import streams


@register("stream_progress", with_progress(PROGRESS_REQUESTS_SQL + """
SELECT student_id, try_cast(attendance AS double) AS attendance,
       try_cast(average_score AS double) AS average_score, risk_level, seq FROM pr
WHERE student_id IS NOT NULL AND risk_level IS NOT NULL AND try_cast(attendance AS double) IS NOT NULL
  AND try_cast(average_score AS double) IS NOT NULL"""))
def stream_progress(spark, sf_dir):
    src, sink = scratch_path(spark, "progress-in"), scratch_path(spark, "progress-out")
    files.write_json(progress_requests(spark, sf_dir), src)
    streams.run_progress_stream(spark, src, sink, scratch_path(spark, "progress-ckpt"))
    return spark.read.parquet(sink).select("student_id", "attendance", "average_score", "risk_level", "seq")


@register("stream_scoring")
def stream_scoring(spark, sf_dir):
    model = trained(spark, sf_dir).model
    src, sink = scratch_path(spark, "score-in"), scratch_path(spark, "score-out")
    files.write_json(score_requests(spark, sf_dir), src)
    streams.run_scoring_stream(spark, src, sink, scratch_path(spark, "score-ckpt"), model)
    return spark.read.parquet(sink)


@register("stream_apply", with_students(_UPDATES_SQL, progress=True))
def stream_apply(spark, sf_dir):
    """Updates streamed into the prediction log one file per micro-batch, compacted into
    a new snapshot version, then read merged (nothing left to merge after compaction)."""
    store = SnapshotStore(spark, scratch_path(spark, "snapshot-stream"))
    store.replace(inputs.students(spark, sf_dir))
    log = PredictionLog(spark, scratch_path(spark, "prediction-log"))
    upd = prediction_updates(spark, sf_dir)
    src = scratch_path(spark, "updates-in")
    # several files, read in whatever order the source lists them: ``seq`` orders their rows
    files.write_json(upd, src)
    streams.run_apply_stream(spark, src, log, scratch_path(spark, "apply-ckpt"), upd.schema, ordered=True)
    prediction_log.compact(store, log)
    return prediction_log.current(store, log).drop("prediction_seq")
