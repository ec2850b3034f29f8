"""Structured Streaming jobs.

The streaming jobs call the same DataFrame functions as the batch path, so a
stream and a batch over the same records give the same rows. All are
stateless per record except the write-back, whose ``foreachBatch`` appends
each micro-batch to a prediction log (merge on read, periodic compaction; see
``sources/prediction_log.py``); a replayed batch id overwrites its own folder,
so a restart after a lost executor or driver applies every batch exactly once.
Checkpoints live under the shared checkpoint folder.
"""

from __future__ import annotations

import hashlib

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema as S
from cohortlens.operators import features, ml, progress, recommend, validate
from cohortlens.sources.prediction_log import PredictionLog

MAX_FILES_PER_TRIGGER = 1000
ENGINEERED = ["average_score", "attendance_ratio", "performance_drop", "score_variance"]


def read_json_stream(spark: SparkSession, path: str, schema,
                     max_files: int | None = MAX_FILES_PER_TRIGGER) -> DataFrame:
    """File stream with a bounded micro-batch (``maxFilesPerTrigger``)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.json(path)


def _run(query_builder, checkpoint: str, available_now: bool = True):
    w = query_builder.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    q = w.start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def progress_stream(requests: DataFrame) -> DataFrame:
    """Validate progress records; valid ones become log rows with their batch's time, number (if they bring one) and date."""
    v = validate.check_progress_requests(requests).filter("is_valid")
    arrived = [c for c in progress.ARRIVED if c in requests.columns]
    seq = F.col("seq") if "seq" in requests.columns else F.lit(None).cast("long")
    return v.select("student_id", F.current_timestamp().alias("timestamp"), "attendance", "average_score", "risk_level",
                    seq.alias("seq"), *arrived).withColumn("dt", F.to_date("timestamp"))


def _reject(spark: SparkSession, requests: DataFrame, checked: DataFrame, rejects: str, checkpoint: str) -> None:
    """Invalid requests as they were sent, with the reason, as JSON lines."""
    reason = [c for c in ("missing", "error_kind", "error_field") if c in checked.columns]
    sent = [c for c in requests.columns if c in checked.columns]
    bad = checked.filter(~F.col("is_valid")).select(*sent, *reason)
    _run(bad.writeStream.format("json").option("path", rejects).outputMode("append"), checkpoint)


def run_progress_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                        rejects: str | None = None) -> None:
    """Accepted records go to ``sink``, rejected ones with their reason to ``rejects``.

    A micro-batch is numbered (``progress.numbered``) and written to folders of its own, named by the
    checkpoint and the batch; its time is the one in the stream's log. A replay replaces these folders with equal rows."""
    requests = read_json_stream(spark, source, _progress_schema())
    placed = requests.select("*", *[F.col(f"_metadata.{c}").alias(c) for c in progress.ARRIVED])
    writer = hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def write(batch: DataFrame, batch_id: int) -> None:
        progress.write_batch(progress.numbered(batch, batch_id), sink, f"{writer}-{batch_id}")

    _run(progress_stream(placed).writeStream.foreachBatch(write), checkpoint)
    if rejects:
        _reject(spark, requests, validate.check_progress_requests(requests), rejects, f"{checkpoint}-rejects")


def _progress_schema():
    # a new StructType: ``StructType.add`` would mutate the shared schema in place
    return T.StructType(S.PROGRESS_REQUEST.fields + [T.StructField("seq", T.LongType())])


def scoring_stream(requests: DataFrame, model: PipelineModel) -> DataFrame:
    """Validate -> scoring features -> model -> recommendations, per request."""
    ok = validate.check_score_requests(requests).filter("is_valid").drop("missing", "error_kind",
                                                                        "error_field", "is_valid")
    feats = features.scoring_features(ok)
    scored = ml.predict(model, feats)
    recs = recommend.recommend(scored, risk_col="predicted_risk")
    return recs.select("student_id", "predicted_risk", "confidence", "class_probabilities",
                       F.concat_ws(", ", F.col("recommendation.difficulty_types")).alias("difficulty_type"),
                       F.struct(*ENGINEERED).alias("engineered_features"), "recommendation")


def run_scoring_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                       model: PipelineModel, rejects: str | None = None) -> None:
    """Scored requests go to ``sink``, rejected ones with their reason to ``rejects``."""
    requests = read_json_stream(spark, source, S.SCORE_REQUEST)
    _run(scoring_stream(requests, model).writeStream.format("parquet").option("path", sink).outputMode("append"), checkpoint)
    if rejects:
        _reject(spark, requests, validate.check_score_requests(requests), rejects, f"{checkpoint}-rejects")


def apply_batch(log: PredictionLog, writer: str = "stream", ordered: bool = False):
    """foreachBatch body: append the micro-batch of prediction updates to the log.

    The cost is the batch's, not the table's; a replayed batch id (after a
    restart) overwrites its own folder, so it is applied exactly once. ``writer`` names the
    stream: one with a fresh checkpoint counts from 0 again and needs a new name.
    """
    def fn(batch: DataFrame, batch_id: int) -> None:
        log.append_batch(batch, batch_id, writer, ordered)
    return fn


def run_apply_stream(spark: SparkSession, source: str, log: PredictionLog, checkpoint: str,
                     schema, max_files: int | None = MAX_FILES_PER_TRIGGER,
                     writer: str = "stream", ordered: bool = False) -> None:
    """``ordered``: the updates' ``seq`` numbers all arrivals, so files may be read in any order."""
    stream = read_json_stream(spark, source, schema, max_files)
    _run(stream.writeStream.foreachBatch(apply_batch(log, writer, ordered)), checkpoint)
