"""spark-submit entry points for the everyday operations.

    spark-submit cohortlens/jobs.py load-csv   --store S --csv PATH [--rejects DIR] [--log L]
    spark-submit cohortlens/jobs.py load-jdbc  --store S --url URL --table T --order-column C [--partition-column C ...]
    spark-submit cohortlens/jobs.py train      --store S --model M [--trees 200]
    spark-submit cohortlens/jobs.py score      --store S --model M --requests JSON_DIR --out DIR [--log L]
    spark-submit cohortlens/jobs.py compact    --store S --log L
    spark-submit cohortlens/jobs.py analytics  --store S --out DIR [--role faculty --faculty-id FAC001]
    spark-submit cohortlens/jobs.py export     --store S --out DIR [--role faculty --faculty-id FAC001] [--high-risk]
    spark-submit cohortlens/jobs.py accounts   --store S --out DIR
    spark-submit cohortlens/jobs.py progress   --log L --requests JSON_DIR [--rejects DIR]
    spark-submit cohortlens/jobs.py history    --log L --student-id ID --out DIR [--role student --own-id ID]
    spark-submit cohortlens/jobs.py stream-progress --log L --requests DIR --checkpoint C [--rejects DIR]
    spark-submit cohortlens/jobs.py stream-score --store S --model M --requests DIR --out DIR --checkpoint C [--rejects DIR]
    spark-submit cohortlens/jobs.py stream-apply --log L --updates DIR --checkpoint C --writer NAME

Loads with ``--log`` clear the predictions logged so far, as a reload does.

(ship the package with ``--py-files``; ``python -m cohortlens.jobs ...`` works locally.)

Every job reads and writes shared storage only, with the session's settings.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import load, ml, progress, stats, updates, validate, views
from cohortlens.session import apply_scale_conf, build_session, ensure_checkpoint_dir
from cohortlens.sources import files, jdbc
from cohortlens.sources import prediction_log
from cohortlens.sources.prediction_log import PredictionLog
from cohortlens.sources.snapshot import SnapshotStore
from cohortlens.streaming import streams


def _store(spark, a) -> SnapshotStore:
    return SnapshotStore(spark, a.store)


def _clearing(spark, a):
    return prediction_log.cleared(PredictionLog(spark, a.log)) if a.log else None


def cmd_load_csv(spark, a):
    """Malformed rows go to ``--rejects``; without it they fail the load."""
    store = _store(spark, a)
    good, bad = load.split_corrupt(files.read_students_csv(spark, a.csv, keep_corrupt=True))
    out = {}
    if a.rejects:
        bad.write.mode("errorifexists").json(a.rejects)
        out["rejected"] = spark.read.schema(bad.schema).json(a.rejects).count()
    elif sample := bad.limit(5).collect():
        raise validate.ValidationError(f"malformed rows, e.g. {[r["line"] for r in sample]}")
    v = load.load(store, good, on_duplicate="error", cluster_by=load.CLUSTER_BY, before_commit=_clearing(spark, a))
    return {"version": v, "rows": store.rows_written, **out}


def cmd_load_jdbc(spark, a):
    kw = {}
    if a.partition_column:
        kw = dict(partition_column=a.partition_column, lower=a.lower, upper=a.upper,
                  num_partitions=a.num_partitions)
    src = jdbc.read_table(spark, a.url, a.table, **kw)
    store = _store(spark, a)
    v = load.load(store, src, on_duplicate="last", require=True, seq=a.order_column, cluster_by=load.CLUSTER_BY,
                  before_commit=_clearing(spark, a))
    return {"version": v, "rows": store.rows_written}


def cmd_train(spark, a):
    """Retrain on the current snapshot (its stored labels) and save model + metrics."""
    snap = _store(spark, a).read()
    p = ml.ForestParams(num_trees=a.trees)
    result = ml.train_and_evaluate(snap, p, with_cv=True)
    version = ml.save(result, a.model)
    return {k: v for k, v in result.metrics.items() if k not in ("classes", "feature_names")} | {
        "version": version, "unlabelled": result.data.unlabelled}


def cmd_score(spark, a):
    """Validate requests, score, recommend; write results and rejects; write predictions back."""
    model = ml.load_model(spark, a.model)
    requests = views.force_own_id(files.read_score_requests_json(spark, a.requests), a.role, a.student_id)
    checked = validate.check_score_requests(requests)
    good, bad = validate.split_valid(checked)
    scored = streams.scoring_stream(good.select(*S.SCORE_REQUEST.fieldNames()), model)
    scored.write.mode("errorifexists").parquet(f"{a.out}/predictions")
    bad.write.mode("errorifexists").json(f"{a.out}/rejected")
    store = _store(spark, a)
    written = spark.read.parquet(f"{a.out}/predictions").filter(F.col("student_id").isNotNull())
    upd = written.select("student_id", "predicted_risk", "confidence", "difficulty_type",
                         F.monotonically_increasing_id().alias("seq"))
    if a.log:   # merge on read: this run costs its own rows; `compact` folds the log in later
        log = PredictionLog(spark, a.log)
        batch = log.next_batch("score")
        log.append_batch(upd, batch, "score")                    # a later run wins, then the later row
        return {"log_batch": batch}
    v = store.replace(updates.apply_predictions(store.read().drop("created_at"), upd), cluster_by=load.CLUSTER_BY)
    return {"version": v}


def cmd_compact(spark, a):
    return {"version": prediction_log.compact(_store(spark, a), PredictionLog(spark, a.log), load.CLUSTER_BY)}


def cmd_export(spark, a):
    """Rows the role may see (or the high-risk ones among them) as CSV."""
    snap = views.scope(_store(spark, a).read(), a.role, a.student_id, a.faculty_id)
    files.write_csv(views.high_risk(snap) if a.high_risk else snap, a.out)
    return {"written": a.out}


def cmd_accounts(spark, a):
    """Default accounts and one per student."""
    updates.accounts_table(spark, _store(spark, a).read()).write.mode("errorifexists").parquet(a.out)
    return {"written": a.out}


def cmd_analytics(spark, a):
    snap = views.scope(_store(spark, a).read(), a.role, a.student_id, a.faculty_id)
    outs = {"summary": stats.analytics_summary(snap),
            "risk_distribution": stats.risk_distribution(snap, keep_null=a.role == "admin"),
            "risk_cards": stats.risk_cards(snap),
            "score_means": stats.score_means_by_risk(snap),
            "correlation": stats.correlation_matrix(snap),
            "histogram": stats.histogram(snap),
            "variance_box": stats.box_summary(snap),
            "drop_density": stats.density(snap),
            "trend": stats.trend(snap)}
    for name, df in outs.items():
        df.write.mode("errorifexists").parquet(f"{a.out}/{name}")
    return {"written": sorted(outs)}


def cmd_progress(spark, a):
    checked = validate.check_progress_requests(files.read_progress_requests_json(spark, a.requests))
    good, bad = validate.split_valid(checked)
    if a.rejects:
        bad.write.mode("errorifexists").json(a.rejects)
    allowed, denied = views.split_own_rows(good, a.role, a.student_id)
    progress.append(allowed.select("student_id", "attendance", "average_score", "risk_level"), a.log)
    return {"log": a.log, "denied": denied.count(), "rejected": bad.count()}


def cmd_history(spark, a):
    """One student's records in time order, for those who may read them."""
    views.check_history(a.role, a.student_id, a.own_id)
    progress.history(spark.read.parquet(a.log), a.student_id).write.mode("errorifexists").json(a.out)
    return {"written": a.out}


def cmd_stream_progress(spark, a):
    streams.run_progress_stream(spark, a.requests, a.log, a.checkpoint, a.rejects)
    return {"sink": a.log}


def cmd_stream_score(spark, a):
    streams.run_scoring_stream(spark, a.requests, a.out, a.checkpoint, ml.load_model(spark, a.model), a.rejects)
    return {"sink": a.out}


def cmd_stream_apply(spark, a):
    schema = "student_id string, predicted_risk string, confidence double, difficulty_type string, seq long"
    streams.run_apply_stream(spark, a.updates, PredictionLog(spark, a.log), a.checkpoint, schema, writer=a.writer)
    return {"log": a.log}


def parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="cohortlens.jobs")
    ap.add_argument("--input-bytes", type=int, default=None,
                    help="size of the input; sizes scan splits and shuffle partitions (session.scale_conf)")
    sub = ap.add_subparsers(dest="cmd", required=True)

    def add(name, fn, *args):
        p = sub.add_parser(name)
        for arg, kw in args:
            p.add_argument(arg, **kw)
        p.set_defaults(fn=fn)
        return p

    req = {"required": True}
    add("load-csv", cmd_load_csv, ("--store", req), ("--csv", req), ("--rejects", {}), ("--log", {}))
    add("load-jdbc", cmd_load_jdbc, ("--store", req), ("--url", req), ("--table", req), ("--order-column", req), ("--log", {}),
        ("--partition-column", {}), ("--lower", {"type": int}), ("--upper", {"type": int}),
        ("--num-partitions", {"type": int}))
    add("train", cmd_train, ("--store", req), ("--model", req), ("--trees", {"type": int, "default": 200}))
    add("score", cmd_score, ("--store", req), ("--model", req), ("--requests", req), ("--out", req),
        ("--role", {"default": "admin"}), ("--student-id", {}), ("--log", {}))
    add("compact", cmd_compact, ("--store", req), ("--log", req))
    add("analytics", cmd_analytics, ("--store", req), ("--out", req), ("--role", {"default": "admin"}),
        ("--student-id", {}), ("--faculty-id", {}))
    add("export", cmd_export, ("--store", req), ("--out", req), ("--role", {"default": "admin"}),
        ("--student-id", {}), ("--faculty-id", {}), ("--high-risk", {"action": "store_true"}))
    add("accounts", cmd_accounts, ("--store", req), ("--out", req))
    add("progress", cmd_progress, ("--log", req), ("--requests", req), ("--role", {"default": "admin"}),
        ("--student-id", {}), ("--rejects", {}))
    add("history", cmd_history, ("--log", req), ("--student-id", req), ("--out", req), ("--role", {"default": "admin"}), ("--own-id", {}))
    add("stream-progress", cmd_stream_progress, ("--log", req), ("--requests", req), ("--checkpoint", req), ("--rejects", {}))
    add("stream-score", cmd_stream_score, ("--store", req), ("--model", req), ("--requests", req),
        ("--out", req), ("--checkpoint", req), ("--rejects", {}))
    add("stream-apply", cmd_stream_apply, ("--log", req), ("--updates", req), ("--checkpoint", req), ("--writer", req))
    return ap


def main(argv=None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or build_session(app=f"cohortlens-{a.cmd}")
    ensure_checkpoint_dir(spark)
    if a.input_bytes:
        apply_scale_conf(spark, a.input_bytes)
    out = a.fn(spark, a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
