"""Model queries.

Training is an action; a trained model is kept per (input folder, settings)
for the life of the process so the model queries share one fit.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions import rules
from cohortlens.operators import features, ml, risk
from cohortlens.plans import inputs
from cohortlens.plans.registry import register
from cohortlens.plans.sqlbase import GEN_FEATURES, points_label_sql, with_gen, with_students
from cohortlens.session import scratch_path

PARAMS = ml.ForestParams()
_RUNS: dict = {}


def training_data(spark, sf_dir):
    return ml.training_frame(inputs.students_raw(spark, sf_dir))


def trained(spark, sf_dir, with_cv: bool = False) -> ml.TrainResult:
    key = (spark.sparkContext.applicationId, sf_dir, PARAMS)   # per application: no stale models
    if key not in _RUNS:
        _RUNS[key] = ml.train_and_evaluate(training_data(spark, sf_dir), PARAMS, with_cv=False)
    run = _RUNS[key]
    if with_cv and not run.cv_scores:
        ml.add_cross_validation(run, PARAMS)
    return run


@register("stratified_split", with_gen(f"""
, lab AS (SELECT student_id, {points_label_sql()} AS risk_level FROM gen),
r AS (SELECT student_id, risk_level,
             row_number() OVER (PARTITION BY risk_level ORDER BY md5(student_id || '#{PARAMS.seed}'),
                                student_id) - 1 AS rank_in_group,
             count(*) OVER (PARTITION BY risk_level) AS n_c FROM lab)
SELECT student_id, risk_level, rank_in_group,
       rank_in_group < round(n_c * {PARAMS.test_fraction}) AS is_test,
       cast(rank_in_group % {PARAMS.folds} AS integer) AS fold
FROM r"""))
def stratified_split(spark, sf_dir):
    a = ml.stratified_assign(training_data(spark, sf_dir), "risk_level", "student_id",
                             PARAMS.seed, PARAMS.test_fraction, PARAMS.folds)
    return a.select("student_id", "risk_level", "rank_in_group", "is_test", "fold")


@register("class_weights", with_gen(f"""
, c AS (SELECT {points_label_sql()} AS risk_level, count(*) AS n FROM gen GROUP BY 1)
SELECT risk_level, n, round(cast((SELECT sum(n) FROM c) AS double)
                            / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"""))
def class_weights(spark, sf_dir):
    w = ml.class_weights(training_data(spark, sf_dir))
    return (w.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.first("weight").alias("w"))
             .select("risk_level", "n", F.round("w", 6).alias("weight")))


@register("train_eval")
def train_eval(spark, sf_dir):
    """Hold-out accuracy and weighted precision / recall / F1 (CV in ``cv_scores``)."""
    r = trained(spark, sf_dir)
    m = r.metrics
    out = spark.createDataFrame([(m["accuracy"], m["precision"], m["recall"], m["f1_score"],
                                  r.test_pairs.count())],
                                "accuracy double, precision double, recall double, f1_score double, "
                                "test_rows long")
    hi, mid = S.BANDS["model_metric"]
    return out.withColumns({f"{c}_band": rules.band(c, hi, mid)
                            for c in ["accuracy", "precision", "recall", "f1_score"]})


@register("cv_scores")
def cv_scores(spark, sf_dir):
    r = trained(spark, sf_dir, with_cv=True)
    rows = [(i, float(s), r.metrics["cv_mean"], r.metrics["cv_std"]) for i, s in enumerate(r.cv_scores)]
    return spark.createDataFrame(rows, "fold int, accuracy double, cv_mean double, cv_std double")


def _scored(spark, sf_dir):
    model = trained(spark, sf_dir).model
    req = features.scoring_features(inputs.students_raw(spark, sf_dir))
    return ml.predict(model, req)


@register("score_students")
def score_students(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("student_id", "predicted_risk", "confidence", "class_probabilities",
                    ml.prediction_record(s).alias("prediction"))


@register("ranked_probabilities")
def ranked_probabilities(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("student_id", ml.ranked_probabilities().alias("ranked"))


@register("feature_importance")
def feature_importance(spark, sf_dir):
    return ml.feature_importances(spark, trained(spark, sf_dir).model)


@register("model_metrics")
def model_metrics(spark, sf_dir):
    """Persist model + metrics document, then read the metrics back."""
    r = trained(spark, sf_dir, with_cv=True)
    path = scratch_path(spark, "risk-model")
    ml.save(r, path)
    ml.load_model(spark, path)
    return ml.load_metrics(spark, path)


# Evaluation operators on a (label, prediction) table derived from the data:
# the ingest rule's label against the points rule's label for every student.
# Both labels are projections of the same rows, so there is no self-join.
def eval_pairs(spark, sf_dir):
    raw = inputs.students_raw(spark, sf_dir)
    lab = features.ingest_features(raw).select("student_id", F.col("risk_level").alias("label"),
                                               *S.REQUEST_FIELDS)
    return risk.label_points(lab, out="prediction").select("label", "prediction")


_PAIRS = f"""
, pairs AS (SELECT s.risk_level AS label, {points_label_sql(att='g.attendance')} AS prediction
            FROM students s JOIN gen g USING (student_id)),
pc AS (SELECT label, prediction, count(*) AS n FROM pairs GROUP BY 1, 2),
cls AS (SELECT label AS cls FROM pc UNION SELECT prediction FROM pc),
rep AS (SELECT cls AS label,
          coalesce((SELECT sum(n) FROM pc WHERE pc.label = cls AND pc.prediction = cls), 0) AS tp,
          coalesce((SELECT sum(n) FROM pc WHERE pc.label = cls), 0) AS support,
          coalesce((SELECT sum(n) FROM pc WHERE pc.prediction = cls), 0) AS predicted
        FROM cls),
rep2 AS (SELECT label, support,
           coalesce(CASE WHEN predicted > 0 THEN cast(tp AS double) / predicted END, 0e0) AS precision,
           coalesce(CASE WHEN support > 0 THEN cast(tp AS double) / support END, 0e0) AS recall
         FROM rep),
rep3 AS (SELECT label, precision, recall,
           coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END,
                    0e0) AS f1, cast(support AS bigint) AS support FROM rep2)
"""


def _eval_sql(body: str) -> str:
    return with_students(_PAIRS + body, extra=(("gen", GEN_FEATURES),))


@register("confusion_matrix", _eval_sql("""
SELECT a.label, b.label AS prediction, coalesce(pc.n, 0) AS count
FROM cls a(label) CROSS JOIN cls b(label) LEFT JOIN pc ON pc.label = a.label AND pc.prediction = b.label"""))
def confusion_matrix(spark, sf_dir):
    return ml.confusion_matrix(eval_pairs(spark, sf_dir))


@register("class_report", _eval_sql("""
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM rep3"""))
def class_report(spark, sf_dir):
    r = ml.class_report(eval_pairs(spark, sf_dir))
    return r.withColumns({c: F.round(c, 6) for c in ["precision", "recall", "f1"]})


@register("eval_metrics", _eval_sql("""
SELECT round((SELECT cast(sum(n) AS double) FROM pc WHERE label = prediction) / (SELECT sum(n) FROM pc), 6)
         AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1_score
FROM rep3"""))
def eval_metrics(spark, sf_dir):
    m = ml.eval_metrics(eval_pairs(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) for c in ["accuracy", "precision", "recall", "f1_score"]])
