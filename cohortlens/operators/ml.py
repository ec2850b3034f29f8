"""Risk model: training, scoring and evaluation with Spark ML.

The random forest is Spark's model, grown level-wise by ``operators/forest`` over the training rows, which also
scores with it. Splits and folds are stratified and exact, and they depend only
on (label, seeded hash of the id, id), so they are the same on any
partitioning; the per-stratum ranks come from ``ordering.rank_in_group``
instead of a window over the label (three labels would mean three tasks). A training run stores its
assigned rows once; the model and every fold are fitted on these, with class
weights from one table of counts. Metrics are aggregates of the small (label, prediction) count table.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema as S
from cohortlens.functions import rules
from cohortlens.operators import forest
from cohortlens.operators.features import generator_features
from cohortlens.operators.ordering import join_group, rank_in_group
from cohortlens.session import stored
from cohortlens.sources.snapshot import file_system


@dataclass(frozen=True)
class ForestParams:
    """Reference settings: 200 trees, depth 10, min leaf 2, seed 42, balanced weights.
    (``min_samples_split`` has no Spark counterpart and is not applied.)"""
    num_trees: int = 200
    max_depth: int = 10
    min_instances_per_node: int = 2
    seed: int = S.SEED
    balanced: bool = True
    test_fraction: float = 0.2
    folds: int = 5
    parallelism: int = 1          # concurrent CV fits; one fit's jobs already fill the executors


def training_frame(raw: DataFrame) -> DataFrame:
    """Rows as the generator writes them: rounded features, label by the points rule."""
    g = generator_features(raw)
    g = g.withColumn("risk_level", rules.risk_points(rules.risk_points_total()))
    digits = {"average_score": 2, "attendance_ratio": 3, "performance_drop": 2, "score_variance": 2}
    return g.withColumns({c: F.round(c, d) for c, d in digits.items()})


def with_feature_defaults(df: DataFrame) -> DataFrame:
    """Absent feature columns and NULL values become 0.0, as at scoring time."""
    return df.withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns
                               else F.lit(0.0)) for c in S.FEATURE_COLS})


def class_weights(df: DataFrame, label: str = "risk_level") -> DataFrame:
    """Balanced weights n / (k * n_c) from the joined class counts. A NULL label is a class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    # one row per class: gathered into one array, and dealt out again with each share
    every = F.collect_list(F.struct(F.col(label).alias("c"), F.col("_nc").alias("n")))
    shares = counts.agg(every.alias("a")).select(F.explode("a").alias("x"), F.size("a").alias("k"),
                                                 F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n"))
    weights = shares.select(F.col("x.c").alias(label), (F.col("n") / (F.col("k") * F.col("x.n"))).alias("weight"))
    return join_group(df, weights, label)


def stratified_assign(df: DataFrame, label: str = "risk_level", key: str = "student_id",
                      seed: int = S.SEED, test_fraction: float = 0.2, folds: int = 5) -> DataFrame:
    """Adds ``is_test`` (exactly round(f * n_c) rows per class) and ``fold`` (rank mod folds)."""
    h = df.withColumn("_h", rules.seeded_rank_key(key, seed))
    r = rank_in_group(h, label, ["_h", key])
    n_test = F.round(F.col("group_size") * test_fraction)
    return (r.withColumn("is_test", F.col("rank_in_group") < n_test)
             .withColumn("fold", (F.col("rank_in_group") % folds).cast("int"))
             .drop("_h", "_pos", "group_size"))


def _forest(p: ForestParams) -> RandomForestClassifier:
    # cacheNodeIds and checkpointInterval are Spark's loop's; ``forest`` keeps nothing from level to level
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=p.num_trees,
                                maxDepth=p.max_depth, minInstancesPerNode=p.min_instances_per_node,
                                seed=p.seed, featureSubsetStrategy="sqrt", cacheNodeIds=True,
                                checkpointInterval=10)
    if p.balanced:
        rf = rf.setWeightCol("weight")
    return rf


def stages(p: ForestParams, labels: list[str]) -> tuple[StringIndexerModel, VectorAssembler, RandomForestClassifier]:
    """``labels``: all classes, in the order of their indexes."""
    indexer = StringIndexerModel.from_labels(labels, inputCol="risk_level", outputCol="label", handleInvalid="error")
    assembler = VectorAssembler(inputCols=S.FEATURE_COLS, outputCol="features")
    return indexer, assembler, _forest(p)


def fit(train: DataFrame, p: ForestParams = ForestParams()) -> PipelineModel:
    """A model of ``train``; rows without a label are left out. The rows are stored once."""
    return training_set(train.withColumns({"is_test": F.lit(False), "fold": F.lit(0)})).fit(p)


@dataclass
class TrainingSet:
    """Stored rows (label, features, ``is_test``, ``fold``) and how many each label, part and fold has.

    A fit reads the rows it needs from the stored ones (a filter on two columns), rather than all rows with a
    weight of 0 outside its part: Spark's trees count rows of weight 0 towards the least leaf size, so
    held-out rows would shape the model that they are to test."""
    rows: DataFrame
    counts: dict[tuple[str, bool, int], int]
    unlabelled: int = 0

    def chosen(self, fold: int | None) -> Callable[[bool, int], bool]:
        """Which rows (is_test, fold) train: all outside ``fold``, or for None those of the training part."""
        return (lambda test, k: not test) if fold is None else (lambda test, k: k != fold)

    def weights(self, fold: int | None = None) -> dict[str, float]:
        """Balanced weights n / (k n_c) of the classes that the rows of a fit have."""
        own = self.sizes(fold)
        total = sum(own.values())
        return {label: total / (len(own) * n) for label, n in own.items()}

    def sizes(self, fold: int | None = None) -> dict[str, int]:
        """How many rows of each class a fit has."""
        own: dict[str, int] = {}
        for (label, test, k), n in self.counts.items():
            if self.chosen(fold)(test, k):
                own[label] = own.get(label, 0) + n
        return dict(sorted(own.items()))

    def grown(self, p: ForestParams, fold: int | None = None) -> forest.Forest:
        weights = self.weights(fold)
        rows = self.rows.where(~F.col("is_test") if fold is None else F.col("fold") != fold)
        return forest.fit(rows, S.FEATURE_COLS, "risk_level", self.sizes(fold), weights if p.balanced else dict.fromkeys(weights, 1.0), _forest(p))

    def fit(self, p: ForestParams, fold: int | None = None) -> PipelineModel:
        indexer, assembler, estimator = stages(p, list(self.sizes(fold)))
        return PipelineModel([indexer, assembler, forest.as_model(self.rows.sparkSession, self.grown(p, fold), estimator)])

    def held_out(self, fold: int | None = None) -> DataFrame:
        return self.rows.where(F.col("is_test") if fold is None else F.col("fold") == fold)


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` in as many equal partitions as the executors run tasks, each in the order of all its columns.

    Every fit reads and bins these. Left as it comes, a table that was coalesced by its bytes is one or
    two partitions. Deal and order are the same in a run that is repeated, so the
    forest's draws, which go by partition and place, are, too."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism).sortWithinPartitions(*rows.columns)


def training_set(assigned: DataFrame) -> TrainingSet:
    """The rows of ``assigned`` that have a label, stored once: label, features with defaults, part and fold."""
    own = with_feature_defaults(assigned).select("risk_level", *S.FEATURE_COLS, "is_test", "fold")
    rows = stored(dealt_out(own), "training-set")
    # a model has each class in it, so the classes are few
    counts = {(r["risk_level"], r["is_test"], r["fold"]): r["n"]
              for r in rows.groupBy("risk_level", "is_test", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    unlabelled = sum(n for (label, _, _), n in counts.items() if label is None)
    return TrainingSet(rows.where(F.col("risk_level").isNotNull()), {k: n for k, n in counts.items() if k[0] is not None}, unlabelled)


def labels_of(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def _label_of(labels: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds predicted label, confidence (max probability, 4 digits) and the
    label -> probability map (4 digits); the model is applied set-wise."""
    labels = labels_of(model)
    lab_arr = F.array(*[F.lit(x) for x in labels])
    rows = with_feature_defaults(df).drop("label")
    # the label's index comes after the trees, so that it is left out where nobody reads it
    scored = model.stages[0].transform(forest.scored(forest.forest_of(model.stages[-1]), rows, S.FEATURE_COLS))
    probs = F.col("probability")
    return (scored
            .select(*[c for c in scored.columns if c != "prediction"], "prediction")
            .withColumn("predicted_risk", _label_of(labels))
            .withColumn("confidence", F.round(F.array_max(probs), 4))
            .withColumn("class_probabilities",
                        F.map_from_arrays(lab_arr, F.transform(probs, lambda x: F.round(x, 4))))
            .drop("probability"))


def prediction_record(df: DataFrame) -> Column:
    """The nested prediction record of one scoring request."""
    return F.struct(
        F.col("predicted_risk").alias("risk_level"), F.col("confidence"),
        F.col("class_probabilities"),
        F.struct(*[F.col(c) for c in ["average_score", "attendance_ratio", "performance_drop",
                                      "score_variance"]]).alias("engineered_features"))


def ranked_probabilities(probs: str = "class_probabilities") -> Column:
    """Array of (label, p) sorted by p descending (label breaks ties)."""
    entries = F.map_entries(F.col(probs))
    return F.array_sort(entries, lambda a, b: F.when(a["value"] > b["value"], -1)
                        .when(a["value"] < b["value"], 1)
                        .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


# ------------------------------------------------------------------ metrics
def pair_counts(pairs: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return pairs.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")) \
                .agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pairs: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """All k x k cells, zeros included, of the labels that occur or of ``labels``.

    The grid is made from the counts (k labels in one row, dealt out twice) and joined to them. A NULL label or
    prediction is a class of its own, which is shown as NULL."""
    counts = pair_counts(pairs)
    if labels is None:
        names = counts.select(F.explode(F.array(F.struct(F.col("label").alias("c")), F.struct(F.col("prediction").alias("c")))).alias("x")).distinct()
        every = names.agg(F.collect_list("x").alias("a"))
    else:
        every = pairs.sparkSession.range(1).select(F.array(*[F.struct(F.lit(x).cast("string").alias("c")) for x in labels]).alias("a"))
    grid = every.select("a", F.explode("a").alias("row")).select("row", F.explode("a").alias("column")).select(
        F.col("row.c").alias("of_label"), F.col("column.c").alias("of_prediction"))
    met = grid["of_label"].eqNullSafe(counts["label"]) & grid["of_prediction"].eqNullSafe(counts["prediction"])
    return grid.join(counts, met, "left").select(F.col("of_label").alias("label"), F.col("of_prediction").alias("prediction"),
                                                 F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def _report_counts(pairs: DataFrame) -> DataFrame:
    """Per class tp / support / predicted from the k x k count table in one pass:
    each (label, prediction, n) cell counts once for its label and once for its
    prediction (``inline`` of two structs), then one aggregate by class."""
    c = pair_counts(pairs)
    n, zero = F.col("n"), F.lit(0).cast("long")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(zero)
    roles = F.array(
        F.struct(F.col("label").alias("cls"), n.alias("support"), hit.alias("tp"), zero.alias("predicted")),
        F.struct(F.col("prediction").alias("cls"), zero.alias("support"), zero.alias("tp"),
                 n.alias("predicted")))
    j = (c.select(F.inline(roles)).groupBy("cls")
          .agg(*[F.sum(x).alias(x) for x in ("support", "tp", "predicted")]))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support")), F.lit(0.0))
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")), F.lit(0.0))
    return j.withColumn("f1", f1)


def class_report(pairs: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1 (0 on zero division) and support."""
    return _report_counts(pairs).select(F.col("cls").alias("label"), "precision", "recall", "f1",
                                        F.col("support").cast("long").alias("support"))


def eval_metrics(pairs: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 in one row (one aggregate)."""
    rep = _report_counts(pairs)
    tot = F.sum("support")
    w = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), tot), F.lit(0.0))
    return rep.agg(F.coalesce(F.try_divide(F.sum("tp").cast("double"), tot), F.lit(0.0)).alias("accuracy"),
                   w("precision").alias("precision"), w("recall").alias("recall"),
                   w("f1").alias("f1_score"))


# ------------------------------------------------------------------ training run
@dataclass
class TrainResult:
    model: PipelineModel
    metrics: dict
    cv_scores: list[float] = field(default_factory=list)
    test_pairs: DataFrame | None = None
    data: TrainingSet | None = None


def _pairs(grown: forest.Forest, labels: list[str], df: DataFrame) -> DataFrame:
    """(label, prediction) of rows that have a label."""
    rows = with_feature_defaults(df).select("risk_level", *S.FEATURE_COLS)
    return forest.scored(grown, rows, S.FEATURE_COLS).select(F.col("risk_level").alias("label"), _label_of(labels).alias("prediction"))


def train_and_evaluate(df: DataFrame, p: ForestParams = ForestParams(), with_cv: bool = True,
                       key: str = "student_id") -> TrainResult:
    """Stratified split, fit, hold-out metrics, stratified k-fold CV accuracy over all rows.
    Rows without a label take no part; ``data.unlabelled`` says how many there were."""
    data = training_set(stratified_assign(df, "risk_level", key, p.seed, p.test_fraction, p.folds))
    model = data.fit(p)
    test_pairs = stored(_pairs(forest.forest_of(model.stages[-1]), labels_of(model), data.held_out()), "test-pairs")
    m = eval_metrics(test_pairs).first().asDict()
    m["classes"] = labels_of(model)
    m["feature_names"] = list(S.FEATURE_COLS)
    result = TrainResult(model, m, [], test_pairs, data)
    if with_cv:
        add_cross_validation(result, p)
    return result


def cross_validate(data: TrainingSet, p: ForestParams = ForestParams()) -> list[float]:
    """Accuracy of each stratified fold (fold = rank in class mod k), trained on the rest.
    ``p.parallelism`` folds are fitted at a time; a fold's result does not depend on the others."""
    def one(k: int) -> float:
        return eval_metrics(_pairs(data.grown(p, k), list(data.sizes(k)), data.held_out(k))).first()["accuracy"]

    with ThreadPoolExecutor(max_workers=max(1, min(p.parallelism, p.folds))) as pool:
        return list(pool.map(one, range(p.folds)))


def add_cross_validation(result: TrainResult, p: ForestParams = ForestParams()) -> TrainResult:
    scores = cross_validate(result.data, p)
    mean = sum(scores) / len(scores)
    result.cv_scores = scores
    result.metrics["cv_mean"] = mean
    result.metrics["cv_std"] = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores))  # population
    return result


def feature_importances(spark: SparkSession, model: PipelineModel) -> DataFrame:
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(S.FEATURE_COLS, [float(x) for x in imp]), key=lambda t: (t[1], t[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


# ------------------------------------------------------------------ persistence
METRICS_SCHEMA = T.StructType([
    T.StructField("accuracy", T.DoubleType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1_score", T.DoubleType()),
    T.StructField("cv_mean", T.DoubleType()), T.StructField("cv_std", T.DoubleType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("feature_names", T.ArrayType(T.StringType()))])


def versions(spark: SparkSession, path: str) -> list[int]:
    """Published versions under ``path``, oldest first."""
    fs, p, _ = file_system(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())


def save(result: TrainResult, path: str) -> int:
    """Publish model and metrics together as a new version under ``path``; its number.

    Both are written to a staging folder that no reader looks at, and one rename publishes them. A save that
    dies before that leaves the pair in use as it was; a job that has loaded it goes on with it. Of two
    saves at a time the rename of one finds its number taken and takes the next."""
    spark = SparkSession.getActiveSession()
    staging = f"{path.rstrip('/')}/staging-{uuid.uuid4().hex}"
    result.model.write().save(f"{staging}/model")
    row = {k: result.metrics.get(k) for k in METRICS_SCHEMA.fieldNames()}
    spark.createDataFrame([row], METRICS_SCHEMA).coalesce(1).write.json(f"{staging}/metrics")
    fs, _, jvm = file_system(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    for _ in range(100):
        v = (versions(spark, path) or [0])[-1] + 1
        if not fs.exists(at(f"{path}/v={v}")) and fs.rename(at(staging), at(f"{path}/v={v}")):
            return v
    raise OSError(f"could not publish a version under {path}")


def _version(spark: SparkSession, path: str, version: int | None) -> str | None:
    found = versions(spark, path)
    v = version if version is not None else found[-1] if found else None
    return f"{path}/v={v}" if v in found else None


def load_model(spark: SparkSession, path: str, version: int | None = None) -> PipelineModel:
    """The newest model under ``path``, or that of ``version``."""
    at = _version(spark, path, version)
    if at is None:
        raise FileNotFoundError(f"no trained model at {path}; train one first")
    return PipelineModel.load(f"{at}/model")


def load_metrics(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The metrics row that was saved with the model, or None when no model has been trained."""
    at = _version(spark, path, version)
    return None if at is None else spark.read.schema(METRICS_SCHEMA).json(f"{at}/metrics")
