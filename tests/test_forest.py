import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.operators import forest, ml

FEATURES = S.FEATURE_COLS
NAMES = ["High Risk", "Low Risk", "Medium Risk"]


def _rows(spark, n: int, step: float = 0.5):
    """Nine numbers a row, some of few values, and a label that follows from three of them."""
    x = [F.round((F.abs(F.xxhash64("id", F.lit(i))) % 10_000) / 100 / step / (1 + 7 * (i % 3)), 0) * step for i in range(9)]
    df = spark.range(n).select("id", *[c.alias(f) for c, f in zip(x, FEATURES, strict=True)])
    points = sum(F.when(F.col(FEATURES[i]) > c, 1).otherwise(0) for i, c in ((0, 40.0), (3, 55.0), (4, 6.0)))
    noise = F.when(F.col("id") % 17 == 0, 1).otherwise(0)
    return df.withColumn("y", ((points + noise) % 3).cast("double")).withColumn(
        "risk_level", F.element_at(F.array(*[F.lit(v) for v in NAMES]), F.col("y").cast("int") + 1))


def _cells(df, shape, size):
    """The chunks of ``df`` as a task holds them."""
    chunks = forest.binned(df, FEATURES, forest.index_of(NAMES, "risk_level"), shape, size).collect()
    return [(r["chunk"], bytes(r["cells"])) for r in chunks]


def _grown(parts, shape, depth):
    """``forest.grow`` in this process."""
    trees = [forest.Tree(t, shape) for t in range(shape.trees)]
    for level in range(depth):
        going = {t.number: t for t in trees if len(t.open)}
        levels = {t: x.levels for t, x in going.items()}
        pairs = [p for part in parts for p in forest.passed(part, levels, shape)]
        for tree, *found in forest.summed(pairs, {t: x[-1].features for t, x in levels.items()}, shape):
            going[tree].split(level + 1 == depth, *found)
    return trees


@pytest.mark.parametrize("n,step", [(3000, 0.5), (700, 0.01), (25_000, 0.01)])
def test_one_tree_of_all_rows_and_features_is_sparks_decision_tree(spark, monkeypatch, tmp_path, n, step):
    df = _rows(spark, n, step).coalesce(1).cache()
    weights = {"High Risk": 1.5, "Low Risk": 0.75, "Medium Risk": 1.25}
    weight = F.element_at(F.create_map(*[F.lit(v) for p in weights.items() for v in p]), F.col("risk_level"))
    dt = DecisionTreeClassifier(featuresCol="features", labelCol="y", weightCol="weight", maxDepth=7, minInstancesPerNode=2, seed=42)
    model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), dt]).fit(df.withColumn("weight", weight)).stages[-1]
    model.write().save(f"{tmp_path}/tree")
    want = [r["n"] for r in spark.read.parquet(f"{tmp_path}/tree/data").select(F.struct("*").alias("n")).orderBy("id").collect()]
    counts = {r["risk_level"]: r["count"] for r in df.groupBy("risk_level").count().collect()}
    found = forest.find_thresholds(df, FEATURES, counts, weights, "risk_level", 32, dt.getSeed())     # of 25,000 rows 10,000 are drawn
    shape = forest.Shape(found, np.array(list(weights.values())), 1, len(FEATURES), 2, 1)
    monkeypatch.setattr(forest, "copies", lambda seed, tree, chunk, n: np.ones(n, np.uint8))
    chunks = _cells(df, shape, n // 10)
    got = [r["nodeData"] for r in _grown([chunks[:2], chunks[2:]], shape, 7)[0].table().to_pylist()]
    assert len(got) == len(want) > 40
    for g, w in zip(got, want, strict=True):
        assert (g["id"], g["leftChild"], g["rightChild"], g["rawCount"], g["prediction"]) == (w["id"], w["leftChild"], w["rightChild"], w["rawCount"], w["prediction"])
        assert g["split"]["featureIndex"] == w["split"]["featureIndex"]
        assert g["split"]["leftCategoriesOrThreshold"] == list(w["split"]["leftCategoriesOrThreshold"])
        assert np.allclose(g["impurityStats"], w["impurityStats"])
        # Spark says -1 of a leaf for which it found no split
        assert np.isclose(g["impurity"], w["impurity"], atol=1e-12) or (w["impurity"], w["leftChild"]) == (-1, -1)
        assert np.isclose(g["gain"], w["gain"])


def test_scores_are_those_of_sparks_model(spark):
    df = _rows(spark, 2500)
    rf = RandomForestClassifier(featuresCol="features", labelCol="y", numTrees=15, maxDepth=9, maxBins=300, seed=3)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    model = rf.fit(assembler.transform(df))
    want = model.transform(assembler.transform(df)).select("id", "prediction", vector_to_array("probability").alias("probability"))
    plan = forest.scored(forest.forest_of(model), df, FEATURES)
    assert "UDF(features" not in plan._jdf.queryExecution().executedPlan().toString()     # Spark's walk, row by row
    got = plan.select("id", "prediction", "probability")
    assert got.count() == 2500 and want.exceptAll(got).isEmpty()
    with pytest.raises(ValueError, match="prediction"):
        forest.scored(forest.forest_of(model), df.withColumn("prediction", F.lit(1.0)), FEATURES)


def test_copies_are_poisson_and_the_same_in_every_pass():
    w = forest.copies(42, 7, 3 << 32, 400_000)
    assert (w == forest.copies(42, 7, 3 << 32, 400_000)).all() and len(forest.copies(42, 7, 3, 5)) == 5
    assert (w != forest.copies(42, 8, 3 << 32, 400_000)).mean() > 0.5
    for k, p in enumerate([0.36788, 0.36788, 0.18394, 0.06131, 0.01533]):
        assert abs((w == k).mean() - p) < 0.004
    assert w.max() < 20


def test_the_forest_does_not_depend_on_parts(spark):
    """Sums are of whole numbers, so that chunks in one task or in five give equal trees; more copies than two bytes hold, too."""
    df = _rows(spark, 4000).coalesce(1)
    shape = forest.Shape(forest.find_thresholds(df, FEATURES, dict.fromkeys(NAMES, 4000 // 3), dict.fromkeys(NAMES, 1.0), "risk_level", 32, 1), np.ones(3), 6, 3, 2, 42)
    chunks = _cells(df, shape, 300)
    tables = [[t.table().to_pylist() for t in _grown(parts, shape, 10)] for parts in ([chunks], [chunks[i::5] for i in range(5)])]
    assert tables[0] == tables[1] and max(len(t) for t in tables[0]) > 100
    many = {0: [forest.Level(np.array([[0, 1, 2]]))]}
    once, = forest.passed([chunks[0]], many, shape)
    often, = forest.passed([chunks[0]] * 12_000, many, shape)
    assert len(often[1]) == 2 * len(once[1])
    a, b = (list(forest.summed([p], {0: np.array([[0, 1, 2]])}, shape))[0][4] for p in (once, often))
    assert (12_000 * a == b).all()


def test_a_fit_keeps_no_rows_cached_and_its_model_is_saved_and_read(spark, tmp_path):
    df = _rows(spark, 1200).withColumns({"is_test": F.col("id") % 5 == 0, "fold": (F.col("id") % 5).cast("int")})
    data = ml.training_set(df)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    model = data.fit(ml.ForestParams(num_trees=7, max_depth=6))
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert model.stages[-1].getNumTrees == 7 and model.stages[-1].numFeatures == 9 and model.stages[-1].numClasses == 3
    assert np.isclose(model.stages[-1].featureImportances.toArray().sum(), 1)
    model.write().save(f"{tmp_path}/model")
    again = type(model).load(f"{tmp_path}/model")
    own, other = (ml.predict(m, df).select("id", "label", "predicted_risk", "class_probabilities") for m in (model, again))
    assert sorted(map(str, own.collect())) == sorted(map(str, other.collect()))
    assert own.where("label = y").count() == 1200


def test_one_class_is_a_forest_of_roots(spark):
    df = _rows(spark, 200).withColumn("risk_level", F.lit("Low Risk"))
    model = ml.fit(df, ml.ForestParams(num_trees=3, max_depth=4))
    assert ml.predict(model, df).where("predicted_risk = 'Low Risk' and confidence = 1").count() == 200
