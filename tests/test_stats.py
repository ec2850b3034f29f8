"""Statistics on small fixtures with a hot group, against brute force / DuckDB."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import stats


def _fixture(seed=7, n=600):
    rng = np.random.default_rng(seed)
    risk = np.where(np.arange(n) % 3 == 0, "hot", rng.choice(["a", "b"], n))
    risk[: n // 3] = "hot"                                   # a third of all rows in one group
    att = np.round(rng.uniform(20, 100, n), 1)
    avg = np.round(0.6 * att + rng.normal(0, 8, n), 2)
    var = np.round(rng.gamma(2.0, 60.0, n), 2)
    var[: n // 6] = 0.0                                       # one value holding a sixth of the rows
    drop = np.round(rng.normal(0, 12, n), 2)
    return pd.DataFrame({"student_id": [f"S{i:05d}" for i in range(n)], "risk_level": risk,
                         "attendance": att, "average_score": avg, "score_variance": var,
                         "performance_drop": drop})


@pytest.mark.parametrize("parts", [1, 8])
def test_box_summary_matches_duckdb(spark, parts):
    """Range-partitioned quartiles against DuckDB."""
    pdf = _fixture()
    df = spark.createDataFrame(pdf).repartition(parts)
    got = {r["risk_level"]: r for r in stats.box_summary(df).collect()}
    want = duckdb.sql("""SELECT risk_level, quantile_cont(score_variance, 0.25) q1,
                                quantile_cont(score_variance, 0.5) med, quantile_cont(score_variance, 0.75) q3
                         FROM pdf GROUP BY 1""").df()
    for _, w in want.iterrows():
        g = got[w["risk_level"]]
        assert math.isclose(g["q1"], w["q1"], abs_tol=1e-9)
        assert math.isclose(g["median"], w["med"], abs_tol=1e-9)
        assert math.isclose(g["q3"], w["q3"], abs_tol=1e-9)


def test_density_integrates_to_about_one(spark):
    pdf = _fixture()
    d = stats.density(spark.createDataFrame(pdf), points=401).toPandas()
    for _, g in d.groupby("risk_level"):
        g = g.sort_values("x")
        area = np.trapezoid(g["density"], g["x"])
        assert 0.8 < area <= 1.0


def _lowess_brute(x, y, grid, frac):
    n = len(x)
    k = math.ceil(frac * n)
    out = []
    for g in grid:
        d = np.abs(x - g)
        h = np.sort(d)[k - 1]
        if h > 0:
            u = d / h
            w = np.where(u < 1, (1 - u ** 3) ** 3, 0.0)
        else:
            w = (d == 0).astype(float)
        sw = w.sum()
        mx, my = (w * x).sum() / sw, (w * y).sum() / sw
        sxx = (w * x * x).sum() - sw * mx * mx
        sxy = (w * x * y).sum() - sw * mx * my
        out.append(my + sxy / sxx * (g - mx) if abs(sxx) > 1e-12 else my)
    return np.array(out)


def test_trend_matches_brute_force(spark):
    """Range-partitioned bandwidths against numpy."""
    pdf = _fixture()
    got = stats.trend(spark.createDataFrame(pdf), points=21).toPandas()
    for grp, g in got.groupby("risk_level"):
        sub = pdf[pdf.risk_level == grp]
        g = g.sort_values("grid_index")
        want = _lowess_brute(sub.attendance.to_numpy(), sub.average_score.to_numpy(),
                             g["x"].to_numpy(), 2.0 / 3.0)
        assert np.allclose(g["y"].to_numpy(), want, rtol=0, atol=5.1e-5)   # output has 4 digits


def test_histogram_top_edge_in_last_bin(spark):
    df = spark.createDataFrame([("a", 100.0), ("a", 0.0), ("a", 99.99)], "risk_level string, average_score double")
    got = {r["bin"]: r["count"] for r in stats.histogram(df).collect()}
    assert got == {0: 1, 19: 2}


def test_correlation_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    r = {(x["x"], x["y"]): x["r"] for x in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert r[("a", "c")] is None and r[("a", "a")] == 1.0 and len(r) == 9


def test_empty_table_summary_is_zero(spark):
    df = spark.createDataFrame([], "faculty_id string, attendance double, average_score double")
    r = stats.analytics_summary(df).first()
    assert (r["total_students"], r["avg_attendance"], r["avg_score"]) == (0, 0.0, 0.0)


def test_null_label_group_kept_or_dropped(spark):
    df = spark.createDataFrame([("High Risk",), (None,), (None,), ("Low Risk",)], "risk_level string")
    keep = {r["risk_level"]: r["count"] for r in stats.risk_distribution(df, keep_null=True).collect()}
    drop = [(r["risk_level"], r["count"]) for r in stats.risk_distribution(df, keep_null=False).collect()]
    assert keep == {"High Risk": 1, "Low Risk": 1, None: 2}
    assert drop == [("High Risk", 1), ("Low Risk", 1)]


def test_risk_cards_fill_absent_labels(spark):
    df = spark.createDataFrame([("F1", "High Risk"), ("F1", "High Risk"), ("F1", "Low Risk")],
                               "faculty_id string, risk_level string")
    r = stats.risk_cards(df, by=["faculty_id"]).first()
    assert (r["n_high"], r["n_medium"], r["n_low"], r["pct_high"], r["pct_medium"]) == (2, 0, 1, 66.7, 0.0)


def test_means_do_not_depend_on_partitioning(spark):
    pdf = _fixture()
    a = stats.score_means_by_risk(spark.createDataFrame(pdf).repartition(1), ["attendance", "average_score"])
    b = stats.score_means_by_risk(spark.createDataFrame(pdf).repartition(13), ["attendance", "average_score"])
    assert sorted(a.collect()) == sorted(b.collect())


def test_density_and_trend_survive_degenerate_groups(spark):
    rows = [("const", 5.0, 50.0)] * 4 + [("single", 1.0, 10.0)] + \
           [("ok", float(i), float(i * 2 % 17)) for i in range(30)]
    df = spark.createDataFrame(rows, "risk_level string, performance_drop double, average_score double") \
        .withColumn("attendance", F.col("performance_drop"))
    d = {r["risk_level"]: r["density"] for r in stats.density(df, points=5).collect()}
    assert d["const"] is None and d["single"] is None and d["ok"] is not None
    t = {r["risk_level"]: r["y"] for r in stats.trend(df, points=5).collect()}
    assert t["const"] == 50.0 and t["single"] == 10.0 and t["ok"] is not None


def test_mean_keeps_all_decimals(spark):
    df = spark.createDataFrame([("a", 33.3333, 33.3333), ("a", 33.3338, 33.3338)], "risk_level string, attendance double, average_score double")
    assert stats.score_means_by_risk(df, ["attendance"]).first()["mean_attendance"] == 33.33355


@pytest.mark.parametrize("bins", [4, 4096])
def test_trend_and_box_over_many_distinct_values(spark, monkeypatch, bins):
    """Full-precision values in a narrow and a wide range: the first counts don't settle ranks and distances."""
    from cohortlens.operators import local_fit, ordering
    monkeypatch.setattr(local_fit, "BINS", bins)
    monkeypatch.setattr(ordering, "BINS", bins)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(50, 1e-7, 400), rng.uniform(0, 100, 300), np.full(100, 61.25)])
    pdf = pd.DataFrame({"student_id": [str(i) for i in range(800)], "risk_level": np.where(rng.random(800) < 0.4, "a", "hot"), "attendance": x,
                        "average_score": 3 + 0.2 * x + rng.normal(0, 1, 800), "score_variance": x * 1e200})
    df = spark.createDataFrame(pdf)
    for grp, g in stats.trend(df, points=11, frac=0.25).toPandas().groupby("risk_level"):
        sub, g = pdf[pdf.risk_level == grp], g.sort_values("grid_index")
        lo, hi = sub.attendance.min(), sub.attendance.max()
        want = _lowess_brute(sub.attendance.to_numpy(), sub.average_score.to_numpy(), lo + (hi - lo) / 10 * np.arange(11), 0.25)
        assert np.allclose(g["y"].to_numpy(), want, rtol=0, atol=6e-5)
    for r in stats.box_summary(df).collect():
        want = np.quantile(pdf[pdf.risk_level == r["risk_level"]].score_variance, [0.25, 0.5, 0.75])
        assert np.allclose([r["q1"], r["median"], r["q3"]], want, rtol=1e-15, atol=0)


def test_density_matches_the_whole_kernel(spark):
    pdf = _fixture()
    for grp, g in stats.density(spark.createDataFrame(pdf), points=41).toPandas().groupby("risk_level"):
        v = pdf[pdf.risk_level == grp].performance_drop.to_numpy()
        h, grid = v.std(ddof=1) * len(v) ** -0.2, np.linspace(v.min(), v.max(), 41)
        want = np.exp(-0.5 * ((grid[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert np.allclose(g.sort_values("grid_index")["density"].to_numpy(), want, rtol=0, atol=5.1e-7)


def test_statistics_read_their_input_once(spark):
    """What the statistics derive from is scanned for the stored rows alone."""
    pdf = _fixture(n=60)
    calls = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(pdf).mapInPandas(lambda it: (calls.add(len(p)) or p for p in it), spark.createDataFrame(pdf).schema)
    for run in (stats.box_summary, stats.box_outliers, stats.density, stats.trend):
        before = calls.value
        run(df).collect()
        assert calls.value - before == 60, run.__name__
