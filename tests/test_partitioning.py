"""Registered queries give the same rows with 1 and 16 shuffle partitions."""

import math

import pytest

from cohortlens.plans import registry
from tests.conftest import SF001

registry.load_all()
NAMES = ["risk_by_class", "analytics_summary", "score_means_by_risk", "correlation_matrix",
         "variance_box", "drop_density", "trend_line", "progress_trend", "stratified_split",
         "fixed_sample", "dedupe_last", "apply_predictions", "scoped_counts", "eval_metrics"]


def _rows(df):
    def norm(v):
        return round(v, 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(norm(x) for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_same_result_on_any_partitioning(spark, name):
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "1")
        one = _rows(registry.QUERIES[name](spark, SF001))
        spark.conf.set(key, "16")
        many = _rows(registry.QUERIES[name](spark, SF001))
    finally:
        spark.conf.set(key, old)
    assert one == many
