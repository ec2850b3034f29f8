"""Plan-shape guards over every registered query (sf0.001).

No cross join or nested-loop join, no row-at-a-time or scalar-Arrow Python UDF,
and the bridge scan reads only the columns it needs.
"""

import pytest

from cohortlens.plans import registry
from tests.conftest import SF001

registry.load_all()
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join_or_python_udf(spark, name):
    df = registry.QUERIES[name](spark, SF001)
    plan = _plan(df)
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_bridge_prunes_lineitem_columns(spark):
    from cohortlens.sources.bridge import students_raw
    plan = _plan(students_raw(spark, SF001))
    line = [ln for ln in plan.splitlines() if "lineitem" in ln and "FileScan" in ln][0]
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_tax:double>" in line


def test_lookup_filter_is_pushed_down(spark):
    """A one-student lookup reaches the Parquet scans as a key predicate."""
    plan = _plan(registry.QUERIES["student_lookup"](spark, SF001))
    assert "EqualTo(l_orderkey,1)" in plan and "EqualTo(o_orderkey,1)" in plan
    plan = _plan(registry.QUERIES["progress_history"](spark, SF001))
    assert "EqualTo(user_id,1)" in plan


_ALLOWED_WINDOW_KEYS = ({"_pid"}, {"risk_level", "gi"}, {"_run"})


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_windows_never_partition_by_a_hot_key(spark, name):
    """A Window puts each partition key's rows in one task. The only windows allowed are over
    one balanced range partition (``_pid``) or the (risk level, grid point) cells of the trend
    bandwidth, whose size is bounded by the distinct x values of a group, or over a table with one
    row per range partition (``_run``)."""
    import re
    plan = _plan(registry.QUERIES[name](spark, SF001))
    for line in plan.splitlines():
        if "Window [" not in line:
            continue
        m = re.search(r"\], \[([^\]]*)\], \[", line)
        keys = {k.split("#")[0].strip() for k in m.group(1).split(",")} if m and m.group(1) else set()
        assert keys in _ALLOWED_WINDOW_KEYS, f"{name}: window partitioned by {keys}"


def test_trend_over_time_has_no_python(spark):
    plan = _plan(registry.QUERIES["progress_trend"](spark, SF001))
    assert "InPandas" not in plan and "InArrow" not in plan


def test_scoped_counts_reads_the_students_twice_at_most(spark):
    """Once for the accounts, once for the counts."""
    plan = _plan(registry.QUERIES["scoped_counts"](spark, SF001))
    assert sum("FileScan" in ln and "lineitem" in ln for ln in plan.splitlines()) <= 2


def test_range_partitions_follow_the_sources_size(spark):
    from cohortlens.session import range_partitions, source_bytes
    small, large = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("nation", "lineitem"))
    sizes = [source_bytes(d) for d in (small, large)]
    assert 0 < sizes[0] < sizes[1]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    task = sizes[0] + 1
    assert [range_partitions(d, task) for d in (small, large)] == [least, max(least, -(-sizes[1] // task))]
    assert range_partitions(large, sizes[1] // (4 * least)) >= 4 * least
    # a join is as large as both its sides, not as their product; rows made in Python have no known size
    both = small.join(large.select("l_orderkey"), small["n_nationkey"] == large["l_orderkey"])
    assert source_bytes(both) == sum(sizes)
    assert source_bytes(spark.createDataFrame([(1,)], "a int")) is None
    assert range_partitions(spark.createDataFrame([(1,)], "a int")) == least
