"""Skew-safe order operators against window-function brute force, incl. a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.operators.ordering import ordered_changes, rank_in_group


def _data(spark, n=3000):
    # key "hot" holds a third of the rows; the rest spread over 200 keys
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{i % 200:03d}"
        rows.append((k, (i * 7919) % 1000, i, float((i * 31) % 97), float(i % 13)))
    return spark.createDataFrame(rows, "k string, t long, seq long, a double, b double")


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_ordered_changes_matches_window(spark, parts):
    df = _data(spark)
    got = ordered_changes(df, "k", ["t", "seq"], ["a", "b"], num_partitions=parts)
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = df.select("k", "t", "seq", "a", "b",
                     F.lag("a").over(w).alias("prev_a"), F.lag("b").over(w).alias("prev_b"),
                     F.first("a").over(w).alias("first_a"), F.first("b").over(w).alias("first_b"))
    cols = ["k", "t", "seq", "a", "b", "prev_a", "prev_b", "first_a", "first_b"]
    assert sorted(got.select(cols).collect()) == sorted(want.select(cols).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_rank_in_group_matches_row_number(spark, parts):
    df = _data(spark)
    got = rank_in_group(df, "k", ["t", "seq"], num_partitions=parts)
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = df.select("seq", (F.row_number().over(w) - 1).alias("rank_in_group"))
    assert sorted(got.select("seq", "rank_in_group").collect()) == sorted(want.collect())


def test_hot_key_spans_partitions(spark):
    from cohortlens.operators.ordering import sorted_checkpoint
    ck = sorted_checkpoint(_data(spark), ["k", "t", "seq"], 8)
    parts = ck.filter(F.col("k") == "hot").select("_pid").distinct().count()
    assert parts > 1


def test_ordered_changes_with_null_values_and_keys(spark):
    rows = [(None if i % 50 == 0 else ("hot" if i % 2 else f"k{i % 7}"), i, i,
             None if i % 9 == 0 else float(i % 11)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, a double")
    got = ordered_changes(df, "k", ["t", "seq"], ["a"], num_partitions=6)
    w = Window.partitionBy("k").orderBy("t", "seq")
    want = df.select("k", "t", "seq", "a", F.lag("a").over(w).alias("prev_a"),
                     F.first("a").over(w).alias("first_a"))
    cols = ["k", "t", "seq", "a", "prev_a", "first_a"]
    assert sorted(got.select(cols).collect(), key=str) == sorted(want.select(cols).collect(), key=str)


@pytest.mark.parametrize("parts", [3, 40])
def test_ordered_changes_when_keys_begin_and_end_inside_partitions(spark, parts):
    """One key over almost all partitions, none that fills one, and partitions without rows."""
    rows = [("b", i, i, None if i % 4 == 0 else float(i)) for i in range(200)] + \
           [(k, i, 1000 + i, float(i)) for k in ("a", "c", None) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, t long, seq long, a double")
    w = Window.partitionBy("k").orderBy("t", "seq")
    cols = ["k", "t", "seq", "a", "prev_a", "first_a"]
    for part in (df, df.where("k = 'b'"), df.where("k <> 'b'"), df.limit(0)):
        got = ordered_changes(part, "k", ["t", "seq"], ["a"], num_partitions=parts)
        want = part.select("k", "t", "seq", "a", F.lag("a").over(w).alias("prev_a"), F.first("a").over(w).alias("first_a"))
        assert sorted(got.select(cols).collect(), key=str) == sorted(want.select(cols).collect(), key=str)
