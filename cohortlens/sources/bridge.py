"""Student and progress tables derived from the driver's TPC-H-style tables.

The test data has no student table, so one is derived: one student per order
with line items, the class from the customer's nation, and five scores from
aggregates of the order's line items. The progress log comes from ``events``.

Plan shape (checked with ``explain``): lineitem is pruned to four columns and
aggregated with a partial (map-side) hash aggregate, so a hot order key
collapses before the shuffle; the aggregate's hash partitioning on
``l_orderkey`` is reused by the join with ``orders``, so only ``orders`` is
exchanged for it. The customer join is left to AQE: broadcast when the
runtime size is small, sort-merge with skew splitting otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.rules import risk_progress


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pct_int(c: str):
    return F.round(F.col(c) * 100).cast("int")


def source_keys(student_ids) -> list[int]:
    """Order / user keys behind student ids ("STU" + zero-padded key)."""
    return sorted({int(s[3:]) for s in student_ids if s and s.startswith("STU") and s[3:].isdigit()})


def class_keys(faculty_ids) -> list[int]:
    """Nation keys behind class ids ("FAC" + zero-padded nation key + 1)."""
    return sorted({int(f[3:]) - 1 for f in faculty_ids if f and f.startswith("FAC") and f[3:].isdigit()})


def students_raw(spark: SparkSession, sf_dir: str, student_ids=None, faculty_ids=None) -> DataFrame:
    """Six score columns plus ``faculty_id`` per student (no derived columns).

    ``student_ids`` restricts the derivation to those students by a key predicate
    on both scans (pushed into the Parquet readers, so a lookup skips row
    groups instead of aggregating all of ``lineitem``); ``faculty_ids`` does the
    same for classes on the ``customer`` scan."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    if student_ids is not None:
        keys = source_keys(student_ids)
        li = li.filter(F.col("l_orderkey").isin(keys))
        orders = orders.filter(F.col("o_orderkey").isin(keys))
    n = F.count(F.lit(1))
    scores = li.groupBy("l_orderkey").agg(
        (F.lit(2.0) * F.max("l_quantity")).alias("attendance"),
        (F.lit(10.0) * F.max(_pct_int("l_discount"))).alias("assignment_score"),
        F.round(F.lit(20.0) + F.lit(80.0) * F.sum(F.col("l_quantity").cast("int"))
                / (F.lit(50.0) * n), 1).alias("internal_marks"),
        F.round(F.lit(12.5) * F.max(_pct_int("l_tax")), 1).alias("quiz_score"),
        F.round(F.lit(30.0) + F.lit(70.0) * F.sum(_pct_int("l_discount"))
                / (F.lit(10.0) * n), 1).alias("previous_semester_marks"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    if faculty_ids is not None:
        customer = customer.filter(F.col("c_nationkey").isin(class_keys(faculty_ids)))
    joined = (orders.join(scores, orders.o_orderkey == scores.l_orderkey)
              .join(customer, orders.o_custkey == customer.c_custkey))
    return joined.select(
        F.concat(F.lit("STU"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0")).alias("student_id"),
        F.concat(F.lit("FAC"), F.lpad((F.col("c_nationkey") + 1).cast("string"), 3, "0")).alias("faculty_id"),
        "attendance", "assignment_score", "internal_marks", "quiz_score", "previous_semester_marks",
    )


def progress_raw(spark: SparkSession, sf_dir: str, student_ids=None) -> DataFrame:
    """Progress log rows: student, time, attendance, average score, arrival seq."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", "props")
    if student_ids is not None:
        ev = ev.filter(F.col("user_id").isin(source_keys(student_ids)))
    return ev.select(
        F.concat(F.lit("STU"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("student_id"),
        F.col("ts").alias("timestamp"),
        F.least(F.col("value"), F.lit(100.0)).alias("attendance"),
        F.get_json_object("props", "$.k").try_cast("double").alias("average_score"),
        F.col("event_id").alias("seq"),
    )


def progress_log(spark: SparkSession, sf_dir: str, student_ids=None) -> DataFrame:
    raw = progress_raw(spark, sf_dir, student_ids)
    return raw.select("student_id", "timestamp", "attendance", "average_score",
                      risk_progress().alias("risk_level"), "seq")
