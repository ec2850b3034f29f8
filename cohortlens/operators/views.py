"""Lookups, role scope, sorts and the fixed-size sample.

Filters are plain predicates on the scan so Catalyst pushes them into the
Parquet reader (``PushedFilters``) or the JDBC ``WHERE`` clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions.rules import seeded_rank_key


def all_students(df: DataFrame) -> DataFrame:
    return df.orderBy("student_id")


def student_lookup(df: DataFrame, student_id: str) -> DataFrame:
    return df.filter(F.col("student_id") == F.lit(student_id))


def class_students(df: DataFrame, faculty_id: str) -> DataFrame:
    return df.filter(F.col("faculty_id") == F.lit(faculty_id)).orderBy("student_id")


def class_ids(df: DataFrame, faculty_id: str) -> DataFrame:
    return (df.filter(F.col("faculty_id") == F.lit(faculty_id))
              .select("student_id").orderBy("student_id"))


def scope_predicate(role: str, student_id: str | None = None,
                    faculty_id: str | None = None) -> Column:
    """admin: every row; faculty: own class; student: own row; anything else: nothing."""
    if role == "admin":
        return F.lit(True)
    if role == "faculty" and faculty_id:
        return F.col("faculty_id") == F.lit(faculty_id)
    if role == "student" and student_id:
        return F.col("student_id") == F.lit(student_id)
    return F.lit(False)


def scope(df: DataFrame, role: str, student_id: str | None = None,
          faculty_id: str | None = None) -> DataFrame:
    return df.filter(scope_predicate(role, student_id, faculty_id))


def force_own_id(requests: DataFrame, role: str, student_id: str | None) -> DataFrame:
    """A student's scoring requests are always about that student."""
    if role == "student":
        return requests.withColumn("student_id", F.lit(student_id).cast("string"))
    return requests


def split_own_rows(records: DataFrame, role: str, student_id: str | None) -> tuple[DataFrame, DataFrame]:
    """(allowed, denied): a student may only write records about themself."""
    if role != "student":
        return records, records.limit(0)
    own = F.col("student_id") == F.lit(student_id)
    return records.filter(own), records.filter(~own | F.col("student_id").isNull())


def check_history(role: str, student_id: str, own_id: str | None) -> None:
    """A student may only read their own history; staff may read any. Anything else is refused."""
    if role not in ("admin", "faculty") and not (role == "student" and own_id == student_id):
        raise PermissionError(f"{role} may not read the history of {student_id}")


# grouping_id over (faculty_id, student_id): the bit of a column that a set leaves out is 1
_CLASS, _OWN, _WHOLE = 1, 2, 3


def scoped_counts(accounts: DataFrame, students: DataFrame) -> DataFrame:
    """Rows each account may read, for every account at once; the students are read once.

    One aggregate over grouping sets counts the students of every class, of every id and of the whole
    table (combined map-side, so a class holding a third of all rows is no skew). Each account
    meets the one count of its scope by an equi-join.
    """
    sets = students.groupingSets([["faculty_id"], ["student_id"], []], "faculty_id", "student_id").agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("n"))
    counts = sets.select("n", F.col("_set").alias("_of"), F.when(F.col("_set") == _WHOLE, F.lit("")).otherwise(
        F.coalesce("faculty_id", "student_id")).alias("_id"))
    wanted = accounts.where(F.col("role").isin("admin", "faculty", "student")).withColumns({
        "_set": F.when(F.col("role") == "admin", _WHOLE).when(F.col("role") == "faculty", _CLASS).otherwise(_OWN),
        "_scope": F.when(F.col("role") == "admin", F.lit("")).when(F.col("role") == "faculty", F.col("linked_faculty_id"))
        .otherwise(F.col("linked_student_id"))})
    both = wanted.join(counts, (F.col("_set") == F.col("_of")) & (F.col("_scope") == F.col("_id")), "left")
    return both.select("username", "role", F.coalesce(F.col("n"), F.lit(0).cast("long")).alias("n_visible"))


def high_risk(df: DataFrame) -> DataFrame:
    return df.filter(F.col("risk_level") == S.HIGH)


def high_risk_priority(df: DataFrame, k: int | None = None) -> DataFrame:
    """High Risk rows, worst average first (id breaks ties); ``k`` makes it a top-k."""
    out = high_risk(df).orderBy(F.col("average_score").asc_nulls_last(), "student_id")
    return out.limit(k) if k else out


def fixed_sample(df: DataFrame, n: int, seed: int = S.SEED, key: str = "student_id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows, the same on any partitioning.

    A seeded hash rank with the key as tie-break; ``orderBy().limit(n)`` plans
    as TakeOrderedAndProject, i.e. a per-partition top-n then a merge of
    ``n x partitions`` rows, so it never sorts the table.
    """
    return df.orderBy(seeded_rank_key(key, seed), F.col(key)).limit(n)
