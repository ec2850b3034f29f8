"""Table changes expressed as DataFrame transforms.

Plain Parquet has no MERGE/UPDATE, so updates are joins that produce the new
version of the table, which a snapshot store then publishes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schema as S

PRED_COLS = ["predicted_risk", "confidence", "difficulty_type"]


def latest_per_key(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """Last row per key by ``order`` (largest wins), as one partial aggregate.

    ``max_by`` combines map-side, so a key repeated a billion times is reduced
    inside each task before the shuffle instead of being sorted in one task.
    """
    picked = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(order))
    return df.groupBy(key).agg(picked.alias("_v")).select(key, "_v.*")


def apply_predictions(students: DataFrame, updates: DataFrame, seq: str = "seq",
                      keep_seq: bool = False) -> DataFrame:
    """Write the prediction columns of matching ids; unmatched ids are ignored; latest wins.

    With ``keep_seq`` the table carries ``prediction_seq`` (the arrival number, or struct of
    numbers, of the update it holds) and an update only replaces an older one, so applying
    updates in several batches, in any batch order, gives the one-batch result.
    """
    latest = latest_per_key(updates, "student_id", seq, PRED_COLS + [seq])
    upd = latest.select(F.col("student_id").alias("_uid"), F.col(seq).alias("_new_seq"),
                        *[F.col(c).alias(f"_new_{c}") for c in PRED_COLS])
    j = students.join(upd, F.col("student_id") == F.col("_uid"), "left")
    matched = F.col("_uid").isNotNull()
    if "prediction_seq" in students.columns:
        matched = matched & (F.col("prediction_seq").isNull() | (F.col("_new_seq") > F.col("prediction_seq")))
    cols = [F.when(matched, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in PRED_COLS else F.col(c) for c in students.columns if c != "prediction_seq"]
    if keep_seq:
        old = F.col("prediction_seq") if "prediction_seq" in students.columns else F.lit(None).cast(updates.schema[seq].dataType)
        cols.append(F.when(matched, F.col("_new_seq")).otherwise(old).alias("prediction_seq"))
    return j.select(cols)


def default_accounts(spark: SparkSession) -> DataFrame:
    rows = [(u, r, s, f) for (u, r, s, f) in S.DEFAULT_ACCOUNTS]
    return spark.createDataFrame(rows, "username string, role string, linked_student_id string, "
                                       "linked_faculty_id string")


def student_accounts(students: DataFrame) -> DataFrame:
    """One account per student, user name = lower-case id (first id wins on a clash)."""
    cand = students.filter(F.col("student_id").isNotNull()).select(
        F.lower("student_id").alias("username"), F.col("student_id"))
    first = cand.groupBy("username").agg(F.min("student_id").alias("linked_student_id"))
    return first.select("username", F.lit("student").alias("role"), "linked_student_id",
                        F.lit(None).cast("string").alias("linked_faculty_id"))


def valid_roles(accounts: DataFrame) -> DataFrame:
    return accounts.filter(F.col("role").isin(S.ROLES))


def insert_if_absent(existing: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new accounts table, rows created): anti-join on user name, then union."""
    created = valid_roles(candidates).join(existing.select("username"), "username", "left_anti")
    cols = existing.columns
    return existing.unionByName(created.select(cols)), created.select(cols)


def accounts_table(spark: SparkSession, students: DataFrame) -> DataFrame:
    """Default accounts, then one per student, as the reference seeds them."""
    table, _ = insert_if_absent(default_accounts(spark), student_accounts(students))
    return table
