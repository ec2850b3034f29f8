"""Validation and data-quality checks.

Record checks add columns (``missing``, ``error_kind``, ``error_field``) and a
split into valid and rejected rows; nothing is dropped silently. ANSI mode is
on, so numeric parsing uses ``try_cast`` (a plain cast would fail the job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S


class ValidationError(ValueError):
    pass


def require_columns(df: DataFrame, required=None) -> DataFrame:
    """Plan-time check that the required columns exist; names of the missing ones, sorted."""
    required = required or S.REQUIRED_COLS
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValidationError(f"missing required columns: {missing}")
    return df


def require_non_empty(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValidationError("source has no rows")
    return df


NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?|nan)\s*$"


def parsed_number(col: str) -> Column:
    """The column as a double, NULL if its text is no number (suffixes such as ``12d`` are none)."""
    return F.when(F.col(col).cast("string").rlike(NUMBER), F.col(col).try_cast("double"))


def _missing(fields) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in fields]))


def check_score_requests(df: DataFrame, fields=None) -> DataFrame:
    """Missing fields first; then, field by field, not numeric or outside [0, 100].

    NaN counts as out of range (it fails ``0 <= v <= 100``). The parsed value of
    each field replaces the string; the first error decides the reason.
    """
    fields = fields or S.REQUEST_FIELDS
    out = df.withColumn("missing", _missing(fields))
    parsed = {f"_v_{c}": parsed_number(c) for c in fields}
    out = out.withColumns(parsed)
    kind, field = F.lit(None).cast("string"), F.lit(None).cast("string")
    for c in reversed(fields):
        v = F.col(f"_v_{c}")
        bad_num = v.isNull()
        bad_rng = F.isnan(v) | (v < 0) | (v > 100)
        kind = F.when(bad_num, F.lit("not_numeric")).when(bad_rng, F.lit("out_of_range")).otherwise(kind)
        field = F.when(bad_num | bad_rng, F.lit(c)).otherwise(field)
    has_missing = F.size("missing") > 0
    out = out.withColumns({
        "error_kind": F.when(has_missing, F.lit("missing")).otherwise(kind),
        "error_field": F.when(has_missing, F.concat_ws(",", "missing")).otherwise(field),
    })
    out = out.withColumn("is_valid", F.col("error_kind").isNull())
    return out.withColumns({c: F.col(f"_v_{c}") for c in fields}).drop(*parsed.keys())


def check_progress_requests(df: DataFrame) -> DataFrame:
    """student_id, attendance, average_score and risk_level required (the label is the
    client's, stored as sent); the two numbers are parsed, with no range check."""
    fields = S.PROGRESS_FIELDS
    nums = ["attendance", "average_score"]
    out = df.withColumn("missing", _missing(fields))
    out = out.withColumns({f"_v_{c}": parsed_number(c) for c in nums})
    bad = F.col("_v_attendance").isNull() | F.col("_v_average_score").isNull()
    out = out.withColumn("error_kind", F.when(F.size("missing") > 0, F.lit("missing"))
                         .when(bad, F.lit("not_numeric")))
    out = out.withColumn("is_valid", F.col("error_kind").isNull())
    return out.withColumns({c: F.col(f"_v_{c}") for c in nums}).drop("_v_attendance", "_v_average_score")


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.filter("is_valid"), df.filter(~F.col("is_valid"))


def key_checks(df: DataFrame, key: str = "student_id") -> DataFrame:
    """Per key: rows and whether the key is null or duplicated (``on_duplicate='error'`` test)."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
              .withColumn("null_key", F.col(key).isNull())
              .withColumn("duplicate", F.col("n_rows") > 1))


def assert_unique_key(df: DataFrame, key: str = "student_id") -> DataFrame:
    """``on_duplicate='error'``: fail when a key repeats or is NULL (old snapshot stays)."""
    bad = key_checks(df, key).filter(F.col("null_key") | F.col("duplicate")).limit(5).collect()
    if bad:
        raise ValidationError(f"duplicate or null keys, e.g. {[r[key] for r in bad]}")
    return df


def dedupe_last(df: DataFrame, key: str = "student_id", seq: str = "seq") -> DataFrame:
    """``on_duplicate='last'``: keep the row with the greatest arrival ``seq`` per key.

    ``max_by`` is a partial aggregate, so a hot key is reduced before the
    shuffle; NULL keys are rejected first (the key column is NOT NULL).
    """
    cols = [c for c in df.columns if c != key]
    picked = F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(seq))
    return (df.filter(F.col(key).isNotNull()).groupBy(key).agg(picked.alias("_r"))
              .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols]))
