"""Synthetic student generator.

Seeded normal scores, clipped, two classes in halves, derived values from the
unrounded scores and rounding last; labels by the points rule. Each value is
a pure function of (student number, seed, stream): a uniform is the first 52
bits of md5("<number>#<seed>#<stream>") and normals come from the Box-Muller
transform, so the output is the same on any number of partitions (``randn``
depends on the partitioning) and can be recomputed by any SQL engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions import rules
from cohortlens.operators.features import generator_features

# Fixed values: (mean, sd, low clip, high clip) of each generated score.
SCORE_PARAMS = {
    "attendance": (72.0, 18.0, 20.0, 100.0),
    "assignment_score": (65.0, 18.0, 0.0, 100.0),
    "internal_marks": (60.0, 15.0, 0.0, 100.0),
    "quiz_score": (62.0, 17.0, 0.0, 100.0),
    "previous_semester_marks": (63.0, 16.0, 0.0, 100.0),
}


def _uniform(i: Column, seed: int, stream: int) -> Column:
    digest = F.md5(F.concat(i.cast("string"), F.lit(f"#{seed}#{stream}")))
    bits52 = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return (bits52.cast("double") + 0.5) / float(1 << 52)


def _normal(i: Column, seed: int, stream: int) -> Column:
    u1, u2 = _uniform(i, seed, 2 * stream), _uniform(i, seed, 2 * stream + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def generate_students(spark: SparkSession, n: int = 500, seed: int = S.SEED,
                      num_partitions: int | None = None) -> DataFrame:
    digits = max(4, len(str(n)))
    base = spark.range(1, n + 1, numPartitions=num_partitions)
    i = F.col("id")
    cols = {"student_id": F.concat(F.lit("STU"), F.lpad(i.cast("string"), digits, "0")),
            "faculty_id": F.when(i <= n // 2, F.lit("FAC001")).otherwise(F.lit("FAC002"))}
    for k, (c, (mean, sd, lo, hi)) in enumerate(SCORE_PARAMS.items()):
        cols[c] = F.least(F.greatest(_normal(i, seed, k) * sd + mean, F.lit(lo)), F.lit(hi))
    raw = base.withColumns(cols).drop("id")
    g = generator_features(raw)
    g = g.withColumn("risk_level", rules.risk_points(rules.risk_points_total()))
    digits_of = {"average_score": 2, "attendance_ratio": 3, "performance_drop": 2, "score_variance": 2}
    rounded = {c: F.round(c, 1) for c in SCORE_PARAMS}
    rounded.update({c: F.round(c, d) for c, d in digits_of.items()})
    return g.withColumns(rounded).select([f.name for f in S.STUDENTS_CSV.fields])
