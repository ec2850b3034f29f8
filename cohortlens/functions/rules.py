"""Risk rules, bands and difficulty tags as Column expressions.

The reference applies several different rule sets in different places; each
one is a named function here. NULL inputs fall to the ``otherwise`` arm, the
way a missing value falls to the last branch in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortlens import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def risk_ingest(attendance="attendance", average="average_score") -> Column:
    """att>=85 & avg>=75 Low; att>=70 & avg>=55 Medium; else High."""
    att, avg = _c(attendance), _c(average)
    return (F.when((att >= 85) & (avg >= 75), F.lit(S.LOW))
            .when((att >= 70) & (avg >= 55), F.lit(S.MEDIUM))
            .otherwise(F.lit(S.HIGH)))


def risk_points_total(attendance="attendance", average="average_score",
                      drop="performance_drop", variance="score_variance") -> Column:
    """Sum of the four graded scores of the training-label rule (signed drop)."""
    att, avg, drp, var = _c(attendance), _c(average), _c(drop), _c(variance)
    return (F.when(att < 60, 3).when(att < 75, 1).otherwise(0)
            + F.when(avg < 45, 3).when(avg < 60, 1).otherwise(0)
            + F.when(drp > 15, 2).when(drp > 5, 1).otherwise(0)
            + F.when(var > 300, 1).otherwise(0))


def risk_points(points: Column) -> Column:
    return (F.when(points >= 5, F.lit(S.HIGH))
            .when(points >= 2, F.lit(S.MEDIUM))
            .otherwise(F.lit(S.LOW)))


def risk_progress(attendance="attendance", average="average_score") -> Column:
    """att<60 or avg<45 High; att<75 or avg<60 Medium; else Low."""
    att, avg = _c(attendance), _c(average)
    return (F.when((att < 60) | (avg < 45), F.lit(S.HIGH))
            .when((att < 75) | (avg < 60), F.lit(S.MEDIUM))
            .otherwise(F.lit(S.LOW)))


def risk_category(attendance="attendance", assignment="assignment_score") -> Column:
    att, asg = _c(attendance), _c(assignment)
    lo, mid, hi = S.CATEGORY_LABELS
    return (F.when((att >= 85) & (asg >= 80), F.lit(lo))
            .when((att >= 70) & (asg >= 65), F.lit(mid))
            .otherwise(F.lit(hi)))


def band(value, hi: float, mid: float) -> Column:
    """Three-band grade: >=hi good, >=mid watch, else poor."""
    v = _c(value)
    return F.when(v >= hi, F.lit("good")).when(v >= mid, F.lit("watch")).otherwise(F.lit("poor"))


def seeded_rank_key(key: str, seed: int) -> Column:
    """Seeded pseudo-random order of ``key``: md5 of "<key>#<seed>" (hex text).

    md5 gives the same digest in every engine, so samples and splits drawn
    with it can be reproduced outside Spark; ties cannot change the result
    because callers break them by the key itself.
    """
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))


def rule_inputs(df_cols=None):
    """Inputs of the recommendation rules with the defaults for missing values."""
    def pick(name, default):
        if df_cols is not None and name not in df_cols:
            return F.lit(float(default))
        return F.coalesce(F.col(name), F.lit(float(default)))
    return {
        "att": pick("attendance", 100), "intm": pick("internal_marks", 100),
        "asg": pick("assignment_score", 100), "quiz": pick("quiz_score", 100),
        "var": pick("score_variance", 0), "drop": pick("performance_drop", 0),
    }


def difficulty_types(df_cols=None) -> Column:
    """Ordered array of difficulty tags, fallback tag when none applies."""
    v = rule_inputs(df_cols)
    t1, t2, t3, t4 = S.DIFFICULTY_TAGS
    tags = F.array_compact(F.array(
        F.when(v["att"] < 60, F.lit(t1)),
        F.when((v["intm"] < 50) | (v["quiz"] < 50), F.lit(t2)),
        F.when(v["asg"] < 50, F.lit(t3)),
        F.when((v["var"] > 300) | (F.abs(v["drop"]) > 15), F.lit(t4)),
    ))
    return F.when(F.size(tags) == 0, F.array(F.lit(S.DIFFICULTY_FALLBACK))).otherwise(tags)


def alert_tags(df_cols=None) -> Column:
    """Short tags of the class alert list (no quiz/variance test), joined by ', '."""
    v = rule_inputs(df_cols)
    t1, t2, t3, t4 = S.ALERT_TAGS
    joined = F.concat_ws(", ",
                         F.when(v["att"] < 60, F.lit(t1)),
                         F.when(v["intm"] < 50, F.lit(t2)),
                         F.when(v["asg"] < 50, F.lit(t3)),
                         F.when(F.abs(v["drop"]) > 15, F.lit(t4)))
    return F.when(joined == "", F.lit(S.ALERT_FALLBACK)).otherwise(joined)
