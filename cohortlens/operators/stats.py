"""Summary statistics.

Every statistic is an aggregate with a partial (map-side) phase, so a group
holding a third of the rows is combined per task before the shuffle and the
shuffle carries one buffer per group and task. Where per-group state is not a
fixed-size buffer (exact quantiles, kernel density, local regression) the
data is first reduced to ``(group, value, count)``: its size is bounded by the
number of distinct values (e.g. 2-decimal variances of 0-100 scores have at
most 333,334 values), not by the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens import schema as S
from cohortlens.functions.exact import exact_mean
from cohortlens.operators import local_fit
from cohortlens.operators.ordering import join_group, selected_quantiles
from cohortlens.session import stored


def _n():
    return F.count(F.lit(1))


def analytics_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count, mean attendance and mean score (2 digits, 0 when empty)."""
    aggs = [_n().alias("total_students"),
            F.coalesce(F.round(exact_mean("attendance"), 2), F.lit(0.0)).alias("avg_attendance"),
            F.coalesce(F.round(exact_mean("average_score"), 2), F.lit(0.0)).alias("avg_score")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def risk_distribution(df: DataFrame, keep_null: bool = True, by: list[str] | None = None) -> DataFrame:
    """SQL variant keeps the NULL label group; the class variant drops it."""
    src = df if keep_null else df.filter(F.col("risk_level").isNotNull())
    keys = (by or []) + ["risk_level"]
    out = src.groupBy(*keys).agg(_n().alias("count"))
    return out if keep_null else out.orderBy(F.desc("count"), "risk_level")


def risk_cards(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Fixed-label counts (0 when absent) and their share in percent, 1 digit."""
    cnt = {lab: F.sum(F.when(F.col("risk_level") == lab, 1).otherwise(0)).cast("long")
           for lab in S.RISK_LABELS}
    aggs = [_n().alias("total")] + [v.alias(f"n_{k.split()[0].lower()}") for k, v in cnt.items()]
    base = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    shares = {f"pct_{k.split()[0].lower()}":
              F.coalesce(F.round(F.try_divide(F.col(f"n_{k.split()[0].lower()}") * 100.0,
                                              F.col("total")), 1), F.lit(0.0))
              for k in S.RISK_LABELS}
    return base.withColumns(shares)


def score_means_by_risk(df: DataFrame, cols=None, digits: int = 6) -> DataFrame:
    """Mean of each score column per risk level, with the fixed display order."""
    cols = cols or S.MEAN_COLS
    order = F.when(F.col("risk_level") == S.HIGH, 0).when(F.col("risk_level") == S.MEDIUM, 1) \
             .when(F.col("risk_level") == S.LOW, 2).otherwise(3)
    out = df.groupBy("risk_level").agg(*[F.round(exact_mean(c), digits).alias(f"mean_{c}") for c in cols])
    return out.withColumn("label_order", order).orderBy("label_order")


def counts_by(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(_n().alias("count"))


def role_counts(accounts: DataFrame) -> DataFrame:
    """Accounts per role with every role present (0 filled)."""
    roles = accounts.sparkSession.createDataFrame([(r,) for r in S.ROLES], "role string")
    counts = accounts.groupBy("role").agg(_n().alias("count"))
    return (F.broadcast(roles).join(counts, "role", "left")
            .select("role", F.coalesce("count", F.lit(0).cast("long")).alias("count")))


def correlation_matrix(df: DataFrame, cols=None, by: list[str] | None = None,
                       digits: int = 6) -> DataFrame:
    """Pearson r for every ordered pair (diagonal included), pairwise-complete, long form.

    One aggregation computes all pairs, each a group of the rows' exploded pairs, so the
    aggregate is small enough for code generation; no rows, no pairs. ``try_divide`` gives NULL where a
    column is constant instead of ANSI's divide-by-zero error of ``corr``.
    """
    cols = [c for c in (cols or S.CORRELATION_COLS) if c in df.columns]
    if len(cols) <= 2:
        raise ValueError("correlation needs more than two numeric columns")
    pairs = [(x, y) for i, x in enumerate(cols) for y in cols[i:]]
    rows = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("a"),
                              F.col(y).cast("double").alias("b")) for x, y in pairs])
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    a, b = F.when(both, F.col("a")), F.when(both, F.col("b"))
    half = (df.select(*(by or []), F.inline(rows)).groupBy(*(by or []), "x", "y")
            .agg(F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("r")))
    there = F.struct(F.col("x").alias("x"), F.col("y").alias("y"))
    back = F.struct(F.col("y").alias("x"), F.col("x").alias("y"))
    ways = F.when(F.col("x") == F.col("y"), F.array(there)).otherwise(F.array(there, back))
    long = half.select(*(by or []), "r", F.inline(ways)).select(*(by or []), "x", "y", "r")
    return long.withColumn("r", F.round("r", digits))


def histogram(df: DataFrame, value: str = "average_score", by: str = "risk_level",
              lo: float = 0.0, hi: float = 100.0, bins: int = 20) -> DataFrame:
    """Equal-width bins over [lo, hi]; the top edge falls in the last bin."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    return (df.filter(F.col(value).isNotNull())
              .groupBy(by, b.alias("bin"))
              .agg(_n().alias("count"))
              .withColumn("bin_start", F.col("bin") * width + lo))


def value_counts(df: DataFrame, value: str, by: str) -> DataFrame:
    """(group, value, count): the bounded reduction used by quantiles and density."""
    return (df.filter(F.col(value).isNotNull())
              .groupBy(by, F.col(value).alias("v")).agg(_n().alias("w")))


def box_summary(df: DataFrame, value: str = "score_variance", by: str = "risk_level") -> DataFrame:
    """Quartiles (linear interpolation, type 7), IQR and 1.5*IQR fences per group.

    The rows' groups and values are stored once; ranges around the quartiles' ranks are then
    narrowed from counts (``ordering.selected_quantiles``): nothing is sorted, and no task holds a group. A NULL
    group is one of the groups; a NULL or NaN value is left out.
    """
    return _box(stored(df.select(by, F.col(value).cast("double").alias("v")), "box-values"), by)


def _box(rows: DataFrame, by: str) -> DataFrame:
    wq = selected_quantiles(rows, by, "v", [0.25, 0.5, 0.75])
    quartile = lambda p: F.max(F.when(F.col("p") == p, F.col("q")))
    return (wq.groupBy(by).agg(F.max("n").alias("n"), F.max("min").alias("min"), F.max("max").alias("max"),
                               quartile(0.25).alias("q1"), quartile(0.5).alias("median"), quartile(0.75).alias("q3"))
              .withColumn("iqr", F.col("q3") - F.col("q1"))
              .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
              .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))


def box_outliers(df: DataFrame, value: str = "score_variance", by: str = "risk_level",
                 key: str = "student_id") -> DataFrame:
    """Rows outside the fences of their group.

    Fences and rows come from the same stored (key, group, value) rows, so the input is read once. The
    fence table has one row per group; the planner broadcasts it when it is
    small, and the big side is then only filtered, not shuffled.
    """
    rows = stored(df.select(key, by, F.col(value).alias("value"), F.col(value).cast("double").alias("v")), "box-rows")
    j = join_group(rows, _box(rows, by).select(by, "lower_fence", "upper_fence"), by)
    return (j.filter((F.col("v") < F.col("lower_fence")) | (F.col("v") > F.col("upper_fence")))
             .select(key, by, F.col("value").alias(value)))


def density(df: DataFrame, value: str = "performance_drop", by: str = "risk_level",
            points: int = 101, digits: int = 6) -> DataFrame:
    """Gaussian kernel density per group on an evenly spaced grid from min to max.

    Bandwidth h: Scott's rule, ``stddev_samp * n^(-1/5)``. The data is reduced to stored (group, value, count)
    rows, from which the group statistics come, too. A value only reaches the grid points within
    R h of it, where R^2 = 2 ln(1 / (e h sqrt(2 pi))) and e = 10^-(digits + 6): what all values beyond that add
    to a density is less than e, a millionth of the last digit. So the rows that are added up per
    (group, grid point), with a partial aggregate, are as many as the kernel's support has grid
    points, which shrinks with n. A constant group has bandwidth 0 and NULL densities.
    """
    vc = stored(value_counts(df, value, by).withColumn("v", F.col("v").cast("double")), "value-counts")
    w, v = F.col("w"), F.col("v")
    means = vc.groupBy(by).agg(F.sum(w).alias("n"), (F.sum(w * v) / F.sum(w)).alias("mean"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    squares = join_group(vc, means.select(by, "mean"), by).groupBy(by).agg(F.sum(w * F.pow(v - F.col("mean"), 2)).alias("ss"))
    sd = F.sqrt(F.try_divide(F.col("ss"), F.col("n") - 1))
    root = math.sqrt(2 * math.pi)
    stats = join_group(means, squares, by).select(
        by, "n", "lo", "hi", (sd * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"),
        ((F.col("hi") - F.col("lo")) / F.lit(points - 1)).alias("step"))
    # few rows, but made from two passes: stored, so that the two uses below don't repeat these
    stats = stored(stats, "density-groups")
    h, lo, step = F.col("h"), F.col("lo"), F.col("step")
    reach = h * F.sqrt(F.greatest(F.lit(0.0), -2 * F.log(F.lit(10.0 ** -(digits + 6) * root) * h)))
    first = F.greatest(F.lit(0.0), F.ceil((v - reach - lo) / step)).cast("int")
    last = F.least(F.lit(float(points - 1)), F.floor((v + reach - lo) / step)).cast("int")
    near = (join_group(vc, stats.where("h > 0"), by).withColumns({"first": first, "last": last}).where("first <= last")
            .select(by, "v", "w", "h", "lo", "step", F.explode(F.sequence("first", "last")).alias("gi")))
    u = (lo + step * F.col("gi") - v) / h
    sums = near.groupBy(by, "gi").agg(F.sum(w * F.exp(-0.5 * u * u)).alias("s"))
    sums = sums.select(F.col(by).alias("_by"), F.col("gi").alias("_gi"), "s")
    grid = stats.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("gi"))
    out = grid.join(sums, grid[by].eqNullSafe(sums["_by"]) & (F.col("gi") == F.col("_gi")), "left")
    return out.select(by, F.col("gi").alias("grid_index"), F.round(lo + step * F.col("gi"), digits).alias("x"),
                      F.when(h > 0, F.round(F.coalesce("s", F.lit(0.0)) / (F.col("n") * h * root), digits)).alias("density"))


def trend(df: DataFrame, x: str = "attendance", y: str = "average_score", by: str = "risk_level",
          points: int = 51, frac: float = 2.0 / 3.0, digits: int = 4) -> DataFrame:
    """Locally weighted linear fit of y on x per group, evaluated on a grid.

    At each grid point g the window is the ceil(frac*n) nearest x values
    (tricube weights on distance / k-th distance); the weighted least-squares
    line is evaluated at g, or the weighted mean when x has no spread there.
    No robustness iterations. Rows are first reduced to stored distinct (group, x)
    with count and sum of y; the k-th distances and the weighted sums come from a few scans of
    these (``local_fit``), so what is shuffled is in proportion to the distinct x. A NULL
    group is one of the groups.
    """
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    px = stored(base.groupBy(by, F.col(x).cast("double").alias("x")).agg(_n().alias("c"), F.sum(F.col(y).cast("double")).alias("sy")), "trend-values")
    fitted = local_fit.lines(px, by, points, frac)
    return fitted.select(by, "grid_index", F.round("x", 6).alias("x"), F.round("y", digits).alias("y"))


def profile(df: DataFrame, cols=None, key: str = "student_id") -> DataFrame:
    """Wide-to-long: one row per (student, measure)."""
    cols = cols or S.PROFILE_COLS
    return df.unpivot([key], cols, "measure", "value")
