"""Locally weighted line over value counts: k-th distances by narrowing, then weighted sums.

Rows are ``(group, x, c, sy)``: a distinct x with its count and sum of y. They are stored once and never
sorted across tasks, exploded or gathered: each pass is a scan in which a task sorts its own
batches and answers for every grid point from slices and cumulative sums of the sorted x. What passes add up
is a few numbers per group, grid point and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGES = 64                                    # distances that a pass tries between a grid point's bounds
BINS = 4096                                   # parts of a group's range in the first count
PRECISION = 1e-13                             # of a distance, in halves of a group's range


class Group(NamedTuple):
    """A group's range, its grid in it (as numbers from -1 to 1) and the weight k that a window has to hold."""
    lo: float
    hi: float
    k: int
    grid: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        half = (self.hi - self.lo) / 2
        return (x - (self.lo + self.hi) / 2) / (half or 1.0)


def _rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of a few rows as literals of the plan."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[c.alias(n) for n, c in r.items()]) for r in rows])))


def _groups_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(group number, x, c, sy) of each batch's groups, by x."""
    for batch in batches:
        g, x, c, sy = (batch.column(n).to_numpy(zero_copy_only=False) for n in names)
        by = np.lexsort((x, g))
        g, x, c, sy = g[by], x[by], c[by], sy[by]
        first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, int)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(g)], strict=True):
            yield int(g[a]), x[a:b], c[a:b], sy[a:b]


def _added_up(rows: DataFrame, groups: list[Group], width: int, part: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums over all rows of ``part``, a matrix (grid points, width) for some rows of a group."""
    points = len(groups[0].grid)
    shape = (points, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for g, x, c, sy in _groups_of(batches, ["g", "x", "c", "sy"]):
            total[g] = total.get(g, np.zeros(shape)) + part(g, groups[g].scaled(x), c, sy)
        for g, sums in total.items():
            yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(points, g, np.int32)), "gi": pa.array(np.arange(points, dtype=np.int32)),
                                              "s": pa.array(list(sums), pa.list_(pa.float64()))})

    each = rows.mapInArrow(run, "g int, gi int, s array<double>").select("g", "gi", F.posexplode("s").alias("i", "v"))
    out = np.zeros((len(groups), *shape))
    for r in each.groupBy("g", "gi", "i").agg(F.sum("v").alias("v")).collect():     # as many numbers as groups, grid points and columns
        out[r["g"], r["gi"], r["i"]] = r["v"]
    return out


def _bounds(rows: DataFrame, groups: list[Group]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the k-th distances from one count of all rows in BINS parts of a group's range.

    A part's rows lie no nearer to a grid point than its nearer end (least or largest x) and no farther than
    the other one. The parts in the order of their farthest rows hold k within the upper bound; in
    the order of their nearest ones, not before the lower. Parts of one x each leave no gap."""
    numbers = _rows(rows.sparkSession, [{"of": F.lit(i), "lo": F.lit(g.lo), "hi": F.lit(g.hi)} for i, g in enumerate(groups)])
    share = F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    parts = rows.join(F.broadcast(numbers), F.col("g") == F.col("of")).groupBy(
        "g", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.sum("c").alias("c"), F.min("x").alias("least"), F.max("x").alias("most")).collect()      # at most BINS a group
    points = len(groups[0].grid)
    low, high = np.zeros((len(groups), points)), np.zeros((len(groups), points))
    for i, group in enumerate(groups):
        own = [p for p in parts if p["g"] == i]
        c, least, most = (np.array([p[n] for p in own], float) for n in ("c", "least", "most"))
        left, right = (group.grid[:, None] - group.scaled(x)[None, :] for x in (most, least))
        far = np.maximum(np.abs(left), np.abs(right))
        near = np.where((left <= 0) & (right >= 0), 0.0, np.minimum(np.abs(left), np.abs(right)))
        for bound, d in ((low, near), (high, far)):
            by = d.argsort(axis=1, kind="stable")
            first = (np.cumsum(c[by], axis=1) >= group.k).argmax(axis=1)
            bound[i] = np.take_along_axis(np.take_along_axis(d, by, 1), first[:, None], 1)[:, 0]
    return low, high


def kth_distances(rows: DataFrame, groups: list[Group]) -> np.ndarray:
    """For each group and grid point the least distance within which the weights add up to k, to PRECISION.

    Where one count of all rows leaves bounds apart, each pass tries EDGES distances between them; how
    much weight lies within one is the difference of two cumulative counts. The bounds close in by
    that factor each time."""
    low, high = _bounds(rows, groups)
    steps = np.arange(1, EDGES + 1) / EDGES
    k = np.array([g.k for g in groups])[:, None, None]
    while (high - low > PRECISION).any():
        tried = low[:, :, None] + (high - low)[:, :, None] * steps
        tried[:, :, -1] = high

        def within(g: int, x: np.ndarray, c: np.ndarray, _: np.ndarray, tried=tried) -> np.ndarray:
            before = np.concatenate([[0.0], np.cumsum(c)])
            at = groups[g].grid[:, None]
            return before[np.searchsorted(x, at + tried[g], side="right")] - before[np.searchsorted(x, at - tried[g], side="left")]

        enough = _added_up(rows, groups, EDGES, within) >= k
        enough[:, :, -1] = True                               # the upper bound holds enough
        first = enough.argmax(axis=2)
        pick = lambda i, tried=tried: np.take_along_axis(tried, i[:, :, None], 2)[:, :, 0]
        low, high = np.where(first > 0, pick(np.maximum(first - 1, 0)), low), pick(first)
    return high


def weighted_sums(rows: DataFrame, groups: list[Group], h: np.ndarray) -> np.ndarray:
    """For each group and grid point the tricube-weighted sums of 1, t, t^2 (by count), y and t y, t = x - grid point.

    A window is a slice of a batch's sorted x, and its weights are taken row by row. (Cumulative sums of powers
    of x would do with fewer steps, but where a window's rows crowd at its edge the weights are as small as
    10^-14 and nothing of them is left in differences of such sums.) A window of width 0 holds the
    rows at the grid point itself, with weight 1."""

    def sums(g: int, x: np.ndarray, c: np.ndarray, sy: np.ndarray) -> np.ndarray:
        out = np.zeros((len(groups[g].grid), 5))
        for i, (at, width) in enumerate(zip(groups[g].grid.tolist(), h[g].tolist(), strict=True)):
            flat = width <= PRECISION
            reach = PRECISION if flat else width
            a, b = np.searchsorted(x, at - reach, side="left"), np.searchsorted(x, at + reach, side="right")
            t = x[a:b] - at
            w = np.ones(b - a) if flat else np.maximum(1 - np.abs(t / width) ** 3, 0) ** 3
            wc, wy = w * c[a:b], w * sy[a:b]
            out[i] = [wc.sum(), wc @ t, wc @ (t * t), wy.sum(), wy @ t]
        return out

    return _added_up(rows, groups, 5, sums)


def lines(values: DataFrame, by: str, points: int, frac: float) -> DataFrame:
    """(by, grid_index, x, y): the fitted lines at ``points`` places from the least to the largest x.

    ``values``: stored (by, x, c, sy). The number of groups is that of labels or classes: one row for each, and
    one number for each of its grid points, reach the driver. A NULL group is one of the groups."""
    spark = values.sparkSession
    found = values.groupBy(by).agg(F.sum("c").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn(
        "k", F.ceil(F.col("n") * frac)).collect()
    group_type = values.schema[by].dataType
    out_type = T.StructType([T.StructField(by, group_type), T.StructField("grid_index", T.IntegerType()),
                             T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    if not found:
        return spark.createDataFrame([], out_type)
    names = [r[by] for r in found]
    places = [r["lo"] + (r["hi"] - r["lo"]) / (points - 1) * np.arange(points) for r in found]
    groups = [Group(r["lo"], r["hi"], int(r["k"]), np.zeros(0)) for r in found]
    groups = [g._replace(grid=g.scaled(p)) for g, p in zip(groups, places, strict=True)]
    numbers = _rows(spark, [{"of_group": F.lit(n).cast(group_type), "g": F.lit(i)} for i, n in enumerate(names)])
    rows = values.join(F.broadcast(numbers), values[by].eqNullSafe(numbers["of_group"])).select("g", "x", F.col("c").cast("double").alias("c"), "sy")
    h = kth_distances(rows, groups)
    sums = weighted_sums(rows, groups, h)
    out = []
    for name, group, place, own in zip(names, groups, places, sums, strict=True):
        for i, (sw, swx, swxx, swy, swxy) in enumerate(own.tolist()):
            mx, my = swx / sw, swy / sw
            sxx, sxy = swxx - sw * mx * mx, swxy - sw * mx * my
            half = (group.hi - group.lo) / 2 or 1.0
            fit = my - sxy / sxx * mx if abs(sxx) * half * half > 1e-12 else my
            out.append((name, i, float(place[i]), float(fit)))
    return spark.createDataFrame(out, out_type)
