"""Order-dependent operators that stay balanced when one key is huge.

A window ``partitionBy(key)`` sends every row of a key to one task; if a key
holds a third of the data, so does that task. Here rows are instead
range-partitioned on the *full* sort key (key, order columns, unique
tie-break): the range partitioner samples that composite key, so a hot key
is spread over many partitions. Each partition is then sorted, positions are
taken with ``monotonically_increasing_id`` (partition index in the high bits,
record number in the low bits), and the result is checkpointed to the shared
checkpoint folder so later passes see exactly the same partitions.

Only per-partition summaries (one row per partition) ever reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.session import ensure_checkpoint_dir, range_partitions, stored

_LOW33 = (1 << 33) - 1


def _num_partitions(df: DataFrame, n: int | None) -> int:
    return n or range_partitions(df)


def sorted_checkpoint(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Range-partition + sort on ``order_cols``; add ``_pid`` and ``_idx``; checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    srt = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    srt = srt.withColumns({"_pid": F.spark_partition_id(),
                           "_idx": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33))})
    return srt.checkpoint(eager=True)


def global_positions(df: DataFrame, order_cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """Add ``_pos``: the 0-based position of each row in the total order ``order_cols``.

    ``order_cols`` should end in a unique column so that the order is total.
    """
    ck = sorted_checkpoint(df, order_cols, num_partitions)
    counts = ck.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()   # <= #partitions
    offsets = _offsets_table(ck, [(r["_pid"], r["n"]) for r in counts])
    return ck.join(offsets, "_pid").withColumn("_pos", F.col("_off") + F.col("_idx")).drop("_idx", "_off")


def _offsets_table(ck: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(``_pid``, ``_off``): rows (or weight) before each partition in partition order.

    One row per partition, so its size is bounded by the partition count; it is
    broadcast (shipped once per executor) rather than inlined into every task.
    """
    rows, acc = [], 0
    for pid, n in sorted(sizes):
        rows.append((pid, acc))
        acc += n
    offsets = ck.sparkSession.createDataFrame(rows, "_pid int, _off long")
    return F.broadcast(offsets)


def join_group(rows: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """``rows`` with the columns of the one row per group; a NULL group finds its own. Whether
    ``groups`` is broadcast is decided from its size at run time."""
    named = groups.withColumnRenamed(group, "_of_group")
    return rows.join(named, rows[group].eqNullSafe(named["_of_group"])).drop("_of_group")


def rank_in_group(df: DataFrame, group: str, order_cols: list[str],
                  num_partitions: int | None = None) -> DataFrame:
    """0-based rank of each row inside its group under ``order_cols`` (total order).

    Equivalent to ``row_number() over (partitionBy(group) orderBy(order_cols)) - 1``
    without one task per group: global positions minus the group's first
    position (one row per group). Rows of a NULL group are ranked among themselves.
    """
    pos = global_positions(df, [group] + order_cols, num_partitions)
    starts = pos.groupBy(group).agg(F.min("_pos").alias("_start"), F.count(F.lit(1)).alias("group_size"))
    return (join_group(pos, starts, group)
               .withColumn("rank_in_group", F.col("_pos") - F.col("_start"))
               .drop("_start", "_pid"))


def ordered_changes(df: DataFrame, key: str, order_cols: list[str], value_cols: list[str],
                    num_partitions: int | None = None) -> DataFrame:
    """Per key in ``order_cols`` order: previous and first value of each ``value_cols``.

    Adds ``prev_<v>`` (NULL on a key's first row) and ``first_<v>``; ``order_cols``
    should end in a unique column (e.g. an arrival number) so that ties cannot
    make the order, and the result, depend on the partitioning. Rows of a NULL key are one group.

    Windows over (partition, key) give the values inside a range partition, so a hot key is as many
    windows as it has partitions. A key that began in an earlier partition gets its previous and first row
    from a carry table, one row per partition, that is built and joined on the executors.
    """
    ck = sorted_checkpoint(df.select(key, *order_cols, *value_cols), [key] + order_cols, num_partitions)
    inside = Window.partitionBy("_pid", key).orderBy("_idx")
    local = stored(ck.withColumns({"_n": F.row_number().over(inside),
                                   **{f"prev_{v}": F.lag(v).over(inside) for v in value_cols},
                                   **{f"first_{v}": F.first(v).over(inside) for v in value_cols}}), "ordered-changes")
    carry = _carries(local, key, value_cols).withColumnRenamed("_pid", "_of")
    goes_on = F.col("_of").isNotNull() & F.col(key).eqNullSafe(F.col("_key"))
    out = local.join(carry, local["_pid"] == carry["_of"], "left")
    cols = {f"prev_{v}": F.when((F.col("_n") == 1) & goes_on, F.col("_prev").getField(v)).otherwise(F.col(f"prev_{v}"))
            for v in value_cols}
    cols |= {f"first_{v}": F.when(goes_on, F.col("_first").getField(v)).otherwise(F.col(f"first_{v}")) for v in value_cols}
    return out.withColumns(cols).drop("_pid", "_idx", "_n", "_of", "_key", "_prev", "_first")


def _carries(local: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """(_pid, _key, _prev, _first) of the partitions whose first key began in an earlier one: the key's
    last row before the partition, and its first row.

    Partitions lie in key order, so a key that goes on is the last key of every partition that it
    has left: its first row is in the first of these, its latest row in the one before."""
    values = F.struct(*value_cols)
    firsts = F.struct(*[F.col(f"first_{v}").alias(v) for v in value_cols])
    parts = stored(local.groupBy("_pid").agg(
        F.min_by(F.struct(F.col(key).alias("k")), "_idx").alias("head"),
        F.max_by(F.struct(F.col(key).alias("k"), values.alias("row"), firsts.alias("first")), "_idx").alias("tail")), "ordered-parts")
    tails = parts.groupBy(F.col("tail.k").alias("_tail")).agg(
        F.min("_pid").alias("from"), F.min_by("tail.first", "_pid").alias("_first"), F.max_by("tail.row", "_pid").alias("latest"))
    before = F.lag("tail.row").over(Window.partitionBy("_run").orderBy("_pid"))       # one row per partition
    heads = parts.withColumn("_run", F.col("tail.k")).select("_pid", F.col("head.k").alias("_key"), F.col("tail.k").eqNullSafe(F.col("head.k")).alias("whole"), before.alias("before"))
    found = heads.join(tails, F.col("_key").eqNullSafe(F.col("_tail")) & (F.col("from") < F.col("_pid")))
    return found.select("_pid", "_key", F.when(F.col("whole"), F.col("before")).otherwise(F.col("latest")).alias("_prev"), "_first")


BINS = 4096                                   # parts that a range is cut into by a round of selection


def selected_quantiles(rows: DataFrame, group: str, value: str, probs: list[float]) -> DataFrame:
    """Exact quantiles (linear interpolation, type 7) of a double column: ``group, p, q, n, min, max``.

    ``rows`` are read once a round, so they should be stored. A quantile lies between the values of
    two ranks. For each rank a range that holds its value is kept, with the number of values below
    it. A round counts a range's values in BINS parts and goes on with the part that the rank
    falls into, from its least to its largest value, until these are the same: two or three rounds for scores.
    Only counts are shuffled, at most BINS for each range and task; the state is a few rows per group, in a
    stored table. NULL and NaN values are left out.
    """
    v = F.col(value)
    rows = rows.where(v.isNotNull() & ~F.isnan(v)).select(F.col(group).alias("_g"), v.alias("_v"))
    base = stored(rows.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max")), "quantile-groups")
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in at for f in (F.floor, F.ceil)]))
    state = base.select("_g", F.col("min").alias("lo"), F.col("max").alias("hi"), F.lit(0).cast("long").alias("below"), ranks.alias("ranks"))
    while not state.where("lo < hi").isEmpty():
        open_ranges = state.where("lo < hi").withColumnRenamed("_g", "_of")
        inside = rows.join(open_ranges, rows["_g"].eqNullSafe(open_ranges["_of"]) & F.col("_v").between(F.col("lo"), F.col("hi")))
        # halves, so that the width of any range is finite
        share = (F.col("_v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        parts = inside.groupBy("_g", "lo", "hi", "below", "ranks", F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("bin")).agg(
            F.count(F.lit(1)).alias("m"), F.min("_v").alias("least"), F.max("_v").alias("most"))
        upto = F.sum("m").over(Window.partitionBy("_g", "lo", "hi").orderBy("bin"))
        hit = parts.withColumn("end", F.col("below") + upto).withColumn("start", F.col("end") - F.col("m")).withColumn(
            "ranks", F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("end")))).where(F.size("ranks") > 0)
        narrowed = hit.select("_g", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("start").alias("below"), "ranks")
        state = stored(narrowed.union(state.where("lo = hi")), "quantile-ranges")
    found = state.select(F.col("_g").alias("_of"), "lo", F.explode("ranks").alias("r"))
    wanted = base.select("*", F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), h.alias("h")) for p, h in zip(probs, at, strict=True)])).alias("t"))
    pairs = wanted.join(found, wanted["_g"].eqNullSafe(found["_of"]) & ((F.col("r") == F.floor("t.h")) | (F.col("r") == F.ceil("t.h"))))
    ends = pairs.groupBy("_g", "t", "n", "min", "max").agg(F.min("lo").alias("a"), F.max("lo").alias("b"))
    return ends.select(F.col("_g").alias(group), F.col("t.p").alias("p"),
                       (F.col("a") + (F.col("t.h") - F.floor("t.h")) * (F.col("b") - F.col("a"))).alias("q"), "n", "min", "max")
