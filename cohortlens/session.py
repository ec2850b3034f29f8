"""Session construction and shared-storage locations.

Scratch output (round trips, snapshots, checkpoints) always lives under the
folder named by ``spark.checkpoint.dir``, which a cluster points at shared
storage. Only when that setting is absent (tests, local runs) do we create a
temporary folder and register it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str | None = None, app: str = "cohortlens",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with AQE (coalescing + skew join) on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if master and master.startswith("local"):              # there the driver is the executor, too
        conf["spark.driver.memory"] = os.environ.get("COHORTLENS_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, task_bytes: int = 256 << 20) -> dict[str, str]:
    """SQL settings sized to the input so that each scan split and each shuffle
    partition is about ``task_bytes`` (fits an executor core's share of memory
    without spilling much). AQE then coalesces small post-shuffle partitions
    towards half that size and splits skewed ones in joins."""
    parts = max(200, -(-int(input_bytes) // task_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(task_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(task_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(task_bytes),
    }


def apply_scale_conf(spark: SparkSession, input_bytes: int, **kw) -> None:
    for k, v in scale_conf(input_bytes, **kw).items():
        spark.conf.set(k, v)


def source_bytes(df: DataFrame) -> int | None:
    """Bytes of all sources that ``df`` is derived from, by the optimizer's statistics; None if one is unknown.

    Sources are summed up: the estimate for a join is the product of its sides."""
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= unknown for s in sizes) else sum(sizes)


def range_partitions(df: DataFrame, task_bytes: int = 64 << 20) -> int:
    """Partitions for a range exchange of ``df``, whose number AQE doesn't change: one for each
    ``task_bytes`` of source, and no fewer than the session's shuffle partitions."""
    least = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    size = source_bytes(df)
    return least if size is None else max(least, -(-size // task_bytes))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    Reads ``spark.checkpoint.dir`` from the session. If it is unset we are in a
    test or a local run: a temporary folder is created only then, and only for
    a local master (a machine-local folder is useless to a cluster).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    base = spark.conf.get(CHECKPOINT_CONF, None) or sc.getConf().get(CHECKPOINT_CONF, None)
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                f"{CHECKPOINT_CONF} must name a shared folder on a cluster")
        base = tempfile.mkdtemp(prefix="cohortlens-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, base)
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def importable(spark: SparkSession) -> None:
    """Python workers find this package where the driver has it (local masters; on a cluster it is
    installed or shipped with --py-files)."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = spark.conf.get(CHECKPOINT_CONF, None) or ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under the shared folder and read back: later passes don't derive it
    again, and a lost executor costs nothing that was already written."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
