"""Versioned snapshot store.

A load replaces the whole student table. Spark refuses to overwrite a path
it is reading, and a half-written overwrite would leave readers with nothing,
so every load writes a staging folder, which is renamed to ``v=<n>`` once it has
passed its checks; the current version is the highest one with a ``_SUCCESS``
marker. A failed load therefore leaves the previous version current.
Paths go through the Hadoop FileSystem API, so any shared file system works.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cohortlens.session import range_partitions


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


class SnapshotStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def versions(self) -> list[int]:
        fs, p, jvm = file_system(self.spark, self.base)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("v=") and name[2:].isdigit():
                ok = jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")
                if fs.exists(ok):
                    out.append(int(name[2:]))
        return sorted(out)

    def current_version(self) -> int | None:
        v = self.versions()
        return v[-1] if v else None

    def _all_versions(self) -> list[int]:
        fs, p, _ = file_system(self.spark, self.base)
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(p)
                      if s.getPath().getName().startswith("v=") and s.getPath().getName()[2:].isdigit())

    def replace(self, df: DataFrame, reject_empty: bool = True,
                cluster_by: tuple[str, ...] | None = None, num_files: int | None = None,
                before_commit: Callable[[int], None] | None = None,
                check: Callable[[DataFrame], None] | None = None) -> int:
        """Publish ``df`` as the new version; an empty source keeps the old one.

        ``cluster_by`` (e.g. ``("faculty_id", "student_id")``) range-partitions and
        sorts the rows before writing, so each file holds one contiguous key
        range: Parquet min/max statistics then let a class filter or an id
        lookup skip whole files and row groups. The range partitioner samples
        the composite key, so a class holding a third of the rows still spreads
        over many files.

        The rows are computed once, into a staging folder that no reader looks at. Row count and
        ``check`` (raises to reject) look at what was written; then ``before_commit`` is told the
        version, and renaming the folder publishes it. ``rows_written`` holds the row count.
        """
        existing = self._all_versions()
        v = (existing[-1] + 1) if existing else 1
        staging = f"{self.base}/staging-{uuid.uuid4().hex}"
        out = df if "created_at" in df.columns else df.withColumn("created_at", F.current_timestamp())
        if cluster_by:
            # written plainly first: the range sample then reads this copy, not the input again
            raw = f"{staging}-raw"
            out.write.parquet(raw)
            out = self.spark.read.schema(out.schema).parquet(raw)
            out = out.repartitionByRange(num_files or range_partitions(out), *cluster_by).sortWithinPartitions(*cluster_by)
        counted = Observation()
        out.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(staging)
        fs, _, jvm = file_system(self.spark, self.base)
        path = jvm.org.apache.hadoop.fs.Path
        try:
            self.rows_written = counted.get["n"]
            if reject_empty and not self.rows_written:
                raise ValueError("source has no rows; the current snapshot is kept")
            if check:
                check(self.spark.read.parquet(staging))
            if before_commit:
                before_commit(v)
            if not fs.rename(path(staging), path(f"{self.base}/v={v}")):
                raise OSError(f"could not publish version {v} under {self.base}")
        finally:
            fs.delete(path(staging), True)
            fs.delete(path(f"{staging}-raw"), True)
        return v

    def read(self, version: int | None = None) -> DataFrame:
        v = version if version is not None else self.current_version()
        if v is None:
            raise FileNotFoundError(f"no snapshot under {self.base}")
        return self.spark.read.parquet(f"{self.base}/v={v}")
