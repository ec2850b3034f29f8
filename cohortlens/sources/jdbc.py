"""External SQL table source.

A full-table read split into ``num_partitions`` range slices of a numeric
column, so the remote table is pulled by many tasks in parallel rather than
through one connection. Decimal columns are cast to double, as the reference's
reader returns floats. Filters and column selection applied to the result are
pushed into the remote ``WHERE`` / ``SELECT`` by Spark's JDBC source.

No registered query uses this reader: its test would need a database that
only this process can see, which the build environment does not allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema as S
from cohortlens.operators.validate import require_columns


def jdbc_options(url: str, table: str, partition_column: str | None = None,
                 lower: int | None = None, upper: int | None = None,
                 num_partitions: int | None = None, fetch_size: int = 10_000,
                 extra: dict[str, str] | None = None) -> dict[str, str]:
    opts = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if partition_column:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("partitioned read needs lower, upper and num_partitions")
        opts.update({"partitionColumn": partition_column, "lowerBound": str(lower),
                     "upperBound": str(upper), "numPartitions": str(num_partitions)})
    opts.update(extra or {})
    return opts


def decimals_to_double(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("double") for f in df.schema.fields
                           if isinstance(f.dataType, T.DecimalType)})


def read_table(spark: SparkSession, url: str, table: str, required=None, **kw) -> DataFrame:
    df = spark.read.format("jdbc").options(**jdbc_options(url, table, **kw)).load()
    return require_columns(decimals_to_double(df), required or S.REQUIRED_COLS)
