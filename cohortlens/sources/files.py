"""CSV and JSON sources and sinks.

CSV input is read with a declared schema (no inference pass over the data,
and one bad value cannot turn a whole column into strings). The schema is
built from each file's own header line, so files may order their columns
differently, and the ingest rule "derive a column only when it is absent" sees
the columns the files have. Malformed rows are kept and flagged in
``_corrupt_record`` (PERMISSIVE mode) instead of failing the load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens import schema as S

CORRUPT = "_corrupt_record"
ARRIVAL = "_arrival"                    # file by name, position in the file

_KNOWN = {f.name: f.dataType for f in S.STUDENTS.fields}


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """(header, file) of every non-empty file: its first line, from the task that reads its start."""
    lines = spark.read.text(path).where("_metadata.file_block_start = 0")
    return (lines.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.first("value").alias("header"))
            .select("header", "file"))


def schema_for_header(columns: list[str]) -> T.StructType:
    """Known columns get their stored type; unknown ones stay strings."""
    return T.StructType([T.StructField(c, _KNOWN.get(c, T.StringType())) for c in columns])


def _read_csv(spark: SparkSession, paths: str | list[str], columns: list[str]) -> DataFrame:
    schema = T.StructType(schema_for_header(columns).fields + [T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
          .option("columnNameOfCorruptRecord", CORRUPT).csv(paths))
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                  F.monotonically_increasing_id().alias("row"))
    return df.withColumn(ARRIVAL, at)


def read_students_csv(spark: SparkSession, path: str, keep_corrupt: bool = False, arrival: bool = False) -> DataFrame:
    """Rows of all files under ``path``, columns found by name in each file's header. A column that only
    some files have is NULL for the others. ``keep_corrupt`` keeps the flag of malformed rows,
    ``arrival`` the order of rows (files by name, then position) for "last wins"."""
    headers = csv_headers(spark, path)
    kinds = sorted(r["header"] for r in headers.select("header").distinct().collect())    # one per column order
    if len(kinds) <= 1:
        df = _read_csv(spark, path, spark.read.option("header", True).csv(path).columns)
    else:
        df = None
        for kind in kinds:        # the files of one header are listed here, as Spark itself lists its input
            of_kind = [r["file"] for r in headers.where(F.col("header") == kind).select("file").collect()]
            part = _read_csv(spark, of_kind, spark.read.option("header", True).csv(of_kind).columns)
            df = part if df is None else df.unionByName(part, allowMissingColumns=True)
    return df.drop(*([] if keep_corrupt else [CORRUPT]), *([] if arrival else [ARRIVAL]))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Header CSV, one folder of part files (written in parallel by every task)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_score_requests_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of scoring requests; every value read as a string for validation."""
    return spark.read.schema(S.SCORE_REQUEST).json(path)


def read_progress_requests_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.PROGRESS_REQUEST).json(path)


def parse_json_column(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """Requests arriving as JSON strings in a column (e.g. a message value)."""
    return df.select(F.from_json(F.col(col), schema).alias("_r")).select("_r.*")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)
