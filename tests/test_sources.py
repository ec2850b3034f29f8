import pytest

from cohortlens.session import scratch_path
from cohortlens.sources import files, jdbc


def test_csv_declared_schema_keeps_bad_rows(spark):
    path = scratch_path(spark, "csv-bad")
    spark.createDataFrame([("S1", "80", "x"), ("S2", "70", "65")],
                          "student_id string, attendance string, quiz_score string") \
        .coalesce(1).write.option("header", True).csv(path)
    df = files.read_students_csv(spark, path, keep_corrupt=True)
    assert df.schema["attendance"].dataType.typeName() == "double"
    rows = {r["student_id"]: r for r in df.collect()}
    assert rows["S1"]["quiz_score"] is None and rows["S1"][files.CORRUPT] is not None
    assert rows["S2"]["quiz_score"] == 65.0 and rows["S2"][files.CORRUPT] is None


def test_jdbc_options():
    o = jdbc.jdbc_options("jdbc:x://h/db", "students", "id", 1, 1000, 8)
    assert o["numPartitions"] == "8" and o["partitionColumn"] == "id"
    with pytest.raises(ValueError):
        jdbc.jdbc_options("jdbc:x://h/db", "students", "id")


def test_decimals_become_double(spark):
    df = spark.sql("SELECT cast(12.5 AS decimal(5,2)) AS attendance, 'a' AS student_id")
    assert jdbc.decimals_to_double(df).schema["attendance"].dataType.typeName() == "double"


def test_scale_conf_sizes_partitions():
    from cohortlens.session import scale_conf
    c = scale_conf(100 * 10**12)                      # 100 TB
    assert int(c["spark.sql.shuffle.partitions"]) == -(-(100 * 10**12) // (256 << 20))   # no cap
    assert int(scale_conf(10 * 2**30)["spark.sql.shuffle.partitions"]) == 200   # floor
    assert int(scale_conf(1000 * 2**30)["spark.sql.shuffle.partitions"]) == 4000
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"


CSV = "student_id,attendance,assignment_score,internal_marks,quiz_score,previous_semester_marks"


def _csv_folder(spark, name, files_):
    """A folder of CSV files, written through Spark's file system."""
    from cohortlens.sources.snapshot import file_system
    base = scratch_path(spark, name)
    for f, lines in files_.items():
        fs, p, _ = file_system(spark, f"{base}/{f}")
        out = fs.create(p)
        out.write(bytearray("\n".join(lines).encode() + b"\n"))
        out.close()
    return base


def test_csv_columns_follow_each_files_header(spark):
    path = _csv_folder(spark, "csv-mixed", {
        "a.csv": ["student_id,attendance,quiz_score", "S1,90,70"],
        "b.csv": ["quiz_score,student_id,attendance", "55,S2,60"],
        "c.csv": ["student_id,attendance", "S3,40"]})
    rows = {r["student_id"]: (r["attendance"], r["quiz_score"]) for r in files.read_students_csv(spark, path).collect()}
    assert rows == {"S1": (90.0, 70.0), "S2": (60.0, 55.0), "S3": (40.0, None)}


def test_last_row_wins_by_file_name_and_position(spark):
    from cohortlens.operators import load
    filler = [f"F{i},50,50,50,50,50" for i in range(500)]
    path = _csv_folder(spark, "csv-last", {"a.csv": [CSV, "S1,10,1,1,1,1", "S2,10,1,1,1,1", "S2,11,1,1,1,1"],
                                           "b.csv": [CSV, *filler, "S1,20,1,1,1,1"]})
    got = load.prepare(files.read_students_csv(spark, path, arrival=True), on_duplicate="last", require=True)
    rows = {r["student_id"]: r["attendance"] for r in got.where("student_id like 'S%'").collect()}
    assert rows == {"S1": 20.0, "S2": 11.0} and got.count() == 502
    with pytest.raises(ValueError):
        load.prepare(files.read_students_csv(spark, path), on_duplicate="last")


def test_load_job_puts_bad_rows_aside(spark):
    from cohortlens import jobs
    from cohortlens.operators.validate import ValidationError
    path = _csv_folder(spark, "csv-oops", {"a.csv": [CSV, "S1,80,70,70,70,60", "S2,oops,70,70,70,60"]})
    store, bad = scratch_path(spark, "oops-store"), scratch_path(spark, "oops-bad")
    with pytest.raises(ValidationError):
        jobs.main(["load-csv", "--store", store, "--csv", path], spark)
    out = jobs.main(["load-csv", "--store", store, "--csv", path, "--rejects", bad], spark)
    assert out == {"version": 1, "rows": 1, "rejected": 1}
    assert "oops" in spark.read.json(bad).first()["line"]
