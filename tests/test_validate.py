import pytest

from cohortlens import schema as S
from cohortlens.operators import validate


def _req(spark, **over):
    base = {"student_id": "S1", "attendance": "50", "assignment_score": "50", "internal_marks": "50",
            "quiz_score": "50", "previous_semester_marks": "50"}
    base.update(over)
    return spark.createDataFrame([tuple(base[f.name] for f in S.SCORE_REQUEST.fields)], S.SCORE_REQUEST)


@pytest.mark.parametrize("val,kind", [("-0.1", "out_of_range"), ("0", None), ("100", None),
                                      ("100.1", "out_of_range"), ("abc", "not_numeric"),
                                      ("", "not_numeric"), (None, "missing"), ("NaN", "out_of_range")])
def test_score_value_checks(spark, val, kind):
    r = validate.check_score_requests(_req(spark, quiz_score=val)).first()
    assert r["error_kind"] == kind
    assert r["is_valid"] == (kind is None)
    if kind:
        assert r["error_field"] == "quiz_score"


def test_first_error_in_field_order_and_missing_first(spark):
    r = validate.check_score_requests(_req(spark, attendance="x", quiz_score="200")).first()
    assert (r["error_kind"], r["error_field"]) == ("not_numeric", "attendance")
    r = validate.check_score_requests(_req(spark, attendance="x", internal_marks=None,
                                           quiz_score=None)).first()
    assert (r["error_kind"], r["error_field"]) == ("missing", "internal_marks,quiz_score")


def test_required_columns_and_empty(spark):
    df = spark.createDataFrame([("a", 1.0)], "student_id string, attendance double")
    with pytest.raises(validate.ValidationError) as e:
        validate.require_columns(df)
    assert "assignment_score" in str(e.value)
    with pytest.raises(validate.ValidationError):
        validate.require_non_empty(df.limit(0))


def test_duplicate_keys(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 3.0), ("b", 2, 2.0), (None, 4, 4.0)],
                               "student_id string, seq long, attendance double")
    got = {r["student_id"]: r["attendance"] for r in validate.dedupe_last(df).collect()}
    assert got == {"a": 3.0, "b": 2.0}
    with pytest.raises(validate.ValidationError):
        validate.assert_unique_key(df)


def test_number_suffixes_are_not_numbers(spark):
    df = spark.createDataFrame([("12d",), ("12f",), ("1e1",), (" 12. ",), (".5",), ("inf",), ("",)], "x string")
    assert [r[0] for r in df.select(validate.parsed_number("x")).collect()] == [None, None, 10.0, 12.0, 0.5, float("inf"), None]
