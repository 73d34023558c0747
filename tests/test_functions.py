"""Scalar parsers and codes on hand-written values (FN-*)."""

from pyspark.sql import functions as F

from estatelens.functions import columns as fn


def _one(spark, values, expr, schema="x string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr(F.col("x")).alias("y")).collect()]


def test_numeric_or_range(spark):
    got = _one(spark, ["1200", "950.0", "1133 - 1384", "34.46Sq. Meter", "4125Perch", None, "1d"],
               fn.parse_numeric_or_range)
    assert got == [1200.0, 950.0, 1258.5, None, None, None, None]


def test_leading_number(spark):
    got = _one(spark, ["3 BHK", "4 Bedroom", "1 RK", "studio", None], fn.parse_leading_number)
    assert got == [3.0, 4.0, 1.0, None, None]


def test_balcony_label(spark):
    got = _one(spark, ["2.0", "5", None, "3+", "3", "x"], fn.balcony_label)
    assert got == ["2", "3+", None, "3+", "3+", None]


def test_locality_normalisation(spark):
    got = _one(spark, ["  Banaswadi", "banaswadi\t ", "BANASWADI  EAST", None], fn.normalise_locality)
    assert got == ["banaswadi", "banaswadi", "banaswadi east", None]


def test_codes(spark):
    assert _one(spark, ["Old Property", "Undefined", None], fn.age_code) == [4.0, -1.0, -1.0]
    assert _one(spark, ["3+", "0", "2.0", None], fn.balcony_code) == [4.0, 0.0, -1.0, -1.0]
    assert _one(spark, ["house", "flat", None], fn.is_house) == [1.0, 0.0, 0.0]
    assert _one(spark, ["semi-furnished", None], fn.furnishing_code) == [1.0, None]


def test_contamination_flag(spark):
    got = _one(spark, ["Amravati Camp", "amaravathi", "Vidarbha road", None], fn.contamination_flag)
    assert got == [True, False, True, False]
