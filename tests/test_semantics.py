import math

from frames import frame
from pyspark.sql import functions as F

from forewarn.functions import semantics as sem

col = F.col


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_nan_becomes_null_and_clip_keeps_it(spark):
    df = sem.null_nan(spark.createDataFrame([(float("nan"),), (5.0,), (None,), (500.0,)], "x double"))
    assert values(df, sem.clip(col("x"), 10, 100)) == [None, 10.0, None, 100.0]
    assert values(df, sem.pymax0(30 - col("x"))) == [0.0, 25.0, 0.0, 0.0]
    assert values(df, sem.npmin(col("x"), 30)) == [None, 5.0, None, 30.0]


def test_round_half_even(spark):
    df = spark.createDataFrame([(0.125,), (33.705,), (2.5,), (-0.5,), (None,)], "x double")
    assert values(df, sem.npround(col("x"), 2)) == [0.12, 33.7, 2.5, -0.5, None]
    assert values(df, sem.npround(col("x")))[2] == 2.0


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (30.0,), (30.01,), (200.0,), (200.5,), (None,)], "x double")
    assert values(df, sem.cut(col("x"), [-1, 30, 200], ["a", "b"])) == [None, "a", "a", "b", "b", None, None]


def test_or_default_keeps_missing(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,)], "x double")
    assert values(df, sem.or_default(col("x"), 30.0)) == [30.0, 2.0, None]


def test_optional_columns(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert values(df, sem.opt(df, "x", 7.0)) == [1.0, None]
    assert values(df, sem.opt(df, "x", 7.0, fill=True)) == [1.0, 7.0]
    assert values(df, sem.opt(df, "y", 7.0)) == [7.0, 7.0]


def test_safe_divide_zero_and_row_std(spark):
    df = frame(spark, [{"a": 10.0, "b": 0.0, "c": 4.0}])
    assert values(df, sem.safe_divide(col("a"), col("b"))) == [10.0]
    assert math.isclose(values(df, sem.row_std([col("a"), col("b"), col("c")]))[0], 5.0332229568471665)


def test_number_text(spark):
    df = spark.createDataFrame([(1234567.5,), (0.125,)], "x double")
    assert values(df, sem.number_text(col("x"), "₹,.0f")) == ["₹1,234,568", "₹0"]
    assert values(df, sem.number_text(col("x"), ".1f%")) == ["1234567.5%", "0.1%"]
    assert values(df, sem.number_text(col("x"), ".0%"))[1] == "12%"
    assert values(df, sem.number_text(col("x"), ".2fx"))[1] == "0.12x"
