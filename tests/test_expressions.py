import math

import pytest
from pyspark.sql import functions as F

from pointloom.functions import expr, mongo, ranges
from pointloom.schema import checked, resolve_type


def one(spark, text, **columns):
    df = spark.range(1).select(*[F.lit(float(v)).alias(k) for k, v in columns.items()])
    return df.select(expr.value(df, text)).first()[0]


@pytest.mark.parametrize(
    "text,want",
    [("1 + 2 * 3", 7), ("(1 + 2) * 3", 9), ("-X + 1", -3), ("X / 8", 0.5), ("floor(2.7)", 2), ("ceil(2.1)", 3), ("round(-2.5)", -3), ("abs(-3)", 3), ("exp2(X)", 16), ("log2(8)", 3), ("log10(100)", 2), ("sqrt(X)", 2), ("2e1 - .5", 19.5)],
)
def test_values(spark, text, want):
    assert one(spark, text, X=4) == pytest.approx(want)


def test_odd_values(spark):
    assert math.isnan(one(spark, "X / Y", X=1, Y=0))
    assert one(spark, "log(X)", X=0) == -math.inf
    assert math.isnan(one(spark, "log(X)", X=-1))
    assert math.isnan(one(spark, "nan()", X=1))


@pytest.mark.parametrize("text", ["1 / 0", "1 < 2 < 3", "X --1", "unknown(1)", "X +", "(X", "X && 1", "!X", "NoSuch + 1"])
def test_errors(spark, text):
    df = spark.range(1).select(F.lit(1.0).alias("X"))
    with pytest.raises(expr.ExpressionError):
        try:
            expr.value(df, text)
        except expr.ExpressionError:
            raise
        expr.condition(df, text)


def test_nan_comparisons(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "X double")
    count = lambda t: df.where(expr.condition(df, t)).count()
    assert [count(t) for t in ("X == X", "X != X", "X < 5", "X > 0", "!(X < 5)", "isnan(X)")] == [1, 1, 1, 1, 1, 1]


def test_precedence(spark):
    df = spark.range(8).select((F.col("id") % 2).cast("double").alias("A"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("B"), F.floor(F.col("id") / 4).cast("double").alias("C"))
    assert df.where(expr.condition(df, "A == 1 || B == 1 && C == 1")).count() == 5


def test_rounding_on_write(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (2.4,)], "X double")
    assert [r[0] for r in df.select(checked(F.col("X"), "int16")).collect()] == [3, -3, 2]
    with pytest.raises(Exception, match="does not fit"):
        df.select(checked(F.col("X") * 1e6, "uint8", "Red")).collect()


def test_widening():
    assert resolve_type("uint8", "uint16") == "uint16"
    assert resolve_type("uint16", "int8") == "int32"
    assert resolve_type("uint64", "int8") == "double"
    assert resolve_type("float", "uint8") == "float"
    assert resolve_type("float", "int32") == "double"


def test_ranges(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(float("nan"),)], "Z double")
    count = lambda t: df.where(ranges.condition(t)).count()
    assert count("Z[2:5]") == 4
    assert count("Z(2:5)") == 2
    assert count("Z[:3)") == 3
    assert count("Z[1:2],Z[8:]") == 4
    assert count("Z![2:5]") == 7  # NaN is in no range


def test_mongo(spark):
    df = spark.createDataFrame([(float(i), 3.0) for i in range(6)], "X double, Y double")
    count = lambda t: df.where(mongo.condition(df, t)).count()
    assert count({"X": {"$gt": 1, "$lt": "Y"}}) == 1
    assert count({"X": {"$in": [0, 5, 9]}}) == 2
    assert count({"X": {"$nin": [0, 5, 9]}}) == 4
    assert count({"$or": [{"X": 0}, {"X": {"$not": {"$lte": 4}}}]}) == 2
    assert count('{"$nor": [{"X": {"$gte": 2}}]}') == 2
