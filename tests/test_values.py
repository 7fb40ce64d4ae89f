import math

import pytest
from pyspark.sql import functions as F

from voxframe.functions import values as v


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()[0]


def test_types_round_trip(spark):
    for kind, most in (("uchar", 255), ("ushort", 65535)):
        codes = spark.range(0, most + 1, max(1, most // 300)).select("id", v.encode(v.decode(F.col("id"), kind) + 1e-9, kind).alias("c"))
        assert codes.where("id <> c").isEmpty()
    assert one(spark, v.encode(F.lit(-3.0), "uchar")) == 0 and one(spark, v.encode(F.lit(9.0), "uchar")) == 255


def test_quantisers(spark):
    q = spark.range(-50, 50).select((F.col("id") / 7.0).alias("v"))
    q = q.withColumn("u", v.quantize_uniform(F.col("v"), 0.5)).withColumn("d", v.quantize_deadzone(F.col("v"), 0.5))
    assert q.where(F.abs(v.unquantize_uniform(F.col("u"), 0.5) - F.col("v")) > 0.25 + 1e-12).isEmpty()
    assert q.where(F.abs(v.unquantize_deadzone(F.col("d"), 0.5) - F.col("v")) > 0.5 + 1e-12).isEmpty()
    assert q.where(v.unsymbolize(v.symbolize(F.col("d"))) != F.col("d")).isEmpty()


def test_analytic_bells_are_means_of_plain_ones(spark):
    bells = [(1.0, 0.5, 0.2, 3.0, 0.4, 0.2)]
    got = one(spark, v.tf_gaussian_analytic(F.lit(0.9), F.lit(0.1), bells))
    steps = [0.1 + 0.8 * (k + 0.5) / 2000 for k in range(2000)]
    mean = sum(math.exp(-(((d - 0.4) / 0.2) ** 2)) for d in steps) / 2000
    assert abs(abs(got["r"]) - mean) < 1e-5


def test_view_frames_are_orthonormal(spark):
    views = spark.createDataFrame([(0.3, 1.1, 2.0), (-0.7, 4.0, 1.0)], "pitch double, yaw double, distance double")
    for orientation in v.ORIENTATIONS:
        for r in v.view_frame(views, orientation).collect():
            right, up, eye = ([r[f"{p}{a}"] for a in "xyz"] for p in "rue")
            dot = lambda a, b: sum(x * y for x, y in zip(a, b))
            assert abs(dot(right, right) - 1) < 1e-9 and abs(dot(up, up) - 1) < 1e-9
            assert abs(dot(right, up)) < 1e-9 and abs(dot(right, eye)) < 1e-9 and abs(math.sqrt(dot(eye, eye)) - r["distance"]) < 1e-9


def test_unknown_type_is_an_error():
    with pytest.raises(KeyError):
        v.TYPE_RANGE["half"]
