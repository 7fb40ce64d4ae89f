"""The driver's tables as grids, points, images and runs, in Spark and, for the oracle, in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import densify

RES = (50, 11, 9)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    """Six digits, by the same double arithmetic as R6; halves of a digit, at which sums in another order could part, are no border."""
    return F.floor(c * 1e6 + 0.4871) / 1e6


def R6(sql: str) -> str:
    return f"floor(({sql}) * 1e6 + 0.4871e0) / 1e6"


def result(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Integers as long; doubles in six digits, but for the exact ones (keys)."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        if kinds[c] in ("int", "smallint", "tinyint", "bigint"):
            out.append(F.col(c).cast("long").alias(c))
        elif kinds[c] in ("float", "double") and c not in exact:
            out.append(r6(F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _voxel(df: DataFrame, *more: Column) -> DataFrame:
    cell = [(F.col("l_quantity").cast("int") - 1).alias("x"), F.round(100 * F.col("l_discount")).cast("int").alias("y"), F.round(100 * F.col("l_tax")).cast("int").alias("z")]
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return df.groupBy(*more, *cell).agg((F.sum(cents).cast("double") / (F.count("*") * 1.05e7)).alias("value"))


_VOXEL = "CAST(l_quantity AS INT) - 1 AS x, CAST(round(100 * l_discount) AS INT) AS y, CAST(round(100 * l_tax) AS INT) AS z"
_PRICE = "CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 1.05e7) AS value"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x (quantity), y (discount), z (tax), value (mean price over 105000); cells without rows are missing."""
    return _voxel(table(spark, sf_dir, "lineitem"))


GRID = f"g AS (SELECT {_VOXEL}, {_PRICE} FROM lineitem GROUP BY 1, 2, 3)"


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return densify(grid(spark, sf_dir), RES)


CELLS = "c AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(d.range AS INT) AS z FROM range(50) a, range(11) b, range(9) d)"
DENSE = f"{GRID}, {CELLS}, dg AS (SELECT x, y, z, coalesce(value, 0) AS value FROM c LEFT JOIN g USING (x, y, z))"


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ensemble (return flag), time (months from 1995-01), x, y, z, value."""
    df = table(spark, sf_dir, "lineitem")
    ensemble = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("ensemble")
    time = ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate") - 1).alias("time")
    return _voxel(df, ensemble, time)


SERIES = (
    "s AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS ensemble, CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INT) AS time, "
    f"{_VOXEL}, {_PRICE} FROM lineitem GROUP BY 1, 2, 3, 4, 5)"
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct px, py, pz in the unit cube."""
    p = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(((F.col("l_quantity") - 0.5) / 50).alias("px"), (p / 1000 - F.floor(p / 1000)).alias("py"), (p / 97 - F.floor(p / 97)).alias("pz")).distinct()


POINTS = "p AS (SELECT DISTINCT (l_quantity - 0.5e0) / 50e0 AS px, l_extendedprice / 1000e0 - floor(l_extendedprice / 1000e0) AS py, l_extendedprice / 97e0 - floor(l_extendedprice / 97e0) AS pz FROM lineitem)"


def small_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """volume_id, label, x, y, z, value: each embedding as a 4 x 4 x 4 grid."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("volume_id"), "label", F.posexplode("embedding").alias("k", "v"))
    return cells.select("volume_id", "label", (F.col("k") % 4).alias("x"), (F.floor(F.col("k") / 4) % 4).cast("int").alias("y"), F.floor(F.col("k") / 16).cast("int").alias("z"), F.col("v").cast("double").alias("value"))


SMALL = "v AS (SELECT volume_id, label, CAST(k % 4 AS INT) AS x, CAST(k // 4 % 4 AS INT) AS y, CAST(k // 16 AS INT) AS z, CAST(e AS DOUBLE) AS value FROM (SELECT vec_id AS volume_id, label, unnest(embedding) AS e, unnest(range(0, len(embedding))) AS k FROM embeddings))"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image (event type), x (day), y (hour), value (mean value over 500), mask (1 where there are events)."""
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long")
    got = e.groupBy(F.col("event_type").alias("image"), (F.dayofmonth("ts") - 1).alias("x"), F.hour("ts").alias("y")).agg((F.sum(cents).cast("double") / (F.count("*") * 5e4)).alias("value"))
    every = got.select("image").distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(719))).alias("k")).select("image", (F.col("k") % 30).alias("x"), F.floor(F.col("k") / 30).cast("int").alias("y"))
    return every.join(got, ["image", "x", "y"], "left").select("image", "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"), F.when(F.col("value").isNull(), 0.0).otherwise(1.0).alias("mask"))


IMAGES = (
    "im0 AS (SELECT event_type AS image, CAST(day(ts) - 1 AS INT) AS x, CAST(hour(ts) AS INT) AS y, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 5e4) AS value FROM events GROUP BY 1, 2, 3), "
    "im AS (SELECT image, x, y, coalesce(value, 0) AS value, CASE WHEN value IS NULL THEN 0e0 ELSE 1e0 END AS mask FROM (SELECT image, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y FROM (SELECT DISTINCT image FROM im0), range(30) a, range(24) b) LEFT JOIN im0 USING (image, x, y))"
)


def pairs(spark: SparkSession, sf_dir: str, step: float = 0.03) -> DataFrame:
    """id, status, truth (price over 500000), predicted (the same, quantised), weight (1 to 7)."""
    from ..functions.values import quantize_uniform, unquantize_uniform

    t = F.col("o_totalprice") / 500000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), t.alias("truth"), unquantize_uniform(quantize_uniform(t, step), step).alias("predicted"), (F.col("o_custkey") % 7 + 1).cast("double").alias("weight"))


PAIRS = "pr AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice / 500000e0 AS truth, trunc(o_totalprice / 500000e0 / 0.03e0 + 0.5e0) * 0.03e0 AS predicted, CAST(o_custkey % 7 + 1 AS DOUBLE) AS weight FROM orders)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """config (priority), variant (status), epoch (month), camera (order key mod 4), seq, metric."""
    month = (F.year("o_orderdate") - 1992) * 12 + F.month("o_orderdate") - 1
    return table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("config"), F.col("o_orderstatus").alias("variant"), month.alias("epoch"), (F.col("o_orderkey") % 4).cast("int").alias("camera"), F.col("o_orderkey").alias("seq"), (F.col("o_totalprice") / 500000).alias("metric"))


RUNS = "ru AS (SELECT o_orderpriority AS config, o_orderstatus AS variant, CAST((year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS INT) AS epoch, CAST(o_orderkey % 4 AS INT) AS camera, o_orderkey AS seq, o_totalprice / 500000e0 AS metric FROM orders)"
