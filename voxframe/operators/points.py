"""Point sequences, importance sampling and the building of training sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import clamp, masked
from ._tables import kept
from .grids import AXES, cells, densify, radical_inverse


def plastic_steps(d: int) -> list[float]:
    """The steps of the d-dimensional sequence: powers of the root of x^(d+1) = x + 1."""
    g = 1.0
    for _ in range(20):
        g -= (g ** (d + 1) - g - 1) / ((d + 1) * g**d - 1)
    return [(1 / g) ** (k + 1) % 1 for k in range(d)]


def hashed(*parts: Column) -> Column:
    """A number in [0, 1) that follows from its arguments: the same on every machine, in every run and in every SQL with md5."""
    return F.conv(F.substr(F.md5(F.concat_ws(",", *(p.cast("string") for p in parts))), F.lit(1), F.lit(10)), 16, 10).cast("double") / float(1 << 40)


def random_points(spark: SparkSession, n: int, d: int, seed: int) -> DataFrame:
    return spark.range(n).select("id", *(hashed(F.lit(seed), F.col("id"), F.lit(k)).alias(f"p{k}") for k in range(d)))


def plastic(i: Column, d: int) -> list[Column]:
    return [F.pmod(0.5 + (i + 1) * a, F.lit(1.0)) for a in plastic_steps(d)]


def plastic_points(spark: SparkSession, n: int, d: int, start: int = 0) -> DataFrame:
    return spark.range(start, start + n).select("id", *(p.alias(f"p{k}") for k, p in enumerate(plastic(F.col("id"), d))))


#: The bases of the axes.
PRIMES = (2, 3, 5, 7, 11, 13)


def halton_points(spark: SparkSession, n: int, d: int, start: int = 0) -> DataFrame:
    digits = (start + n).bit_length() + 1
    return spark.range(start, start + n).select("id", *(radical_inverse(F.col("id"), b, digits).alias(f"p{k}") for k, b in enumerate(PRIMES[:d])))


def fibonacci_views(spark: SparkSession, n: int, distance: float = 1.0) -> DataFrame:
    """view, pitch, yaw, distance of n views spread evenly over the sphere."""
    angle = (2 - (math.sqrt(5) + 1) / 2) * (2 * math.pi)
    i = F.col("id") + 1
    return spark.range(n).select(F.col("id").cast("int").alias("view"), F.asin(-1 + 2 * i / float(n + 1)).alias("pitch"), F.pmod(i * angle, F.lit(2 * math.pi)).alias("yaw"), F.lit(distance).alias("distance"))


def rotation_views(spark: SparkSession, n: int, pitch: float, yaw: float, distance: float) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("view"), F.lit(pitch).alias("pitch"), (yaw + F.col("id") * (2 * math.pi / n)).alias("yaw"), F.lit(distance).alias("distance"))


def stratified_points(spark: SparkSession, res: Sequence[int], k: int, sampler: str = "plastic", seed: int = 0) -> DataFrame:
    """k jittered points in every voxel: x, y, z, k, px, py, pz in the unit cube."""
    each = cells(spark, res).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    index = (F.col("x") + res[0] * (F.col("y") + res[1] * F.col("z"))) * k + F.col("k")
    jitter = plastic(index, 3) if sampler == "plastic" else [hashed(F.lit(seed), index, F.lit(a)) for a in range(3)]
    return each.withColumns({f"p{a}": (F.col(a) + j) / float(n) for a, n, j in zip(AXES, res, jitter)})


def nth(df: DataFrame, column: str, n: int, blocks: int = 4096) -> tuple[int, int]:
    """The n-th smallest whole number of a column (n from 1), and how many rows are below it.

    The range that holds it is cut into so many blocks, which are counted, until a block is one number: two or three aggregates
    of a few thousand rows, no sort and no task that holds more.
    """
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high, before = ends.low, ends.high, 0
    while low < high:
        width = (high - low) // blocks + 1
        at = F.floor((F.col(column) - low) / width)
        counts = df.where(F.col(column).between(low, high)).groupBy(at.alias("block")).agg(F.count("*").alias("n")).orderBy("block").collect()
        for row in counts:
            if before + row.n >= n:
                break
            before += row.n
        low, high = low + row.block * width, min(high, low + (row.block + 1) * width - 1)
    return low, before


def first_accepted(accepted: DataFrame, n: int, blocks: int = 4096) -> DataFrame:
    """The n rows of the least id (ids are distinct), without a sort of all. ``accepted`` is read several times: pass a written table."""
    if n <= 0:
        return accepted.where("false")
    if accepted.count() <= n:
        return accepted
    return accepted.where(F.col("id") <= nth(accepted, "id", n, blocks)[0])


def importance_points(candidates: DataFrame, value_at: Callable[[DataFrame], DataFrame], n: int, least: float, most: float) -> DataFrame:
    """Rejection sampling: candidates (id, px, py, pz, u) with max(value / most, least) > u, the first n.

    ``value_at`` adds ``value`` to points, e.g. a sample of a grid; candidates with their values are written once, and read to count
    and to cut. Fewer rows come back if the candidates don't suffice.
    """
    return first_accepted(kept(value_at(candidates)).where(F.greatest(F.col("value") / most, F.lit(least)) > F.col("u")), n)


def loss_grid(samples: DataFrame, res: Sequence[int]) -> DataFrame:
    """Sum of the errors of the samples in each voxel, and the largest sum: x, y, z, loss, largest."""
    at = [clamp(F.floor(F.col(f"p{a}") * n), 0, n - 1).cast("int").alias(a) for a, n in zip(AXES, res)]
    sums = samples.groupBy(*at).agg(F.sum("error").alias("loss"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("loss").alias("largest"))))


def sub_batch(batch: int, parts: int = 8) -> int:
    return max(1, batch // parts)


def next_multiple(n: int, of: int) -> int:
    return -(-n // of) * of


def chunk(df: DataFrame, batch: int, parts: int = 8, id_column: str = "id") -> DataFrame:
    return df.withColumn("chunk_id", F.floor(F.col(id_column) / sub_batch(batch, parts)))


def split_train_val(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """Adds validation: the first int(chunks * share) chunks in hashed order; rows of a chunk stay together.

    The last of those chunks is found by counts, so whether a row belongs to them follows from its own chunk, without a join.
    """
    turn = (hashed(F.lit(seed), F.col("chunk_id")) * float(1 << 40)).cast("long")
    chunks = kept(df.select("chunk_id").distinct().withColumn("turn", turn))
    most = int(chunks.count() * share)
    if not most:
        return df.withColumn("validation", F.lit(False))
    last, before = nth(chunks, "turn", most)
    tied = nth(chunks.where(F.col("turn") == last), "chunk_id", most - before)[0]
    return df.withColumn("validation", F.coalesce((turn < last) | ((turn == last) & (F.col("chunk_id") <= tied)), F.lit(False)))


def dataset_size(members: DataFrame, samples: int, batch: int, row_bytes: int) -> DataFrame:
    """members, rows, batches, bytes of a planned data set with so many samples for each member (rounded up to batches)."""
    each = next_multiple(samples, batch)
    return members.agg(F.count("*").alias("members")).select("members", (F.col("members") * each).alias("rows"), (F.col("members") * (each // batch)).alias("batches"), (F.col("members") * each * row_bytes).alias("bytes"))


def config_grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """All combinations of experiment settings, with a name made of them."""
    out = spark.range(1).select()
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))
    return out.withColumn("name", F.concat_ws("-", *(F.concat(F.lit(n), F.col(n).cast("string")) for n in axes)))


def world_samples(members: DataFrame, per_member: int, batch: int, value_at: Callable[[DataFrame], DataFrame], number: Column, dim: int = 3) -> DataFrame:
    """Points for every member (a row of ``members``), with what ``value_at`` adds to them.

    ``per_member`` is rounded up to whole batches. The sampler starts at ``number`` (the member's own) times that, so no two
    members have the same points: i, px, py, pz.
    """
    n = next_multiple(per_member, batch)
    rows = members.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", number * n + F.col("i"))
    return value_at(rows.withColumns({f"p{a}": p for a, p in zip(AXES, plastic(F.col("i"), dim))}))


def screen_samples(pixels: DataFrame, number: Column, least: float) -> DataFrame:
    """Pixels with colour and alpha, of which empty ones are thinned: kept with the probability alpha, ``least`` at least."""
    return pixels.where(masked(F.col("alpha"), plastic(number, 1)[0], least))


def resample_by_loss(errors: DataFrame, res: Sequence[int], candidates: DataFrame, value_at: Callable[[DataFrame, DataFrame], DataFrame], n: int, least: float, batch: int, share: float) -> DataFrame:
    """A new data set where a predictor errs: ``errors`` (px, py, pz, error) become a density of points, of which ``n`` are
    accepted, cut into chunks and split.

    ``value_at`` takes candidates and a dense grid and adds value, as ``sampling.sample`` does.
    """
    losses = kept(loss_grid(errors, res))  # read for the largest loss and for the candidates
    most = losses.agg(F.max("loss")).first()[0] or 1.0
    field = densify(losses.select(*AXES, F.col("loss").alias("value")), res)
    picked = importance_points(candidates, lambda c: value_at(c, field), n, least, most)
    return split_train_val(chunk(picked, batch), share)
