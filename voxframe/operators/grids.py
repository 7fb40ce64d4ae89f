"""Operators on voxel tables (x, y, z, value and key columns): pooling, histograms, reshaping, filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def cells(spark: SparkSession, res: Sequence[int]) -> DataFrame:
    """All cells of a grid."""
    nx, ny, nz = res
    i = F.col("id")
    return spark.range(nx * ny * nz).select(*(c.cast("int").alias(a) for a, c in zip(AXES, (i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))))))


def densify(grid: DataFrame, res: Sequence[int], fill: float = 0.0) -> DataFrame:
    """One row for each cell; missing ones get ``fill``."""
    return cells(grid.sparkSession, res).join(grid.select(*AXES, "value"), list(AXES), "left").select(*AXES, F.coalesce("value", F.lit(fill)).alias("value"))


def volume_histogram(grid: DataFrame, bins: int = 512, variant: str = "exact") -> DataFrame:
    """bin, n, largest (the fullest bin's count) over the range of the values.

    ``variant="reference"`` takes the range's ends cut to integers, as an integer reduction gives them.
    """
    ends = grid.agg(F.min("value").alias("low"), F.max("value").alias("high"))
    if variant == "reference":
        ends = ends.select(F.col("low").cast("long").cast("double").alias("low"), F.col("high").cast("long").cast("double").alias("high"))
    b = ((bins - 1) * (F.col("value") - F.col("low")) / F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))).cast("int")
    counts = grid.crossJoin(F.broadcast(ends)).groupBy(F.least(F.greatest(b, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("largest", F.max("n").over(Window.partitionBy(F.lit(0))))  # a row for each bin at most


def value_range(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"))


def mip_size(n: int, level: int) -> int:
    """The size of a mip level: level 0 is the data, level k reduces by k + 1."""
    return max(1, n // (level + 1))


def _outputs(c: Column, size: int, new: int) -> Column:
    """The output cells whose windows [floor(a*size/new), ceil((a+1)*size/new)) hold a voxel."""
    return F.sequence(F.floor(c * new / size).cast("int"), (F.ceil((c + 1) * new / size) - 1).cast("int"))


def resample(grid: DataFrame, res: Sequence[int], new: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """Means over adaptive windows, which overlap where sizes don't divide. A voxel is sent to at most 2 cells an axis."""
    out = grid
    for a, n, m in zip(AXES, res, new):
        out = out.withColumn(a, F.explode(_outputs(F.col(a), n, m)))
    return out.groupBy(*by, *AXES).agg(F.avg("value").alias("value"))


def mipmap(grid: DataFrame, res: Sequence[int], level: int, by: Sequence[str] = ()) -> DataFrame:
    return resample(grid, res, [mip_size(n, level) for n in res], by)


def radical_inverse(i: Column, base: int, digits: int = 24) -> Column:
    """The digits of a whole number mirrored at the point."""
    digit = lambda k: F.floor(i / F.pow(F.lit(float(base)), k)) % base
    return F.aggregate(F.sequence(F.lit(0), F.lit(digits - 1)), F.lit(0.0), lambda s, k: s + digit(k) / F.pow(F.lit(float(base)), k + 1))


def mipmap_halton(grid: DataFrame, res: Sequence[int], level: int) -> DataFrame:
    """One voxel of each window, at the Halton point of the output cell's linear index."""
    new = [mip_size(n, level) for n in res]
    target = cells(grid.sparkSession, new)
    index = F.col("x") + new[0] * (F.col("y") + new[1] * F.col("z"))
    digits = 1 + max(1, (new[0] * new[1] * new[2]).bit_length())
    for a, n, m, base in zip(AXES, res, new, (3, 5, 7)):
        low, high = F.floor(F.col(a) * n / m), F.ceil((F.col(a) + 1) * n / m)
        target = target.withColumn(f"s{a}", (low + F.floor((high - low) * radical_inverse(index, base, digits))).cast("int"))
    source = grid.select(*(F.col(a).alias(f"s{a}") for a in AXES), "value")
    return target.join(source, [f"s{a}" for a in AXES]).select(*AXES, "value")


def memory_report(features: DataFrame, with_channels: bool = True) -> DataFrame:
    """Bytes of each volume, from size_x, size_y, size_z, dtype, channels of its features."""
    width = F.when(F.col("dtype") == "uchar", 1).when(F.col("dtype") == "ushort", 2).otherwise(4)
    size = width * F.col("size_x") * F.col("size_y") * F.col("size_z")
    return features.groupBy("volume_id").agg(F.sum(size * F.col("channels") if with_channels else size).alias("bytes"))


def max_abs(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return grid.groupBy(*by).agg(F.max(F.abs("value")).alias("max_abs"))


def smoothness(grid: DataFrame, dims: Sequence[str] = AXES) -> DataFrame:
    """Mean of squared forward differences along the axes, of a dense grid, read once."""
    from .stencils import differences

    return differences(grid, dims).where("n > 0").select("axis", (F.col("total") / F.col("n")).alias("mean"), "total")


def compare_grids(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cells that differ, or that only one has."""
    both = a.select(*AXES, F.col("value").alias("left")).join(b.select(*AXES, F.col("value").alias("right")), list(AXES), "full")
    return both.where(F.col("left").isNull() | F.col("right").isNull() | (F.abs(F.col("left") - F.col("right")) > tolerance))


def slice_grid(grid: DataFrame, res: Sequence[int], slices: Sequence[tuple[int, int, int]]) -> DataFrame:
    """start, end, step of each axis; a negative end counts from the back, -1 is the full axis."""
    out = grid
    for a, n, (start, end, step) in zip(AXES, res, slices):
        stop = n + end + 1 if end < 0 else end
        out = out.where((F.col(a) >= start) & (F.col(a) < stop) & ((F.col(a) - start) % step == 0)).withColumn(a, F.floor((F.col(a) - start) / step).cast("int"))
    return out


def to_bricks(grid: DataFrame, brick: int, halo: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Bricks of ``brick`` cells an axis with their neighbours' ``halo`` cells: bx, by, bz, values (x, y, z, value) in order."""
    out = grid
    for a in AXES:
        own = F.floor(F.col(a) / brick).cast("int")
        near = F.array_distinct(F.array(*(F.floor((F.col(a) + h) / brick).cast("int") for h in (-halo, 0, halo)))) if halo else F.array(own)
        out = out.withColumn(f"b{a}", F.explode(near))
    grouped = out.where("bx >= 0 and by >= 0 and bz >= 0").groupBy(*by, "bx", "by", "bz")
    return grouped.agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "value"))).alias("values"))


def brick_extent(axis: str, n: int, brick: int, low: int, high: int) -> tuple[Column, Column]:
    """First cell and number of cells of a brick along an axis, with its halo, cut at the grid's border."""
    b = F.col(f"b{axis}")
    first = F.greatest(F.lit(0), b * brick - low)
    return first, F.least(F.lit(n), (b + 1) * brick + high) - first


def array_bricks(grid: DataFrame, res: Sequence[int], brick: int = 16, low: int = 0, high: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Bricks of ``brick`` cells an axis with ``low`` cells before and ``high`` behind them: bx, by, bz and ``cells``, their values
    by z, then y, then x, so that a cell is found by its place. The grid must be dense: a brick that lacks a cell is an error.
    """
    out = grid.select(*by, *AXES, "value")
    for a, n in zip(AXES, res):
        first, last = F.floor((F.col(a) - high) / brick), F.floor((F.col(a) + low) / brick)
        out = out.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.lit((n - 1) // brick)).cast("int"))))
    whole = F.lit(1)
    for a, n in zip(AXES, res):
        whole = whole * brick_extent(a, n, brick, low, high)[1]
    made = out.groupBy(*by, "bx", "by", "bz").agg(F.array_sort(F.collect_list(F.struct("z", "y", "x", "value"))).alias("sorted"))
    cells = F.when(F.size("sorted") == whole, F.col("sorted.value")).otherwise(F.raise_error(F.lit("a brick lacks cells, or has some twice: the grid isn't dense")))
    return made.select(*by, "bx", "by", "bz", cells.alias("cells"))


def from_bricks(bricks: DataFrame, brick: int, by: Sequence[str] = ()) -> DataFrame:
    """The cells of all bricks without their halos."""
    cell = bricks.select(*by, "bx", "by", "bz", F.explode("values").alias("v")).select(*by, "bx", "by", "bz", "v.x", "v.y", "v.z", "v.value")
    own = F.lit(True)
    for a in AXES:
        own = own & (F.floor(F.col(a) / brick) == F.col(f"b{a}"))
    return cell.where(own).select(*by, *AXES, "value")


def pad_to_cube(grid: DataFrame, res: Sequence[int]) -> DataFrame:
    """Zeros around the data, up to the longest axis; of an odd rest, the smaller part comes first."""
    side = max(res)
    out = grid
    for a, n in zip(AXES, res):
        out = out.withColumn(a, (F.col(a) + (side - n) // 2).cast("int"))
    return densify(out, [side] * 3)


def stack_channels(a: DataFrame, b: DataFrame, channels_a: int) -> DataFrame:
    return a.unionByName(b.withColumn("channel", (F.col("channel") + channels_a).cast("int")))


def add_feature(voxels: DataFrame, name: str, other: DataFrame) -> DataFrame:
    return voxels.unionByName(other.withColumn("feature", F.lit(name)))


def select_feature(voxels: DataFrame, names: Sequence[str], which: str | int) -> DataFrame:
    """By name (no rows if there is none) or by place (an error if there is none)."""
    return voxels.where(F.col("feature") == (names[which] if isinstance(which, int) else which))


# --- images: x, y, value, and a mask (1 where there is data)


def _halves(n: int) -> int:
    return max(1, n // 2)


def fill_missing(image: DataFrame, width: int, height: int, by: Sequence[str] = ()) -> DataFrame:
    """Fills cells without data from a pyramid: means of the data below, then weights 9/16, 3/16, 3/16, 1/16 of the cells near.

    ``image``: all cells, with value and mask. The rounds are log2 of the size and known beforehand; a level is made from the
    one below it alone, by one aggregate that Spark computes once for all that read it.
    """
    levels, sizes = [image], [(width, height)]
    keys = image.select(*by).distinct() if by else None
    while sizes[-1] != (1, 1):
        (w, h), (w2, h2) = sizes[-1], tuple(map(_halves, sizes[-1]))
        down = levels[-1].where("mask >= 0.5").withColumn("x", F.explode(_outputs(F.col("x"), w, w2))).withColumn("y", F.explode(_outputs(F.col("y"), h, h2)))
        means = down.groupBy(*by, "x", "y").agg(F.avg("value").alias("value"), F.lit(1.0).alias("mask"))
        levels.append(_all_cells(image.sparkSession, keys, means, w2, h2, by))
        sizes.append((w2, h2))
    full = levels[-1]
    for level in reversed(levels[:-1]):
        full = _filled(level, full, by)
    return full


def _near() -> Column:
    """Structs (lx, ly, w) of the four cells of the smaller level that are nearest to x, y."""
    near = []
    for k in (0, 1):
        for m in (0, 1):
            near.append(F.struct((F.floor(F.col("x") / 2) + k * F.when(F.col("x") % 2 == 0, -1).otherwise(1)).cast("int").alias("lx"), (F.floor(F.col("y") / 2) + m * F.when(F.col("y") % 2 == 0, -1).otherwise(1)).cast("int").alias("ly"), F.lit([9, 3, 1][k + m] / 16).alias("w")))
    return F.inline(F.array(*near))


def _filled(level: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """A level whose cells without data are filled from the smaller one."""
    low = small.where("mask >= 0.5").select(*by, F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("value").alias("low"))
    empty = level.where("mask < 0.5")
    asked = empty.select(*by, "x", "y", _near())
    filled = asked.join(low, [*by, "lx", "ly"], "left").groupBy(*by, "x", "y").agg((F.sum(F.col("w") * F.col("low")) / F.sum(F.when(F.col("low").isNotNull(), F.col("w")))).alias("filled"))
    up = filled.select(*by, "x", "y", F.coalesce("filled", F.lit(0.0)).alias("value"), F.when(F.col("filled").isNotNull(), 1.0).otherwise(0.0).alias("mask"))
    return level.where("mask >= 0.5").select(*by, "x", "y", "value", F.lit(1.0).alias("mask")).union(up)


def _all_cells(spark: SparkSession, keys: DataFrame | None, some: DataFrame, w: int, h: int, by: Sequence[str]) -> DataFrame:
    if keys is None:
        every = spark.range(w * h).withColumnRenamed("id", "k")
    else:
        every = keys.select(*by, F.explode(F.sequence(F.lit(0), F.lit(w * h - 1))).alias("k"))
    every = every.select(*by, (F.col("k") % w).cast("int").alias("x"), F.floor(F.col("k") / w).cast("int").alias("y"))
    return every.join(some, [*by, "x", "y"], "left").select(*by, "x", "y", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("mask", F.lit(0.0)).alias("mask"))


def fill_fractional(image: DataFrame, width: int, height: int, by: Sequence[str] = ()) -> DataFrame:
    """The same with a mask from 0 to 1: means are weighted by it, a cell's own value counts as much as its mask."""
    if width <= 1 and height <= 1:
        return image
    w, h = _halves(width), _halves(height)
    down = image.withColumn("x", F.explode(_outputs(F.col("x"), width, w))).withColumn("y", F.explode(_outputs(F.col("y"), height, h)))
    small = down.groupBy(*by, "x", "y").agg(
        F.when(F.sum("mask") > 0, F.sum(F.col("mask") * F.col("value")) / F.sum("mask")).otherwise(0.0).alias("value"), F.max("mask").alias("mask")
    )
    small = fill_fractional(small, w, h, by).select(*by, F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("value").alias("low"), F.col("mask").alias("low_mask"))
    asked = image.select(*by, "x", "y", _near()).join(small, [*by, "lx", "ly"])
    share = F.col("w") * F.col("low_mask")
    filled = asked.groupBy(*by, "x", "y").agg(F.sum(share * F.col("low")).alias("s"), F.sum(share).alias("n"), (F.sum(share) / F.sum("w")).alias("m"))
    out = image.join(filled, [*by, "x", "y"], "left")
    own = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)
    return out.select(*by, "x", "y", (F.col("mask") * F.col("value") + (1 - F.col("mask")) * own).alias("value"), (F.col("mask") + (1 - F.col("mask")) * F.coalesce("m", F.lit(0.0))).alias("mask"))
