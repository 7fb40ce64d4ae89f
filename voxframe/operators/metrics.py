"""Error, image and experiment statistics over joined tables (truth, predicted)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import kept
from .grids import resample
from .stencils import Stack, on_bricks, weighted_ahead, whole_windows


def l1_l2(pairs: DataFrame, by: Sequence[str] = (), weight_l1: float = 1.0, weight_l2: float = 1.0) -> DataFrame:
    e = F.col("predicted") - F.col("truth")
    out = pairs.groupBy(*by).agg(F.avg(F.abs(e)).alias("l1"), F.avg(e * e).alias("l2"))
    return out.withColumn("total", F.col("l1") * weight_l1 + F.col("l2") * weight_l2)


def rgbo_losses(pairs: DataFrame, by: Sequence[str] = (), absorption_weight: float = 1.0) -> DataFrame:
    """l1 and l2 of channels 0-2 and of channel 3 apart, and their weighted sums."""
    e = F.col("predicted") - F.col("truth")
    colour = F.col("channel") < 3
    parts = {f"{n}_{p}": F.avg(F.when(own, v)) for n, v in (("l1", F.abs(e)), ("l2", e * e)) for p, own in (("rgb", colour), ("o", ~colour))}
    out = pairs.groupBy(*by).agg(*(c.alias(n) for n, c in parts.items()))
    return out.withColumns({n: F.col(f"{n}_rgb") + absorption_weight * F.col(f"{n}_o") for n in ("l1", "l2")})


def screen_losses(pairs: DataFrame, key: Sequence[str], by: Sequence[str] = (), multiply_alpha: bool = True) -> DataFrame:
    """l1 and l2 of colours, both premultiplied by the truth's alpha (channel 3)."""
    alpha = pairs.where("channel = 3").select(*key, F.col("truth").alias("alpha"))
    colours = pairs.where("channel < 3").join(alpha, list(key))
    scale = F.col("alpha") if multiply_alpha else F.lit(1.0)
    return l1_l2(colours.withColumn("truth", F.col("truth") * scale).withColumn("predicted", F.col("predicted") * scale), by).drop("total")


def array_stats(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Range, moments and errors of two arrays, with SNR, PSNR (dB) and normalised cross-correlation."""
    x, y = F.col("truth"), F.col("predicted")
    e = y - x
    s = pairs.groupBy(*by).agg(
        F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("range"), F.avg(x).alias("mean"), (F.avg(x * x) - F.avg(x) * F.avg(x)).alias("variance"),
        F.avg(e).alias("mean_error"), F.avg(F.abs(e)).alias("mean_abs_error"), F.max(F.abs(e)).alias("max_abs_error"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(y).alias("mean_y"), (F.avg(y * y) - F.avg(y) * F.avg(y)).alias("variance_y"), F.sum(x * y).alias("xy"),
    )
    decibel = lambda v: 20 * F.log10(v / F.col("rmse"))
    covariance = (F.col("xy") - F.col("n") * F.col("mean") * F.col("mean_y")) / (F.col("n") - 1)
    out = s.withColumns({"snr": decibel(F.sqrt("variance")), "psnr": decibel(F.col("range")), "ncc": covariance / F.sqrt(F.col("variance") * F.col("variance_y"))})
    return out.drop("mean_y", "variance_y", "xy")


def psnr(pairs: DataFrame, by: Sequence[str] = (), peak: float = 1.0) -> DataFrame:
    e = F.col("predicted") - F.col("truth")
    return pairs.groupBy(*by).agg((10 * F.log10(peak * peak / F.avg(e * e))).alias("psnr"))


def _norm(names: Sequence[str]) -> Column:
    return F.sqrt(sum((F.col(n) * F.col(n) for n in names), F.lit(0.0)))


def gradient_errors(pairs: DataFrame) -> DataFrame:
    """Of true (tx, ty, tz) and predicted (qx, qy, qz) gradients: l1, l2, length_error, cosine, true_length."""
    t, q = ("tx", "ty", "tz"), ("qx", "qy", "qz")
    d = [F.col(a) - F.col(b) for a, b in zip(t, q)]
    lt, lq = _norm(t), _norm(q)
    dot = sum((F.col(a) * F.col(b) for a, b in zip(t, q)), F.lit(0.0))
    return pairs.withColumns(
        {"l1": (F.abs(d[0]) + F.abs(d[1]) + F.abs(d[2])) / 3, "l2": (d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / 3, "length_error": F.abs(lt - lq),
         "cosine": dot / (F.greatest(lt, F.lit(1e-5)) * F.greatest(lq, F.lit(1e-5))), "true_length": lt}
    )


def cosine_by_threshold(errors: DataFrame, thresholds: Sequence[float] = (0.0, 0.01, 0.1, 1.0)) -> DataFrame:
    """Statistics of the cosine where the true gradient is at least so long; a row counts for each threshold below it."""
    passed = F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("true_length") >= t)).alias("threshold")
    return errors.select(passed, "cosine").groupBy("threshold").agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.min("cosine").alias("low"), F.max("cosine").alias("high"))


#: Bins into which the range of a quantile is cut a round, and values that are few enough to be sorted as one list.
BINS, FEW = 4096, 4096


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: Sequence[str] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """by and the exact quantiles (between two neighbours, linear) of a group's values, named by ``shares``; nulls are left out.

    Selection by counts: the range that holds a wanted place is cut into bins, counted, and narrowed to the bin that the place falls into,
    until it holds one value or few. A round is an aggregate of a few thousand rows a group, so neither a group's values nor
    its distinct values ever meet in one task.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"))
    ends = v.groupBy(*by).agg(F.count("*").alias("count"), F.min("__v").alias("low"), F.max("__v").alias("high")).where("count > 0")
    asked = F.array(*(F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("count") - 1)).alias("place")) for name, q in shares.items()))
    wanted = kept(ends.select(*by, "count", F.inline(asked)))
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(F.floor(F.lit(float(q)) * (F.col("count") - 1)), F.ceil(F.lit(float(q)) * (F.col("count") - 1))) for q in shares.values()))))
    state = kept(ends.select(*by, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), "count", "low", "high"))
    span = [*by, "low", "high"]

    def inside(ranges: DataFrame) -> DataFrame:
        """Values with the ranges that hold them; of a group there are at most two ranges for each share."""
        met = v.join(ranges, list(by)) if by else v.crossJoin(F.broadcast(ranges))
        return met.where((F.col("__v") >= F.col("low")) & (F.col("__v") <= F.col("high")))

    open_ = (F.col("low") < F.col("high")) & (F.col("count") > few)
    while not (todo := state.where(open_)).isEmpty():
        share = (F.col("__v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        at = F.least(F.floor(share * bins), F.lit(bins - 1)).alias("bin")
        counts = inside(todo.select(*span).distinct()).groupBy(*span, at).agg(F.count("*").alias("n"), F.min("__v").alias("new_low"), F.max("__v").alias("new_high"))
        line = Window.partitionBy(*span).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(line), F.lit(0)))
        met = todo.join(counts, span)
        begin = F.col("below") + F.col("before")
        found = met.where((F.col("rank") >= begin) & (F.col("rank") < begin + F.col("n"))).select(*by, "rank", begin.alias("below"), F.col("n").alias("count"), F.col("new_low").alias("low"), F.col("new_high").alias("high"))
        state = kept(found.unionByName(state.where(~open_)))
    lists = inside(state.where("low < high").select(*span).distinct()).groupBy(*span).agg(F.array_sort(F.collect_list("__v")).alias("values"))
    several = state.where("low < high").join(lists, span).select(*by, "rank", F.get("values", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    values = kept(several.unionByName(state.where("low = high").select(*by, "rank", F.col("low").alias("v"))))
    low = wanted.withColumn("rank", F.floor("place")).join(values, [*by, "rank"]).withColumnRenamed("v", "a").drop("rank")
    both = low.withColumn("rank", F.ceil("place")).join(values, [*by, "rank"]).withColumn("f", F.col("place") - F.floor("place"))
    mixed = both.withColumn("q", F.when(F.col("f") == 0, F.col("a")).otherwise((1 - F.col("f")) * F.col("a") + F.col("f") * F.col("v")))
    return mixed.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in shares))


def summary(df: DataFrame, value: str, weight: str | None = None) -> DataFrame:
    """min, max, mean, std (weighted where a weight is given), quartiles and whiskers of a box plot, in one row."""
    v, w = F.col(value), F.col(weight) if weight else F.lit(1.0)
    s = df.agg(F.min(v).alias("low"), F.max(v).alias("high"), (F.sum(v * w) / F.sum(w)).alias("mean"), (F.sum(v * v * w) / F.sum(w)).alias("square"))
    s = s.crossJoin(F.broadcast(quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})))
    s = s.withColumn("std", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0)))).drop("square")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    ends = df.select(v.alias("v")).crossJoin(F.broadcast(s)).agg(F.min(F.when(F.col("v") >= F.col("q1") - reach, F.col("v"))).alias("whisker_low"), F.max(F.when(F.col("v") <= F.col("q3") + reach, F.col("v"))).alias("whisker_high"))
    return s.crossJoin(F.broadcast(ends))


def summary_histogram(df: DataFrame, value: str, bins: int = 50, weight: str | None = None) -> DataFrame:
    """bin, edge (its lower one), n: (weighted) counts over the range of the values; the last bin is closed."""
    ends = df.agg(F.min(value).alias("low"), F.max(value).alias("high"))
    b = F.least(F.floor((F.col(value) - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))
    n = F.sum(F.col(weight)).cast("long") if weight else F.count("*")
    got = df.crossJoin(F.broadcast(ends)).groupBy(b.cast("int").alias("bin"), (F.col("low") + b * (F.col("high") - F.col("low")) / bins).alias("edge")).agg(n.alias("n"))
    return got


def masked_minmax(df: DataFrame, value: str, weight: str, eps: float) -> DataFrame:
    own = F.when(F.col(weight) > eps, F.col(value))
    return df.agg(F.min(own).alias("low"), F.max(own).alias("high"))


def histogram_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """Manhattan distance of two normalised histograms (bin, n)."""
    both = a.crossJoin(F.broadcast(a.agg(F.sum("n").alias("s")))).select("bin", (F.col("n") / F.col("s")).alias("p")).join(
        b.crossJoin(F.broadcast(b.agg(F.sum("n").alias("s")))).select("bin", (F.col("n") / F.col("s")).alias("q")), "bin", "full")
    return both.agg(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))).alias("distance"))


def temporal_loss(a: DataFrame, b: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """l1 and l2 of consecutive frames (value, mask); values where a mask is below one half count as 0, but count."""
    both = a.select(*key, F.col("value").alias("v"), F.col("mask").alias("m")).join(b.select(*key, F.col("value").alias("w"), F.col("mask").alias("k")), list(key))
    e = F.when((F.col("m") >= 0.5) & (F.col("k") >= 0.5), F.col("v") - F.col("w")).otherwise(0.0)
    return both.groupBy(*by).agg(F.avg(F.abs(e)).alias("l1"), F.avg(e * e).alias("l2"))


def gaussian_window(size: int, sigma: float = 1.5) -> list[float]:
    w = [math.exp(-((k - size // 2) ** 2) / (2 * sigma**2)) for k in range(size)]
    return [x / sum(w) for x in w]


def gaussian_blur(image: DataFrame, axis: str, other: str, size: int, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Weighted sums over ``size`` neighbours along an axis of a dense image, where all of them exist."""
    return blur(image, [axis], size, values, by).select(*by, axis, other, *values)


def blur(image: DataFrame, axes: Sequence[str], size: int, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The same along several axes at once (by, x, y, values), in one exchange."""
    w = gaussian_window(size)

    def work(stack: Stack) -> dict[str, np.ndarray]:
        out = {}
        for v, array in zip(values, stack.arrays):
            for a in axes:
                array = weighted_ahead(array, a, w)
            out[v] = array
        return out | {"keep": whole_windows(stack, axes)}

    flat = image.select(*by, "x", "y", F.lit(0).alias("z"), *(F.col(v).cast("double").alias(v) for v in values))
    return on_bricks(flat, work, dict.fromkeys(values, "double"), (0, size - 1), axes, by, values).drop("z")


def _ssim_maps(pairs: DataFrame, width: int, height: int, by: Sequence[str]) -> DataFrame:
    size = min(11, width, height)
    x, y = F.col("truth"), F.col("predicted")
    terms = pairs.select(*by, "x", "y", x.alias("mx"), y.alias("my"), (x * x).alias("xx"), (y * y).alias("yy"), (x * y).alias("xy"))
    return blur(terms, ["x", "y"], size, ["mx", "my", "xx", "yy", "xy"], by)


def ssim(pairs: DataFrame, width: int, height: int, by: Sequence[str] = (), value_range: float = 1.0) -> DataFrame:
    """Mean structural similarity of images (x, y, truth, predicted), its contrast part, and dssim = (1 - ssim) / 2."""
    c1, c2 = (0.01 * value_range) ** 2, (0.03 * value_range) ** 2
    m = _ssim_maps(pairs, width, height, by)
    mx, my = F.col("mx"), F.col("my")
    sx, sy, sxy = F.col("xx") - mx * mx, F.col("yy") - my * my, F.col("xy") - mx * my
    contrast = (2 * sxy + c2) / (sx + sy + c2)
    whole = contrast * (2 * mx * my + c1) / (mx * mx + my * my + c1)
    out = m.groupBy(*by).agg(F.avg(whole).alias("ssim"), F.avg(contrast).alias("contrast"))
    return out.withColumn("dssim", (1 - F.col("ssim")) / 2)


#: Weights of the five scales.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(pairs: DataFrame, width: int, height: int, by: Sequence[str] = (), variant: str = "standard") -> DataFrame:
    """Product of contrast over five scales (2 x 2 means between) and of the last scale's ssim, to the scales' weights.

    ``variant="reference"`` multiplies by the last scale's contrast, once for each scale before it.
    """
    levels, image, w, h = [], pairs, width, height
    for k, power in enumerate(SCALES):
        s = ssim(image, w, h, by).select(*by, F.col("ssim").alias(f"s{k}"), F.col("contrast").alias(f"c{k}"))
        levels.append(s)
        if k + 1 < len(SCALES):
            flat = image.select(*by, F.col("x"), F.col("y"), F.lit(0).alias("z"), F.explode(F.array(F.struct(F.lit("truth").alias("n"), F.col("truth").alias("value")), F.struct(F.lit("predicted").alias("n"), F.col("predicted").alias("value")))).alias("e"))
            half = resample(flat.select(*by, "x", "y", "z", "e.n", "e.value"), (w, h, 1), (w // 2, h // 2, 1), [*by, "n"])
            w, h = w // 2, h // 2
            image = half.groupBy(*by, "x", "y").agg(F.max(F.when(F.col("n") == "truth", F.col("value"))).alias("truth"), F.max(F.when(F.col("n") == "predicted", F.col("value"))).alias("predicted"))
    out = levels[0]
    for level in levels[1:]:
        out = out.join(level, list(by)) if by else out.crossJoin(F.broadcast(level))
    last = len(SCALES) - 1
    product = F.lit(1.0)
    for k, power in enumerate(SCALES[:-1]):
        product = product * F.pow(F.greatest(F.col(f"c{k}"), F.lit(0.0)), power)
        if variant == "reference":
            product = product * F.pow(F.greatest(F.col(f"c{last}"), F.lit(0.0)), SCALES[last])
    if variant != "reference":
        product = product * F.pow(F.greatest(F.col(f"s{last}"), F.lit(0.0)), SCALES[last])
    return out.select(*by, product.alias("ms_ssim"))


# --- experiments


def mean_std_over_cameras(df: DataFrame, by: Sequence[str], values: Sequence[str], timings: Sequence[str] = ()) -> DataFrame:
    """Mean and population std; timings leave out camera 0, which warms up."""
    own = {v: F.when(F.col("camera") > 0, F.col(v)) if v in timings else F.col(v) for v in [*values, *timings]}
    return df.groupBy(*by).agg(*(f(c).alias(f"{v}_{n}") for v, c in own.items() for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def per_timestep_mean(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, "time").agg(F.avg("value").alias("value"))


def epoch_means(df: DataFrame) -> DataFrame:
    """run, epoch, mean of the batches' losses up to the epoch before the first NaN, and the run's last mean."""
    means = df.groupBy("run", "epoch").agg(F.avg("loss").alias("mean"))
    first_nan = means.groupBy("run").agg(F.min(F.when(F.isnan("mean"), F.col("epoch"))).alias("stop"))
    kept = means.join(first_nan, "run").where(F.col("stop").isNull() | (F.col("epoch") < F.col("stop"))).drop("stop")
    last = kept.groupBy("run").agg(F.max_by("mean", "epoch").alias("last"))
    return kept.join(last, "run")


def layer_budget(configs: DataFrame, size: int, channels: int) -> DataFrame:
    """Of each width the deepest network, its weights, and the size of a grid that takes the same memory at that width."""
    weights = configs.withColumn("weights", F.col("channels") * (F.col("channels") + 1) * F.col("layers"))
    deepest = weights.groupBy("channels").agg(F.max(F.struct("layers", "weights")).alias("m")).select("channels", "m.layers", "m.weights")
    return deepest.withColumn("grid_size", F.round(F.cbrt(F.lit(float(size**3 * channels)) / F.col("channels"))).cast("int"))


def rate_curve(cases: DataFrame, by: Sequence[str]) -> DataFrame:
    """Compression rate of each case and its place among its group's by rate."""
    rated = cases.withColumn("rate", F.col("original_bytes") / F.col("compressed_bytes"))
    return rated.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rate", "seq")))


def best_per_group(df: DataFrame, by: Sequence[str], highest: Sequence[str] = (), lowest: Sequence[str] = ()) -> DataFrame:
    """Adds best_<value>; ties are all best."""
    group = Window.partitionBy(*by)
    new = {f"best_{v}": F.col(v) == F.max(v).over(group) for v in highest} | {f"best_{v}": F.col(v) == F.min(v).over(group) for v in lowest}
    return df.withColumns(new)


def closest_rate(rated: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """Of each group the case whose rate is nearest to the target on a log scale; of equal ones the first."""
    away = F.abs(F.log10(F.lit(target)) - F.log10("rate"))
    return rated.groupBy(*by).agg(F.min_by(F.struct("seq", "rate"), F.struct(away, F.col("seq"))).alias("c")).select(*by, "c.seq", "c.rate")


def speedup(df: DataFrame, by: Sequence[str], variant: str, base: str, value: str) -> DataFrame:
    """Each variant's value and its ratio to the base variant of the same configuration."""
    own = df.where(F.col(variant) == base).select(*by, F.col(value).alias("base"))
    return df.join(own, list(by)).withColumn("ratio", F.col("base") / F.col(value)).drop("base")


def mask_outliers(df: DataFrame, by: Sequence[str], value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Nulls for values below ``low`` or above ``high`` times their series' median."""
    median = quantiles(df, value, {"median": 0.5}, by)
    keep = F.lit(True)
    if low is not None:
        keep = keep & (F.col(value) >= low * F.col("median"))
    if high is not None:
        keep = keep & (F.col(value) <= high * F.col("median"))
    return df.join(median, list(by)).withColumn(value, F.when(keep, F.col(value))).drop("median")


def metric_heatmap(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """A row for each ``row``, a column of means for each of the values of ``column``."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg("value"))
