"""Expressions on single values: voxel types, transfer functions, quantisers, views. All are built-in Spark expressions, so a
pipeline of them stays in one generated stage; ``tf_gaussian_analytic`` alone needs Python (Spark has no error function)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest stored value of each voxel type; floats are stored as they are.
TYPE_RANGE = {"uchar": 255, "ushort": 65535, "float": 1}


def clamp(c: Column, low: Column | float, high: Column | float) -> Column:
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    return F.least(F.greatest(c, low), high)


def lerp(a: Column, b: Column, f: Column) -> Column:
    return a + f * (b - a)


def truncate(c: Column) -> Column:
    """Towards zero, as a cast to an integer does."""
    return c.cast("long")


# --- voxel types and coordinates


def decode(stored: Column, dtype: str) -> Column:
    return stored.cast("double") / TYPE_RANGE[dtype]


def encode(value: Column, dtype: str) -> Column:
    most = TYPE_RANGE[dtype]
    return value if dtype == "float" else truncate(clamp(value * most, 0.0, float(most)))


def clip_scale(value: Column, low: float, high: float) -> Column:
    return clamp(value, low, high) / high


def to_object_space(points: DataFrame, box_min: Sequence[float], box_size: Sequence[float], res: Sequence[int], mode: str = "old") -> DataFrame:
    """Adds ox, oy, oz (voxel coordinates) and inside. "old": the last voxel lies on the box's far side; "new": one beyond."""
    out = points
    inside = F.lit(True)
    for axis, low, size, n in zip("xyz", box_min, box_size, res):
        o = (F.col(f"p{axis}") - low) / size * float(n - 1 if mode == "old" else n)
        out = out.withColumn(f"o{axis}", o)
        inside = inside & F.col(f"o{axis}").between(0.0, float(n - 1))
    return out.withColumn("inside", inside)


# --- transfer functions: each gives a struct r, g, b, a of a density


def _rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))


def tf_identity(density: Column, absorption: float, emission: float, step: float = 1.0) -> Column:
    d = clamp(density, 0.0, 1.0)
    return _rgba(d * emission, d * emission, d * emission, d * absorption * step)


def tf_gaussian(density: Column, points: Sequence[Sequence[float]], step: float = 1.0, gradient_length: Column | None = None) -> Column:
    """``points``: r, g, b, absorption, mean, width of each bell; ``gradient_length`` widens the bells."""
    scale = F.lit(1.0) if gradient_length is None else F.greatest(F.lit(1e-5), gradient_length * 0.1)
    total = [F.lit(0.0)] * 4
    for *colour, mean, width in points:
        away = (density - mean) / (F.lit(width) * scale)
        bell = F.exp(-away * away)
        total = [t + bell * float(c) for t, c in zip(total, colour)]
    return _rgba(*total[:3], total[3] * step)


#: A rational exponent for the complementary error function (error below 1.2e-7 of its value).
ERF = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
#: Places and weights of the five-point Gauss rule on [-1, 1].
GAUSS = [(0.0, 0.5688888888888889), (0.5384693101056831, 0.4786286704993665), (-0.5384693101056831, 0.4786286704993665), (0.9061798459386640, 0.2369268850561891), (-0.9061798459386640, 0.2369268850561891)]


def erf(x: Column) -> Column:
    t = 1 / (1 + F.abs(x) * 0.5)
    exponent = F.lit(ERF[-1])
    for c in reversed(ERF[:-1]):
        exponent = exponent * t + c
    return F.signum(x) * (1 - t * F.exp(exponent - x * x))


def tf_gaussian_analytic(density: Column, previous: Column, points: Sequence[Sequence[float]], step: float = 1.0) -> Column:
    """The bells' mean over the segment from the previous density; a previous one below 0 means none.

    By the error function, but over segments of less than half a bell's width, where a difference of two such values would
    lose digits, by five points.
    """
    before = F.when(previous < 0, density).otherwise(previous)
    middle, half = (density + before) * 0.5, (density - before) * 0.5
    total = [F.lit(0.0)] * 4
    for *colour, mean, width in points:
        near = F.lit(0.0)
        for place, weight in GAUSS:
            away = (middle + half * place - mean) / width
            near = near + F.exp(-away * away) * (weight / 2)
        far = (erf((density - mean) / width) - erf((before - mean) / width)) * (math.sqrt(math.pi) / 4 * width) / half
        bell = F.when(F.abs(half) < width / 4, near).otherwise(far)
        total = [t + bell * float(c) for t, c in zip(total, colour)]
    return _rgba(*total[:3], total[3] * step)


def tf_piecewise(density: Column, points: Sequence[Sequence[float]], step: float = 1.0) -> Column:
    """``points``: r, g, b, absorption, position, by position; linear between two points, constant outside."""
    d = clamp(density, 0.0, 1.0)
    out = None
    for low, high in reversed(list(zip(points, points[1:]))):
        f = (clamp(d, low[4], high[4]) - low[4]) / (high[4] - low[4])
        piece = _rgba(*(lerp(F.lit(float(a)), F.lit(float(b)), f) * (step if k == 3 else 1.0) for k, (a, b) in enumerate(zip(low[:4], high[:4]))))
        out = piece if out is None else F.when(F.lit(high[4]) > d, piece).otherwise(out)
    return out


def _entry(table: Column, k: Column, size: int) -> Column:
    return F.element_at(table, (clamp(k, 0, size - 1) + 1).cast("int"))


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def table_lookup(at: Column, table: Sequence[Sequence[float]]) -> Column:
    """The array of a table's values at a position from 0 to 1: entries are centred, ends are held."""
    size = len(table)
    entries = F.array(*(F.array(*(F.lit(float(v)) for v in row)) for row in table))

    def between(d: Column) -> Column:
        k = F.floor(d)
        return F.zip_with(_entry(entries, k, size), _entry(entries, k + 1, size), lambda a, b: lerp(a, b, d - k))

    return bind(clamp(at, 0.0, 1.0) * float(size) - 0.5, between)


def tf_table(density: Column, table: Sequence[Sequence[float]], step: float = 1.0) -> Column:
    return bind(table_lookup(density, table), lambda v: _rgba(v[0], v[1], v[2], v[3] * step))


def apply_tf(density: Column, tf, low: float, high: float) -> Column:
    """``tf`` of the density rescaled from [low, high]; nothing below ``low``. ``tf``: a function of a column."""
    zero = _rgba(*[F.lit(0.0)] * 4)
    return F.when(density < low, zero).otherwise(tf((density - low) / (high - low)))


def previous_density(previous: Column, low: float, high: float) -> Column:
    """The previous density for apply_tf's function, rescaled alike; -1 below ``low``."""
    scaled = (previous - low) / (high - low)
    return F.when(scaled < 0, -1.0).otherwise(scaled)


def _unweighted(r: Column, g: Column, b: Column, a: Column) -> Column:
    return _rgba(*(F.when(a > 1e-5, c / a).otherwise(c) for c in (r, g, b)), a)


def tf_preintegrated_1d(density: Column, previous: Column, table: Sequence[Sequence[float]], integral: Sequence[Sequence[float]], step: float) -> Column:
    """Colour between two densities from a table of integrals (see ``preintegrate_1d``)."""
    d = clamp(density, 0.0, 1.0)
    ends = F.struct(d.alias("d"), F.when(previous < 0, d).otherwise(previous).alias("p"))

    def colour(e: Column) -> Column:
        wide = e["d"] - e["p"]
        mean = F.zip_with(table_lookup(e["p"], integral), table_lookup(e["d"], integral), lambda x, y: (y - x) * step / wide)
        rgba = bind(mean, lambda m: _unweighted(m[0], m[1], m[2], 1 - F.exp(-m[3])))
        return F.when(F.abs(wide) < 1e-3, tf_table(e["d"], table, step)).otherwise(rgba)

    return bind(ends, colour)


# --- quantisers


def quantize_uniform(v: Column, step: Column | float) -> Column:
    return truncate(v / step + F.signum(v) * 0.5)


def unquantize_uniform(q: Column, step: Column | float) -> Column:
    return q * step


def quantize_deadzone(v: Column, step: Column | float) -> Column:
    return truncate(v / step)


def unquantize_deadzone(q: Column, step: Column | float) -> Column:
    return (q + F.signum(q) * 0.5) * step


def symbolize(q: Column) -> Column:
    return 2 * F.abs(q) - F.when(q < 0, 1).otherwise(0)


def unsymbolize(s: Column) -> Column:
    half = F.floor((s + 1) / 2)
    return F.when(s % 2 == 1, -half).otherwise(half)


# --- time, views, encodings


def time_index(t: Column, start: int, step: int, count: int) -> Column:
    """The fractional index among equally spaced keyframes, held at both ends."""
    return clamp((t - start) / float(step), 0.0, float(count - 1))


def tag_timesteps(frames: DataFrame, keyframes: DataFrame, trained: DataFrame) -> DataFrame:
    """Adds is_keyframe and is_trained; both lists have a column ``time``."""
    out = frames
    for name, own in (("is_keyframe", keyframes), ("is_trained", trained)):
        out = out.join(own.select("time").distinct().withColumn(name, F.lit(True)), "time", "left").withColumn(name, F.col(name).isNotNull())
    return out


#: Fixed values of the six view orientations: up vector, permutation with signs, sign of the yaw.
ORIENTATIONS = {
    "Xp": ((1, 0, 0), (2, -1, -3), -1),
    "Xm": ((-1, 0, 0), (-2, 1, 3), 1),
    "Yp": ((0, 1, 0), (1, 2, 3), 1),
    "Ym": ((0, -1, 0), (-1, -2, -3), -1),
    "Zp": ((0, 0, 1), (-3, -1, 2), 1),
    "Zm": ((0, 0, -1), (3, 1, -2), -1),
}


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def length(v: Sequence[Column]) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def view_frame(views: DataFrame, orientation: str = "Yp", centre: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """From pitch, yaw, distance: the eye (ex..), and the unit vectors right (rx..) and up (ux..) of the image."""
    up, order, sign = ORIENTATIONS[orientation]
    pitch, yaw, distance = -F.col("pitch"), F.col("yaw") * sign, F.col("distance")
    ball = [F.cos(pitch) * F.cos(yaw) * distance, F.sin(pitch) * distance, F.cos(pitch) * F.sin(yaw) * distance]
    out = views
    for k, axis in enumerate("xyz"):
        out = out.withColumn(f"e{axis}", ball[abs(order[k]) - 1] * (1 if order[k] > 0 else -1) + centre[k])
    front = [F.lit(float(c)) - F.col(f"e{a}") for c, a in zip(centre, "xyz")]
    size = length(front)
    front = [f / size for f in front]
    right = cross(front, [F.lit(float(u)) for u in up])
    for a, c in zip("xyz", right):
        out = out.withColumn(f"r{a}", c / length(right))
    above = cross([F.col(f"r{a}") for a in "xyz"], front)
    for a, c in zip("xyz", above):
        out = out.withColumn(f"u{a}", c / length(above))
    return out


def fourier_features(df: DataFrame, columns: Sequence[str], bands: int, prefix: str = "f") -> DataFrame:
    """Appends cosines and sines of each column at 2*pi*2^k, k < bands."""
    new = {}
    for k, (band, name) in enumerate(product(range(bands), columns)):
        arg = F.col(name) * (2 * math.pi * 2**band)
        new |= {f"{prefix}_cos{k}": F.cos(arg), f"{prefix}_sin{k}": F.sin(arg)}
    return df.withColumns(new)


def fourier_matrix(df: DataFrame, columns: Sequence[str], matrix: Sequence[Sequence[float]], prefix: str = "f") -> DataFrame:
    """Appends cosine and sine of each row of a matrix times the columns, times 2*pi."""
    new = {}
    for k, row in enumerate(matrix):
        arg = sum((F.col(c) * float(m) for c, m in zip(columns, row)), F.lit(0.0)) * (2 * math.pi)
        new |= {f"{prefix}_cos{k}": F.cos(arg), f"{prefix}_sin{k}": F.sin(arg)}
    return df.withColumns(new)


def masked(alpha: Column, u: Column, least: float) -> Column:
    """Whether a pixel is kept: with the probability alpha, but at least ``least``; ``u`` is uniform in [0, 1)."""
    return alpha * (1 - least) + least >= u
