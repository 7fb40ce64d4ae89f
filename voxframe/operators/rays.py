"""Views, rays, and ordered aggregation along rays."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clamp, cross, length
from ._tables import kept
from .grids import AXES, array_bricks
from .sampling import BRICK, REACH, gradient_bricks, gradient_reach, sample, sample_bricks

RAY = ["view", "px", "py"]
#: Entries an axis of tables that are broadcast at most (a million entries of 40 bytes).
MOST_ENTRIES = 1024


def view_rays(frames: DataFrame, width: int, height: int, tan_x: float, tan_y: float) -> DataFrame:
    """A ray for each pixel of each view frame: origin ex.., unit direction dx.."""
    pixels = F.explode(F.sequence(F.lit(0), F.lit(width * height - 1)))
    rays = frames.select("*", pixels.alias("pixel")).withColumns({"px": (F.col("pixel") % width).cast("int"), "py": F.floor(F.col("pixel") / width).cast("int")})
    nx, ny = 2 * (F.col("px") + 0.5) / width - 1, 2 * (F.col("py") + 0.5) / height - 1
    up, right = [F.col(f"u{a}") for a in AXES], [F.col(f"r{a}") for a in AXES]
    front = cross(up, right)
    way = [f + r * (nx * tan_x) + u * (ny * tan_y) for f, r, u in zip(front, right, up)]
    size = length(way)
    return rays.select(*RAY, *(f"e{a}" for a in AXES), *((w / size).alias(f"d{a}") for a, w in zip(AXES, way)))


def max_steps(clipped: DataFrame, step: float) -> DataFrame:
    return clipped.groupBy("view").agg((F.max(F.col("tmax") - F.col("tmin")) / step).cast("int").alias("steps"))


def step_rays(clipped: DataFrame, step: float, by: Sequence[str] = ()) -> DataFrame:
    """Positions at tmin + k * step up to tmax: k, t, px_, py_, pz_ (in world space)."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.col("tmax") - F.col("tmin")) / step).cast("int")))
    out = clipped.select(*by, *RAY, "tmin", "tmax", *(f"e{a}" for a in AXES), *(f"d{a}" for a in AXES), k.alias("k")).withColumn("t", F.col("tmin") + F.col("k") * step)
    return out.withColumns({f"w{a}": F.col(f"e{a}") + F.col("t") * F.col(f"d{a}") for a in AXES})


def ray_samples(stepped: DataFrame, grid: DataFrame, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float], tf: Callable[[Column, Column], Column], mode: str = "linear", by: Sequence[str] = ()) -> DataFrame:
    """view, px, py, k, t, value, rgba: grid values along the rays and their colours; ``tf`` takes value and previous value."""
    for a, low, size, n in zip(AXES, box_min, box_size, res):
        o = (F.col(f"w{a}") - low) / size * float(n - 1)
        stepped = stepped.withColumn(f"o{a}", F.least(F.greatest(o, F.lit(0.0)), F.lit(float(n - 1))))
    seen = sample(stepped, grid, res, [*by, *RAY, "k", "t"], mode, by)
    before = F.lag("value").over(Window.partitionBy(*by, *RAY).orderBy("k"))
    return seen.withColumn("previous", F.coalesce(before, F.lit(-1.0))).withColumn("rgba", tf(F.col("value"), F.col("previous"))).drop("previous")


def composite(samples: DataFrame, blend: str = "beer", early_out: float = 1.0, key: Sequence[str] = RAY) -> DataFrame:
    """Front-to-back blending of r, g, b, a (absorption) and t along each ray: r, g, b, alpha, depth.

    The light left before each step is a running sum of logarithms, so that no step waits for another; steps where less than
    1 - early_out is left are dropped.
    """
    absorbed = F.col("a") if blend == "beer" else -F.log(F.greatest(1 - F.least(F.col("a"), F.lit(1.0)), F.lit(1e-300)))
    line = Window.partitionBy(*key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    steps = samples.withColumn("absorbed", absorbed).withColumn("left", F.exp(-F.coalesce(F.sum("absorbed").over(line), F.lit(0.0))))
    seen = steps.where(F.col("left") > 1 - early_out) if early_out < 1 else steps
    weight = F.col("left") * (1 - F.exp(-F.col("absorbed")))
    return seen.groupBy(*key).agg(*(F.sum(weight * F.col(c)).alias(c) for c in ("r", "g", "b")), F.sum(weight).alias("alpha"), F.sum(weight * F.col("t")).alias("depth"))


def line_integrals(clipped: DataFrame, grid: DataFrame, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float], step: float, tf: Callable[[Column, Column], Column], early_out: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Images of all clipped rays as one job: r, g, b, alpha, depth of each ray, and of each ``by`` (as ensemble and time).

    Rays and grid share the columns ``by``. Samples are joined with bricks, then dealt once by ray: previous values, the light
    that is left and the sums share that dealing.
    """
    seen = ray_samples(step_rays(clipped, step, by), grid, res, box_min, box_size, tf, by=by)
    return composite(seen.select(*by, *RAY, "k", "t", "rgba.*"), early_out=early_out, key=[*by, *RAY])


def _in_grid(at: Column, axis: str, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float]) -> Column:
    """The object coordinate of a world coordinate, held at the border."""
    k = AXES.index(axis)
    return clamp((at - box_min[k]) / box_size[k] * float(res[k] - 1), 0.0, float(res[k] - 1))


def brick_runs(clipped: DataFrame, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float], step: float, brick: int = BRICK, by: Sequence[str] = ()) -> DataFrame:
    """The steps of each ray cut where it passes from brick to brick: run (0, 1, ...), bx, by, bz, k0 .. k1.

    One row a ray and brick, from the ray's own row: no step has a row, and nothing is shuffled.
    """
    last = F.floor((F.col("tmax") - F.col("tmin")) / step).cast("int")
    count = [-(-n // brick) for n in res]

    def name(k: Column) -> Column:
        place = []
        for a, n in zip(AXES, res):
            o = _in_grid(F.col(f"e{a}") + (F.col("tmin") + k * step) * F.col(f"d{a}"), a, res, box_min, box_size)
            place.append(F.floor(clamp(o.cast("int"), 0, n - 1) / brick).cast("long"))
        return place[0] + count[0] * (place[1] + count[1] * place[2])

    named = clipped.withColumn("__last", last).withColumn("__names", F.transform(F.sequence(F.lit(0), F.col("__last")), name))
    borders = F.filter(F.sequence(F.lit(0), F.col("__last")), lambda k: (k == 0) | (F.get("__names", k) != F.get("__names", k - 1)))
    cut = named.withColumn("__borders", borders)
    runs = F.transform("__borders", lambda k, i: F.struct(i.alias("run"), F.get("__names", k).alias("name"), k.alias("k0"), (F.coalesce(F.get("__borders", i + 1), F.col("__last") + 1) - 1).alias("k1")))
    out = cut.select(*by, *RAY, "tmin", *(f"e{a}" for a in AXES), *(f"d{a}" for a in AXES), F.inline(runs))
    places = (F.col("name") % count[0], F.floor(F.col("name") / count[0]) % count[1], F.floor(F.col("name") / (count[0] * count[1])))
    return out.withColumns({f"b{a}": p.cast("int") for a, p in zip(AXES, places)}).drop("name")


def march(clipped: DataFrame, grid: DataFrame, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float], step: float, tf: Callable[[Column, Column], Column], early_out: float = 1.0, dmin: float | None = None, normals: bool = False, by: Sequence[str] = (), brick: int = BRICK) -> DataFrame:
    """Images of all clipped rays: r, g, b, alpha, depth (and nx, ny, nz) of each ray, and samples, the number of values read for it.

    The same as ``line_integrals`` with ``early_out``, but steps become rows only where they count. Bricks know the range of their
    values, and those below ``dmin``, where nothing absorbs, are left out. The other runs of steps are taken from front to back in rounds of
    1, 2, 4, ... bricks a ray; rays of which no more than 1 - ``early_out`` of the light is left take no part in the next one. So the rows
    fall with opacity and empty space, and the number of rounds is the logarithm of the bricks on a ray.

    ``normals``: blends unit gradients with the weights of the colours; they are read only where a value reaches ``dmin``. Values
    below ``dmin`` are -1 as previous values.
    """
    key, halo = [*by, *RAY], gradient_reach() if normals else REACH["linear"]
    bricks = kept(array_bricks(grid, res, brick, *halo, by))
    runs = brick_runs(clipped, res, box_min, box_size, step, brick, by)
    if dmin is not None:
        full = bricks.where(F.array_max("cells") >= dmin).select(*by, "bx", "by", "bz")
        runs = runs.join(full, [*by, "bx", "by", "bz"], "left_semi")
    runs = kept(runs)
    last = runs.agg(F.max("run")).first()[0]
    sums = ["r", "g", "b", "alpha", "depth", *(f"n{a}" for a in AXES if normals)]
    nothing = {c: F.lit(0.0) for c in [*sums, "absorbed"]} | {"samples": F.lit(0).cast("long"), "last_k": F.lit(None).cast("int"), "last_value": F.lit(None).cast("double")}
    live, done = clipped.select(*key).withColumns(nothing), []
    first, count = 0, 1
    while last is not None and first <= last:
        now = runs.where((F.col("run") >= first) & (F.col("run") < first + count)).join(live.select(*key, "absorbed", "last_k", "last_value"), key)
        seen = _march_samples(now, bricks, res, box_min, box_size, step, halo, dmin, normals, key, by, brick)
        part = _march_sums(seen, tf, early_out, dmin, sums, key)
        met = live.join(part, key, "left")
        new = {c: F.col(c) + F.coalesce(f"{c}_", F.lit(0)) for c in [*sums, "absorbed", "samples"]} | {c: F.coalesce(f"{c}_", c) for c in ("last_k", "last_value")}
        live = kept(met.select(*key, *(v.alias(c) for c, v in new.items())))
        if early_out < 1:
            over = F.exp(-F.col("absorbed")) <= 1 - early_out
            done.append(live.where(over))
            live = live.where(~over)
        first, count = first + count, 2 * count
    for more in done:
        live = live.union(more)
    return live.select(*key, *sums, "samples")


def _march_samples(runs: DataFrame, bricks: DataFrame, res: Sequence[int], box_min: Sequence[float], box_size: Sequence[float], step: float, halo: tuple[int, int], dmin: float | None, normals: bool, key: Sequence[str], by: Sequence[str], brick: int) -> DataFrame:
    """k, t, value (and gx, gy, gz in world space) at all steps of some runs."""
    steps = runs.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("t", F.col("tmin") + F.col("k") * step)
    steps = steps.withColumns({f"o{a}": _in_grid(F.col(f"e{a}") + F.col("t") * F.col(f"d{a}"), a, res, box_min, box_size) for a in AXES}).drop("bx", "by", "bz")
    own = [*key, "absorbed", "last_k", "last_value", "k", "t"]
    if not normals:
        return sample_bricks(steps, bricks, res, brick, own, "linear", by, halo)
    seen = gradient_bricks(steps, bricks, res, brick, own, 1.0, by, value=True)
    return seen.withColumns({f"g{a}": F.col(f"g{a}") * ((n - 1) / size) for a, n, size in zip(AXES, res, box_size)})


def _march_sums(seen: DataFrame, tf: Callable[[Column, Column], Column], early_out: float, dmin: float | None, sums: Sequence[str], key: Sequence[str]) -> DataFrame:
    """What the steps of a round add to each ray's sums (named with _), and the last of them."""
    line = Window.partitionBy(*key).orderBy("k")
    before = F.struct("k", "value")
    lag = F.coalesce(F.lag(before).over(line), F.when(F.col("last_k").isNotNull(), F.struct(F.col("last_k").alias("k"), F.col("last_value").alias("value"))))
    previous = F.when(F.col("before.k") == F.col("k") - 1, F.col("before.value")).otherwise(-1.0)
    if dmin is not None:
        previous = F.when(previous >= dmin, previous).otherwise(-1.0)
    steps = seen.withColumn("before", lag).withColumn("rgba", tf(F.col("value"), previous))
    steps = steps.withColumn("a", F.col("rgba.a") if dmin is None else F.when(F.col("value") >= dmin, F.col("rgba.a")).otherwise(0.0))
    so_far = F.coalesce(F.sum("a").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    steps = steps.withColumn("left", F.exp(-(F.col("absorbed") + so_far)))
    weight = F.when(F.col("left") > 1 - early_out, F.col("left") * (1 - F.exp(-F.col("a")))).otherwise(0.0) if early_out < 1 else F.col("left") * (1 - F.exp(-F.col("a")))
    of = {"r": F.col("rgba.r"), "g": F.col("rgba.g"), "b": F.col("rgba.b"), "alpha": F.lit(1.0), "depth": F.col("t")}
    if "nx" in sums:
        size = F.greatest(length([F.col(f"g{a}") for a in AXES]), F.lit(1e-30))
        of |= {f"n{a}": F.col(f"g{a}") / size for a in AXES}
    added = [F.sum(weight * of[c]).alias(f"{c}_") for c in sums]
    return steps.groupBy(*key).agg(*added, F.sum("a").alias("absorbed_"), F.count("*").alias("samples_"), F.max("k").alias("last_k_"), F.max_by("value", "k").alias("last_value_"))


def image_from_samples(rays: DataFrame, samples: int, key: Sequence[str] = RAY) -> DataFrame:
    """Means over the sub-pixel samples; depth is weighted by alpha."""
    total = F.sum("alpha")
    return rays.groupBy(*key).agg(*((F.sum(c) / samples).alias(c) for c in ("r", "g", "b", "alpha")), F.when(total > 0, F.sum(F.col("alpha") * F.col("depth")) / total).otherwise(0.0).alias("depth"))


def first_crossing(samples: DataFrame, iso: float, key: Sequence[str] = RAY) -> DataFrame:
    """The first step of each ray with a value above ``iso``: its depth t and the depth before."""
    line = Window.partitionBy(*key).orderBy("k")
    with_before = samples.withColumn("before", F.lag("t").over(line))
    return with_before.where(F.col("value") > iso).groupBy(*key).agg(F.min(F.struct("k", "t", "before")).alias("hit")).select(*key, "hit.k", "hit.t", "hit.before")


def refine_crossing(hits: DataFrame, value_at: Callable[[DataFrame], DataFrame], iso: float, rounds: int, key: Sequence[str] = RAY) -> DataFrame:
    """Bisection between the depth before and that of the crossing; ``value_at`` adds value at depth t to rays."""
    out = hits.select(*key, F.coalesce("before", "t").alias("low"), F.col("t").alias("high"))
    for _ in range(rounds):
        middle = value_at(out.withColumn("t", (F.col("low") + F.col("high")) * 0.5))
        above = F.col("value") > iso
        out = middle.select(*key, F.when(above, F.col("low")).otherwise(F.col("t")).alias("low"), F.when(above, F.col("t")).otherwise(F.col("high")).alias("high"))
    return out.select(*key, F.col("high").alias("t"))


def mean_of_passes(pixels: DataFrame, key: Sequence[str]) -> DataFrame:
    """The running mean of each pixel over its passes."""
    line = Window.partitionBy(*key).orderBy("pass").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return pixels.withColumn("mean", F.avg("value").over(line))


def preintegrate_1d(table: DataFrame, res: int) -> DataFrame:
    """Running trapezoids of colour * absorption and absorption over a table (tf, i, r, g, b, a) of ``res`` centred entries."""
    line = Window.partitionBy("tf").orderBy("i")
    width = F.when(F.col("i") == 0, 0.5 / res).otherwise(1.0 / res)
    steps = {}
    for c in ("r", "g", "b"):
        now = F.col(c) * F.col("a")
        steps[c] = width * 0.5 * (now + F.coalesce(F.lag(now).over(line), now))
    steps["a"] = width * 0.5 * (F.col("a") + F.coalesce(F.lag("a").over(line), F.col("a")))
    stepped = table.select("tf", "i", *(s.alias(c) for c, s in steps.items()))
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.select("tf", "i", *(F.sum(c).over(so_far).alias(c) for c in steps))


def preintegrate_2d(ends: DataFrame, colour: Callable[[Column], Column], step: float, n: int) -> DataFrame:
    """For each pair (i, j, start, stop) of densities: colour with self-attenuation over n steps between them."""
    each = ends.select("i", "j", "start", "stop", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("s"))
    omega = F.col("s") * (1.0 / n)
    each = each.withColumn("c", colour((1 - omega) * F.col("start") + omega * F.col("stop")))
    pair = Window.partitionBy("i", "j").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("so_far", F.sum(F.col("c.a") * (step / n)).over(pair))
    weight = F.col("c.a") * (step / n) * F.exp(-F.col("so_far"))
    return each.groupBy("i", "j").agg(*(F.sum(F.col(f"c.{c}") * weight).alias(c) for c in ("r", "g", "b")), (1 - F.exp(-F.sum(F.col("c.a") * (step / n)))).alias("a"))


def preintegrated_2d(samples: DataFrame, pairs: DataFrame, n: int, key: Sequence[str], mode: str = "nearest") -> DataFrame:
    """Colours of samples (before, value) from a table of ``preintegrate_2d`` with n x n centred entries: key, r, g, b, a.

    A sample without one before it (negative) stands for itself. ``mode="linear"`` mixes the four entries around. Colours are
    freed of their absorption. The table is broadcast: n is at most ``MOST_ENTRIES``.
    """
    if n > MOST_ENTRIES:
        raise ValueError(f"a table of {n} x {n} entries is too large to send to all tasks")
    start = F.when(F.col("before") < 0, F.col("value")).otherwise(F.col("before"))
    if mode == "nearest":
        cell = lambda c: F.least(F.greatest(F.floor(c * n), F.lit(0)), F.lit(n - 1)).cast("int")
        asked = samples.select(*key, cell(start).alias("i"), cell(F.col("value")).alias("j"), F.lit(1.0).alias("w"))
    else:
        p = {"i": F.least(F.greatest(start * n - 0.5, F.lit(0.0)), F.lit(n - 1.0)), "j": F.least(F.greatest(F.col("value") * n - 0.5, F.lit(0.0)), F.lit(n - 1.0))}
        part = []
        for s, t in ((0, 0), (0, 1), (1, 0), (1, 1)):
            place, w = [], F.lit(1.0)
            for c, more in (("i", s), ("j", t)):
                f = p[c] - F.floor(p[c])
                w = w * (f if more else 1 - f)
                place.append(F.least(F.floor(p[c]) + more, F.lit(n - 1)).cast("int").alias(c))
            part.append(F.struct(*place, w.alias("w")))
        asked = samples.select(*key, F.inline(F.array(*part)))
    met = asked.join(F.broadcast(pairs), ["i", "j"])
    if mode == "nearest":
        mixed = met.select(*key, "r", "g", "b", "a")
    else:
        mixed = met.groupBy(*key).agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in "rgba"))
    return mixed.select(*key, *(F.when(F.col("a") > 1e-5, F.col(c) / F.col("a")).otherwise(F.col(c)).alias(c) for c in "rgb"), "a")
