"""Registered queries of sampling joins, stencils, point sequences and rays, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import grids as g
from ..operators import points as pt
from ..operators import rays as ry
from ..operators import sampling as sa
from .bindings import DENSE, GRID, IMAGES, POINTS, R6, RES, SERIES, SMALL, dense, grid, images, points, result, series, small_volumes, table
from .queries_values import KEY3, ORACLE, PIECES, QUERIES, TABLE, pieces_sql, query

NX, NY, NZ = RES


def at_points(spark, d):
    return v.to_object_space(points(spark, d), (0, 0, 0), (1, 1, 1), RES)


OBJ = f"{POINTS}, o AS (SELECT px, py, pz, px * 49e0 AS ox, py * 10e0 AS oy, pz * 8e0 AS oz FROM p)"


def cl(e, n):
    return f"least(greatest({e}, 0), {n - 1})"


@query("j1_sample_nearest", f"WITH {DENSE}, {OBJ} SELECT px, py, pz, {R6('value')} AS value FROM o JOIN dg ON x = {cl('floor(ox + 0.5e0)', NX)} AND y = {cl('floor(oy + 0.5e0)', NY)} AND z = {cl('floor(oz + 0.5e0)', NZ)}")
def j1(spark, d):
    return result(sa.sample(at_points(spark, d), dense(spark, d), RES, KEY3, "nearest"), KEY3)


CORNERS = f"k AS (SELECT px, py, pz, {cl('trunc(ox) + a.range', NX)} AS x, {cl('trunc(oy) + b.range', NY)} AS y, {cl('trunc(oz) + e.range', NZ)} AS z, (CASE a.range WHEN 1 THEN ox - trunc(ox) ELSE 1 - (ox - trunc(ox)) END) * (CASE b.range WHEN 1 THEN oy - trunc(oy) ELSE 1 - (oy - trunc(oy)) END) * (CASE e.range WHEN 1 THEN oz - trunc(oz) ELSE 1 - (oz - trunc(oz)) END) AS w FROM o, range(2) a, range(2) b, range(2) e)"
J2SQL = f"{DENSE}, {OBJ}, {CORNERS}, j2 AS (SELECT px, py, pz, sum(w * value) AS value FROM k JOIN dg USING (x, y, z) GROUP BY 1, 2, 3)"
LINEAR = f"WITH {DENSE}, {OBJ}, {CORNERS} SELECT px, py, pz, {R6('sum(w * value)')} AS value FROM k JOIN dg USING (x, y, z) GROUP BY 1, 2, 3"


@query("j2_sample_linear", LINEAR)
def j2(spark, d):
    return result(sa.sample(at_points(spark, d), dense(spark, d), RES, KEY3, "linear"), KEY3)


@query("j2_sample_bricks", LINEAR)
def j2b(spark, d):
    return result(sa.sample_bricks(at_points(spark, d), g.array_bricks(dense(spark, d), RES, 8), RES, 8, KEY3), KEY3)


@query("j3_time_lerp", f"""WITH {SERIES}, f AS (SELECT ensemble, ((time - 6) // 12)::INT AS idx, CAST(sum(round(value * 1e6)) AS DOUBLE) / count(*) / 1e6 AS value FROM s WHERE (time - 6) % 12 = 0 AND time >= 6 GROUP BY 1, 2),
a AS (SELECT DISTINCT ensemble, time, least(greatest((time - 6) / 12e0, 0), 5) AS t FROM s),
b AS (SELECT *, least(greatest(floor(t), 0), 5) AS low, least(least(greatest(floor(t), 0), 5) + 1, 5) AS high FROM a)
SELECT b.ensemble::BIGINT AS ensemble, time::BIGINT AS time, {R6("(1 - (t - floor(t))) * x.value + (t - floor(t)) * y.value")} AS value FROM b JOIN f x ON x.ensemble = b.ensemble AND x.idx = low JOIN f y ON y.ensemble = b.ensemble AND y.idx = high""")
def j3(spark, d):
    s = series(spark, d)
    mean = F.sum(F.round(F.col("value") * 1e6)) / F.count("*") / 1e6
    frames = s.where("(time - 6) % 12 = 0 and time >= 6").groupBy("ensemble", F.floor((F.col("time") - 6) / 12).cast("int").alias("idx")).agg(mean.alias("value"))
    asked = s.select("ensemble", "time").distinct().withColumn("t", (F.col("time") - 6) / 12)
    return result(sa.time_lerp(asked, frames, 6, ["ensemble", "time"], ["ensemble"]))


def _cubic_sql() -> str:
    part = []
    for a in "xyz":
        f = f"(o{a} - 0.5e0 - floor(o{a} - 0.5e0))"
        i = f"floor(o{a} - 0.5e0)"
        w = [f"((1 - {f}) * (1 - {f}) * (1 - {f}) / 6)", f"(2e0 / 3 - 0.5e0 * {f} * {f} * (2 - {f}))", f"(2e0 / 3 - 0.5e0 * (1 - {f}) * (1 - {f}) * (2 - (1 - {f})))", f"({f} * {f} * {f} / 6)"]
        part.append(f"{w[0]} + {w[1]} AS g{a}0, {w[2]} + {w[3]} AS g{a}1, {w[1]} / ({w[0]} + {w[1]}) - 0.5e0 + {i} AS h{a}0, {w[3]} / ({w[2]} + {w[3]}) + 1.5e0 + {i} AS h{a}1")
    made = f"m AS (SELECT px, py, pz, {', '.join(part)} FROM o)"
    pick = ", ".join(f"CASE {r}.range WHEN 0 THEN h{a}0 ELSE h{a}1 END AS o{a}" for a, r in zip("xyz", ("qx", "qy", "qz")))
    tap = " * ".join(f"(CASE {r}.range WHEN 0 THEN g{a}0 ELSE g{a}1 END)" for a, r in zip("xyz", ("qx", "qy", "qz")))
    taps = f"tp AS (SELECT px, py, pz, {pick}, {tap} AS tap FROM m, range(2) qx, range(2) qy, range(2) qz)"
    corners = CORNERS.replace("FROM o,", "FROM tp o,").replace(" AS w FROM", " * tap AS w FROM").replace("k AS", "kk AS")
    return f"WITH {DENSE}, {OBJ}, {made}, {taps}, {corners} SELECT px, py, pz, {R6('sum(w * value)')} AS value FROM kk JOIN dg USING (x, y, z) GROUP BY 1, 2, 3"


@query("j4_sample_cubic", _cubic_sql())
def j4(spark, d):
    return result(sa.sample(at_points(spark, d), dense(spark, d), RES, KEY3, "cubic"), KEY3)


LATENT = f"""lat AS (SELECT label AS channel, x, y, z, CAST(sum(round(value * 1e6)) AS DOUBLE) / count(*) / 1e6 AS value FROM v GROUP BY 1, 2, 3, 4)"""
CELL = "q AS (SELECT px, py, pz, " + ", ".join(f"least(greatest(floor(p{a} * 4e0 - 0.5e0) + r{a}.range, 0), 3) AS x{a}" for a in "xyz") + ", " + " * ".join(f"(CASE r{a}.range WHEN 1 THEN p{a} * 4e0 - 0.5e0 - floor(p{a} * 4e0 - 0.5e0) ELSE 1 - (p{a} * 4e0 - 0.5e0 - floor(p{a} * 4e0 - 0.5e0)) END)" for a in "xyz") + " AS w FROM p, range(2) rx, range(2) ry, range(2) rz)"


def latent_grids(spark, d):
    mean = F.sum(F.round(F.col("value") * 1e6)) / F.count("*") / 1e6
    return small_volumes(spark, d).groupBy(F.col("label").alias("channel"), "x", "y", "z").agg(mean.alias("value"))


@query("j5_latent_features", f"WITH {SMALL}, {LATENT}, {POINTS}, {CELL} SELECT px, py, pz, channel::BIGINT AS channel, {R6('sum(w * value)')} AS value FROM q JOIN lat ON x = xx AND y = xy AND z = xz GROUP BY 1, 2, 3, 4")
def j5(spark, d):
    return result(sa.latent_features(points(spark, d), latent_grids(spark, d), (4, 4, 4), KEY3), KEY3)


TIMES, MEMBERS = 5, 3
FRAMED = "".join(f", {n} AS (SELECT {f} AS frame, label AS channel, x, y, z, CAST(sum(round(value * 1e6)) AS DOUBLE) / count(*) / 1e6 AS value FROM v GROUP BY 1, 2, 3, 4, 5)" for n, f in (("lt", f"volume_id % {TIMES}"), ("le", f"volume_id // {TIMES} % {MEMBERS}")))
_AT = {"t": ("px * 6e0 - 0.5e0", TIMES), "e": ("py * 3e0 - 0.25e0", MEMBERS)}
BLENDED = FRAMED + "".join(
    f", ix{n} AS (SELECT px, py, pz, least(greatest({at}, 0), {count - 1}) AS t FROM p), w{n} AS (SELECT px, py, pz, floor(t) AS frame, 1 - (t - floor(t)) AS fw FROM ix{n} UNION ALL SELECT px, py, pz, least(floor(t) + 1, {count - 1}) AS frame, t - floor(t) AS fw FROM ix{n}), "
    f"b{n} AS (SELECT q.px, q.py, q.pz, channel, sum(w * fw * value) AS value FROM q JOIN w{n} USING (px, py, pz) JOIN l{n} ON l{n}.frame = w{n}.frame AND x = xx AND y = xy AND z = xz GROUP BY 1, 2, 3, 4)"
    for n, (at, count) in _AT.items()
)


def framed_grids(spark, d):
    """Latent grids of times and of members: the small volumes of each label, averaged by their number."""
    mean = F.sum(F.round(F.col("value") * 1e6)) / F.count("*") / 1e6
    small = small_volumes(spark, d)
    frames = (F.col("volume_id") % TIMES, F.floor(F.col("volume_id") / TIMES) % MEMBERS)
    return [small.groupBy(f.cast("int").alias("frame"), F.col("label").alias("channel"), "x", "y", "z").agg(mean.alias("value")) for f in frames]


def framed_points(spark, d):
    return points(spark, d).withColumns({"t": F.col("px") * 6 - 0.5, "e": F.col("py") * 3 - 0.25})


@query("j5_latent_series", f"WITH {SMALL}, {POINTS}, {CELL}{BLENDED} SELECT px, py, pz, channel::BIGINT AS channel, {R6('value')} AS value FROM bt UNION ALL SELECT px, py, pz, (channel + 10)::BIGINT AS channel, {R6('value')} AS value FROM be")
def j5s(spark, d):
    times, members = framed_grids(spark, d)
    return result(sa.latent_series(framed_points(spark, d), KEY3, times, (4, 4, 4), TIMES, members, (4, 4, 4), MEMBERS), KEY3)


VECTORS = "ve AS (SELECT label AS idx, x + 4 * (y + 4 * z) AS channel, CAST(sum(round(value * 1e6)) AS DOUBLE) / count(*) / 1e6 AS value FROM v GROUP BY 1, 2)"


def vectors(spark, d):
    mean = F.sum(F.round(F.col("value") * 1e6)) / F.count("*") / 1e6
    return small_volumes(spark, d).groupBy(F.col("label").alias("idx"), (F.col("x") + 4 * (F.col("y") + 4 * F.col("z"))).alias("channel")).agg(mean.alias("value"))


@query("j6_interp_vectors", f"WITH {SMALL}, {VECTORS}, {SERIES}, a AS (SELECT DISTINCT time, least(greatest(time / 7e0 - 0.5e0, 0), 9) AS t FROM s), b AS (SELECT *, least(greatest(floor(t), 0), 8) AS low FROM a) SELECT time::BIGINT AS time, l.channel::BIGINT AS channel, {R6('(1 - (t - low)) * l.value + (t - low) * h.value')} AS value FROM b JOIN ve l ON l.idx = low JOIN ve h ON h.idx = low + 1 AND h.channel = l.channel")
def j6(spark, d):
    asked = series(spark, d).select("time").distinct().withColumn("t", F.col("time") / 7 - 0.5)
    return result(sa.interp_vectors(asked, vectors(spark, d), 10, ["time"]))


FLOW = "fl AS (SELECT image, x, y, x - 30e0 * (0.02e0 + value * 0.01e0) AS sx, y - 24e0 * (0.03e0 - value * 0.01e0) AS sy FROM im)"


@query("j7_warp", f"WITH {IMAGES}, {FLOW}, q AS (SELECT image, x, y, floor(sx) + a.range AS vx, floor(sy) + b.range AS vy, (CASE a.range WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE b.range WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS w FROM fl, range(2) a, range(2) b) SELECT q.image, q.x::BIGINT AS x, q.y::BIGINT AS y, {R6('sum(w * coalesce(im.value, 0))')} AS value FROM q LEFT JOIN im ON im.image = q.image AND im.x = vx AND im.y = vy GROUP BY 1, 2, 3")
def j7(spark, d):
    im = images(spark, d)
    flow = im.select("image", "x", "y", (0.02 + F.col("value") * 0.01).alias("fx"), (0.03 - F.col("value") * 0.01).alias("fy"))
    return result(sa.warp(im, flow, 30, 24, ["image"]))


def _rays(spark, d):
    """Lines from outside the unit cube towards the points."""
    p = points(spark, d)
    return p.withColumns({"ex": F.lit(-1.0), "ey": F.lit(0.3), "ez": F.lit(0.4), "dx": F.lit(1.0), "dy": (F.col("py") - 0.4) * 0.5, "dz": (F.col("pz") - 0.45) * 0.5})


RAYS = f"{POINTS}, r AS (SELECT px, py, pz, -1e0 AS ex, 0.3e0 AS ey, 0.4e0 AS ez, 1e0 AS dx, (py - 0.4e0) * 0.5e0 AS dy, (pz - 0.45e0) * 0.5e0 AS dz FROM p)"
SLAB = ", ".join(f"least((lo - e{a}) / d{a}, (hi - e{a}) / d{a}) AS n{a}, greatest((lo - e{a}) / d{a}, (hi - e{a}) / d{a}) AS f{a}" for a in "xyz")


@query("j8_ray_clip", f"WITH {RAYS}, bx AS (SELECT * FROM (VALUES (0, 0e0, 1e0), (1, 0.25e0, 0.5e0)) t(box, lo, hi)), m AS (SELECT px, py, pz, box, {SLAB} FROM r, bx), c AS (SELECT px, py, pz, box, greatest(nx, ny, nz, 0) AS tmin, least(fx, fy, fz) AS tmax FROM m) SELECT px, py, pz, box::BIGINT AS box, {R6('tmin')} AS tmin, {R6('tmax')} AS tmax FROM c WHERE tmin <= tmax")
def j8(spark, d):
    boxes = spark.createDataFrame([(0, *[0.0] * 3, *[1.0] * 3), (1, *[0.25] * 3, *[0.5] * 3)], "box int, low_x double, low_y double, low_z double, high_x double, high_y double, high_z double")
    return result(sa.ray_clip(_rays(spark, d), boxes).select(*KEY3, "box", "tmin", "tmax"), KEY3)


SIDES = {"x": "p_size / 51e0", "y": "p_retailprice / 97 - floor(p_retailprice / 97)", "z": "p_partkey * 0.618e0 - floor(p_partkey * 0.618e0)"}
MANY = "bm AS (SELECT p_partkey AS box, " + ", ".join(f"{c} AS low_{a}, {c} + 0.02e0 AS high_{a}" for a, c in SIDES.items()) + " FROM part)"


@query("j8_ray_clip_many", f"WITH {RAYS}, {MANY}, m AS (SELECT px, py, pz, box, " + ", ".join(f"least((low_{a} - e{a}) / d{a}, (high_{a} - e{a}) / d{a}) AS n{a}, greatest((low_{a} - e{a}) / d{a}, (high_{a} - e{a}) / d{a}) AS f{a}" for a in "xyz") + f" FROM (SELECT * FROM r WHERE dy <> 0 AND dz <> 0), bm), c AS (SELECT px, py, pz, box, greatest(nx, ny, nz, 0) AS tmin, least(fx, fy, fz) AS tmax FROM m) SELECT px, py, pz, box, {R6('tmin')} AS tmin, {R6('tmax')} AS tmax FROM c WHERE tmin <= tmax")
def j8m(spark, d):
    """A box for each part, met by cells."""
    part = table(spark, d, "part")
    low = {"x": F.col("p_size") / 51, "y": F.col("p_retailprice") / 97 - F.floor(F.col("p_retailprice") / 97), "z": F.col("p_partkey") * 0.618 - F.floor(F.col("p_partkey") * 0.618)}
    boxes = part.select(F.col("p_partkey").alias("box"), *(c.alias(f"low_{a}") for a, c in low.items()), *((c + 0.02).alias(f"high_{a}") for a, c in low.items()))
    return result(sa.clip_by_cells(_rays(spark, d).where("dy <> 0 and dz <> 0"), boxes, keep=[*KEY3, "box"]), KEY3)


@query("j10_pair_prediction", f"WITH {GRID}, b AS (SELECT x, y, z, round(value * 32) / 32 AS value FROM g WHERE z < 7) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('g.value')} AS truth, {R6('b.value')} AS predicted FROM g JOIN b USING (x, y, z)")
def j10(spark, d):
    a = grid(spark, d)
    return result(sa.pair_prediction(a, a.where("z < 7").withColumn("value", F.round(F.col("value") * 32) / 32), g.AXES))


def diff_sql(value: str, a: str, part: str = "") -> str:
    over = f"OVER (PARTITION BY {part}{', '.join(b for b in 'xyz' if b != a)} ORDER BY {a})"
    return f"(coalesce(lead({value}) {over}, {value}) - coalesce(lag({value}) {over}, {value})) * 0.5e0"


GRAD = "gr AS (SELECT x, y, z, " + ", ".join(f"{diff_sql('value', a)} AS g{a}" for a in "xyz") + " FROM dg)"


@query("w1_gradient", f"WITH {DENSE}, {GRAD} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('gx')} AS gx, {R6('gy')} AS gy, {R6('gz')} AS gz FROM gr")
def w1(spark, d):
    return result(sa.gradient(dense(spark, d)).drop("value"))


def _gradient_at_sql() -> str:
    moved = " UNION ALL ".join(
        f"SELECT px, py, pz, {k} AS axis, {s} AS sgn, " + ", ".join(f"least(greatest(o{b} + {float(s) if a == b else 0.0}, 0), {n - 1}) AS o{b}" for b, n in zip("xyz", RES)) + " FROM o"
        for k, a in enumerate("xyz") for s in (-1, 1)
    )
    corners = CORNERS.replace("FROM o,", "FROM mv o,").replace("SELECT px, py, pz,", "SELECT px, py, pz, axis, sgn,")
    return f"WITH {DENSE}, {OBJ}, mv AS ({moved}), {corners} SELECT px, py, pz, " + ", ".join(f"{R6(f'sum(CASE WHEN axis = {k} THEN sgn * w * value * 0.5e0 ELSE 0 END)')} AS g{a}" for k, a in enumerate("xyz")) + " FROM k JOIN dg USING (x, y, z) GROUP BY 1, 2, 3"


@query("w2_gradient_at", _gradient_at_sql())
def w2(spark, d):
    return result(sa.gradient_at(at_points(spark, d), dense(spark, d), RES, KEY3), KEY3)


#: Where curvatures don't hang on the last digits of a sum: elsewhere the query gives null.
STEADY = "abs(k1) < 1e3 AND abs(k2) < 1e3 AND pow(k1 - k2, 2) > 1e-6"


def _curvature_sql() -> str:
    h = ", ".join(f"{diff_sql('g' + a, b)} AS h{a}{b}" for a in "xyz" for b in "xyz")
    n = ", ".join(f"-g{a} / size AS n{a}" for a in "xyz")
    p = ", ".join(f"{1 if a == b else 0}e0 - n{a} * n{b} AS p{a}{b}, (h{a}{b} + h{b}{a}) * 0.5e0 AS s{a}{b}" for a in "xyz" for b in "xyz")
    q = ", ".join("(" + " + ".join(f"s{a}{c} * p{c}{b}" for c in "xyz") + f") AS q{a}{b}" for a in "xyz" for b in "xyz")
    w = ", ".join("-(" + " + ".join(f"p{a}{c} * q{c}{b}" for c in "xyz") + f") / size AS w{a}{b}" for a in "xyz" for b in "xyz")
    f2 = " + ".join(f"w{a}{b} * w{a}{b}" for a in "xyz" for b in "xyz")
    k = ["coalesce((t + CASE WHEN i >= 0 THEN sqrt(i) END) * 0.5e0, 0)", "coalesce((t - CASE WHEN i >= 0 THEN sqrt(i) END) * 0.5e0, 0)"]
    return (f"WITH {DENSE}, {GRAD}, ga AS (SELECT *, {h}, greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-7) AS size FROM gr), gb AS (SELECT *, {n} FROM ga), gc AS (SELECT *, {p} FROM gb), ge AS (SELECT *, {q} FROM gc), f AS (SELECT *, {w} FROM ge), "
            f"h AS (SELECT x, y, z, wxx + wyy + wzz AS t, 2 * ({f2}) - (wxx + wyy + wzz) * (wxx + wyy + wzz) AS i FROM f), k AS (SELECT x, y, z, i, {k[0]} AS k1, {k[1]} AS k2 FROM h) "
            f"SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, CASE WHEN {STEADY} THEN round(k1, 3) END AS k1, CASE WHEN {STEADY} THEN round(k2, 3) END AS k2 FROM k")


@query("w3_curvature", _curvature_sql().replace("round(k1, 3)", "floor(k1 * 1e3 + 0.4871e0) / 1e3").replace("round(k2, 3)", "floor(k2 * 1e3 + 0.4871e0) / 1e3"))
def w3(spark, d):
    k = sa.curvature(dense(spark, d))
    return result(k.select("x", "y", "z", *(F.when(F.expr(STEADY), F.floor(F.col(c) * 1e3 + 0.4871) / 1e3).alias(c) for c in ("k1", "k2"))), ("k1", "k2"))


# --- points


def hashed_sql(*parts) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(',', {', '.join(map(str, parts))})), 1, 10) AS BIGINT) / {1 << 40}e0"


@query("d1_random_points", "WITH n AS (SELECT count(*) AS n FROM lineitem), i AS (SELECT unnest(range(n)) AS id FROM n) SELECT id, " + ", ".join(f"{R6(hashed_sql(7, 'id', k))} AS p{k}" for k in range(3)) + " FROM i")
def d1(spark, d):
    """As many points as the table has rows, from a hash of their number."""
    n = table(spark, d, "lineitem").count()
    return result(pt.random_points(spark, n, 3, 7))


def plastic_sql(i: str, k: int, dim: int = 3) -> str:
    e = f"(0.5e0 + ({i} + 1) * {pt.plastic_steps(dim)[k]!r}::DOUBLE)"
    return f"({e} - floor({e}))"


@query("d2_plastic_points", f"WITH n AS (SELECT count(*) AS n FROM lineitem), i AS (SELECT unnest(range(n)) AS id FROM n) SELECT id, " + ", ".join(f"{R6(plastic_sql('id', k))} AS p{k}" for k in range(3)) + " FROM i")
def d2(spark, d):
    return result(pt.plastic_points(spark, table(spark, d, "lineitem").count(), 3))


def inv(i: str, b: int, digits: int = 20) -> str:
    return "(" + " + ".join(f"({i} // {b ** k} % {b}) / {float(b ** (k + 1))!r}::DOUBLE" for k in range(digits) if b**k < 10**7) + ")"


@query("d3_halton_points", "WITH n AS (SELECT count(*) AS n FROM orders), i AS (SELECT unnest(range(n)) AS id FROM n) SELECT id, " + ", ".join(f"{R6(inv('id', b))} AS p{k}" for k, b in enumerate((2, 3, 5))) + " FROM i")
def d3(spark, d):
    return result(pt.halton_points(spark, table(spark, d, "orders").count(), 3))


ANGLE = (2 - (math.sqrt(5) + 1) / 2) * (2 * math.pi)


@query("d4_fibonacci_views", f"WITH n AS (SELECT count(*) AS n FROM supplier), i AS (SELECT unnest(range(n)) + 1 AS i, n FROM n) SELECT (i - 1)::BIGINT AS view, {R6('asin(-1 + 2 * i / (n + 1)::DOUBLE)')} AS pitch, {R6(f'i * {ANGLE!r}::DOUBLE - floor(i * {ANGLE!r}::DOUBLE / {2 * math.pi!r}) * {2 * math.pi!r}')} AS yaw FROM i")
def d4(spark, d):
    return result(pt.fibonacci_views(spark, table(spark, d, "supplier").count()).drop("distance"))


@query("d4_rotation_views", f"WITH n AS (SELECT count(*) AS n FROM supplier), i AS (SELECT unnest(range(n)) AS i, n FROM n) SELECT i AS view, {R6('0.2e0')} AS pitch, {R6(f'0.4e0 + i * ({2 * math.pi!r}::DOUBLE / n)')} AS yaw FROM i")
def d4r(spark, d):
    return result(pt.rotation_views(spark, table(spark, d, "supplier").count(), 0.2, 0.4, 1.0).drop("distance"))


STRAT = f"st AS (SELECT x, y, z, k.range AS k, ((x + 50 * (y + 11 * z)) * 2 + k.range) AS i FROM c, range(2) k)"


@query("d5_stratified_points", f"WITH {DENSE}, {STRAT} SELECT st.x::BIGINT AS x, st.y::BIGINT AS y, st.z::BIGINT AS z, k, " + ", ".join(f"{R6(f'(st.{a} + {plastic_sql(chr(105), j)}) / {n}e0')} AS p{a}" for j, (a, n) in enumerate(zip("xyz", RES))) + ", " + R6("g.value") + " AS value FROM st JOIN g USING (x, y, z)")
def d5(spark, d):
    return result(pt.stratified_points(spark, RES, 2).join(grid(spark, d), ["x", "y", "z"]))


def candidates(spark, n):
    c = pt.plastic_points(spark, n, 4)
    return c.select("id", *(F.col(f"p{k}").alias(f"p{a}") for k, a in enumerate("xyz")), F.col("p3").alias("u"))


CAND = "ca AS (SELECT range AS id, " + ", ".join(f"{plastic_sql('range', k, 4)} AS {n}" for k, n in enumerate(("px", "py", "pz", "u"))) + " FROM (SELECT unnest(range(n)) AS range FROM (SELECT count(*) AS n FROM orders)))"
ACCEPT = f"{CAND}, o AS (SELECT id, u, px, py, pz, px * 49e0 AS ox, py * 10e0 AS oy, pz * 8e0 AS oz FROM ca), {CORNERS.replace('SELECT px, py, pz,', 'SELECT id, u, px, py, pz,')}, sm AS (SELECT id, u, px, py, pz, sum(w * value) AS value FROM k JOIN dg USING (x, y, z) GROUP BY 1, 2, 3, 4, 5)"


def sampled(spark, d, field=None):
    def at(c):
        o = v.to_object_space(c, (0, 0, 0), (1, 1, 1), RES)
        return sa.sample(o, field if field is not None else dense(spark, d), RES, ["id", "u", *KEY3])

    return at


@query("d6_importance_points", f"WITH {DENSE}, {ACCEPT} SELECT id, {R6('px')} AS px, {R6('py')} AS py, {R6('pz')} AS pz, {R6('value')} AS value FROM sm WHERE greatest(value, 0.05) > u ORDER BY id LIMIT (SELECT count(*) // 4 FROM orders)")
def d6(spark, d):
    n = table(spark, d, "orders").count()
    return result(pt.importance_points(candidates(spark, n), sampled(spark, d), n // 4, 0.05, 1.0).drop("u"))


@query("d7_importance_from_grid", f"WITH {GRID}, cc AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(d.range AS INT) AS z FROM range(50) a, range(11) b, range(9) d), dg AS (SELECT x, y, z, coalesce(abs(value - 0.5e0) * 2, 0) AS value FROM cc LEFT JOIN g USING (x, y, z)), {ACCEPT} SELECT id, {R6('px')} AS px, {R6('py')} AS py, {R6('pz')} AS pz, {R6('value')} AS value FROM sm WHERE greatest(value / 0.5e0, 0.1) > u ORDER BY id LIMIT (SELECT count(*) // 5 FROM orders)")
def d7(spark, d):
    field = g.densify(grid(spark, d).withColumn("value", F.abs(F.col("value") - 0.5) * 2), RES)
    n = table(spark, d, "orders").count()
    return result(pt.importance_points(candidates(spark, n), sampled(spark, d, field), n // 5, 0.1, 0.5).drop("u"))


@query("a16_loss_grid", f"WITH {POINTS}, e AS (SELECT {cl('floor(px * 16)', 16)}::INT AS x, {cl('floor(py * 16)', 16)}::INT AS y, {cl('floor(pz * 16)', 16)}::INT AS z, abs(py - pz) AS error FROM p), s AS (SELECT x, y, z, sum(error) AS loss FROM e GROUP BY 1, 2, 3) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('loss')} AS loss, {R6('max(loss) OVER ()')} AS largest FROM s")
def a16(spark, d):
    return result(pt.loss_grid(points(spark, d).withColumn("error", F.abs(F.col("py") - F.col("pz"))), (16, 16, 16)))


def world(spark, d):
    """Points for every member: the sampler's start advances by member; nearest cells stand for the grid."""
    def at(rows):
        o = v.to_object_space(rows, (0, 0, 0), (1, 1, 1), RES)
        return sa.sample(o, series(spark, d), RES, ["i", *KEY3], "nearest", ["ensemble", "time"])

    members = series(spark, d).select("ensemble", "time").distinct()
    seen = pt.world_samples(members, 30, 16, at, F.col("ensemble") * 200 + F.col("time"))
    return seen.withColumn("idx", v.time_index(F.col("time"), 6, 12, 6)).withColumn("c", v.tf_piecewise(F.col("value"), PIECES))


WORLD = (f"{SERIES}, me AS (SELECT DISTINCT ensemble, time FROM s), ro AS (SELECT ensemble, time, (ensemble * 200 + time) * 32 + k.range AS i FROM me, range(32) k), "
         f"ro2 AS (SELECT *, {', '.join(f'{plastic_sql(chr(105), k)} AS p{a}' for k, a in enumerate('xyz'))} FROM ro), "
         f"wo AS (SELECT ro2.*, s.value FROM ro2 JOIN s ON s.ensemble = ro2.ensemble AND s.time = ro2.time AND s.x = {cl('floor(px * 49 + 0.5e0)', NX)} AND s.y = {cl('floor(py * 10 + 0.5e0)', NY)} AND s.z = {cl('floor(pz * 8 + 0.5e0)', NZ)})")


@query("d9_world_samples", f"WITH {WORLD} SELECT i::BIGINT AS i, ensemble::BIGINT AS ensemble, time::BIGINT AS time, {R6('px')} AS px, {R6('py')} AS py, {R6('pz')} AS pz, {R6('least(greatest((time - 6) / 12e0, 0), 5)')} AS idx, {R6('value')} AS value, {R6(pieces_sql('value', 3))} AS a FROM wo")
def d9(spark, d):
    w = world(spark, d)
    return result(w.select("i", "ensemble", "time", *KEY3, "idx", "value", F.col("c.a").alias("a")))


@query("d11_split_train_val", f"WITH o AS (SELECT o_orderkey AS id, o_orderkey // 128 AS chunk_id FROM orders), c AS (SELECT DISTINCT chunk_id FROM o), r AS (SELECT chunk_id, row_number() OVER (ORDER BY {hashed_sql(0, 'chunk_id')}, chunk_id) AS place, count(*) OVER () AS n FROM c) SELECT id, chunk_id, place <= trunc(n * 0.2e0) AS validation FROM o JOIN r USING (chunk_id)")
def d11(spark, d):
    """Orders in chunks, a fifth of which go to validation as wholes."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return result(pt.split_train_val(pt.chunk(o, 1024), 0.2))


@query("d12_chunk", "SELECT o_orderkey AS id, o_orderkey // 128 AS chunk_id FROM orders")
def d12(spark, d):
    return result(pt.chunk(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), 1024))


@query("d13_dataset_size", f"WITH {SERIES}, m AS (SELECT count(*) AS n FROM (SELECT DISTINCT ensemble, time FROM s)) SELECT n AS members, n * 1024 AS rows, n * 2 AS batches, n * 1024 * 28 AS bytes FROM m")
def d13(spark, d):
    return result(pt.dataset_size(series(spark, d).select("ensemble", "time").distinct(), 1000, 512, 28))


@query("d15_config_grid", "WITH p AS (SELECT DISTINCT o_orderpriority AS p FROM orders), s AS (SELECT DISTINCT o_orderstatus AS s FROM orders) SELECT p.p AS prio, s.s AS status, c.c AS channels, concat('prio', p.p, '-status', s.s, '-channels', c.c) AS name FROM p, s, (VALUES (16::BIGINT), (32::BIGINT)) c(c)")
def d15(spark, d):
    o = table(spark, d, "orders")
    axes = {n: sorted(r[0] for r in o.select(c).distinct().collect()) for n, c in (("prio", "o_orderpriority"), ("status", "o_orderstatus"))}
    return result(pt.config_grid(spark, **axes, channels=[16, 32]))


@query("d14_resample_by_loss", f"WITH {DENSE}, {STRAT}, ps AS (SELECT " + ", ".join(f"(st.{a} + {plastic_sql(chr(105), j)}) / {n}e0 AS p{a}" for j, (a, n) in enumerate(zip("xyz", RES))) + ", abs(g.value - 0.5e0) AS error FROM st JOIN g USING (x, y, z)), lo AS (SELECT " + ", ".join(f"CAST({cl(f'floor(p{a} * {n})', n)} AS INT) AS {a}" for a, n in zip("xyz", RES)) + f", sum(error) AS loss FROM ps GROUP BY 1, 2, 3), mo AS (SELECT max(loss) AS most FROM lo), dl AS (SELECT x, y, z, coalesce(loss, 0) AS value FROM c LEFT JOIN lo USING (x, y, z)), {ACCEPT.replace('JOIN dg USING', 'JOIN dl USING')}, pk AS (SELECT id, px, py, pz, value FROM sm, mo WHERE greatest(value / most, 0.05) > u ORDER BY id LIMIT (SELECT count(*) // 5 FROM orders)), ck AS (SELECT *, id // 64 AS chunk_id FROM pk), ch AS (SELECT chunk_id, row_number() OVER (ORDER BY {hashed_sql(0, 'chunk_id')}, chunk_id) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT chunk_id FROM ck)) SELECT id, {R6('px')} AS px, {R6('py')} AS py, {R6('pz')} AS pz, {R6('value')} AS value, chunk_id, place <= trunc(n * 0.2e0) AS validation FROM ck JOIN ch USING (chunk_id)")
def d14(spark, d):
    """Points where a predictor errs: its error grid becomes the density of new points."""
    s = pt.stratified_points(spark, RES, 2).join(grid(spark, d), ["x", "y", "z"])
    n = table(spark, d, "orders").count()
    errors = s.withColumn("error", F.abs(F.col("value") - 0.5))
    return result(pt.resample_by_loss(errors, RES, candidates(spark, n), lambda c, field: sampled(spark, d, field)(c), n // 5, 0.05, 512, 0.2).drop("u"))


# --- rays


VIEWS = 5


def frames(spark, d):
    n = table(spark, d, "region").count()
    return v.view_frame(pt.fibonacci_views(spark, n, 2.0), centre=(0.5, 0.5, 0.5))


def view(spark, d, size=12):
    box = spark.createDataFrame([(*[0.0] * 3, *[1.0] * 3)], "low_x double, low_y double, low_z double, high_x double, high_y double, high_z double")
    rays = ry.view_rays(frames(spark, d), size, size, 0.4, 0.4)
    return rays, sa.ray_clip(rays, box)


FRAMES = (f"n AS (SELECT count(*) AS n FROM region), vi AS (SELECT (i - 1)::INT AS view, asin(-1 + 2 * i / (n + 1)::DOUBLE) AS pitch, i * {ANGLE!r}::DOUBLE AS yaw FROM (SELECT unnest(range(n)) + 1 AS i, n FROM n)), "
          "fa AS (SELECT view, cos(-pitch) * cos(yaw) * 2 AS qx, sin(-pitch) * 2 AS qy, cos(-pitch) * sin(yaw) * 2 AS qz FROM vi), "
          "fb AS (SELECT view, qx + 0.5e0 AS ex, qy + 0.5e0 AS ey, qz + 0.5e0 AS ez, -qx / 2 AS wx, -qy / 2 AS wy, -qz / 2 AS wz FROM fa), "
          "fc AS (SELECT *, -wz / sqrt(wx * wx + wz * wz) AS rx, 0e0 AS ry, wx / sqrt(wx * wx + wz * wz) AS rz FROM fb), "
          "fd AS (SELECT *, ry * wz - rz * wy AS ux, rz * wx - rx * wz AS uy, rx * wy - ry * wx AS uz FROM fc), ")
VRAYS = FRAMES + ("ra0 AS (SELECT fd.*, (i.range % 12)::INT AS px, (i.range // 12)::INT AS py FROM fd, range(144) i), "
                  "ra1 AS (SELECT *, (2 * (px + 0.5e0) / 12 - 1) * 0.4e0 AS nx, (2 * (py + 0.5e0) / 12 - 1) * 0.4e0 AS ny FROM ra0), "
                  "ra2 AS (SELECT *, wx + rx * nx + ux * ny AS ax, wy + ry * nx + uy * ny AS ay, wz + rz * nx + uz * ny AS az FROM ra1), "
                  "ra AS (SELECT view, px, py, ex, ey, ez, ax / sqrt(ax * ax + ay * ay + az * az) AS dx, ay / sqrt(ax * ax + ay * ay + az * az) AS dy, az / sqrt(ax * ax + ay * ay + az * az) AS dz FROM ra2)")
CLIPPED = VRAYS + ", cl0 AS (SELECT *, " + ", ".join(f"least(-e{a} / d{a}, (1 - e{a}) / d{a}) AS n{a}, greatest(-e{a} / d{a}, (1 - e{a}) / d{a}) AS f{a}" for a in "xyz") + " FROM ra), cp AS (SELECT *, greatest(nx, ny, nz, 0) AS tmin, least(fx, fy, fz) AS tmax FROM cl0 WHERE greatest(nx, ny, nz, 0) <= least(fx, fy, fz))"


@query("r1_view_rays", f"WITH {VRAYS} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, {R6('dx')} AS dx, {R6('dy')} AS dy, {R6('dz')} AS dz FROM ra")
def r1(spark, d):
    return result(view(spark, d)[0].drop("ex", "ey", "ez"))


@query("r2_max_steps", f"WITH {CLIPPED} SELECT view::BIGINT AS view, trunc(max(tmax - tmin) / 0.0517e0)::BIGINT AS steps FROM cp GROUP BY view")
def r2(spark, d):
    return result(ry.max_steps(view(spark, d)[1], 0.0517))


STEPS = CLIPPED + ", sp AS (SELECT view, px, py, k, tmin + k * 0.0517e0 AS t, " + ", ".join(f"e{a} + (tmin + k * 0.0517e0) * d{a} AS w{a}" for a in "xyz") + " FROM (SELECT *, unnest(range(0, floor((tmax - tmin) / 0.0517e0)::BIGINT + 1)) AS k FROM cp))"


@query("r3_step_rays", f"WITH {STEPS} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, k::BIGINT AS k, {R6('t')} AS t, {R6('wx')} AS wx, {R6('wy')} AS wy, {R6('wz')} AS wz FROM sp")
def r3(spark, d):
    return result(ry.step_rays(view(spark, d)[1], 0.0517).select(*ry.RAY, "k", "t", "wx", "wy", "wz"))


OBJS = STEPS + ", o AS (SELECT view, px, py, k AS kk, t, " + ", ".join(f"least(greatest(w{a} * {n - 1}e0, 0), {n - 1}) AS o{a}" for a, n in zip("xyz", RES)) + " FROM sp)"
RC = CORNERS.replace("SELECT px, py, pz,", "SELECT view, px, py, kk, t,")
SEEN = f"{DENSE}, {OBJS}, {RC}, se AS (SELECT view, px, py, kk AS k, t, sum(w * value) AS value FROM k JOIN dg USING (x, y, z) GROUP BY 1, 2, 3, 4, 5)"


def seen(spark, d):
    return ry.ray_samples(ry.step_rays(view(spark, d)[1], 0.0517), dense(spark, d), RES, (0, 0, 0), (1, 1, 1), lambda c, p: v.tf_piecewise(c, PIECES, 0.0517))


@query("r4_ray_samples", f"WITH {SEEN} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, k::BIGINT AS k, {R6('value')} AS value, {R6(pieces_sql('value', 0))} AS r, {R6(pieces_sql('value', 3) + ' * 0.0517e0')} AS a FROM se")
def r4(spark, d):
    return result(seen(spark, d).select(*ry.RAY, "k", "value", F.col("rgba.r").alias("r"), F.col("rgba.a").alias("a")))


COMP = f"{SEEN}, co AS (SELECT view, px, py, k, t, {', '.join(f'{pieces_sql(chr(118) + chr(97) + chr(108) + chr(117) + chr(101), c)} AS {n}' for c, n in enumerate('rgb'))}, ({pieces_sql('value', 3)}) * 0.0517e0 AS a FROM se), cw AS (SELECT *, exp(-coalesce(sum(a) OVER (PARTITION BY view, px, py ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft FROM co)"


def image(spark, d, early=1.0):
    s = seen(spark, d).select(*ry.RAY, "k", "t", "rgba.*")
    return ry.composite(s, early_out=early)


def comp_sql(where=""):
    return f"WITH {COMP} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, " + ", ".join(f"{R6(f'sum(lft * (1 - exp(-a)) * {c})')} AS {n}" for n, c in (("r", "r"), ("g", "g"), ("b", "b"), ("alpha", "1"), ("depth", "t"))) + f" FROM cw {where} GROUP BY 1, 2, 3"


@query("r5_composite", comp_sql("WHERE lft > 1 - 0.6e0"))
def r5(spark, d):
    return result(image(spark, d, 0.6))


@query("r6_image_from_samples", f"WITH {COMP}, im AS (SELECT view, px, py, sum(lft * (1 - exp(-a)) * r) AS r, sum(lft * (1 - exp(-a))) AS alpha, sum(lft * (1 - exp(-a)) * t) AS depth FROM cw GROUP BY 1, 2, 3) SELECT view::BIGINT AS view, (px // 2)::BIGINT AS px, (py // 2)::BIGINT AS py, {R6('sum(r) / 4')} AS r, {R6('sum(alpha) / 4')} AS alpha, {R6('sum(alpha * depth) / sum(alpha)')} AS depth FROM im GROUP BY 1, 2, 3")
def r6q(spark, d):
    fine = image(spark, d).withColumn("px", F.floor(F.col("px") / 2)).withColumn("py", F.floor(F.col("py") / 2))
    return result(ry.image_from_samples(fine, 4).select(*ry.RAY, "r", "alpha", "depth"))


@query("r7_first_crossing", f"WITH {SEEN}, b AS (SELECT *, lag(t) OVER (PARTITION BY view, px, py ORDER BY k) AS before FROM se) SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, min(k)::BIGINT AS k, {R6('arg_min(t, k)')} AS t, {R6('arg_min(coalesce(before, -1), k)')} AS before FROM b WHERE value > 0.45 GROUP BY 1, 2, 3")
def r7(spark, d):
    return result(ry.first_crossing(seen(spark, d), 0.45).withColumn("before", F.coalesce("before", F.lit(-1.0))))


def _refined_sql(rounds: int) -> str:
    parts = ["b AS (SELECT *, lag(t) OVER (PARTITION BY view, px, py ORDER BY k) AS before FROM se)",
             "h0 AS (SELECT view, px, py, coalesce(arg_min(coalesce(before, t), k), min(t)) AS low, arg_min(t, k) AS high FROM b WHERE value > 0.45 GROUP BY 1, 2, 3)"]
    for k in range(rounds):
        place = ", ".join(f"least(greatest((e{a} + (low + high) * 0.5e0 * d{a}) * {n - 1}e0, 0), {n - 1}) AS o{a}" for a, n in zip("xyz", RES))
        corners = CORNERS.replace("k AS (", f"k{k} AS (").replace("FROM o,", f"FROM o{k},").replace("SELECT px, py, pz,", "SELECT view, px, py, low, high, t,")
        parts += [
            f"o{k} AS (SELECT view, px, py, low, high, (low + high) * 0.5e0 AS t, {place} FROM h{k} JOIN ra USING (view, px, py))",
            corners,
            f"s{k} AS (SELECT view, px, py, low, high, t, sum(w * value) AS value FROM k{k} JOIN dg USING (x, y, z) GROUP BY 1, 2, 3, 4, 5, 6)",
            f"h{k + 1} AS (SELECT view, px, py, CASE WHEN value > 0.45 THEN low ELSE t END AS low, CASE WHEN value > 0.45 THEN t ELSE high END AS high FROM s{k})",
        ]
    return f"WITH {SEEN}, {', '.join(parts)} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, {R6('high')} AS t FROM h{rounds}"


@query("r7_refined_crossing", _refined_sql(3))
def r7r(spark, d):
    rays = view(spark, d)[0]
    field = dense(spark, d)

    def at(hits):
        there = hits.join(rays, ry.RAY).withColumns({f"o{a}": v.clamp((F.col(f"e{a}") + F.col("t") * F.col(f"d{a}")) * float(n - 1), 0.0, float(n - 1)) for a, n in zip("xyz", RES)})
        return sa.sample(there, field, RES, [*ry.RAY, "low", "high", "t"])

    return result(ry.refine_crossing(ry.first_crossing(seen(spark, d), 0.45), at, 0.45, 3))


@query("r9_line_integrals", comp_sql())
def r9(spark, d):
    return result(ry.line_integrals(view(spark, d)[1], dense(spark, d), RES, (0, 0, 0), (1, 1, 1), 0.0517, lambda c, p: v.tf_piecewise(c, PIECES, 0.0517)))


# values below 0.45 are empty: steps there neither absorb nor have a colour
DMIN = 0.45
MARCHED = f"{SEEN}, co AS (SELECT view, px, py, k, t, {', '.join(f'{pieces_sql(chr(118) + chr(97) + chr(108) + chr(117) + chr(101), c)} AS {n}' for c, n in enumerate('rgb'))}, CASE WHEN value >= {DMIN}e0 THEN ({pieces_sql('value', 3)}) * 0.0517e0 * 40 ELSE 0 END AS a FROM se), cw AS (SELECT *, exp(-coalesce(sum(a) OVER (PARTITION BY view, px, py ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft FROM co)"


def marched(spark, d, **how):
    return ry.march(view(spark, d)[1], dense(spark, d), RES, (0, 0, 0), (1, 1, 1), 0.0517, lambda c, p: v.tf_piecewise(c, PIECES, 0.0517 * 40), brick=4, **how)


def marched_sql(early: str) -> str:
    w = f"CASE WHEN lft > 1 - {early} THEN lft * (1 - exp(-a)) ELSE 0 END"
    return f"WITH {MARCHED} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, " + ", ".join(f"{R6(f'sum({w} * {c})')} AS {n}" for n, c in (("r", "r"), ("g", "g"), ("b", "b"), ("alpha", "1"), ("depth", "t"))) + " FROM cw GROUP BY 1, 2, 3"


@query("r9_march_bricks", marched_sql("0.7e0"))
def r9m(spark, d):
    return result(marched(spark, d, early_out=0.7, dmin=DMIN).drop("samples"))


_MOVED = {f"{a}{s}": ", ".join(f"o{b}" if b != a else f"least(greatest(o{a} {'+' if s == 'p' else '-'} 1, 0), {n - 1}) AS o{a}" for b, n in zip("xyz", RES)) for a in "xyz" for s in "pm"}
NORMALS = MARCHED + "".join(
    f", o{side} AS (SELECT view, px, py, kk, t, {moved} FROM o), " + RC.replace("k AS (", f"k{side} AS (").replace("FROM o,", f"FROM o{side},") + f", s{side} AS (SELECT view, px, py, kk AS k, sum(w * value) AS v{side} FROM k{side} JOIN dg USING (x, y, z) GROUP BY 1, 2, 3, 4)"
    for side, moved in _MOVED.items()
) + ", gn AS (SELECT view, px, py, k, " + ", ".join(f"(v{a}p - v{a}m) * {0.5 * (n - 1)}e0 AS g{a}" for a, n in zip("xyz", RES)) + " FROM " + " JOIN ".join(f"s{side}" + (" USING (view, px, py, k)" if k else "") for k, side in enumerate(_MOVED)) + "), nn AS (SELECT view, px, py, k, " + ", ".join(f"g{a} / greatest(sqrt(gx * gx + gy * gy + gz * gz), 1e-30) AS n{a}" for a in "xyz") + " FROM gn)"


@query("r4_r5_normals", f"WITH {NORMALS} SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, {R6('sum(lft * (1 - exp(-a)))')} AS alpha, " + ", ".join(f"{R6(f'sum(lft * (1 - exp(-a)) * n{a})')} AS n{a}" for a in "xyz") + " FROM cw JOIN nn USING (view, px, py, k) GROUP BY 1, 2, 3")
def r5n(spark, d):
    """Normals along rays, blended with the weights of the colours."""
    return result(marched(spark, d, dmin=DMIN, normals=True).select(*ry.RAY, "alpha", "nx", "ny", "nz"))


@query("d10_screen_samples", f"WITH {COMP}, im AS (SELECT view, px, py, sum(lft * (1 - exp(-a)) * r) AS r, sum(lft * (1 - exp(-a))) AS alpha FROM cw GROUP BY 1, 2, 3) SELECT view::BIGINT AS view, px::BIGINT AS px, py::BIGINT AS py, {R6('r')} AS r, {R6('alpha')} AS alpha FROM im WHERE alpha * 0.9e0 + 0.1e0 >= {plastic_sql('(view * 144 + py * 12 + px)', 0, 1)}")
def d10(spark, d):
    kept = pt.screen_samples(image(spark, d), F.col("view") * 144 + F.col("py") * 12 + F.col("px"), 0.1)
    return result(kept.select(*ry.RAY, "r", "alpha"))


@query("w9_mean_of_passes", f"WITH l AS (SELECT l_orderkey, l_linenumber AS pass, min(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, pass::BIGINT AS pass, {R6('v')} AS value, {R6('avg(v) OVER (PARTITION BY l_orderkey ORDER BY pass ROWS UNBOUNDED PRECEDING)')} AS mean FROM l")
def w9(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("pass")).agg(F.min("l_discount").alias("value"))
    return result(ry.mean_of_passes(l, ["l_orderkey"]))


TF1 = "tf AS (SELECT label AS tf, x + 4 * (y + 4 * z) AS i, avg(abs(value)) AS v FROM v GROUP BY 1, 2), tb AS (SELECT tf, i, v AS r, v * v AS g, 1 - v AS b, v * 3 AS a FROM tf)"


@query("w5_preintegrate_1d", f"WITH {SMALL}, {TF1}, st AS (SELECT tf, i, " + ", ".join(f"(CASE WHEN i = 0 THEN 0.5e0 / 64 ELSE 1e0 / 64 END) * 0.5e0 * ({e} + coalesce(lag({e}) OVER w, {e})) AS {c}" for c, e in (("r", "r * a"), ("g", "g * a"), ("b", "b * a"), ("a", "a"))) + " FROM tb WINDOW w AS (PARTITION BY tf ORDER BY i)) SELECT tf::BIGINT AS tf, i::BIGINT AS i, " + ", ".join(f"{R6(f'sum({c}) OVER (PARTITION BY tf ORDER BY i)')} AS {c}" for c in "rgba") + " FROM st")
def w5(spark, d):
    t = small_volumes(spark, d).groupBy(F.col("label").alias("tf"), (F.col("x") + 4 * (F.col("y") + 4 * F.col("z"))).alias("i")).agg(F.avg(F.abs("value")).alias("v"))
    x = F.col("v")
    return result(ry.preintegrate_1d(t.select("tf", "i", x.alias("r"), (x * x).alias("g"), (1 - x).alias("b"), (x * 3).alias("a")), 64))
