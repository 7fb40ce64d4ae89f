"""Registered queries of value expressions and grid operators, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import grids as g
from ..operators import sampling as sa
from .bindings import CELLS, DENSE, GRID, IMAGES, PAIRS, POINTS, R6, RES, SERIES, SMALL, dense, grid, images, pairs, points, result, series, small_volumes, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


PIECES = [(0.1, 0.2, 0.9, 0.0, 0.0), (0.8, 0.4, 0.2, 2.0, 0.4), (0.9, 0.9, 0.5, 3.0, 0.7), (1.0, 0.9, 0.3, 5.0, 1.0)]
BELLS = [(0.9, 0.1, 0.2, 3.0, 0.3, 0.1), (0.2, 0.8, 0.1, 1.5, 0.6, 0.2)]
TABLE = [(k / 7, 1 - k / 7, k * k / 49, 4 * k / 7) for k in range(8)]
PARTS = "rgba"
KEY3 = ("px", "py", "pz")


def lst(x) -> str:
    return "[" + ", ".join(f"{float(a)!r}::DOUBLE" for a in x) + "]"


def rgba(df, c="c"):
    return df.select(*(k for k in df.columns if k != c), *(F.col(f"{c}.{p}").alias(p) for p in PARTS))


RGBA = ", ".join(f"{R6(p)} AS {p}" for p in PARTS)


def clampsql(e: str, lo, hi) -> str:
    return f"least(greatest({e}, {lo}), {hi})"


def table_sql(d: str, c: int, tab=TABLE) -> str:
    n = len(tab)
    at = f"({clampsql(d, '0e0', '1e0')} * {n}e0 - 0.5e0)"
    col = lst([row[c] for row in tab])
    low, high = (f"{col}[CAST({clampsql(f'floor({at}) + {s}', 0, n - 1)} AS INT) + 1]" for s in (0, 1))
    return f"({low} + ({at} - floor({at})) * ({high} - {low}))"


@query("p1_encode_decode", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, trunc(least(greatest(value * 65535, 0), 65535))::BIGINT AS code, {R6('trunc(least(greatest(value * 65535, 0), 65535)) / 65535e0')} AS back FROM g")
def p1(spark, d):
    out = grid(spark, d).withColumn("code", v.encode(F.col("value"), "ushort")).withColumn("back", v.decode(F.col("code"), "ushort"))
    return result(out.drop("value"))


@query("p2_object_space", f"WITH {POINTS} SELECT px, py, pz, {R6('px * 49')} AS ox, {R6('py * 10')} AS oy, {R6('pz * 8')} AS oz, true AS inside FROM p")
def p2(spark, d):
    return result(v.to_object_space(points(spark, d), (0, 0, 0), (1, 1, 1), RES), KEY3)


@query("p3_tf_identity", f"WITH {GRID}, t AS (SELECT *, least(greatest(value * 1.2, 0), 1) AS d FROM g) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('d * 0.7')} AS r, {R6('d * 0.7')} AS g, {R6('d * 0.7')} AS b, {R6('d * 5 * 0.1')} AS a FROM t")
def p3(spark, d):
    return result(rgba(grid(spark, d).withColumn("c", v.tf_identity(F.col("value") * 1.2, 5.0, 0.7, 0.1)).drop("value")))


def bells_sql(d: str, c: int) -> str:
    return " + ".join(f"{b[c]!r}::DOUBLE * exp(-power(({d} - {b[4]!r}) / {b[5]!r}, 2))" for b in BELLS)


@query("p4_tf_gaussian", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, " + ", ".join(f"{R6(bells_sql('value', c))} AS {p}" for c, p in enumerate(PARTS)) + " FROM g")
def p4(spark, d):
    return result(rgba(grid(spark, d).withColumn("c", v.tf_gaussian(F.col("value"), BELLS)).drop("value")))


def erf_sql(x: str) -> str:
    t = f"(1 / (1 + abs({x}) * 0.5e0))"
    exponent = f"{v.ERF[-1]!r}::DOUBLE"
    for c in reversed(v.ERF[:-1]):
        exponent = f"({exponent} * {t} + ({c!r}::DOUBLE))"
    return f"(sign({x}) * (1 - {t} * exp({exponent} - {x} * {x})))"


def segments_sql(c: int) -> str:
    out = []
    for b in BELLS:
        mean, width = f"{b[4]!r}::DOUBLE", f"{b[5]!r}::DOUBLE"
        near = " + ".join(f"exp(-power((m + h * ({p!r}::DOUBLE) - {mean}) / {width}, 2)) * {w / 2!r}::DOUBLE" for p, w in v.GAUSS)
        far = f"({erf_sql(f'((d - {mean}) / {width})')} - {erf_sql(f'((p - {mean}) / {width})')}) * {math.sqrt(math.pi) / 4 * b[5]!r}::DOUBLE / h"
        out.append(f"{b[c]!r}::DOUBLE * (CASE WHEN abs(h) < {width} / 4 THEN {near} ELSE {far} END)")
    return " + ".join(out)


@query("p4_tf_gaussian_analytic", f"WITH {DENSE}, t AS (SELECT x, y, z, value AS d, coalesce(lag(value) OVER (PARTITION BY y, z ORDER BY x), value) AS p FROM dg), k AS (SELECT *, (d + p) * 0.5e0 AS m, (d - p) * 0.5e0 AS h FROM t) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, " + ", ".join(f"{R6(segments_sql(c))} AS {p}" for c, p in enumerate(PARTS)) + " FROM k")
def p4a(spark, d):
    """Densities along x: the bells' means over each segment."""
    from pyspark.sql import Window

    line = dense(spark, d).withColumn("before", F.coalesce(F.lag("value").over(Window.partitionBy("y", "z").orderBy("x")), F.lit(-1.0)))
    return result(rgba(line.withColumn("c", v.tf_gaussian_analytic(F.col("value"), F.col("before"), BELLS)).drop("value", "before")))


def pieces_sql(d: str, c: int) -> str:
    out = ""
    steps = list(zip(PIECES, PIECES[1:]))
    for k, (lo, hi) in enumerate(steps):
        f = f"({clampsql(d, lo[4], hi[4])} - {lo[4]!r}::DOUBLE) / ({hi[4]!r}::DOUBLE - {lo[4]!r}::DOUBLE)"
        e = f"{lo[c]!r}::DOUBLE + {f} * ({hi[c]!r}::DOUBLE - {lo[c]!r}::DOUBLE)"
        out += f" WHEN {d} < {hi[4]!r} THEN {e}" if k + 1 < len(steps) else f" ELSE {e}"
    return f"CASE{out} END"


@query("p5_tf_piecewise", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, " + ", ".join(f"{R6(pieces_sql('value', c))} AS {p}" for c, p in enumerate(PARTS)) + " FROM g")
def p5(spark, d):
    return result(rgba(grid(spark, d).withColumn("c", v.tf_piecewise(F.col("value"), PIECES)).drop("value")))


@query("p6_tf_table", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, " + ", ".join(f"{R6(table_sql('value', c))} AS {p}" for c, p in enumerate(PARTS)) + " FROM g")
def p6(spark, d):
    return result(rgba(grid(spark, d).withColumn("c", v.tf_table(F.col("value"), TABLE)).drop("value")))


@query("p7_apply_tf", f"WITH {GRID}, t AS (SELECT *, (value - 0.2e0) / (0.7e0 - 0.2e0) AS d FROM g) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, " + ", ".join(f"CASE WHEN value < 0.2 THEN 0e0 ELSE {R6(table_sql('d', c))} END AS {p}" for c, p in enumerate(PARTS)) + " FROM t")
def p7(spark, d):
    return result(rgba(grid(spark, d).withColumn("c", v.apply_tf(F.col("value"), lambda c: v.tf_table(c, TABLE), 0.2, 0.7)).drop("value")))


INTEGRAL = []
for _k, _row in enumerate(TABLE):
    _last, _w = (TABLE[_k - 1], 1 / 8) if _k else (_row, 1 / 16)
    _before = INTEGRAL[-1] if INTEGRAL else (0.0,) * 4
    INTEGRAL.append(tuple(_before[c] + _w * 0.5 * (_row[c] * _row[3] + _last[c] * _last[3]) for c in range(3)) + (_before[3] + _w * 0.5 * (_row[3] + _last[3]),))


def _p8sql() -> str:
    front, back = ([table_sql(x, c, INTEGRAL) for c in range(4)] for x in ("p", "d"))
    plain = [table_sql("d", c) + (" * 0.5" if c == 3 else "") for c in range(4)]
    rgb = [f"({b} - {f}) * 0.5 / (d - p)" for f, b in zip(front[:3], back[:3])]
    a = f"1 - exp(({front[3]} - {back[3]}) * 0.5 / (d - p))"
    inner = f"SELECT x, y, z, abs(p - d) < 1e-3 AS near, {', '.join(f'{e} AS p{k}' for k, e in enumerate(plain))}, {', '.join(f'{e} AS q{k}' for k, e in enumerate([*rgb, a]))} FROM t"
    cols = [f"CASE WHEN near THEN p{k} WHEN q3 > 1e-5 THEN q{k} / q3 ELSE q{k} END" for k in range(3)] + ["CASE WHEN near THEN p3 ELSE q3 END"]
    return f"WITH {DENSE}, t AS (SELECT x, y, z, least(greatest(value, 0e0), 1e0) AS d, coalesce(lag(value) OVER (PARTITION BY y, z ORDER BY x), value) AS p FROM dg), u AS ({inner}) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {', '.join(f'{R6(e)} AS {n}' for e, n in zip(cols, PARTS))} FROM u"


def _with_before(spark, d):
    from pyspark.sql import Window

    return dense(spark, d).withColumn("before", F.coalesce(F.lag("value").over(Window.partitionBy("y", "z").orderBy("x")), F.lit(-1.0)))


@query("p8_tf_preintegrated_1d", _p8sql())
def p8(spark, d):
    return result(rgba(_with_before(spark, d).withColumn("c", v.tf_preintegrated_1d(F.col("value"), F.col("before"), TABLE, INTEGRAL, 0.5)).drop("value", "before")))


@query("p9_tf_preintegrated_2d", f"""WITH {DENSE}, t AS (SELECT x, y, z, value AS d, coalesce(lag(value) OVER (PARTITION BY y, z ORDER BY x), value) AS p FROM dg),
pair AS (SELECT i.range AS i, j.range AS j, s.range + 1 AS s, {", ".join(table_sql("((1 - (s.range + 1) * 0.0625e0) * ((i.range + 0.5e0) / 16) + (s.range + 1) * 0.0625e0 * ((j.range + 0.5e0) / 16))", c) + f" AS {p}" for c, p in enumerate(PARTS))} FROM range(16) i, range(16) j, range(16) s),
w AS (SELECT *, sum(a * 0.03125e0) OVER (PARTITION BY i, j ORDER BY s) AS sofar FROM pair),
tab AS (SELECT i, j, sum(r * a * 0.03125e0 * exp(-sofar)) AS r, sum(g * a * 0.03125e0 * exp(-sofar)) AS g, sum(b * a * 0.03125e0 * exp(-sofar)) AS b, 1 - exp(-sum(a * 0.03125e0)) AS a FROM w GROUP BY 1, 2)
SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6("CASE WHEN a > 1e-5 THEN r / a ELSE r END")} AS r, {R6("CASE WHEN a > 1e-5 THEN g / a ELSE g END")} AS g, {R6("CASE WHEN a > 1e-5 THEN b / a ELSE b END")} AS b, {R6("a")} AS a
FROM t JOIN tab ON tab.i = least(greatest(floor(p * 16), 0), 15) AND tab.j = least(greatest(floor(d * 16), 0), 15)""")
def p9(spark, d):
    """The nearest entry of a table of (previous, current) densities."""
    from ..operators.rays import preintegrated_2d

    return result(preintegrated_2d(_with_before(spark, d), _pairs_table(spark), 16, ["x", "y", "z"]))


def _pairs_table(spark):
    from ..operators.rays import preintegrate_2d

    ends = spark.range(256).select((F.col("id") % 16).cast("int").alias("i"), F.floor(F.col("id") / 16).cast("int").alias("j"))
    ends = ends.withColumns({"start": (F.col("i") + 0.5) / 16, "stop": (F.col("j") + 0.5) / 16})
    return preintegrate_2d(ends, lambda c: v.tf_table(c, TABLE), 0.5, 16)


@query("g11_preintegrate_2d", f"""WITH s AS (SELECT DISTINCT round(100 * l_discount) AS i, round(100 * l_tax) AS j FROM lineitem),
pair AS (SELECT i, j, k.range + 1 AS s, {", ".join(table_sql("((1 - (k.range + 1) * 0.0625e0) * ((i + 0.5e0) / 11) + (k.range + 1) * 0.0625e0 * ((j + 0.5e0) / 9))", c) + f" AS {p}" for c, p in enumerate(PARTS))} FROM s, range(16) k),
w AS (SELECT *, sum(a * 0.0625e0) OVER (PARTITION BY i, j ORDER BY s) AS sofar FROM pair)
SELECT i::BIGINT AS i, j::BIGINT AS j, {R6("sum(r * a * 0.0625e0 * exp(-sofar))")} AS r, {R6("sum(g * a * 0.0625e0 * exp(-sofar))")} AS g, {R6("sum(b * a * 0.0625e0 * exp(-sofar))")} AS b, {R6("1 - exp(-sum(a * 0.0625e0))")} AS a FROM w GROUP BY 1, 2""")
def g11(spark, d):
    from ..operators.rays import preintegrate_2d

    ends = table(spark, d, "lineitem").select(F.round(100 * F.col("l_discount")).cast("int").alias("i"), F.round(100 * F.col("l_tax")).cast("int").alias("j")).distinct()
    ends = ends.withColumns({"start": (F.col("i") + 0.5) / 11, "stop": (F.col("j") + 0.5) / 9})
    return result(preintegrate_2d(ends, lambda c: v.tf_table(c, TABLE), 1.0, 16))


@query("p10_view_frame", f"""WITH w AS (SELECT DISTINCT l_discount * 8 AS pitch, l_tax * 30 AS yaw FROM lineitem),
e AS (SELECT pitch, yaw, cos(-pitch) * cos(yaw) * 2 AS ex, sin(-pitch) * 2 AS ey, cos(-pitch) * sin(yaw) * 2 AS ez FROM w)
SELECT pitch, yaw, {R6("ex")} AS ex, {R6("ey")} AS ey, {R6("ez")} AS ez, {R6("ez / sqrt(ex * ex + ez * ez)")} AS rx, 0e0 AS ry, {R6("-ex / sqrt(ex * ex + ez * ez)")} AS rz FROM e""")
def p10(spark, d):
    views = table(spark, d, "lineitem").select((F.col("l_discount") * 8).alias("pitch"), (F.col("l_tax") * 30).alias("yaw")).distinct().withColumn("distance", F.lit(2.0))
    out = v.view_frame(views).select("pitch", "yaw", "ex", "ey", "ez", "rx", "ry", "rz")
    return result(out.withColumn("ry", F.col("ry") + 0.0), ("pitch", "yaw"))


@query("p15_fourier_features", f"WITH {POINTS} SELECT px, py, pz, " + ", ".join(f"{R6(f'{fn}({c} * {2 * math.pi * 2 ** b!r})')} AS f_{fn}{3 * b + k}" for b in range(2) for k, c in enumerate(KEY3) for fn in ("cos", "sin")) + " FROM p")
def p15(spark, d):
    return result(v.fourier_features(points(spark, d), KEY3, 2), KEY3)


@query("p17_time_index", f"WITH {SERIES} SELECT DISTINCT ensemble::BIGINT AS ensemble, time::BIGINT AS time, {R6('least(greatest((time - 6) / 12e0, 0), 5)')} AS idx FROM s")
def p17(spark, d):
    return result(series(spark, d).select("ensemble", "time").distinct().withColumn("idx", v.time_index(F.col("time"), 6, 12, 6)))


@query("p18_tag_timesteps", f"WITH {SERIES}, t AS (SELECT DISTINCT time FROM s) SELECT time::BIGINT AS time, time % 12 = 6 AS is_keyframe, time % 3 = 0 AS is_trained FROM t")
def p18(spark, d):
    t = series(spark, d).select("time").distinct()
    return result(v.tag_timesteps(t, t.where("time % 12 = 6"), t.where("time % 3 = 0")))


@query("p19_quantize_uniform", f"WITH {SMALL} SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, trunc(value / 0.05e0 + sign(value) * 0.5e0)::BIGINT AS q, {R6('trunc(value / 0.05e0 + sign(value) * 0.5e0) * 0.05e0')} AS back FROM v")
def p19(spark, d):
    out = small_volumes(spark, d).withColumn("q", v.quantize_uniform(F.col("value"), 0.05)).withColumn("back", v.unquantize_uniform(F.col("q"), 0.05))
    return result(out.drop("value", "label"))


@query("p20_quantize_deadzone", f"WITH {SMALL}, q AS (SELECT *, trunc(value / 0.05e0) AS q FROM v) SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, q::BIGINT AS q, {R6('(q + sign(q) * 0.5e0) * 0.05e0')} AS back FROM q")
def p20(spark, d):
    out = small_volumes(spark, d).withColumn("q", v.quantize_deadzone(F.col("value"), 0.05)).withColumn("back", v.unquantize_deadzone(F.col("q"), 0.05))
    return result(out.drop("value", "label"))


@query("p21_symbolize", f"WITH {SMALL}, q AS (SELECT *, trunc(value / 0.05e0)::BIGINT AS q FROM v) SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, 2 * abs(q) - CASE WHEN q < 0 THEN 1 ELSE 0 END AS symbol, q AS back FROM q")
def p21(spark, d):
    out = small_volumes(spark, d).withColumn("symbol", v.symbolize(v.quantize_deadzone(F.col("value"), 0.05))).withColumn("back", v.unsymbolize(F.col("symbol")))
    return result(out.drop("value", "label"))


@query("p22_masked_pixels", f"WITH {IMAGES} SELECT image, x::BIGINT AS x, y::BIGINT AS y FROM im WHERE value * 0.8e0 + 0.2e0 >= (0.5e0 + (x + 30 * y + 1) * 0.618033988749895e0) - floor(0.5e0 + (x + 30 * y + 1) * 0.618033988749895e0)")
def p22(spark, d):
    i = 0.5 + (F.col("x") + 30 * F.col("y") + 1) * 0.618033988749895
    return result(images(spark, d).where(v.masked(F.col("value"), i - F.floor(i), 0.2)).select("image", "x", "y"))


@query("g8_clip_scale", f"WITH {SMALL} SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('least(greatest(value, 0), 0.15e0) / 0.15e0')} AS value FROM v")
def g8(spark, d):
    return result(small_volumes(spark, d).withColumn("value", v.clip_scale(F.col("value"), 0.0, 0.15)).drop("label"))


# --- grids


@query("a1_volume_histogram", f"WITH {GRID}, m AS (SELECT min(value) AS lo, max(value) AS hi FROM g), h AS (SELECT trunc(511 * (value - lo) / greatest(1e-6, hi - lo))::BIGINT AS bin, count(*) AS n FROM g, m GROUP BY 1) SELECT bin, n, max(n) OVER () AS largest FROM h")
def a1(spark, d):
    return result(g.volume_histogram(grid(spark, d)))


@query("a2_value_range", f"WITH {SERIES} SELECT ensemble::BIGINT AS ensemble, time::BIGINT AS time, {R6('min(value)')} AS low, {R6('max(value)')} AS high, {R6('avg(value)')} AS mean FROM s GROUP BY ensemble, time")
def a2(spark, d):
    return result(g.value_range(series(spark, d), ["ensemble", "time"]))


def pool_sql(new, source="dg") -> str:
    part = ", ".join(f"unnest(range(({a} * {m}) // {n}, -((-({a} + 1) * {m}) // {n}))) AS {a}" for a, n, m in zip("xyz", RES, new))
    return f"SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('avg(value)')} AS value FROM (SELECT a.range AS x, b.range AS y, c2.range AS z, value FROM dg JOIN range({new[0]}) a ON dg.x >= (a.range * 50) // {new[0]} AND dg.x < ((a.range + 1) * 50 + {new[0]} - 1) // {new[0]} JOIN range({new[1]}) b ON dg.y >= (b.range * 11) // {new[1]} AND dg.y < ((b.range + 1) * 11 + {new[1]} - 1) // {new[1]} JOIN range({new[2]}) c2 ON dg.z >= (c2.range * 9) // {new[2]} AND dg.z < ((c2.range + 1) * 9 + {new[2]} - 1) // {new[2]}) GROUP BY 1, 2, 3"


@query("a3_mipmap_average", f"WITH {DENSE} " + pool_sql((25, 5, 4)))
def a3(spark, d):
    return result(g.mipmap(dense(spark, d), RES, 1))


def inverse_sql(i: str, base: int, digits: int) -> str:
    return "(" + " + ".join(f"({i} // {base ** k} % {base}) / {float(base ** (k + 1))!r}::DOUBLE" for k in range(digits)) + ")"


def _halton_pick() -> str:
    new = (25, 5, 4)
    i = "(x + 25 * (y + 5 * z))"
    place = [f"(({a} * {n}) // {m} + floor(((({a} + 1) * {n} + {m} - 1) // {m} - ({a} * {n}) // {m}) * {inverse_sql(i, b, 10)}))::BIGINT AS s{a}" for a, n, m, b in zip("xyz", RES, new, (3, 5, 7))]
    return f"WITH {DENSE}, o AS (SELECT a.range AS x, b.range AS y, e.range AS z FROM range(25) a, range(5) b, range(4) e), q AS (SELECT x, y, z, {', '.join(place)} FROM o) SELECT q.x::BIGINT AS x, q.y::BIGINT AS y, q.z::BIGINT AS z, {R6('value')} AS value FROM q JOIN dg ON dg.x = sx AND dg.y = sy AND dg.z = sz"


@query("a4_mipmap_halton", _halton_pick())
def a4(spark, d):
    return result(g.mipmap_halton(dense(spark, d), RES, 1))


@query("a5_resample", f"WITH {DENSE} " + pool_sql((20, 7, 6)))
def a5(spark, d):
    return result(g.resample(dense(spark, d), RES, (20, 7, 6)))


@query("a6_memory_report", f"WITH {SERIES} SELECT ensemble::BIGINT AS volume_id, (sum(4 * 50 * 11 * 9))::BIGINT AS bytes FROM (SELECT DISTINCT ensemble, time FROM s) GROUP BY ensemble")
def a6(spark, d):
    f = series(spark, d).select(F.col("ensemble").alias("volume_id"), "time").distinct()
    return result(g.memory_report(f.withColumns({"dtype": F.lit("float"), "channels": F.lit(1), "size_x": F.lit(50), "size_y": F.lit(11), "size_z": F.lit(9)})))


@query("a20_max_abs", f"WITH {SMALL} SELECT volume_id, {R6('max(abs(value))')} AS max_abs FROM v GROUP BY volume_id")
def a20(spark, d):
    return result(g.max_abs(small_volumes(spark, d), ["volume_id"]))


@query("a32_smoothness", f"WITH {DENSE}, " + ", ".join(f"s{a} AS (SELECT '{a}' AS axis, lead(value) OVER (PARTITION BY {', '.join(b for b in 'xyz' if b != a)} ORDER BY {a}) - value AS e FROM dg)" for a in "xyz") + f", u AS (SELECT * FROM sx UNION ALL SELECT * FROM sy UNION ALL SELECT * FROM sz) SELECT axis, {R6('avg(e * e)')} AS mean, {R6('sum(e * e)')} AS total FROM u WHERE e IS NOT NULL GROUP BY axis")
def a32(spark, d):
    return result(g.smoothness(dense(spark, d)))


@query("j9_compare_grids", f"WITH {GRID}, b AS (SELECT x, y, z, trunc(value * 64) / 64e0 AS value FROM g WHERE x < 40) SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('g.value')} AS left, {R6('b.value')} AS right FROM g FULL JOIN b USING (x, y, z) WHERE g.value IS NULL OR b.value IS NULL OR abs(g.value - b.value) > 0.005")
def j9(spark, d):
    a = grid(spark, d)
    b = a.where("x < 40").withColumn("value", v.truncate(F.col("value") * 64) / 64)
    return result(g.compare_grids(a, b, 0.005))


@query("g1_slice_grid", f"WITH {GRID} SELECT ((x - 4) // 3)::BIGINT AS x, y::BIGINT AS y, (z - 1)::BIGINT AS z, {R6('value')} AS value FROM g WHERE x >= 4 AND x < 41 AND (x - 4) % 3 = 0 AND z >= 1 AND z < 8")
def g1(spark, d):
    return result(g.slice_grid(grid(spark, d), RES, [(4, 41, 3), (0, -1, 1), (1, -2, 1)]))


BRICK_OWN = ", ".join(f"unnest(list_distinct([({a} - 1 + 800) // 8 - 100, {a} // 8, ({a} + 1) // 8])) AS b{a}" for a in "xyz")


@query("g3_to_bricks", f"WITH {DENSE}, hx AS (SELECT *, unnest(list_distinct([(x + 7) // 8 - 1, x // 8, (x + 1) // 8])) AS bx FROM dg), hy AS (SELECT *, unnest(list_distinct([(y + 7) // 8 - 1, y // 8, (y + 1) // 8])) AS b_y FROM hx), hz AS (SELECT *, unnest(list_distinct([(z + 7) // 8 - 1, z // 8, (z + 1) // 8])) AS bz FROM hy) SELECT bx::BIGINT AS bx, b_y::BIGINT AS b_y, bz::BIGINT AS bz, count(*)::BIGINT AS cells, {R6('sum(value)')} AS total FROM hz WHERE bx >= 0 AND b_y >= 0 AND bz >= 0 GROUP BY 1, 2, 3")
def g3(spark, d):
    b = g.to_bricks(dense(spark, d), 8, 1)
    return result(b.select("bx", F.col("by").alias("b_y"), "bz", F.size("values").alias("cells"), F.aggregate("values", F.lit(0.0), lambda s, c: s + c["value"]).alias("total")))


@query("g4_from_bricks", f"WITH {DENSE} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('value')} AS value FROM dg")
def g4(spark, d):
    return result(g.from_bricks(g.to_bricks(dense(spark, d), 8, 1), 8))


@query("g9_pad_to_cube", f"WITH {GRID}, c AS (SELECT CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(d.range AS INT) AS z FROM range(50) a, range(50) b, range(50) d) SELECT c.x::BIGINT AS x, c.y::BIGINT AS y, c.z::BIGINT AS z, {R6('coalesce(value, 0)')} AS value FROM c LEFT JOIN g ON g.x = c.x AND g.y + 19 = c.y AND g.z + 20 = c.z")
def g9(spark, d):
    return result(g.pad_to_cube(grid(spark, d), RES))


@query("g10_stack_channels", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, 0::BIGINT AS channel, {R6('value')} AS value FROM g UNION ALL SELECT x, y, z, 1, {R6('value * value')} FROM g")
def g10(spark, d):
    a = grid(spark, d).withColumn("channel", F.lit(0))
    return result(g.stack_channels(a, a.withColumn("value", F.col("value") * F.col("value")), 1))


@query("s12_add_select_feature", f"WITH {GRID} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('1 - value')} AS value, 'rest' AS feature FROM g")
def s12(spark, d):
    a = grid(spark, d)
    both = g.add_feature(a.withColumn("feature", F.lit("density")), "rest", a.withColumn("value", 1 - F.col("value")))
    return result(g.select_feature(both, ["density", "rest"], 1))


def _fill_sql(levels: list[tuple[int, int]]) -> str:
    """The pyramid of one image table im(image, x, y, value, mask) in SQL."""
    parts = []
    for k, ((w, h), (w2, h2)) in enumerate(zip(levels, levels[1:])):
        parts.append(f"d{k + 1} AS (SELECT image, a.range AS x, b.range AS y, avg(value) FILTER (mask >= 0.5) AS v FROM d{k} JOIN range({w2}) a ON d{k}.x >= (a.range * {w}) // {w2} AND d{k}.x < ((a.range + 1) * {w} + {w2} - 1) // {w2} JOIN range({h2}) b ON d{k}.y >= (b.range * {h}) // {h2} AND d{k}.y < ((b.range + 1) * {h} + {h2} - 1) // {h2} GROUP BY 1, 2, 3)")
        parts[-1] = parts[-1].replace("SELECT image, a.range", "SELECT image, x, y, coalesce(v, 0) AS value, CASE WHEN v IS NULL THEN 0e0 ELSE 1e0 END AS mask FROM (SELECT image, a.range", 1)[:-1] + "))"
    last = len(levels) - 1
    parts.append(f"u{last} AS (SELECT * FROM d{last})")
    for k in range(last - 1, -1, -1):
        near = " UNION ALL ".join(f"SELECT image, x, y, x // 2 + {a} * CASE WHEN x % 2 = 0 THEN -1 ELSE 1 END AS lx, y // 2 + {b} * CASE WHEN y % 2 = 0 THEN -1 ELSE 1 END AS ly, {[0.5625, 0.1875, 0.0625][a + b]}e0 AS w FROM d{k} WHERE mask < 0.5" for a in (0, 1) for b in (0, 1))
        parts.append(f"n{k} AS (SELECT n.image, n.x, n.y, sum(w * u.value) / sum(w) AS filled FROM ({near}) n JOIN u{k + 1} u ON u.image = n.image AND u.x = lx AND u.y = ly AND u.mask >= 0.5 GROUP BY 1, 2, 3)")
        parts.append(f"u{k} AS (SELECT d.image, d.x, d.y, CASE WHEN d.mask >= 0.5 THEN d.value ELSE coalesce(filled, 0) END AS value, CASE WHEN d.mask >= 0.5 OR filled IS NOT NULL THEN 1e0 ELSE 0e0 END AS mask FROM d{k} d LEFT JOIN n{k} n ON n.image = d.image AND n.x = d.x AND n.y = d.y)")
    return ", ".join(parts)


HOLES = "CASE WHEN (x * 7 + y * 3) % 5 < 3 THEN 0e0 ELSE mask END"


@query("g6_fill_missing", f"WITH {IMAGES}, d0 AS (SELECT image, x, y, value, {HOLES} AS mask FROM im), {_fill_sql([(30, 24), (15, 12), (7, 6), (3, 3), (1, 1)])} SELECT image, x::BIGINT AS x, y::BIGINT AS y, {R6('value')} AS value, mask FROM u0")
def g6(spark, d):
    holes = images(spark, d).withColumn("mask", F.when((F.col("x") * 7 + F.col("y") * 3) % 5 < 3, 0.0).otherwise(F.col("mask")))
    return result(g.fill_missing(holes, 30, 24, ["image"]))


def _fractional_sql(levels) -> str:
    """The pyramid with masks between 0 and 1 in SQL."""
    parts = []
    for k, ((w, h), (w2, h2)) in enumerate(zip(levels, levels[1:])):
        parts.append(f"d{k + 1} AS (SELECT image, a.range AS x, b.range AS y, CASE WHEN sum(mask) > 0 THEN sum(mask * value) / sum(mask) ELSE 0 END AS value, max(mask) AS mask FROM d{k} JOIN range({w2}) a ON d{k}.x >= (a.range * {w}) // {w2} AND d{k}.x < ((a.range + 1) * {w} + {w2} - 1) // {w2} JOIN range({h2}) b ON d{k}.y >= (b.range * {h}) // {h2} AND d{k}.y < ((b.range + 1) * {h} + {h2} - 1) // {h2} GROUP BY 1, 2, 3)")
    last = len(levels) - 1
    parts.append(f"u{last} AS (SELECT * FROM d{last})")
    for k in range(last - 1, -1, -1):
        near = " UNION ALL ".join(f"SELECT image, x, y, x // 2 + {a} * CASE WHEN x % 2 = 0 THEN -1 ELSE 1 END AS lx, y // 2 + {b} * CASE WHEN y % 2 = 0 THEN -1 ELSE 1 END AS ly, {[0.5625, 0.1875, 0.0625][a + b]}e0 AS w FROM d{k}" for a in (0, 1) for b in (0, 1))
        parts.append(f"n{k} AS (SELECT n.image, n.x, n.y, sum(w * u.mask * u.value) AS s, sum(w * u.mask) AS n, sum(w * u.mask) / sum(w) AS m FROM ({near}) n JOIN u{k + 1} u ON u.image = n.image AND u.x = lx AND u.y = ly GROUP BY 1, 2, 3)")
        parts.append(f"u{k} AS (SELECT d.image, d.x, d.y, d.mask * d.value + (1 - d.mask) * CASE WHEN n > 0 THEN s / n ELSE 0 END AS value, d.mask + (1 - d.mask) * coalesce(m, 0) AS mask FROM d{k} d LEFT JOIN n{k} n ON n.image = d.image AND n.x = d.x AND n.y = d.y)")
    return ", ".join(parts)


@query("g7_fill_fractional", f"WITH {IMAGES}, d0 AS (SELECT image, x, y, value, CASE WHEN (x * 7 + y * 3) % 5 < 3 THEN (x % 4) / 8e0 ELSE mask END AS mask FROM im), {_fractional_sql([(30, 24), (15, 12), (7, 6), (3, 3), (1, 1)])} SELECT image, x::BIGINT AS x, y::BIGINT AS y, {R6('value')} AS value, {R6('mask')} AS mask FROM u0")
def g7(spark, d):
    holes = images(spark, d).withColumn("mask", F.when((F.col("x") * 7 + F.col("y") * 3) % 5 < 3, (F.col("x") % 4) / 8).otherwise(F.col("mask")))
    return result(g.fill_fractional(holes, 30, 24, ["image"]))
