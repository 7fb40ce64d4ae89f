"""Registered queries of metrics, experiments, compression and scoring, with their SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import values as v
from ..operators import compress as cp
from ..operators import grids as g
from ..operators import metrics as mt
from ..operators import sampling as sa
from ..operators.scoring import Model, evaluate_model, latent_inputs, score
from .bindings import DENSE, GRID, IMAGES, PAIRS, POINTS, R6, RES, RUNS, SERIES, SMALL, dense, grid, images, pairs, points, result, runs, series, small_volumes, table
from .queries_sampling import BLENDED, CELL, GRAD, J2SQL, LATENT, MEMBERS, TIMES, at_points, framed_grids, framed_points, latent_grids
from .queries_values import KEY3, query

E2 = "(predicted - truth)"


@query("a7_l1_l2", f"WITH {PAIRS} SELECT status, {R6(f'avg(abs{E2})')} AS l1, {R6(f'avg({E2} * {E2})')} AS l2, {R6(f'avg(abs{E2}) * 0.7 + avg({E2} * {E2}) * 0.3')} AS total FROM pr GROUP BY status")
def a7(spark, d):
    return result(mt.l1_l2(pairs(spark, d), ["status"], 0.7, 0.3))


CHANNELS = f"{IMAGES}, ch AS (SELECT image, x, y, c.range AS channel, CASE WHEN c.range = 3 THEN value ELSE value * (c.range + 1) / 3 END AS truth, trunc((CASE WHEN c.range = 3 THEN value ELSE value * (c.range + 1) / 3 END) * 16 + 0.5e0) / 16 AS predicted FROM im, range(4) c)"


def channels(spark, d):
    c = images(spark, d).withColumn("channel", F.explode(F.sequence(F.lit(0), F.lit(3))))
    t = c.withColumn("truth", F.when(F.col("channel") == 3, F.col("value")).otherwise(F.col("value") * (F.col("channel") + 1) / 3))
    return t.withColumn("predicted", v.quantize_uniform(F.col("truth"), 1 / 16) / 16)


@query("a8_rgbo_losses", f"WITH {CHANNELS}, s AS (SELECT image, avg(abs{E2}) FILTER (channel < 3) AS a, avg(abs{E2}) FILTER (channel = 3) AS b, avg({E2} * {E2}) FILTER (channel < 3) AS c, avg({E2} * {E2}) FILTER (channel = 3) AS e FROM ch GROUP BY image) SELECT image, {R6('a')} AS l1_rgb, {R6('b')} AS l1_o, {R6('c')} AS l2_rgb, {R6('e')} AS l2_o, {R6('a + 0.5 * b')} AS l1, {R6('c + 0.5 * e')} AS l2 FROM s")
def a8(spark, d):
    return result(mt.rgbo_losses(channels(spark, d), ["image"], 0.5))


@query("a9_screen_losses", f"WITH {CHANNELS}, s AS (SELECT c.image, c.truth * a.truth AS truth, c.predicted * a.truth AS predicted FROM ch c JOIN ch a ON a.image = c.image AND a.x = c.x AND a.y = c.y AND a.channel = 3 WHERE c.channel < 3) SELECT image, {R6(f'avg(abs{E2})')} AS l1, {R6(f'avg({E2} * {E2})')} AS l2 FROM s GROUP BY image")
def a9(spark, d):
    return result(mt.screen_losses(channels(spark, d), ["image", "x", "y"], ["image"]))


@query("a10_array_stats", f"WITH {PAIRS}, s AS (SELECT status, count(*) AS n, max(truth) - min(truth) AS range, avg(truth) AS mean, avg(truth * truth) - avg(truth) * avg(truth) AS variance, avg{E2} AS mean_error, avg(abs{E2}) AS mean_abs_error, max(abs{E2}) AS max_abs_error, sqrt(avg({E2} * {E2})) AS rmse, avg(predicted) AS my, avg(predicted * predicted) - avg(predicted) * avg(predicted) AS vy, sum(truth * predicted) AS xy FROM pr GROUP BY status) SELECT status, n, {R6('range')} AS range, {R6('mean')} AS mean, {R6('variance')} AS variance, {R6('mean_error')} AS mean_error, {R6('mean_abs_error')} AS mean_abs_error, {R6('max_abs_error')} AS max_abs_error, {R6('rmse')} AS rmse, {R6('20 * log10(sqrt(variance) / rmse)')} AS snr, {R6('20 * log10(range / rmse)')} AS psnr, {R6('(xy - n * mean * my) / (n - 1) / sqrt(variance * vy)')} AS ncc FROM s")
def a10(spark, d):
    return result(mt.array_stats(pairs(spark, d), ["status"]))


@query("a11_psnr", f"WITH {PAIRS} SELECT status, {R6(f'10 * log10(1 / avg({E2} * {E2}))')} AS psnr FROM pr GROUP BY status")
def a11(spark, d):
    return result(mt.psnr(pairs(spark, d), ["status"]))


TWO = f"{GRAD}, q AS (SELECT x, y, z, gx AS tx, gy AS ty, gz AS tz, trunc(gx * 64) / 64 AS qx, trunc(gy * 64) / 64 AS qy, trunc(gz * 64) / 64 AS qz FROM gr), er AS (SELECT *, (abs(tx - qx) + abs(ty - qy) + abs(tz - qz)) / 3 AS l1, ((tx - qx) * (tx - qx) + (ty - qy) * (ty - qy) + (tz - qz) * (tz - qz)) / 3 AS l2, abs(sqrt(tx * tx + ty * ty + tz * tz) - sqrt(qx * qx + qy * qy + qz * qz)) AS length_error, (tx * qx + ty * qy + tz * qz) / (greatest(sqrt(tx * tx + ty * ty + tz * tz), 1e-5) * greatest(sqrt(qx * qx + qy * qy + qz * qz), 1e-5)) AS cosine, sqrt(tx * tx + ty * ty + tz * tz) AS true_length FROM q)"


def gradient_pairs(spark, d):
    gr = sa.gradient(dense(spark, d))
    both = gr.select("x", "y", "z", *(F.col(f"g{a}").alias(f"t{a}") for a in "xyz"), *((v.truncate(F.col(f"g{a}") * 64) / 64).alias(f"q{a}") for a in "xyz"))
    return mt.gradient_errors(both)


@query("a12_gradient_errors", f"WITH {DENSE}, {TWO} SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('l1')} AS l1, {R6('l2')} AS l2, {R6('length_error')} AS length_error, {R6('cosine')} AS cosine FROM er")
def a12(spark, d):
    return result(gradient_pairs(spark, d).select("x", "y", "z", "l1", "l2", "length_error", "cosine"))


@query("a13_cosine_by_threshold", f"WITH {DENSE}, {TWO} SELECT t.t AS threshold, count(*) AS n, {R6('avg(cosine)')} AS mean, {R6('min(cosine)')} AS low, {R6('max(cosine)')} AS high FROM er JOIN (VALUES (0e0), (0.01e0), (0.1e0), (1e0)) t(t) ON true_length >= t.t GROUP BY 1")
def a13(spark, d):
    return result(mt.cosine_by_threshold(gradient_pairs(spark, d)), ("threshold",))


@query("a14_summary", f"WITH {PAIRS}, s AS (SELECT min(truth) AS low, max(truth) AS high, sum(truth * weight) / sum(weight) AS mean, sum(truth * truth * weight) / sum(weight) AS sq, quantile_cont(truth, 0.25) AS q1, quantile_cont(truth, 0.5) AS median, quantile_cont(truth, 0.75) AS q3 FROM pr), w AS (SELECT min(truth) FILTER (truth >= q1 - 1.5 * (q3 - q1)) AS wl, max(truth) FILTER (truth <= q3 + 1.5 * (q3 - q1)) AS wh FROM pr, s) SELECT {R6('low')} AS low, {R6('high')} AS high, {R6('mean')} AS mean, {R6('sqrt(sq - mean * mean)')} AS std, {R6('q1')} AS q1, {R6('median')} AS median, {R6('q3')} AS q3, {R6('wl')} AS whisker_low, {R6('wh')} AS whisker_high FROM s, w")
def a14(spark, d):
    return result(mt.summary(pairs(spark, d), "truth", "weight"))


@query("a14_summary_histogram", f"WITH {PAIRS}, m AS (SELECT min(truth) AS lo, max(truth) AS hi FROM pr) SELECT least(floor((truth - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, {R6('any_value(lo + least(floor((truth - lo) / (hi - lo) * 50), 49) * (hi - lo) / 50)')} AS edge, sum(weight)::BIGINT AS n FROM pr, m GROUP BY 1")
def a14h(spark, d):
    return result(mt.summary_histogram(pairs(spark, d), "truth", 50, "weight"))


@query("a15_masked_minmax", f"WITH {PAIRS} SELECT {R6('min(truth) FILTER (weight > 3.5)')} AS low, {R6('max(truth) FILTER (weight > 3.5)')} AS high FROM pr")
def a15(spark, d):
    return result(mt.masked_minmax(pairs(spark, d), "truth", "weight", 3.5))


@query("a17_byte_linear", f"WITH {SMALL}, m AS (SELECT volume_id, min(value) AS lo, max(value) - min(value) AS ra FROM v GROUP BY 1), c AS (SELECT v.volume_id, x, y, z, value, lo, ra, least(greatest(floor(255 * (value - lo) / greatest(1e-5, ra) + 0.5e0), 0), 255) AS code FROM v JOIN m USING (volume_id)) SELECT volume_id, {R6('avg(abs(lo + code / 255e0 * ra - value))')} AS error, sum(code)::BIGINT AS codes FROM c GROUP BY 1")
def a17(spark, d):
    c = cp.byte_linear(small_volumes(spark, d), ["volume_id"])
    return result(c.groupBy("volume_id").agg(F.avg(F.abs(F.col("decoded") - F.col("value"))).alias("error"), F.sum("code").alias("codes")))


NORMAL = f"""ga AS (SELECT volume_id, avg(value) AS mean, stddev_samp(value) AS sigma FROM v GROUP BY 1),
gc AS (SELECT v.volume_id, x, y, z, value, mean, sigma, len(list_filter([{', '.join(repr(NormalDist().inv_cdf((k + 0.5) / 255)) for k in range(255))}]::DOUBLE[], lambda l: l < (value - mean) / sigma)) AS code FROM v JOIN ga USING (volume_id)),
gd AS (SELECT *, mean + sigma * list_extract([{', '.join(repr(NormalDist().inv_cdf(0.5 + (2 - 1e-4) * (k / 255 - 0.5) / 2)) for k in range(256))}]::DOUBLE[], code + 1) AS decoded FROM gc)"""


@query("a18_byte_gaussian", f"WITH {SMALL}, {NORMAL} SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('value')} AS value, code::BIGINT AS code, {R6('decoded')} AS decoded FROM gd")
def a18(spark, d):
    return result(cp.byte_gaussian(small_volumes(spark, d), ["volume_id"]).drop("label"))


@query("a19_encoding_report", f"WITH {SMALL}, {NORMAL}, m AS (SELECT volume_id, min(value) AS lo, max(value) - min(value) AS ra FROM v GROUP BY 1), c AS (SELECT value, lo + least(greatest(floor(255 * (value - lo) / greatest(1e-5, ra) + 0.5e0), 0), 255) / 255e0 * ra AS decoded FROM v JOIN m USING (volume_id)), n AS (SELECT count(*) AS n, count(DISTINCT volume_id) AS groups FROM v) "
       f"SELECT 'float' AS encoding, {R6('avg(abs(CAST(CAST(value AS FLOAT) AS DOUBLE) - value))')} AS error, (SELECT n * 4 FROM n)::BIGINT AS bytes FROM v UNION ALL SELECT 'linear', {R6('avg(abs(decoded - value))')}, (SELECT n + groups * 8 FROM n)::BIGINT FROM c UNION ALL SELECT 'gaussian', {R6('avg(abs(decoded - value))')}, (SELECT n + groups * 8 FROM n)::BIGINT FROM gd")
def a19(spark, d):
    return result(cp.encoding_report(small_volumes(spark, d), ["volume_id"]))


SYMBOLS = f"{SMALL}, sy AS (SELECT volume_id, label AS band, x + 4 * (y + 4 * z) AS position, 2 * abs(trunc(value / 0.1e0))::BIGINT - CASE WHEN trunc(value / 0.1e0) < 0 THEN 1 ELSE 0 END AS symbol FROM v)"


def symbols(spark, d):
    s = v.symbolize(v.quantize_deadzone(F.col("value"), 0.1))
    return small_volumes(spark, d).select("volume_id", F.col("label").alias("band"), (F.col("x") + 4 * (F.col("y") + 4 * F.col("z"))).alias("position"), s.alias("symbol"))


@query("a21_symbol_histogram", f"WITH {SYMBOLS}, h AS (SELECT band, symbol, count(*) AS n FROM sy GROUP BY 1, 2) SELECT band::BIGINT AS band, count(*) AS symbols, sum(n)::BIGINT AS total, {R6('sum(-n * log2(n / total))')} AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY band) AS total FROM h) GROUP BY 1")
def a21(spark, d):
    h = cp.symbol_histogram(symbols(spark, d), ["band"])
    return result(h.groupBy("band").agg(F.count("*").alias("symbols"), F.sum("n").alias("total")).join(cp.entropy_bits(h, ["band"]), "band"))


@query("a21_huffman_bits")
def a21h(spark, d):
    return result(cp.huffman_bits(cp.symbol_histogram(symbols(spark, d), ["band"]), "band"))


@query("a22_error_target", f"WITH {SMALL}, s AS (SELECT volume_id, sqrt(sum(value * value)) AS norm, min(value) AS lo, max(value) AS hi, count(*) AS n FROM v GROUP BY 1), t AS (SELECT *, power((hi - lo) / 2 / power(10, 2), 2) * n AS sse FROM s) SELECT volume_id, {R6('norm')} AS norm, {R6('lo')} AS low, {R6('hi')} AS high, n, {R6('sse')} AS sse, {R6('sqrt(sse) / norm')} AS epsilon FROM t")
def a22(spark, d):
    return result(cp.error_target(small_volumes(spark, d), "psnr", 40.0, ["volume_id"]))


@query("a23_tucker_gram", f"WITH {SMALL} SELECT a.volume_id, a.x::BIGINT AS i, b.x::BIGINT AS j, {R6('sum(a.value * b.value)')} AS value FROM v a JOIN v b ON a.volume_id = b.volume_id AND a.y = b.y AND a.z = b.z GROUP BY 1, 2, 3")
def a23(spark, d):
    return result(cp.tucker_gram(small_volumes(spark, d), "x", ["volume_id"]))


@query("a23_tucker_core")
def a23c(spark, d):
    return result(cp.tucker(small_volumes(spark, d).drop("label"), "volume_id", 4))


@query("a23_tucker_norms", f"WITH {SMALL} SELECT volume_id, {R6('sum(value * value)')} AS square, true AS apart, true AS falling FROM v GROUP BY 1")
def a23n(spark, d):
    """What makes a core one: it keeps the squares' sum, its slices are at right angles, and their norms fall."""
    core = cp.tucker(small_volumes(spark, d).drop("label"), "volume_id", 4)
    gram = None
    for a in "xyz":
        own = cp.tucker_gram(core, a, ["volume_id"]).withColumn("axis", F.lit(a))
        gram = own if gram is None else gram.unionByName(own)
    line = Window.partitionBy("volume_id", "axis").orderBy("i")
    norms = gram.where("i = j").withColumn("falls", F.coalesce(F.lag("value").over(line) >= F.col("value") - 1e-9, F.lit(True)))
    return result(norms.groupBy("volume_id").agg((F.sum("value") / 3).alias("square"), F.every("falls").alias("falling")).join(gram.where("i <> j").groupBy("volume_id").agg((F.max(F.abs("value")) < 1e-9).alias("apart")), "volume_id"))


@query("a24_bitplanes_of_values", f"WITH {SMALL}, t AS (SELECT volume_id, floor(log2(max(abs(value)))) AS top FROM v GROUP BY 1), q AS (SELECT v.volume_id, value, top, floor(abs(value) * power(2, 15 - top)) AS q, p.range AS plane FROM v JOIN t USING (volume_id), range(16) p), e AS (SELECT volume_id, plane, floor(q / power(2, 15 - plane)) AS seen, abs(value) - floor(q / power(2, 15 - plane)) * power(2, 15 - plane) / power(2, 15 - top) AS e FROM q) SELECT volume_id, plane::BIGINT AS plane, sum(CAST(seen AS BIGINT) % 2)::BIGINT AS ones, sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END)::BIGINT AS new, {R6('sum(e * e)')} AS sse FROM e GROUP BY 1, 2")
def a24v(spark, d):
    return result(cp.bitplane_profile(small_volumes(spark, d).drop("label"), 16, ["volume_id"]))


TARGETS = [("eps", 0.3), ("rmse", 0.02), ("psnr", 30.0)]
ALLOWED = " UNION ALL ".join(
    f"SELECT volume_id, '{kind}' AS kind, {value!r}::DOUBLE AS target, {allowed} AS allowed FROM v GROUP BY 1"
    for kind, value, allowed in ((k, v, {"eps": f"power(sqrt(sum(value * value)) * {v!r}, 2)", "rmse": f"{v * v!r} * count(*)", "psnr": f"power((max(value) - min(value)) / 2 / {10 ** (v / 20)!r}, 2) * count(*)"}[k]) for k, v in TARGETS)
)
PLANES = f"""{SMALL}, t AS (SELECT volume_id, floor(log2(max(abs(value)))) AS top FROM v GROUP BY 1),
q AS (SELECT v.volume_id, value, top, floor(abs(value) * power(2, 15 - top)) AS q, p.range AS plane FROM v JOIN t USING (volume_id), range(16) p),
e AS (SELECT volume_id, plane, floor(q / power(2, 15 - plane)) AS seen, abs(value) - floor(q / power(2, 15 - plane)) * power(2, 15 - plane) / power(2, 15 - top) AS e FROM q),
pf AS (SELECT volume_id, plane, CAST(sum(CASE WHEN seen = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new, sum(e * e) AS sse FROM e GROUP BY 1, 2),
kn AS (SELECT *, coalesce(sum(new) OVER (PARTITION BY volume_id ORDER BY plane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS known FROM pf),
cs AS (SELECT volume_id, plane, sse, known + new + CASE WHEN new > 0 AND new < 64 - known THEN -new * log2(new / (64e0 - known)) - (64 - known - new) * log2(1 - new / (64e0 - known)) ELSE 0 END AS cost FROM kn),
bt AS (SELECT volume_id, plane, sse, sum(cost) OVER (PARTITION BY volume_id ORDER BY plane ROWS UNBOUNDED PRECEDING) AS bits FROM cs),
al AS ({ALLOWED}),
mn AS (SELECT al.volume_id, al.kind, al.target, al.allowed, min(CASE WHEN bt.sse <= al.allowed THEN bt.plane END) AS plane FROM al JOIN bt USING (volume_id) GROUP BY ALL)"""


@query("a24_target_planes", f"WITH {PLANES} SELECT mn.volume_id, kind, {R6('target')} AS target, {R6('allowed')} AS allowed, mn.plane::BIGINT AS plane, {R6('bt.bits')} AS bits, {R6('bt.sse')} AS sse FROM mn LEFT JOIN bt ON bt.volume_id = mn.volume_id AND bt.plane = mn.plane")
def a24t(spark, d):
    """The first plane, and the bits down to it, of a relative error, an rmse and a psnr."""
    return result(cp.target_planes(small_volumes(spark, d).drop("label"), TARGETS, 16, ["volume_id"]))


@query("a24_bitplane_profile")
def a24(spark, d):
    return result(cp.bitplane_profile(cp.tucker(small_volumes(spark, d).drop("label"), "volume_id", 4), 16, ["volume_id"]))


@query("a25_tucker_ranks", f"WITH {SMALL}, k AS (SELECT * FROM v WHERE abs(value) > 0.25) " + " UNION ALL ".join(f"SELECT volume_id, '{a}' AS axis, (max({a}) + 1)::BIGINT AS rank, {R6('sqrt(sum(value * value))')} AS norm FROM k GROUP BY 1" for a in "xyz"))
def a25(spark, d):
    return result(cp.tucker_ranks(small_volumes(spark, d), 0.25, ["volume_id"]))


@query("a25_slice_norms", f"WITH {SMALL} SELECT volume_id, y::BIGINT AS index, {R6('sqrt(sum(value * value))')} AS norm FROM v GROUP BY 1, 2")
def a25n(spark, d):
    return result(cp.slice_norms(small_volumes(spark, d), "y", ["volume_id"]))


RUNZ = f"{SYMBOLS}, zr AS (SELECT volume_id, position, symbol, position - coalesce(lag(position) OVER (PARTITION BY volume_id ORDER BY position), -1) - 1 AS zeros FROM sy WHERE symbol <> 0)"


@query("a26_zero_runs", f"WITH {RUNZ} SELECT volume_id, zeros::BIGINT AS zeros, (zeros // 4)::BIGINT AS extra, (zeros % 4)::BIGINT AS rest, count(*) AS n FROM zr GROUP BY 1, 2, 3, 4")
def a26(spark, d):
    return result(cp.zero_runs(symbols(spark, d), ["volume_id"], "position", 3).groupBy("volume_id", "zeros", "extra", "rest").agg(F.count("*").alias("n")))


@query("w4_zero_run_places", f"WITH {RUNZ} SELECT volume_id, position::BIGINT AS position, symbol, zeros::BIGINT AS zeros FROM zr")
def w4(spark, d):
    return result(cp.zero_runs(symbols(spark, d), ["volume_id"], "position", 3).select("volume_id", "position", "symbol", "zeros"))


@query("a27_mean_std_over_cameras", f"WITH {RUNS} SELECT config, variant, {R6('avg(metric)')} AS metric_mean, {R6('stddev_pop(metric)')} AS metric_std, {R6('avg(metric * 2) FILTER (camera > 0)')} AS time_mean, {R6('stddev_pop(metric * 2) FILTER (camera > 0)')} AS time_std FROM ru GROUP BY 1, 2")
def a27(spark, d):
    return result(mt.mean_std_over_cameras(runs(spark, d).withColumn("time", F.col("metric") * 2), ["config", "variant"], ["metric"], ["time"]))


@query("a28_per_timestep_mean", f"WITH {RUNS} SELECT config, variant, epoch::BIGINT AS time, {R6('avg(metric)')} AS value FROM ru GROUP BY 1, 2, 3")
def a28(spark, d):
    return result(mt.per_timestep_mean(runs(spark, d).withColumnsRenamed({"epoch": "time", "metric": "value"}), ["config", "variant"]))


@query("a29_epoch_means", f"WITH {RUNS}, m AS (SELECT config AS run, epoch, avg(CASE WHEN config = '1-URGENT' AND epoch >= 60 THEN 'nan'::DOUBLE ELSE metric END) AS mean FROM ru GROUP BY 1, 2), f AS (SELECT run, min(epoch) FILTER (isnan(mean)) AS stop FROM m GROUP BY 1), k AS (SELECT m.* FROM m JOIN f USING (run) WHERE stop IS NULL OR epoch < stop) SELECT run, epoch::BIGINT AS epoch, {R6('mean')} AS mean, {R6('arg_max(mean, epoch) OVER (PARTITION BY run)')} AS last FROM k")
def a29(spark, d):
    r = runs(spark, d)
    loss = F.when((F.col("config") == "1-URGENT") & (F.col("epoch") >= 60), float("nan")).otherwise(F.col("metric"))
    return result(mt.epoch_means(r.select(F.col("config").alias("run"), "epoch", loss.alias("loss"))))


@query("a30_histogram_distance", f"WITH {PAIRS}, h AS (SELECT floor(truth * 40) AS bin, count(*) FILTER (status = 'F') AS a, count(*) FILTER (status = 'O') AS b FROM pr GROUP BY 1) SELECT {R6('sum(abs(a / sa - b / sb))')} AS distance FROM h, (SELECT sum(a) AS sa, sum(b) AS sb FROM h)")
def a30(spark, d):
    h = pairs(spark, d).groupBy(F.floor(F.col("truth") * 40).alias("bin"), "status").agg(F.count("*").alias("n"))
    return result(mt.histogram_distance(h.where("status = 'F'").drop("status"), h.where("status = 'O'").drop("status")))


@query("a33_temporal_loss", f"WITH {IMAGES}, b AS (SELECT image, x, y, CASE WHEN a.mask >= 0.5 AND b.mask >= 0.5 THEN a.value - b.value ELSE 0 END AS e FROM im a JOIN (SELECT image, x - 1 AS x, y, value, mask FROM im) b USING (image, x, y)) SELECT image, {R6('avg(abs(e))')} AS l1, {R6('avg(e * e)')} AS l2 FROM b GROUP BY 1")
def a33(spark, d):
    im = images(spark, d)
    return result(mt.temporal_loss(im, im.withColumn("x", F.col("x") - 1), ["image", "x", "y"], ["image"]))


def image_pairs(spark, d, step=1 / 8):
    return images(spark, d).select("image", "x", "y", F.col("value").alias("truth"), (v.quantize_uniform(F.col("value"), step) * step).alias("predicted"))


WINDOW = mt.gaussian_window(11)
_LINE = lambda c, o: f"({' + '.join(f'lead({c}, {k}) OVER (PARTITION BY image, {o[1]} ORDER BY {o[0]}) * {w!r}' for k, w in enumerate(WINDOW))})"
SSIM_T = f"{IMAGES}, ip AS (SELECT image, x, y, value AS mx, trunc(value / 0.125e0 + 0.5e0) * 0.125e0 AS my FROM im), t0 AS (SELECT *, mx * mx AS xx, my * my AS yy, mx * my AS xy FROM ip), t1 AS (SELECT image, x, y, " + ", ".join(f"{_LINE(c, 'xy')} AS {c}" for c in ("mx", "my", "xx", "yy", "xy")) + " FROM t0), t2 AS (SELECT image, x, y, " + ", ".join(f"{_LINE(c, 'yx')} AS {c}" for c in ("mx", "my", "xx", "yy", "xy")) + " FROM t1 WHERE mx IS NOT NULL), t3 AS (SELECT image, x, y, mx, my, xx, yy, xy FROM t2 WHERE mx IS NOT NULL)"


@query("w6_gaussian_blur", f"WITH {SSIM_T} SELECT image, x::BIGINT AS x, y::BIGINT AS y, {R6('mx')} AS value FROM t3")
def w6(spark, d):
    im = images(spark, d).select("image", "x", "y", "value")
    return result(mt.blur(im, ["x", "y"], 11, ["value"], ["image"]))


@query("a34_ssim", f"WITH {SSIM_T}, c AS (SELECT image, (2 * (xy - mx * my) + 0.0009e0) / (xx - mx * mx + yy - my * my + 0.0009e0) AS c, (2 * mx * my + 0.0001e0) / (mx * mx + my * my + 0.0001e0) AS l FROM t3) SELECT image, {R6('avg(c * l)')} AS ssim, {R6('avg(c)')} AS contrast, {R6('(1 - avg(c * l)) / 2')} AS dssim FROM c GROUP BY 1")
def a34(spark, d):
    return result(mt.ssim(image_pairs(spark, d), 30, 24, ["image"]))


def _scales_sql() -> str:
    parts = ["o AS (SELECT CAST(o_custkey % 64 AS INT) AS x, CAST(o_orderkey % 64 AS INT) AS y, avg(o_totalprice) / 500000 AS value FROM orders GROUP BY 1, 2)",
             "i0 AS (SELECT 'o' AS image, x, y, coalesce(value, 0) AS a, trunc(coalesce(value, 0) / 0.125e0 + 0.5e0) * 0.125e0 AS b FROM (SELECT CAST(p.range AS INT) AS x, CAST(q.range AS INT) AS y FROM range(64) p, range(64) q) LEFT JOIN o USING (x, y))"]
    names = ("mx", "my", "xx", "yy", "xy")
    for k in range(5):
        window = mt.gaussian_window(min(11, 64 >> k))
        line = lambda c, axis, other: "(" + " + ".join(f"lead({c}, {j}) OVER (PARTITION BY image, {other} ORDER BY {axis}) * {w!r}" for j, w in enumerate(window)) + f") AS {c}"  # noqa: B023, E731
        parts += [
            f"t{k} AS (SELECT image, x, y, a AS mx, b AS my, a * a AS xx, b * b AS yy, a * b AS xy FROM i{k})",
            f"u{k} AS (SELECT * FROM (SELECT image, x, y, {', '.join(line(c, 'x', 'y') for c in names)} FROM t{k}) WHERE mx IS NOT NULL)",
            f"v{k} AS (SELECT * FROM (SELECT image, x, y, {', '.join(line(c, 'y', 'x') for c in names)} FROM u{k}) WHERE mx IS NOT NULL)",
            f"w{k} AS (SELECT *, (2 * (xy - mx * my) + 9e-4) / (xx - mx * mx + yy - my * my + 9e-4) AS c FROM v{k})",
            f"s{k} AS (SELECT image, avg(c) AS c, avg(c * (2 * mx * my + 1e-4) / (mx * mx + my * my + 1e-4)) AS s FROM w{k} GROUP BY 1)",
            f"i{k + 1} AS (SELECT image, x // 2 AS x, y // 2 AS y, avg(a) AS a, avg(b) AS b FROM i{k} GROUP BY 1, 2, 3)",
        ]
    product = " * ".join([f"power(greatest(s{k}.c, 0), {mt.SCALES[k]})" for k in range(4)] + [f"power(greatest(s4.s, 0), {mt.SCALES[4]})"])
    return f"WITH {', '.join(parts)} SELECT s0.image, {R6(product)} AS ms_ssim FROM s0, s1, s2, s3, s4"


@query("a35_ms_ssim", _scales_sql())
def a35(spark, d):
    """Images of orders by customer and part of the price, large enough for five scales."""
    o = table(spark, d, "orders").groupBy((F.col("o_custkey") % 64).cast("int").alias("x"), (F.col("o_orderkey") % 64).cast("int").alias("y")).agg((F.avg("o_totalprice") / 500000).alias("value"))
    full = g.cells(spark, (64, 64, 1)).join(o, ["x", "y"], "left").select("x", "y", F.lit("o").alias("image"), F.coalesce("value", F.lit(0.0)).alias("truth"))
    return result(mt.ms_ssim(full.withColumn("predicted", v.quantize_uniform(F.col("truth"), 0.125) * 0.125), 64, 64, ["image"]))


@query("a36_layer_budget", "WITH c AS (SELECT DISTINCT (o_custkey % 4 + 1) * 16 AS channels, o_orderkey % 5 + 2 AS layers FROM orders), m AS (SELECT channels, max(layers) AS layers FROM c GROUP BY 1) SELECT channels::BIGINT AS channels, layers::BIGINT AS layers, (channels * (channels + 1) * layers)::BIGINT AS weights, round(cbrt(32 ** 3 * 16.0e0 / channels))::BIGINT AS grid_size FROM m")
def a36(spark, d):
    c = table(spark, d, "orders").select(((F.col("o_custkey") % 4 + 1) * 16).alias("channels"), (F.col("o_orderkey") % 5 + 2).alias("layers")).distinct()
    return result(mt.layer_budget(c, 32, 16))


CASES = f"{RUNS}, cs AS (SELECT config, variant, epoch, min(seq) AS seq, count(*) * 4000 AS original_bytes, sum((metric * 1000)::BIGINT + 1)::BIGINT AS compressed_bytes FROM ru GROUP BY 1, 2, 3), rt AS (SELECT *, original_bytes / compressed_bytes AS rate FROM cs)"


def cases(spark, d):
    return runs(spark, d).groupBy("config", "variant", "epoch").agg(F.min("seq").alias("seq"), (F.count("*") * 4000).alias("original_bytes"), F.sum(F.rint(F.col("metric") * 1000).cast("long") + 1).alias("compressed_bytes"))


@query("w10_rate_curve", f"WITH {CASES} SELECT config, variant, epoch::BIGINT AS epoch, {R6('rate')} AS rate, row_number() OVER (PARTITION BY config, variant ORDER BY rate, seq) AS place FROM rt")
def w10(spark, d):
    return result(mt.rate_curve(cases(spark, d), ["config", "variant"]).select("config", "variant", "epoch", "rate", "place"))


@query("w11_best_per_group", f"WITH {RUNS}, m AS (SELECT config, variant, epoch, max(metric) AS hi, min(metric) AS lo FROM ru GROUP BY 1, 2, 3) SELECT config, variant, epoch::BIGINT AS epoch, {R6('hi')} AS hi, {R6('lo')} AS lo, hi = max(hi) OVER w AS best_hi, lo = min(lo) OVER w AS best_lo FROM m WINDOW w AS (PARTITION BY config, epoch)")
def w11(spark, d):
    m = runs(spark, d).groupBy("config", "variant", "epoch").agg(F.max("metric").alias("hi"), F.min("metric").alias("lo"))
    return result(mt.best_per_group(m, ["config", "epoch"], ["hi"], ["lo"]))


@query("w12_closest_rate", f"WITH {CASES} SELECT config, variant, seq, {R6('rate')} AS rate FROM (SELECT *, row_number() OVER (PARTITION BY config, variant ORDER BY abs(log10(9e0) - log10(rate)), seq) AS k FROM rt) WHERE k = 1")
def w12(spark, d):
    return result(mt.closest_rate(mt.rate_curve(cases(spark, d), ["config", "variant"]), ["config", "variant"], 9.0))


@query("w13_speedup", f"WITH {RUNS}, m AS (SELECT config, variant, avg(metric) AS value FROM ru GROUP BY 1, 2) SELECT m.config, m.variant, {R6('m.value')} AS value, {R6('b.value / m.value')} AS ratio FROM m JOIN m b ON b.config = m.config AND b.variant = 'F'")
def w13(spark, d):
    m = runs(spark, d).groupBy("config", "variant").agg(F.avg("metric").alias("value"))
    return result(mt.speedup(m, ["config"], "variant", "F", "value"))


@query("w14_mask_outliers", f"WITH {RUNS}, m AS (SELECT config, median(metric) AS md FROM ru GROUP BY 1) SELECT config, seq, {R6('CASE WHEN metric >= 0.7 * md AND metric <= 1.3 * md THEN metric END')} AS metric FROM ru JOIN m USING (config)")
def w14(spark, d):
    return result(mt.mask_outliers(runs(spark, d), ["config"], "metric", 0.7, 1.3).select("config", "seq", "metric"))


@query("d16_metric_heatmap", f"WITH {RUNS} SELECT config, {', '.join(R6(f'avg(metric) FILTER (variant = {chr(39)}{s}{chr(39)})') + f' AS {chr(34)}{s}{chr(34)}' for s in 'FOP')} FROM ru GROUP BY 1")
def d16(spark, d):
    return result(mt.metric_heatmap(runs(spark, d).withColumnRenamed("metric", "value"), "config", "variant", ["F", "O", "P"]))


def _tap_sql() -> str:
    rows = []
    for at in range(4):
        for k in range(9):
            src = (at + k - 4) % 6
            src = min(src, 6 - src)
            w = (cp.HIGH if at % 2 else cp.LOW)[k]
            rows.append(f"({at // 2 + (at % 2) * 2}, {src}, {w!r}::DOUBLE)")
    return f"tp(o, s, w) AS (VALUES {', '.join(rows)})"


@query("w7_dwt_axis", f"WITH {SMALL}, {_tap_sql()} SELECT volume_id, o::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('sum(w * value)')} AS value FROM v JOIN tp ON s = x GROUP BY 1, 2, 3, 4")
def w7(spark, d):
    return result(cp.dwt_axis(small_volumes(spark, d), "x", 4, ["volume_id"]))


@query("w7_dwt_round_trip", f"WITH {SMALL} SELECT volume_id, count(*) AS cells, true AS close FROM v GROUP BY 1")
def w7r(spark, d):
    cells = small_volumes(spark, d).drop("label")
    back = cp.dwt_inverse(cp.dwt_forward(cells, 4, 1, ["volume_id"]), 4, 1, ["volume_id"])
    both = back.withColumnRenamed("value", "back").join(cells, ["volume_id", "x", "y", "z"])
    return result(both.groupBy("volume_id").agg(F.count("*").alias("cells"), (F.max(F.abs(F.col("back") - F.col("value"))) < 1e-5).alias("close")))


RND = "(sign({0}) * floor((abs({0}) + {1}) / {2}))"
_N1 = "(coalesce(lag(q) OVER w, lead(q) OVER w) + coalesce(lead(q) OVER w, lag(q) OVER w))"
INT_SQL = f"""WITH {SMALL}, q AS (SELECT volume_id, x, y, z, trunc(value * 200 + sign(value) * 0.5e0)::BIGINT AS q FROM v),
o AS (SELECT volume_id, x, y, z, CASE WHEN x % 2 = 1 THEN q - {RND.format(_N1, 1, 2)} ELSE q END AS q FROM q WINDOW w AS (PARTITION BY volume_id, y, z ORDER BY x)),
e AS (SELECT volume_id, x, y, z, CASE WHEN x % 2 = 0 THEN q + {RND.format(_N1, 2, 4)} ELSE q END AS q FROM o WINDOW w AS (PARTITION BY volume_id, y, z ORDER BY x))
SELECT volume_id, (x // 2 + (x % 2) * 2)::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, q::BIGINT AS value FROM e"""


def whole(spark, d):
    return small_volumes(spark, d).drop("label").withColumn("value", v.quantize_uniform(F.col("value"), 0.005))


@query("w8_dwt_int_axis", INT_SQL)
def w8(spark, d):
    q = small_volumes(spark, d).drop("label").withColumn("value", v.truncate(F.col("value") * 200 + F.signum("value") * 0.5))
    return result(cp.dwt_int_axis(q, "x", 4, ["volume_id"]))


@query("w8_dwt_int_round_trip", f"WITH {SMALL} SELECT volume_id, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, trunc(value / 0.005e0 + sign(value) * 0.5e0)::BIGINT AS value FROM v")
def w8r(spark, d):
    return result(cp.idwt_int_axes(cp.dwt_int_axes(whole(spark, d), "xyz", 4, ["volume_id"]), "zyx", 4, ["volume_id"]))


def _each_axis(name: str, source: str, taps: str, axis: str) -> str:
    """A CTE that filters one axis of 4 cells by a table of taps (at, from, weight)."""
    others = [a for a in "xyz" if a != axis]
    keys = "volume_id, step, " if "step" in taps else "volume_id, "
    return f"{name} AS (SELECT {keys}{', '.join(others)}, o AS {axis}, sum(w * value) AS value FROM {source} JOIN {taps.split()[0]} ON s = {axis} GROUP BY ALL)"


def _back_taps() -> str:
    rows = []
    for at in range(4):
        for k in range(9):
            src = (at + k - 4) % 6
            src = min(src, 6 - src)
            place = src // 2 + (src % 2) * 2
            w = (cp.ODD if at % 2 else cp.EVEN)[k]
            rows.append(f"({at}, {place}, {w!r}::DOUBLE)")
    return f"bp(o, s, w) AS (VALUES {', '.join(rows)})"


G5_SQL = f"""WITH {SMALL}, {_tap_sql()}, {_back_taps()},
{_each_axis("f1", "v", "tp", "x")}, {_each_axis("f2", "f1", "tp", "y")}, {_each_axis("f3", "f2", "tp", "z")},
q AS (SELECT volume_id, step, x, y, z, trunc(value / step + sign(value) * 0.5e0) AS q FROM f3, (VALUES (0.05e0), (0.1e0)) s(step)),
h AS (SELECT volume_id, step, 2 * abs(q) - CASE WHEN q < 0 THEN 1 ELSE 0 END AS symbol, count(*) AS n FROM q GROUP BY ALL),
e AS (SELECT volume_id, step, sum(-n * log2(n / 64e0)) AS entropy FROM h GROUP BY ALL),
b0 AS (SELECT volume_id, step, x, y, z, q * step AS value FROM q),
{_each_axis("b1", "b0", "bp step", "z")}, {_each_axis("b2", "b1", "bp step", "y")}, {_each_axis("b3", "b2", "bp step", "x")},
r AS (SELECT b3.volume_id, b3.step, sqrt(avg((b3.value - v.value) * (b3.value - v.value))) AS rmse FROM b3 JOIN v USING (volume_id, x, y, z) GROUP BY ALL)
SELECT e.volume_id, {R6("e.step")} AS step, 64::BIGINT AS cells, {R6("entropy")} AS entropy, {R6("rmse")} AS rmse FROM e JOIN r ON e.volume_id = r.volume_id AND e.step = r.step"""


def rates(spark, d):
    return cp.rate_by_brick(small_volumes(spark, d).drop("label"), 4, 1, [0.05, 0.1], "volume_id")


@query("g5_rate_entropy", G5_SQL)
def g5e(spark, d):
    """Cells, entropy and error of the rates, which SQL can express."""
    return result(rates(spark, d).select("volume_id", "step", "cells", "entropy", "rmse"))


@query("g5_rate_by_brick")
def g5(spark, d):
    return result(rates(spark, d).drop("brick", "cells"))


@query("g5_bricked_or_whole")
def g5b(spark, d):
    return result(cp.bricked_or_whole(small_volumes(spark, d).drop("label"), 4, 1, [0.05, 0.1], "volume_id", 2))


# --- scoring


def tiny() -> Model:
    rng = np.random.default_rng(4)
    return Model([(rng.standard_normal((3, 4)).round(2), rng.standard_normal(4).round(2)), (rng.standard_normal((4, 1)).round(2), rng.standard_normal(1).round(2))])


def tiny_sql() -> str:
    (w1, b1), (w2, b2) = tiny().layers
    hidden = [f"greatest(px * {w1[0, k]!r} + py * {w1[1, k]!r} + pz * {w1[2, k]!r} + ({b1[k]!r}), 0)".replace("np.float64", "") for k in range(4)]
    return "1 / (1 + exp(-(" + " + ".join(f"{h} * {w2[k, 0]!r}".replace("np.float64", "") for k, h in enumerate(hidden)) + f" + ({b2[0]!r}))))".replace("np.float64", "")


@query("m1_score", f"WITH {POINTS} SELECT px, py, pz, {R6(tiny_sql())} AS value FROM p")
def m1(spark, d):
    return result(score(points(spark, d), tiny(), KEY3, KEY3), KEY3)


def wide() -> Model:
    """One layer over the position, one Fourier band of it and ten latent channels."""
    rng = np.random.default_rng(9)
    return Model([(rng.standard_normal((19, 1)).round(2), rng.standard_normal(1).round(2))])


def wide_sql() -> str:
    w = [float(x) for x in wide().layers[0][0][:, 0]]
    place = [f"{p} * {w[k]!r}" for k, p in enumerate(KEY3)]
    bands = [f"{f}({p} * {2 * math.pi!r}::DOUBLE) * {w[3 + 2 * k + m]!r}" for k, p in enumerate(KEY3) for m, f in enumerate(("cos", "sin"))]
    channels = " ".join(f"WHEN {c} THEN {w[9 + c]!r}" for c in range(10))
    mixed = f"lf AS (SELECT px, py, pz, sum(w * value * CASE channel {channels} END) AS s FROM q JOIN lat ON x = xx AND y = xy AND z = xz GROUP BY 1, 2, 3)"
    return f"WITH {SMALL}, {LATENT}, {POINTS}, {CELL}, {mixed} SELECT px, py, pz, {R6('1 / (1 + exp(-(' + ' + '.join(place + bands) + f' + s + ({float(wide().layers[0][1][0])!r}))))')} AS value FROM lf"


@query("m1_score_latent", wide_sql())
def m1l(spark, d):
    rows, inputs = latent_inputs(points(spark, d), KEY3, latent_grids(spark, d), (4, 4, 4), bands=1)
    return result(score(rows, wide(), inputs, KEY3), KEY3)


def framed_model() -> Model:
    """One layer over the position, ten channels of times and ten of members."""
    rng = np.random.default_rng(10)
    return Model([(rng.standard_normal((23, 1)).round(2), rng.standard_normal(1).round(2))])


def framed_sql() -> str:
    w = [float(x) for x in framed_model().layers[0][0][:, 0]]
    place = " + ".join(f"{p} * {w[k]!r}" for k, p in enumerate(KEY3))
    mixed = ", ".join(f"s{n} AS (SELECT px, py, pz, sum(value * CASE channel {' '.join(f'WHEN {c} THEN {w[first + c]!r}' for c in range(10))} END) AS s{n} FROM b{n} GROUP BY 1, 2, 3)" for n, first in (("t", 3), ("e", 13)))
    return f"WITH {SMALL}, {POINTS}, {CELL}{BLENDED}, {mixed} SELECT px, py, pz, {R6(f'1 / (1 + exp(-({place} + st + se + ({float(framed_model().layers[0][1][0])!r}))))')} AS value FROM st JOIN se USING (px, py, pz)"


@query("m1_score_series", framed_sql())
def m1s(spark, d):
    """Points at fractional times and members, scored with latent grids of both."""
    times, members = framed_grids(spark, d)
    rows, inputs = latent_inputs(framed_points(spark, d), KEY3, res=(4, 4, 4), time_grids=times, times=TIMES, ensemble_grids=members, members=MEMBERS)
    return result(score(rows, framed_model(), inputs, KEY3), KEY3)


@query("m3_evaluate_model", f"WITH {J2SQL}, pr AS (SELECT value AS truth, {tiny_sql()} AS predicted FROM j2) SELECT {R6(f'avg(abs{E2})')} AS l1, {R6(f'avg({E2} * {E2})')} AS l2, count(*) AS n, {R6(f'sqrt(avg({E2} * {E2}))')} AS rmse, {R6('(sum(truth * predicted) - count(*) * avg(truth) * avg(predicted)) / (count(*) - 1) / sqrt((avg(truth * truth) - avg(truth) * avg(truth)) * (avg(predicted * predicted) - avg(predicted) * avg(predicted)))')} AS ncc, {R6(f'10 * log10(1 / avg({E2} * {E2}))')} AS psnr FROM pr")
def m3(spark, d):
    truth = sa.sample(at_points(spark, d), dense(spark, d), RES, KEY3)
    return result(evaluate_model(sa.pair_prediction(truth, score(points(spark, d), tiny(), KEY3, KEY3), KEY3)))
