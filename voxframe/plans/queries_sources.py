"""Registered queries of sources and sinks, with their SQL. Files are written from the driver's tables and read again."""

from __future__ import annotations

import json
import os
import struct
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import grids as g
from ..sources import volumes as vo
from .bindings import DENSE, GRID, R6, RES, RUNS, SERIES, dense, grid, result, runs, series, table
from .queries_values import query


def scratch(spark) -> str:
    """A new folder below the session's shared one (or the warehouse, where none is set)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{uuid.uuid4().hex}"


@query("s1_ensemble_manifest", "WITH n AS (SELECT count(*) AS n FROM nation), r AS (SELECT count(*) AS r FROM region) SELECT (2 + 3 * e)::BIGINT AS ensemble, (1 + t)::BIGINT AS time, concat('files/ensemble', lpad((2 + 3 * e)::VARCHAR, 3, '0'), '/time', lpad((1 + t)::VARCHAR, 3, '0'), '.dat') AS path FROM (SELECT unnest(range(r)) AS e FROM r), (SELECT unnest(range(n)) AS t FROM n)")
def s1(spark, d):
    n, r = table(spark, d, "nation").count(), table(spark, d, "region").count()
    return result(vo.ensemble_manifest(spark, "files/ensemble%1$03d/time%2$03d.dat", (2, 3, r), (1, 1, n)))


@query("s1_described_ensembles", f"WITH {SERIES}, de AS (SELECT ensemble, min(time) AS low, max(time) - min(time) + 1 AS n FROM s GROUP BY 1) SELECT ensemble::BIGINT AS ensemble, (low + t.range)::BIGINT AS time, concat('flag', lpad(ensemble::VARCHAR, 6, '0'), '/t', lpad((low + t.range)::VARCHAR, 4, '0'), '.cvol') AS path FROM de, range(100) t WHERE t.range < n")
def s1d(spark, d):
    """A descriptor for each return flag, written as JSON and read again; odd ones name members by name, even ones by place."""
    folder = scratch(spark)
    own = series(spark, d).groupBy("ensemble").agg(F.min("time").alias("start_timestep"), (F.max("time") - F.min("time") + 1).alias("num_timesteps"))
    form = F.when(F.col("ensemble") % 2 == 0, "flag%1$06d/t%2$04d.cvol").otherwise("flag{ensemble:06d}/t{time:04d}.cvol")
    own.select(form.alias("format"), F.col("ensemble").alias("start_ensemble"), "start_timestep", "num_timesteps").repartition("start_ensemble").write.option("maxRecordsPerFile", 1).json(folder)
    got = vo.described_ensembles(spark, folder)
    below = F.regexp_replace("path", "^.*/(?=flag)", "")
    return result(got.select("ensemble", "time", below.alias("path")))


@query("s2_missing_volumes", f"WITH {SERIES}, have AS (SELECT DISTINCT ensemble, time FROM s WHERE z = 0), m AS (SELECT a.range AS ensemble, b.range AS time FROM range(3) a, range(100) b) SELECT ensemble, time, concat('v', lpad(ensemble::VARCHAR, 3, '0'), '/', lpad(time::VARCHAR, 3, '0')) AS path FROM m ANTI JOIN have ON have.ensemble = m.ensemble AND have.time = m.time")
def s2(spark, d):
    fmt = "v%1$03d/%2$03d"
    have = series(spark, d).where("z = 0").select("ensemble", "time").distinct().select(F.format_string(fmt, "ensemble", "time").alias("path"))
    return result(vo.missing_volumes(vo.ensemble_manifest(spark, fmt, (0, 1, 3), (0, 1, 100)), have))


EQ = {
    "sphere": "1 - sqrt(px * px + py * py + pz * pz)",
    "marschner_lobb": "((1 - sin(pz * 1.5707963267948966)) + 0.25e0 * (1 + cos(cos(sqrt(px * px + py * py) * 1.5707963267948966) * 37.69911184307752))) / 2.5e0",
    "kummer": "greatest(0, least(1, 0.5e0 - (px * px * px * px + py * py * py * py + pz * 2 * (pz * 2) - px * px - py * py - pz * 2 - px * px * (py * py) - py * py * (pz * 2) - pz * 2 * (px * px) + 1)))",
    "tube": "((1 - sqrt(py * py + pz * pz) * power(0.9e0 - 0.5e0 * cos(7 * px), 3)) - 0.9e0) * 10",
    "heart": "greatest(0, least(1, 0.5e0 - (power(2 * px * px + 2 * py * py + pz * 2 - 1, 3) - 0.1e0 * px * px * (pz * 2) * pz - py * py * (pz * 2) * pz)))",
}


def _eq_sql(n: str) -> str:
    h = vo.BOX.get(n, 1.0)
    p = ", ".join(f"-{h!r}::DOUBLE + {r}.range * (2 * {h!r}::DOUBLE / (m - 1)) AS p{a}" for a, r in zip("xyz", "abc"))
    return f"SELECT '{n}' AS equation, x, y, z, {R6(EQ[n])} AS value FROM (SELECT a.range AS x, b.range AS y, c.range AS z, {p} FROM nn, range(25) a, range(25) b, range(25) c WHERE a.range < m AND b.range < m AND c.range < m)"


@query("s8_synthetic_volume", "WITH nn AS (SELECT count(*) AS m FROM nation) " + " UNION ALL ".join(_eq_sql(n) for n in EQ))
def s8(spark, d):
    """As many voxels an axis as there are nations."""
    m, out = table(spark, d, "nation").count(), None
    for n in EQ:
        one = vo.synthetic_volume(spark, m, n).select(F.lit(n).alias("equation"), "x", "y", "z", "value")
        out = one if out is None else out.union(one)
    return result(out)


#: Declared equations, as files of them have them.
DECLARED = [
    {"name": "PuffyCube", "boxsize": 2.6, "parameters": {}, "codeForward": "auto x2=x*x; auto y2=y*y; auto z2=z*z; return x2+y2+z2-(x2*x2)-(y2*y2)-(z2*z2);"},
    {"name": "Cube", "boxsize": 2, "parameters": {"scale": 0.5}, "codeForward": "return 1 - sqrtf(sqr(fmaxf(0.0f, fabsf(x) - p.scale)) + sqr(fmaxf(0.0f, fabsf(y) - p.scale)) + sqr(fmaxf(0.0f, fabsf(z) - p.scale)));"},
    {"name": "Marschner Lobb", "boxsize": 2, "parameters": {"fM": 6.0, "alpha": 0.25}, "codeForward": "auto r = sqrtf(x * x + y * y);\n auto pr = cosf(2 * M_PI * p.fM * cosf(M_PI * r / 2));\n auto num = (1 - sinf(M_PI * z / 2)) + p.alpha * (1 + pr);\n auto denom = 2 * (1 + p.alpha);\n return num / denom;"},
    {"name": "Heart", "boxsize": 2, "parameters": {}, "codeForward": "auto x2 = x * x, y2 = y * y, z2 = z * 2;\n return implicit2Density(cb(2*x2+2*y2+z2-1) - 0.1f*x2*z2*z - y2*z2*z);"},
    {"name": "Cassini", "boxsize": 2, "parameters": {"a": 0.25}, "codeForward": "return implicit2Density((sqr(x+p.a)+y*y)*(sqr(x-p.a)+y*y) - z*z);"},
]
DECLARED_SQL = {
    "PuffyCube": (1.3, "px * px + py * py + pz * pz - px * px * px * px - py * py * py * py - pz * pz * pz * pz"),
    "Cube": (1.0, "1 - sqrt(power(greatest(0, abs(px) - 0.5e0), 2) + power(greatest(0, abs(py) - 0.5e0), 2) + power(greatest(0, abs(pz) - 0.5e0), 2))"),
    "Marschner Lobb": (1.0, "((1 - sin(3.141592653589793e0 * pz / 2)) + 0.25e0 * (1 + cos(2 * 3.141592653589793e0 * 6 * cos(3.141592653589793e0 * sqrt(px * px + py * py) / 2)))) / 2.5e0"),
    "Heart": (1.0, EQ["heart"]),
    "Cassini": (1.0, "greatest(0, least(1, 0.5e0 - (((px + 0.25e0) * (px + 0.25e0) + py * py) * ((px - 0.25e0) * (px - 0.25e0) + py * py) - pz * pz)))"),
}


def _declared_sql(name: str) -> str:
    h, formula = DECLARED_SQL[name]
    p = ", ".join(f"-{h!r}::DOUBLE + {r}.range * (2 * {h!r}::DOUBLE / (m - 1)) AS p{a}" for a, r in zip("xyz", "abc"))
    return f"SELECT '{name}' AS equation, x, y, z, {R6(formula)} AS value FROM (SELECT a.range AS x, b.range AS y, c.range AS z, {p} FROM nn, range(25) a, range(25) b, range(25) c WHERE a.range < m AND b.range < m AND c.range < m)"


@query("s8_declared_volume", "WITH nn AS (SELECT count(*) AS m FROM nation) " + " UNION ALL ".join(map(_declared_sql, DECLARED_SQL)))
def s8d(spark, d):
    """Declared equations, written as a JSON file and read again, on as many voxels an axis as there are nations."""
    path = scratch(spark)
    spark.createDataFrame([(json.dumps(DECLARED),)], "value string").coalesce(1).write.text(path)
    m, out = table(spark, d, "nation").count(), None
    for one in vo.declared_equations(spark, path):
        own = vo.declared_volume(spark, one, m).select(F.lit(one["name"]).alias("equation"), "x", "y", "z", "value")
        out = own if out is None else out.union(own)
    return result(out)


_POOL = "SELECT level, x, y, z, avg(value) AS value FROM (SELECT l.range AS level, a.range AS x, b.range AS y, c.range AS z, value FROM dg, range(1, 4) l, range(25) a, range(6) b, range(5) c WHERE " + " AND ".join(f"{r}.range < greatest(1, {n} // (l.range + 1)) AND {axis} >= floor({r}.range * {n}::DOUBLE / greatest(1, {n} // (l.range + 1))) AND {axis} < ceil(({r}.range + 1) * {n}::DOUBLE / greatest(1, {n} // (l.range + 1)))" for axis, r, n in zip("xyz", "abc", RES)) + ") GROUP BY 1, 2, 3, 4"


@query("s9_write_levels", f"WITH {DENSE}, lv AS ({_POOL} UNION ALL SELECT 0 AS level, x, y, z, value FROM dg) SELECT level::BIGINT AS level, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('value')} AS value FROM lv WHERE level IN (0, 2, 3)")
def s9l(spark, d):
    """Three mip levels beside the data; the data and two of them are read again, each by itself."""
    path = scratch(spark)
    vo.write_volumes(dense(spark, d), path, RES, 3)
    out = None
    for level in (0, 2, 3):
        own = vo.read_level(spark, path, level).withColumn("level", F.lit(level)).select("level", "x", "y", "z", "value")
        out = own if out is None else out.union(own)
    return result(out)


@query("s9_write_volumes", f"WITH {SERIES} SELECT ensemble::BIGINT AS ensemble, time::BIGINT AS time, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('value')} AS value FROM s")
def s9(spark, d):
    path = scratch(spark)
    vo.write_volumes(series(spark, d), path)
    return result(spark.read.parquet(path).select("ensemble", "time", "x", "y", "z", "value"))


#: Cases of all configurations for each number of files a configuration has.
CASES = 10_000


def write_cases(r, path: str) -> None:
    """Evaluation files of all runs, dealt by their seq over as many files as their count asks for; a file holds one object."""
    deals = 1 + r.count() // CASES
    case = F.struct(F.col("variant").alias("algorithm"), "seq", F.col("metric").alias("psnr_world"))
    dealt = r.groupBy("config", F.pmod(F.xxhash64("seq"), F.lit(deals)).alias("deal")).agg(F.collect_list(case).alias("cases")).drop("deal")
    dealt.write.option("maxRecordsPerFile", 1).partitionBy("config").json(path)


@query("s10_read_eval_json", f"WITH {RUNS} SELECT config, variant AS algorithm, seq, {R6('metric')} AS psnr_world FROM ru")
def s10(spark, d):
    path = scratch(spark)
    write_cases(runs(spark, d), path)
    return result(vo.read_eval_json(spark, path).select("config", "algorithm", "seq", "psnr_world"))


@query("s11_export_runs", f"WITH {RUNS} SELECT config, variant, epoch::BIGINT AS epoch, {R6('avg(metric)')} AS metric FROM ru GROUP BY 1, 2, 3")
def s11(spark, d):
    path = scratch(spark)
    vo.export_runs(runs(spark, d).groupBy("config", "variant", "epoch").agg(F.avg("metric").alias("metric")), path)
    return result(spark.read.csv(path, sep="\t", header=True, schema="config string, variant string, epoch int, metric double"))


@query("s13_persist_views", f"WITH {SERIES} SELECT ensemble::BIGINT AS ensemble, time::BIGINT AS time, count(*) AS n FROM s GROUP BY 1, 2")
def s13(spark, d):
    """Asked twice: the second time only what is absent is computed."""
    path, key = scratch(spark), ["ensemble", "time"]
    all_ = series(spark, d)
    compute = lambda asked: all_.join(asked, key, "left_semi").groupBy(*key).agg(F.count("*").alias("n"))
    keys = all_.select(*key).distinct()
    vo.persist_views(keys.where("time < 12"), compute, path, key)
    return result(vo.persist_views(keys, compute, path, key).select("ensemble", "time", "n"))


# --- volume files: each member's grid is written by a task in one of the formats, and read again


DENSE_MEMBERS = f"{SERIES}, me AS (SELECT ensemble, x, y, z, CAST(sum(round(value * 1e6)) AS DOUBLE) / count(*) / 1e6 AS value FROM s GROUP BY 1, 2, 3, 4), ce AS (SELECT ensemble, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z FROM (SELECT DISTINCT ensemble FROM me), range(50) a, range(11) b, range(9) c), dm AS (SELECT ce.*, CAST(coalesce(value, 0) AS FLOAT) AS value FROM ce LEFT JOIN me USING (ensemble, x, y, z))"
VOXELS_SQL = f"WITH {DENSE_MEMBERS} SELECT ensemble::BIGINT AS ensemble, x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, {R6('CAST(value AS DOUBLE)')} AS value FROM dm"


def write_files(spark, d, kind: str):
    """The manifest (path, ensemble, time; or density, velocity) of one file for each ensemble; a grid has 4950 cells."""
    folder = scratch(spark).removeprefix("file://").replace("file:/", "/", 1)
    mean = F.sum(F.round(F.col("value") * 1e6)) / F.count("*") / 1e6
    members = series(spark, d).groupBy("ensemble", "x", "y", "z").agg(mean.alias("value"))

    def write(group: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        values = np.zeros(RES[::-1], np.float32)
        values[group.z, group.y, group.x] = group.value
        ensemble = int(group.ensemble.iloc[0])
        path = f"{folder}/{ensemble:03d}.{kind}"
        WRITERS[kind](path, values, ensemble)
        return pd.DataFrame({"path": [path], "ensemble": [ensemble], "time": [0]})

    made = members.groupBy("ensemble").applyInPandas(write, "path string, ensemble int, time int")
    made.write.parquet(folder + "-manifest")
    return spark.read.parquet(folder + "-manifest")


def _write_cvol(path: str, values: np.ndarray, ensemble: int) -> None:
    nz, ny, nx = values.shape
    with open(path, "wb") as f:
        f.write(struct.pack("<4si3fii4x", vo.MAGIC, vo.VERSION, 1.0, 1.0, 1.0, 1, 0))
        f.write(struct.pack("<i", 7) + b"density" + struct.pack("<3Qii", nx, ny, nz, 1, 2))
        values.tofile(f)


def _write_legacy(path: str, values: np.ndarray, ensemble: int) -> None:
    nz, ny, nx = values.shape
    with open(path, "wb") as f:
        f.write(b"cvol" + struct.pack("<3Q3dI?7x", nx, ny, nz, 0.1, 0.1, 0.1, 2, False))
        values.tofile(f)


def _write_raw(path: str, values: np.ndarray, ensemble: int) -> None:
    """A text descriptor, and its data behind ten bytes of header."""
    nz, ny, nx = values.shape
    with open(f"{path}-{ensemble}.bin", "wb") as f:
        f.write(b"ten bytes.")
        values.tofile(f)
    with open(path, "w") as f:
        f.write(f"ObjectFileName: {os.path.basename(path)}-%d.bin\nResolution: {nx} {ny} {nz}\nSliceThickness: 1 1 1\nFormat: FLOAT\n")


def _write_xyz(path: str, values: np.ndarray, ensemble: int) -> None:
    nz, ny, nx = values.shape
    with open(path, "wb") as f:
        f.write(struct.pack("<3I3d", nx, ny, nz, 1.0, 1.0, 1.0))
        np.ascontiguousarray(values.transpose(2, 1, 0)).tofile(f)


def _write_npz(path: str, values: np.ndarray, ensemble: int) -> None:
    """Densities up to 8, of which those above 5 are cut, and velocities; all are exact multiples."""
    density = values[..., None] * np.float32(8)
    np.savez_compressed(path, density)
    np.savez_compressed(path + "-velocity", np.concatenate([density, density / 2, density / 4], axis=3))


WRITERS = {"cvol": _write_cvol, "legacy": _write_legacy, "dat": _write_raw, "xyz": _write_xyz, "npz": _write_npz}


@query("s3_read_volumes", VOXELS_SQL)
def s3(spark, d):
    return result(vo.read_volumes(write_files(spark, d, "cvol")).select("ensemble", "x", "y", "z", "value"))


@query("s4_read_legacy_volumes", VOXELS_SQL)
def s4(spark, d):
    return result(vo.read_volumes(write_files(spark, d, "legacy")).select("ensemble", "x", "y", "z", "value"))


@query("s5_read_raw_volumes", VOXELS_SQL)
def s5(spark, d):
    return result(vo.read_raw_volumes(write_files(spark, d, "dat")).select("ensemble", "x", "y", "z", "value"))


@query("s6_read_xyz_volumes", VOXELS_SQL)
def s6(spark, d):
    return result(vo.read_xyz_volumes(write_files(spark, d, "xyz")).select("ensemble", "x", "y", "z", "value"))


@query("s7_convert_npz_series", f"WITH {DENSE_MEMBERS}, cu AS (SELECT ensemble, CAST(a.range AS INT) AS x, CAST(b.range AS INT) AS y, CAST(c.range AS INT) AS z, k.range AS channel FROM (SELECT DISTINCT ensemble FROM dm), range(50) a, range(50) b, range(50) c, range(4) k) "
       ", va AS (SELECT cu.*, CAST(CASE WHEN value IS NULL THEN 0 WHEN channel = 0 THEN least(CAST(value AS DOUBLE) * 8, 5) / 5 ELSE CAST(value AS DOUBLE) * 16 / power(2, channel) END AS FLOAT) AS value FROM cu LEFT JOIN dm ON dm.ensemble = cu.ensemble AND dm.x = cu.x AND dm.y = cu.y - 19 AND dm.z = cu.z - 20) "
       f"SELECT ensemble::BIGINT AS ensemble, channel, y::BIGINT AS y, z::BIGINT AS z, count(*) AS n, count(*) FILTER (value > 0) AS filled, {R6('CAST(max(value) AS DOUBLE)')} AS largest, CAST(sum(round(CAST(value AS DOUBLE) * 1e6) * (x + 1)) AS BIGINT) AS placed FROM va GROUP BY 1, 2, 3, 4")
def s7(spark, d):
    pairs = write_files(spark, d, "npz").select(F.col("path").alias("density"), F.concat("path", F.lit("-velocity.npz")).alias("velocity"), "ensemble", "time")
    cells = vo.convert_npz_series(pairs).withColumn("value", F.col("value").cast("double"))
    placed = F.sum((F.round(F.col("value") * 1e6) * (F.col("x") + 1)).cast("long")).alias("placed")
    return result(cells.groupBy("ensemble", "channel", "y", "z").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 0).alias("filled"), F.max("value").alias("largest"), placed))
