"""Reading and writing volumes. Files are first cut into slabs (rows with byte ranges) of at most ``SLAB_VOXELS`` voxels, which
Spark deals out, so that no task reads a whole file; zipped arrays alone are streamed by one task a file, slab by slab. Paths
must be seen by all executors, as files are read by Python's calls; a path may begin with file:."""

from __future__ import annotations

import json
import os
import re
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import cells, mip_size, mipmap, resample

VOXELS = "volume_id string, ensemble int, time int, feature string, x int, y int, z int, channel int, value float"
#: First bytes of a volume file, its version, the headers' lengths, and the type codes.
MAGIC, VERSION, HEADER, LEGACY_HEADER = b"CVOL", 1, 32, 64
TYPES = {0: ("uchar", np.uint8, 255), 1: ("ushort", np.uint16, 65535), 2: ("float", np.float32, 1)}
#: Voxels (times channels) that a task has at once.
SLAB_VOXELS = 1 << 20


def ensemble_manifest(spark: SparkSession, fmt: str, ensembles: tuple[int, int, int], times: tuple[int, int, int]) -> DataFrame:
    """ensemble, time, path of every member; start, step, count of each axis; ``fmt`` takes ensemble and time by place ("%1$03d")."""
    (e0, de, ne), (t0, dt, nt) = ensembles, times
    e = spark.range(ne).select((e0 + de * F.col("id")).cast("int").alias("ensemble"))
    t = spark.range(nt).select((t0 + dt * F.col("id")).cast("int").alias("time"))
    return e.crossJoin(t).withColumn("path", F.format_string(fmt, "ensemble", "time"))


#: What an ensemble's descriptor says; all but the format may be left out.
DESCRIPTOR = "format string, start_ensemble int, step_ensembles int, num_ensembles int, start_timestep int, step_timestep int, num_timesteps int"


def described_ensembles(spark: SparkSession, path: str) -> DataFrame:
    """descriptor, ensemble, time, path of the members of all ensembles that the JSON files at ``path`` describe.

    Starts are 0, steps and numbers 1 where a file doesn't say. A format takes ensemble and time by place ("%1$03d") or by
    name ("{ensemble:06d}", "{time}"). Paths are relative to the folder of their descriptor unless they begin with / or a scheme.
    """
    read = spark.read.schema(DESCRIPTOR).option("multiLine", "true").json(path).select(F.input_file_name().alias("descriptor"), "*")
    default = {"start_ensemble": 0, "step_ensembles": 1, "num_ensembles": 1, "start_timestep": 0, "step_timestep": 1, "num_timesteps": 1}
    read = read.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in default.items()}).where("format is not null and num_ensembles > 0 and num_timesteps > 0")
    form = F.col("format")
    for place, name in ((1, "ensemble"), (2, "time")):
        form = F.regexp_replace(F.regexp_replace(form, rf"\{{{name}:([0-9]+)d?\}}", rf"%{place}\$$1d"), rf"\{{{name}(?::d)?\}}", rf"%{place}\$d")
    each = read.withColumn("form", form).withColumn("e", F.explode(F.sequence(F.lit(0), F.col("num_ensembles") - 1))).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("num_timesteps") - 1)))
    each = each.withColumns({"ensemble": F.col("start_ensemble") + F.col("step_ensembles") * F.col("e"), "time": F.col("start_timestep") + F.col("step_timestep") * F.col("t")})
    named = F.expr("format_string(form, ensemble, time)")
    folder = F.regexp_replace("descriptor", "/[^/]*$", "/")
    whole = F.when(named.rlike("^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)"), named).otherwise(F.concat(folder, named))
    return each.select("descriptor", "ensemble", "time", whole.alias("path"))


def member(manifest: DataFrame, ensemble_index: int, time_index: int, ensembles: tuple[int, int, int], times: tuple[int, int, int]) -> DataFrame:
    """The row of an index pair; indices out of range are an error."""
    if not (0 <= ensemble_index < ensembles[2] and 0 <= time_index < times[2]):
        raise IndexError(f"member ({ensemble_index}, {time_index}) is out of range")
    return manifest.where((F.col("ensemble") == ensembles[0] + ensembles[1] * ensemble_index) & (F.col("time") == times[0] + times[1] * time_index))


def missing_volumes(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Members whose path isn't listed."""
    return manifest.join(listing.select("path"), "path", "left_anti")


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Paths below a folder, without reading the files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def read_header(path: str) -> dict:
    """World size and features (name, dtype, channels, sizes, offset of the data) of a volume file."""
    with open(_local(path), "rb") as f:
        magic, version, wx, wy, wz, features, flags = struct.unpack("<4si3fii4x", f.read(HEADER))
        if magic != MAGIC:
            f.seek(4)
            sx, sy, sz, vx, vy, vz, kind, packed = struct.unpack("<3Q3dI?7x", f.read(LEGACY_HEADER - 4))
            if packed:
                raise ValueError(f"{path}: compressed bodies aren't supported")
            return {"world": (vx * sx, vy * sy, vz * sz), "features": [("density", kind, 1, sx, sy, sz, LEGACY_HEADER)]}
        if version != VERSION:
            raise ValueError(f"{path}: unknown version {version}")
        if flags & 1:
            raise ValueError(f"{path}: compressed bodies aren't supported")
        found, at = [], HEADER
        for _ in range(features):
            f.seek(at)
            (n,) = struct.unpack("<i", f.read(4))
            name = f.read(n).decode()
            sx, sy, sz, channels, kind = struct.unpack("<3Qii", f.read(32))
            at += 4 + n + 32
            found.append((name, kind, channels, sx, sy, sz, at))
            at += sx * sy * sz * channels * TYPES[kind][1]().nbytes
        return {"world": (wx, wy, wz), "features": found}


def _slabs(manifest: DataFrame) -> DataFrame:
    """A row for each slab of whole z slices of each feature."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                for name, kind, channels, sx, sy, sz, at in read_header(r.path)["features"]:
                    each = sx * sy * channels * TYPES[kind][1]().nbytes
                    step = max(1, SLAB_VOXELS // max(sx * sy * channels, 1))
                    rows += [(r.path, r.ensemble, r.time, name, kind, channels, sx, sy, z, min(step, sz - z), at + z * each) for z in range(0, sz, step)]
            yield pd.DataFrame(rows, columns=["path", "ensemble", "time", "feature", "kind", "channels", "sx", "sy", "z0", "nz", "at"])

    ddl = "path string, ensemble int, time int, feature string, kind int, channels int, sx long, sy long, z0 long, nz long, at long"
    return manifest.select("path", "ensemble", "time").mapInPandas(cut, ddl)


def _long(values: np.ndarray, z0: int, r, feature: str, volume: str, x0: int = 0) -> pa.RecordBatch:
    """Rows of an array (z, y, x, channel) of a member's file."""
    nz, ny, nx, nc = values.shape
    n = values.size
    whole = lambda value, kind: pa.repeat(pa.scalar(None if pd.isna(value) else value, kind), n)
    x = np.tile(np.repeat(np.arange(x0, x0 + nx, dtype=np.int32), nc), nz * ny)
    y = np.tile(np.repeat(np.arange(ny, dtype=np.int32), nx * nc), nz)
    z = np.repeat(np.arange(z0, z0 + nz, dtype=np.int32), ny * nx * nc)
    columns = [whole(volume, pa.string()), whole(r.ensemble, pa.int32()), whole(r.time, pa.int32()), whole(feature, pa.string()), x, y, z, np.tile(np.arange(nc, dtype=np.int32), nz * ny * nx), values.ravel().astype(np.float32)]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[c.split()[0] for c in VOXELS.split(", ")])


def _voxels(slabs: DataFrame, load: Callable[[object], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Voxels of slabs; ``load`` takes one row. Slabs are dealt by their own place, so a large file is read by many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pandas().itertuples():
                yield from load(r)

    return slabs.repartition(*slabs.columns).mapInArrow(run, VOXELS)


def _local(path: str) -> str:
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else path


def read_volumes(manifest: DataFrame) -> DataFrame:
    """Voxels (values scaled to 1) of many volume files, version 1 and legacy."""

    def load(r) -> Iterator[pa.RecordBatch]:
        _, dtype, most = TYPES[r.kind]
        raw = np.fromfile(_local(r.path), dtype, int(r.nz * r.sy * r.sx * r.channels), offset=int(r.at))
        data = raw.astype(np.float32).reshape(int(r.nz), int(r.sy), int(r.sx), int(r.channels)) / np.float32(most)
        yield _long(data, int(r.z0), r, r.feature, r.path)

    return _voxels(_slabs(manifest), load)


def _descriptor(path: str, ensemble: int) -> tuple[str, list[int], str]:
    """The raw file, resolution and format that a text descriptor names."""
    fields = dict(line.split(":", 1) for line in open(_local(path)).read().splitlines() if ":" in line)
    fields = {k.strip(): v.strip() for k, v in fields.items()}
    name = fields["ObjectFileName"]
    return f"{_local(path).rpartition('/')[0]}/{name % ensemble if '%' in name else name}", [int(n) for n in fields["Resolution"].split()], fields["Format"].upper()


RAW_TYPES = {"UCHAR": (np.uint8, 255), "USHORT": (np.uint16, 65535), "FLOAT": (np.float32, 1)}


def read_raw_volumes(manifest: DataFrame) -> DataFrame:
    """Voxels of text descriptors (ObjectFileName, Resolution, SliceThickness, Format) with raw files beside them."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                file, (nx, ny, nz), kind = _descriptor(r.path, r.ensemble)
                width = RAW_TYPES[kind][0]().nbytes
                head = os.path.getsize(file) - nx * ny * nz * width  # what is before the payload is a header
                step = max(1, SLAB_VOXELS // (nx * ny))
                rows += [(r.path, r.ensemble, r.time, file, kind, nx, ny, z, min(step, nz - z), head + z * nx * ny * width) for z in range(0, nz, step)]
            yield pd.DataFrame(rows, columns=["path", "ensemble", "time", "file", "kind", "nx", "ny", "z0", "n", "at"])

    def load(r) -> Iterator[pa.RecordBatch]:
        dtype, most = RAW_TYPES[r.kind]
        data = np.fromfile(r.file, dtype, int(r.nx * r.ny * r.n), offset=int(r.at)).astype(np.float32) / np.float32(most)
        yield _long(data.reshape(int(r.n), int(r.ny), int(r.nx), 1), int(r.z0), r, "density", r.path)

    ddl = "path string, ensemble int, time int, file string, kind string, nx long, ny long, z0 long, n long, at long"
    return _voxels(manifest.select("path", "ensemble", "time").mapInPandas(cut, ddl), load)


def world_size(resolution: Sequence[int], thickness: Sequence[float]) -> tuple[float, ...]:
    """World size of a raw volume: its longest side is 1."""
    size = [n * t for n, t in zip(resolution, thickness)]
    return tuple(s / max(size) for s in size)


def read_xyz_volumes(manifest: DataFrame) -> DataFrame:
    """Voxels of files with 3 sizes, 3 doubles and floats whose fastest axis is z."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                nx, ny, nz = (int(n) for n in np.fromfile(_local(r.path), np.uint32, 3))
                step = max(1, SLAB_VOXELS // (ny * nz))
                rows += [(r.path, r.ensemble, r.time, ny, nz, x, min(step, nx - x)) for x in range(0, nx, step)]
            yield pd.DataFrame(rows, columns=["path", "ensemble", "time", "ny", "nz", "x0", "n"])

    def load(r) -> Iterator[pa.RecordBatch]:
        n, ny, nz = int(r.n), int(r.ny), int(r.nz)
        data = np.fromfile(_local(r.path), np.float32, n * ny * nz, offset=36 + 4 * int(r.x0) * ny * nz).reshape(n, ny, nz)
        yield _long(np.ascontiguousarray(data.transpose(2, 1, 0))[..., None], 0, r, "density", r.path, int(r.x0))

    ddl = "path string, ensemble int, time int, ny long, nz long, x0 long, n long"
    return _voxels(manifest.select("path", "ensemble", "time").mapInPandas(cut, ddl), load)


def _zipped_slices(path: str) -> tuple[tuple[int, ...], Iterator[np.ndarray]]:
    """Shape (z, y, x, c) and the z slices of a zipped array, one at a time."""
    archive = zipfile.ZipFile(_local(path))
    f = archive.open("arr_0.npy")
    version = np.lib.format.read_magic(f)
    shape, by_column, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
    if by_column:
        raise ValueError(f"{path}: arrays whose first axis is the fastest aren't supported")
    size = int(np.prod(shape[1:])) * dtype.itemsize
    return shape, (np.frombuffer(f.read(size), dtype).reshape(shape[1:]) for _ in range(shape[0]))


def convert_npz_series(manifest: DataFrame) -> DataFrame:
    """Four channels (density cut to [0, 5] and scaled, velocity) of pairs of arrays (z, y, x, c), padded to cubes with zeros.

    A zipped array can't be entered in its middle, so one task streams a pair of files, z slice by z slice.
    """

    def load(r) -> Iterator[pa.RecordBatch]:
        (nz, ny, nx, _), density = _zipped_slices(r.density)
        _, velocity = _zipped_slices(r.velocity)
        side = max(nz, ny, nx)
        before = [(side - n) // 2 for n in (nz, ny, nx)]
        for z in range(side):
            plane = np.zeros((1, side, side, 4), np.float32)
            if before[0] <= z < before[0] + nz:
                both = np.concatenate([np.clip(next(density), 0, 5) / 5, next(velocity)], axis=2)
                plane[0, before[1] : before[1] + ny, before[2] : before[2] + nx] = both
            yield _long(plane, z, r, "flow", r.density)

    return _voxels(manifest.select("density", "velocity", "ensemble", "time"), load)


def write_volumes(voxels: DataFrame, path: str, res: Sequence[int] | None = None, levels: int = 0) -> None:
    """Parquet by volume, feature, level and time, so that a reader opens only what it asks for.

    With ``levels``, the mip levels 1 .. ``levels`` (reductions by 2, 3, ...) of grids of size ``res`` are written beside the data, each from what is
    written already: from the largest level that divides it, as the means of whole windows are means of means, else from the data.
    """
    parts = [c for c in ("volume_id", "feature") if c in voxels.columns]
    times = [c for c in ("time",) if c in voxels.columns]
    if not levels:
        voxels.write.partitionBy(*parts, *times).parquet(path)
        return
    if res is None:
        raise ValueError("levels need the size of the grids")
    by = [c for c in voxels.columns if c not in ("x", "y", "z", "value")]
    data = voxels.withColumn("value", F.col("value").cast("double"))
    data.withColumn("level", F.lit(0)).write.partitionBy(*parts, "level", *times).parquet(path)
    schema = data.withColumn("level", F.lit(0)).schema
    for level in range(1, levels + 1):
        shrink, own = level + 1, [mip_size(n, level) for n in res]
        below = max((k for k in range(level) if shrink % (k + 1) == 0 and all(n % shrink == 0 or n == 1 for n in res)), default=0)
        source = voxels.sparkSession.read.schema(schema).parquet(path).where(F.col("level") == below).drop("level")
        made = resample(source, [mip_size(n, below) for n in res], own, by) if below else mipmap(source, res, level, by)
        made.withColumn("level", F.lit(level)).write.mode("append").partitionBy(*parts, "level", *times).parquet(path)


def read_level(spark: SparkSession, path: str, level: int) -> DataFrame:
    """The voxels of a level; files of other levels aren't opened."""
    return spark.read.parquet(path).where(F.col("level") == level).drop("level")


def read_eval_json(spark: SparkSession, path: str) -> DataFrame:
    """A row for each case of evaluation files, with its file."""
    whole = spark.read.option("multiLine", "true").json(path).withColumn("file", F.input_file_name())
    return whole.select("file", *(c for c in whole.columns if c not in ("cases", "file")), F.explode("cases").alias("case")).select("*", "case.*").drop("case")


def export_runs(runs: DataFrame, path: str) -> None:
    runs.write.option("sep", "\t").option("header", "true").csv(path)


def persist_views(asked: DataFrame, compute, path: str, key: Sequence[str]) -> DataFrame:
    """The cached rows of the asked keys; absent ones are computed from their keys and added to the cache."""
    spark = asked.sparkSession
    try:
        held = spark.read.parquet(path)
        absent = asked.join(held.select(*key).distinct(), list(key), "left_anti")
    except Exception as error:  # nothing cached so far
        if "PATH_NOT_FOUND" not in str(error):
            raise
        absent = asked
    compute(absent).write.mode("append").partitionBy(*key[:1]).parquet(path)
    return spark.read.parquet(path).join(asked.select(*key).distinct(), list(key), "left_semi")


#: The boxes of the implicit equations (lowest and highest coordinate).
BOX = {"endrass": 2.0, "ding_dong": 2.0, "kummer": 2.0, "blobby": 2.0, "barth": 1.5, "steiner": 0.5}


def _implicit(name: str, x, y, z, p: dict):
    density = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - v))
    cube = lambda v: v * v * v
    x2, y2, z2 = x * x, y * y, z * 2  # the last one isn't a square: it defines the data set
    if name == "marschner_lobb":
        fm, alpha = p.get("fM", 6.0), p.get("alpha", 0.25)
        rho = F.cos(F.cos(F.sqrt(x * x + y * y) * (np.pi / 2)) * (2 * np.pi * fm))
        return ((1 - F.sin(z * (np.pi / 2))) + alpha * (1 + rho)) / (2 * (1 + alpha))
    if name == "cube":
        edge = [F.greatest(F.lit(0.0), F.abs(c) - p.get("scale", 0.5)) for c in (x, y, z)]
        return 1 - F.sqrt(sum((e * e for e in edge), F.lit(0.0)))
    if name == "sphere":
        return 1 - F.sqrt(x * x + y * y + z * z)
    if name == "inverse_sphere":
        return F.sqrt(x * x + y * y + z * z)
    if name == "ding_dong":
        return density(x2 + y2 - z * (1 - z * z))
    if name == "endrass":
        r = float(np.sqrt(2))
        a, b = (x + y) * (x + y) - 2, (x - y) * (x - y) - 2
        inner = -4 * (1 - r) + 8 * (2 - r) * z * z + 2 * (2 - 7 * r) * (x2 + y2) - 16 * z * z * z * z + 8 * (1 + 2 * r) * z * z - 1 + 12 * r
        return 0.5 + 64 * (x2 - 1) * (y2 - 1) * a * b - inner * inner
    if name == "barth":
        phi = float((1 + np.sqrt(5)) / 2)
        w = (z + 0.5) * 2
        around = x2 + y2 + w - 1
        return 0.5 + 4 * (phi * phi * x2 - y2) * (phi * phi * y2 - w) * (phi * phi * w - x2) - (1 + 2 * phi) * around * around
    if name == "heart":
        return density(cube(2 * x2 + 2 * y2 + z2 - 1) - 0.1 * x2 * z2 * z - y2 * z2 * z)
    if name == "kleine":
        a, b, c = 25 * x * x, 25 * y * y, 5 * z * 2
        less = a + b + c - 10 * y - 1
        return 0.5 - ((a + b + c + 10 * y - 1) * less * less - 8 * c + 400 * x * y * less)
    if name == "cassini":
        a = p.get("a", 0.25)
        return density(((x + a) * (x + a) + y2) * ((x - a) * (x - a) + y2) - z * z)
    if name == "steiner":
        return density(x2 * y2 + x2 * z2 + y2 * z2 - 2 * x * y * z)
    if name == "cross_cap":
        return density(4 * x2 * (x2 + y2 * z2 + z) + y2 * (y2 + z2 - 1))
    if name == "kummer":
        return density(x2 * x2 + y2 * y2 + z2 * z2 - x2 - y2 - z2 - x2 * y2 - y2 * z2 - z2 * x2 + 1)
    if name == "blobby":
        return density(x2 + y2 * z2 + F.sin(4 * x) - F.cos(4 * y) + F.sin(4 * z) - 1)
    if name == "tube":
        return ((1 - F.sqrt(y * y + z * z) * cube(0.9 - 0.5 * F.cos(7 * x))) - 0.9) * 10
    raise ValueError(f"unknown equation {name}")


EQUATIONS = ["marschner_lobb", "cube", "sphere", "inverse_sphere", "ding_dong", "endrass", "barth", "heart", "kleine", "cassini", "steiner", "cross_cap", "kummer", "blobby", "tube"]


def synthetic_volume(spark: SparkSession, resolution: int, equation, params: dict | None = None, box: float | None = None) -> DataFrame:
    """An implicit equation (a name, or a function of x, y, z columns) on an equally spaced grid that includes both ends."""
    half = box or (BOX.get(equation, 1.0) if isinstance(equation, str) else 1.0)
    step = 2 * half / (resolution - 1)
    x, y, z = (-half + F.col(a) * step for a in "xyz")
    value = _implicit(equation, x, y, z, params or {}) if isinstance(equation, str) else equation(x, y, z)
    return cells(spark, [resolution] * 3).withColumn("value", value)


# --- declared equations

#: Functions that declared equations may call, beside Spark's own.
FUNCTIONS = {"sqr": "({0}) * ({0})", "cb": "({0}) * ({0}) * ({0})", "implicit2Density": "greatest(0D, least(1D, 0.5D - ({0})))"}
_ALIASES = {"sqrtf": "sqrt", "cosf": "cos", "sinf": "sin", "expf": "exp", "powf": "power", "fabsf": "abs", "fmaxf": "greatest", "fminf": "least"}


def _cut(text: str, at: str) -> list[str]:
    """Parts of a text between signs that stand outside brackets."""
    parts, deep = [""], 0
    for c in text:
        deep += (c == "(") - (c == ")")
        if c == at and not deep:
            parts.append("")
        else:
            parts[-1] += c
    return [p.strip() for p in parts if p.strip()]


def declared_expression(text: str) -> str:
    """A declared formula as an expression of Spark SQL, which is left to parse it: numbers are doubles, functions have Spark's names."""
    out = re.sub(r"(?<![\w.])(\d+\.?\d*(?:e-?\d+)?)f?(?![\w.])", r"\1D", text).replace("M_PI", "pi()")
    for name, own in _ALIASES.items():
        out = re.sub(rf"\b{name}\(", f"{own}(", out)
    for name, own in FUNCTIONS.items():
        while m := re.search(rf"\b{name}\(", out):
            deep, end = 1, m.end()
            while deep:
                deep += (out[end] == "(") - (out[end] == ")")
                end += 1
            out = out[: m.start()] + "(" + own.format(out[m.end() : end - 1]) + ")" + out[end:]
    return out


def declared_volume(spark: SparkSession, declaration: dict, resolution: int) -> DataFrame:
    """x, y, z, value of an equation that a JSON object declares, on an equally spaced grid that includes both ends.

    ``declaration``: name, boxsize, parameters (numbers, called p.name) and codeForward: names set by "auto a = ..;", and "return ..;" with
    arithmetic and functions of x, y, z and of what was set before. Expressions are Spark's, so nothing runs outside its plans.
    """
    half = float(declaration.get("boxsize", 2)) / 2
    step = 2 * half / (resolution - 1)
    place = [(-half + F.col(a) * step).alias(a) for a in "xyz"]
    given = declaration.get("parameters") or {}
    p = F.struct(*(F.lit(float(v)).alias(k) for k, v in given.items())) if given else F.lit(None).cast("double")
    out = cells(spark, [resolution] * 3).select(F.struct("x", "y", "z").alias("cell"), *place, p.alias("p"))
    for statement in _cut(declaration["codeForward"], ";"):
        if statement.startswith("return"):
            out = out.select("cell.*", F.expr(declared_expression(statement.removeprefix("return"))).cast("double").alias("value"))
            return out
        for one in _cut(re.sub(r"^(?:auto|float|double|real_t)\s", "", statement), ","):
            name, _, own = one.partition("=")
            out = out.withColumn(name.strip(), F.expr(declared_expression(own)))
    raise ValueError(f"the equation {declaration.get('name')} returns nothing")


def declared_equations(spark: SparkSession, path: str) -> list[dict]:
    """The objects of a JSON file of declared equations (a list, some kB long)."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
