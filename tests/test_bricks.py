"""Operators on bricks, slabs, stretches and ranges: cut small, they give what whole arrays give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import values
from voxframe.operators import compress, grids, metrics, points, rays, sampling, stencils
from voxframe.operators._tables import kept

RES = (11, 7, 5)


@pytest.fixture(scope="module")
def field(spark):
    """Two dense grids (key, x, y, z, value) and their arrays (z, y, x)."""
    rng = np.random.default_rng(8)
    arrays = {k: rng.random(RES[::-1]) for k in ("a", "b")}
    rows = [(k, x, y, z, float(v)) for k, a in arrays.items() for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "key string, x int, y int, z int, value double").repartition(3).cache(), arrays


def array(df, key, value="value", res=RES):
    out = np.full(res[::-1], np.nan)
    for r in df.where(F.col("key") == key).collect():
        assert np.isnan(out[r.z, r.y, r.x])
        out[r.z, r.y, r.x] = r[value]
    return out


@pytest.mark.parametrize("brick", [2, 3, 32])
def test_stencils_do_not_depend_on_bricks(spark, field, monkeypatch, brick):
    df, arrays = field
    monkeypatch.setattr(stencils, "BRICK", brick)
    monkeypatch.setattr(stencils.on_bricks, "__defaults__", tuple(brick if d == 32 else d for d in stencils.on_bricks.__defaults__))
    got = stencils.gradient(df, (1.0, 2.0, 0.5), ["key"])
    for k, a in arrays.items():
        padded = np.pad(a, 1, mode="edge")
        assert np.allclose(array(got, k, "gx"), (padded[1:-1, 1:-1, 2:] - padded[1:-1, 1:-1, :-2]) * 0.5)
        assert np.allclose(array(got, k, "gy"), (padded[1:-1, 2:, 1:-1] - padded[1:-1, :-2, 1:-1]) * 0.25)
        assert np.allclose(array(got, k, "gz"), (padded[2:, 1:-1, 1:-1] - padded[:-2, 1:-1, 1:-1]))
    got = {(r.key, r.axis): (r.n, r.total) for r in stencils.differences(df, by=["key"]).collect()}
    for k, a in arrays.items():
        for n, axis in enumerate("xyz"):
            d = np.diff(a, axis=2 - n)
            assert got[k, axis][0] == d.size and abs(got[k, axis][1] - (d * d).sum()) < 1e-9
    image = df.where("z = 0").drop("z")
    got = metrics.blur(image, ["x", "y"], 3, ["value"], ["key"]).withColumn("z", F.lit(0))
    w = np.array(metrics.gaussian_window(3))
    for k, a in arrays.items():
        want = np.full(a[0].shape, np.nan)
        for y in range(5):
            for x in range(9):
                want[y, x] = (a[0, y : y + 3, x : x + 3] * w[:, None] * w[None, :]).sum()
        assert np.allclose(array(got, k, res=(11, 7, 1))[0], want, equal_nan=True)


def test_curvature_does_not_depend_on_bricks(field, monkeypatch):
    df, _ = field
    want = {tuple(r[:4]): r[4:] for r in stencils.curvature(df, ["key"]).collect()}
    monkeypatch.setattr(stencils.on_bricks, "__defaults__", tuple(2 if d == 32 else d for d in stencils.on_bricks.__defaults__))
    got = {tuple(r[:4]): r[4:] for r in stencils.curvature(df, ["key"]).collect()}
    assert got.keys() == want.keys() and len(got) == 2 * 11 * 7 * 5 and all(np.allclose(got[k], want[k]) for k in got)


def test_stencils_refuse_sparse_grids(field):
    df, _ = field
    with pytest.raises(Exception, match="isn't dense"):
        stencils.gradient(df.where("x <> 3 or y <> 2"), by=["key"]).collect()


@pytest.fixture(scope="module")
def cube(spark):
    rng = np.random.default_rng(2)
    arrays = {k: np.cumsum(rng.normal(size=(8, 8, 8)), axis=2) for k in (1, 2, 3)}
    rows = [(k, x, y, z, float(v)) for k, a in arrays.items() for (z, y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "key long, x int, y int, z int, value double").repartition(3).cache(), arrays


def test_wavelets_in_bricks_come_back(cube, monkeypatch):
    df, arrays = cube
    monkeypatch.setattr(stencils.on_bricks, "__defaults__", tuple(4 if d == 32 else d for d in stencils.on_bricks.__defaults__))
    there = compress.dwt_forward(df, 8, 2, ["key"])
    back = compress.dwt_inverse(there, 8, 2, ["key"])
    for k, a in arrays.items():
        assert np.allclose(array(there, k, res=(8, 8, 8)), compress._transformed(a[None], 2)[0])
        assert np.allclose(array(back, k, res=(8, 8, 8)), a, atol=1e-4)
    whole = df.withColumn("value", F.round(F.col("value") * 100).cast("long"))
    back = compress.idwt_int_axes(compress.dwt_int_axes(whole, "xyz", 8, ["key"]), "zyx", 8, ["key"])
    columns = ["key", "x", "y", "z", "value"]
    assert back.count() == 3 * 512 and back.select(columns).exceptAll(whole.select(columns)).isEmpty()


@pytest.mark.parametrize("brick", [None, 4, 2])
def test_rates_of_bricks(cube, brick):
    df, arrays = cube
    size = brick or 8
    got = {(r.key, r.brick, r.step): r for r in compress.rate_by_brick(df, 8, 1, [0.25, 2.0], "key", brick, most=3).collect()}
    assert len(got) == 3 * (8 // size) ** 3 * 2
    for (k, number, step), r in got.items():
        bx, by, bz = number % (8 // size), number // (8 // size) % (8 // size), number // (8 // size) ** 2
        own = arrays[k][bz * size :, by * size :, bx * size :][:size, :size, :size]
        c = compress._transformed(own[None], 1)[0]
        q = np.trunc(c / step + np.sign(c) * 0.5).astype(int)
        symbols = np.where(q < 0, -2 * q - 1, 2 * q).ravel()
        n = np.unique(symbols, return_counts=True)[1]
        assert r.cells == size**3 and abs(r.entropy - -(n * np.log2(n / n.sum())).sum()) < 1e-6
        assert r.bits == sum(a * b for a, b in zip(n, compress.code_lengths(n.tolist()))) >= r.entropy - 1e-6
        error = compress._restored((q * step)[None], 1)[0] - own
        assert abs(r.rmse - np.sqrt((error**2).mean())) < 1e-9
        runs, zeros = [], 0
        for s in symbols:
            if s == 0:
                zeros += 1
            else:
                runs += [3] * (zeros // 4) + [zeros % 4]
                zeros = 0
        bits = 0
        for stream in (symbols[symbols > 0].tolist(), runs):
            n = np.unique(stream, return_counts=True)[1].tolist() if len(stream) else []
            bits += sum(a * b for a, b in zip(n, compress.code_lengths(n)))
        assert r.run_bits == bits


def test_bricks_against_the_whole(cube):
    df, _ = cube
    got = compress.bricked_or_whole(df, 8, 1, [0.5], "key", 4).collect()
    parts = compress.rate_by_brick(df, 8, 1, [0.5], "key", 4).groupBy("key").agg(F.sum("bits").alias("bits")).collect()
    assert {r.key: r.brick_bits for r in got} == {r.key: r.bits for r in parts} and all(r.more == r.brick_bits - r.whole_bits for r in got)


def test_tucker_by_slabs(cube, monkeypatch):
    df, arrays = cube
    monkeypatch.setattr(compress, "SLAB", 3)
    for n, axis in enumerate("xyz"):
        gram = {(r.key, r.i, r.j): r.value for r in compress.tucker_gram(df, axis, ["key"]).collect()}
        for k, a in arrays.items():
            flat = np.moveaxis(a, 2 - n, 0).reshape(8, -1)
            assert np.allclose([[gram[k, i, j] for j in range(8)] for i in range(8)], flat @ flat.T)
    small, large = compress.tucker(df, "key", 8), compress.tucker(df, "key")
    for k, a in arrays.items():
        one, two = array(small, k, res=(8, 8, 8)), array(large, k, res=(8, 8, 8))
        assert np.allclose(one, two, atol=1e-8) and abs((one**2).sum() - (a**2).sum()) < 1e-6


@pytest.mark.parametrize(("bins", "few"), [(4096, 4096), (3, 2), (2, 0)])
def test_quantiles(spark, bins, few):
    rng = np.random.default_rng(6)
    groups = {"n": rng.normal(size=301), "ties": rng.integers(0, 3, 200).astype(float), "one": np.array([5.0]), "same": np.full(50, -2.0), "wide": np.append(rng.random(20) * 1e-300, [1e308, -1e308]), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("none", None), ("n", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "most": 0.99, "high": 1.0}
    got = {r.k: r for r in metrics.quantiles(df, "v", shares, ["k"], bins, few).collect()}
    assert got.keys() == groups.keys()
    for k, own in groups.items():
        own = np.sort(own)
        for name, q in shares.items():
            place = q * (len(own) - 1)
            a, b, f = own[int(np.floor(place))], own[int(np.ceil(place))], place - np.floor(place)
            assert got[k][name] == (a if f == 0 else (1 - f) * a + f * b), (k, name)
    alone = metrics.quantiles(df.where("k = 'n'"), "v", {"median": 0.5}, bins=bins, few=few).first()
    assert alone.median == got["n"]["median"]


@pytest.mark.parametrize("stretch", [1, 5, 1 << 16])
def test_runs_across_stretches(spark, stretch):
    rng = np.random.default_rng(1)
    streams = {k: np.where(rng.random(200) < share, rng.integers(1, 4, 200), 0) for k, share in (("a", 0.5), ("b", 0.03), ("c", 0.0))}
    df = spark.createDataFrame([(k, i, int(s)) for k, own in streams.items() for i, s in enumerate(own)], "k string, position int, symbol int").repartition(3)
    got = {(r.k, r.position): (r.zeros, r.extra, r.rest) for r in compress.zero_runs(df, ["k"], "position", 3, stretch).collect()}
    want = {}
    for k, own in streams.items():
        last = -1
        for i in np.flatnonzero(own).tolist():
            zeros = i - last - 1
            want[k, i], last = (zeros, zeros // 4, zeros % 4), i
    assert got == want


def test_code_lengths_of_a_skewed_alphabet():
    counts = [2**k for k in range(600)]
    assert compress.code_lengths(counts)[:3] == [599, 599, 598] and compress.code_lengths([]) == []


# --- marching rays


@pytest.fixture(scope="module")
def scene(spark):
    """A ball in an otherwise empty box, and rays through it."""
    cells = grids.cells(spark, (24, 24, 24))
    r = F.sqrt(sum(((F.col(a) - 11.5) * (F.col(a) - 11.5) for a in "xyz"), F.lit(0.0)))
    grid = cells.withColumn("value", F.greatest(F.lit(0.0), 1 - r / 9)).cache()
    frames = values.view_frame(points.fibonacci_views(spark, 3, 2.0), centre=(0.5, 0.5, 0.5))
    box = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0, 1.0, 1.0)], "low_x double, low_y double, low_z double, high_x double, high_y double, high_z double")
    return grid, sampling.ray_clip(rays.view_rays(frames, 8, 8, 0.4, 0.4), box).cache()


def shade(value, previous):
    """Colours that also need the value before."""
    before = F.greatest(previous, F.lit(0.0))
    return F.struct(value.alias("r"), (value - before).alias("g"), before.alias("b"), F.when(value > 0.3, value * 2).otherwise(0.0).alias("a"))


def images_of(df, names):
    return {(r.view, r.px, r.py): np.array([r[c] for c in names]) for r in df.collect()}


@pytest.mark.parametrize("brick", [3, 16])
@pytest.mark.parametrize("early", [1.0, 0.8])
def test_marching_equals_all_samples(scene, brick, early):
    grid, clipped = scene
    how = (grid, (24, 24, 24), (0, 0, 0), (1, 1, 1), 0.03, shade)
    names = ["r", "g", "b", "alpha", "depth"]
    want = images_of(rays.line_integrals(clipped, *how, early_out=early), names)
    got = rays.march(clipped, *how, early_out=early, brick=brick).cache()
    mine = images_of(got, names)
    assert mine.keys() == want.keys() and all(np.allclose(mine[k], want[k]) for k in want)
    assert (got.agg(F.sum("samples")).first()[0] < rays.step_rays(clipped, 0.03).count()) == (early < 1)


def test_marching_leaves_out_what_is_empty(scene):
    grid, clipped = scene
    how = (grid, (24, 24, 24), (0, 0, 0), (1, 1, 1), 0.03, shade)
    every = rays.march(clipped, *how, dmin=0.3, brick=32).cache()
    some = rays.march(clipped, *how, dmin=0.3, brick=4).cache()
    names = ["r", "alpha", "depth"]
    a, b = images_of(every, names), images_of(some, names)
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    few, all_ = (x.agg(F.sum("samples")).first()[0] for x in (some, every))
    assert 0 < few < all_ / 2


def test_normals_point_into_the_ball(scene):
    grid, clipped = scene
    got = rays.march(clipped, grid, (24, 24, 24), (0, 0, 0), (1, 1, 1), 0.03, shade, dmin=0.3, normals=True, brick=8).where("alpha > 0.2")
    met = got.join(clipped, rays.RAY).collect()
    assert len(met) > 10
    for r in met:  # towards the centre, and most of it seen on the front side
        hit = np.array([r.ex, r.ey, r.ez]) + r.depth / r.alpha * np.array([r.dx, r.dy, r.dz])
        way = np.array([0.5] * 3) - hit
        n = np.array([r.nx, r.ny, r.nz])
        assert np.linalg.norm(n) <= r.alpha + 1e-9
        if np.linalg.norm(way) > 0.15:
            assert n @ way > 0


def test_runs_of_bricks_hold_every_step_once(scene):
    _, clipped = scene
    runs = rays.brick_runs(clipped, (24, 24, 24), (0, 0, 0), (1, 1, 1), 0.03, 5)
    steps = runs.withColumn("k", F.explode(F.sequence("k0", "k1"))).select(*rays.RAY, "k")
    want = rays.step_rays(clipped, 0.03).select(*rays.RAY, "k")
    assert steps.count() == want.count() and steps.exceptAll(want).isEmpty()
    assert runs.count() < steps.count() / 2


def test_kept_tables_survive_their_source(spark):
    df = kept(spark.range(5))
    assert sorted(r.id for r in df.collect()) == list(range(5)) and "Scan" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("n", [1, 3, 16])
def test_rays_meet_many_boxes(spark, monkeypatch, n):
    rng = np.random.default_rng(12)
    low = np.round(rng.random((80, 3)), 1)  # on planes between cells too
    size = np.where(rng.random((80, 3)) < 0.2, 0.0, np.round(rng.random((80, 3)) * 0.3, 2))
    box = [(k, *map(float, a), *map(float, a + b)) for k, (a, b) in enumerate(zip(low, size))]
    boxes = spark.createDataFrame(box, "box int, low_x double, low_y double, low_z double, high_x double, high_y double, high_z double")
    way = rng.normal(size=(120, 3))
    way[::4, 0] = 0.0
    way[::6, 2] = 0.0
    at = np.where(rng.random((120, 3)) < 0.3, np.round(rng.random((120, 3)), 1), rng.random((120, 3)) * 1.4 - 0.2)
    ray = [(k, *map(float, a), *map(float, b)) for k, (a, b) in enumerate(zip(at, way))]
    lines = spark.createDataFrame(ray, "ray int, ex double, ey double, ez double, dx double, dy double, dz double")
    key = lambda df: sorted((r.ray, r.box, round(r.tmin, 9), round(r.tmax, 9)) for r in df.collect())
    want = key(sampling.ray_clip(lines, boxes))
    assert len(want) > 50 and key(sampling.clip_by_cells(lines, boxes, n)) == want
    for k, b, t, u in want[::7]:  # points between entry and exit are in the box
        p = at[k] + (t + u) / 2 * way[k]
        assert (p >= low[b] - 1e-6).all() and (p <= low[b] + size[b] + 1e-6).all()
    monkeypatch.setattr(sampling, "MOST_BOXES", 10)
    assert key(sampling.ray_clip(lines, boxes)) == want


@pytest.mark.parametrize("blocks", [2, 7, 4096])
def test_numbers_by_place(spark, blocks):
    rng = np.random.default_rng(3)
    own = np.sort(np.append(rng.integers(-50, 10**12, 300), [7] * 40))
    df = spark.createDataFrame([(int(v),) for v in own], "v long").repartition(3)
    for n in (1, 2, 30, 200, len(own)):
        v, before = points.nth(df, "v", n, blocks)
        assert v == own[n - 1] and before == (own < v).sum()


def test_first_accepted_and_split(spark):
    df = spark.createDataFrame([(int(i) ** 3, 0.5) for i in range(200)], "id long, value double")
    assert sorted(r.id for r in points.first_accepted(df, 50, 8).collect()) == [i**3 for i in range(50)]
    assert points.first_accepted(df, 500).count() == 200 and points.first_accepted(df, 0).isEmpty()
    rows = points.chunk(spark.range(1000), 80)
    got = points.split_train_val(rows, 0.3)
    of = {}
    for r in got.collect():
        of.setdefault(r.chunk_id, set()).add(r.validation)
    assert all(len(v) == 1 for v in of.values()) and sum(v == {True} for v in of.values()) == int(len(of) * 0.3)
    assert points.split_train_val(rows, 0.0).where("validation").isEmpty()


def test_target_planes(cube):
    df, arrays = cube
    targets = [("eps", 0.5), ("eps", 1e-9), ("rmse", 0.5), ("psnr", 20.0)]
    got = {(r.key, r.kind, r.target): r for r in compress.target_planes(df, targets, 10, ["key"]).collect()}
    for k, a in arrays.items():
        v = np.abs(a).ravel()
        top = np.floor(np.log2(v.max()))
        q = np.floor(v * 2.0 ** (9 - top)).astype(int)
        for kind, target in targets:
            allowed = {"eps": (np.linalg.norm(v) * target) ** 2, "rmse": target**2 * v.size, "psnr": ((a.max() - a.min()) / 2 / 10 ** (target / 20)) ** 2 * v.size}[kind]
            want, known, bits = None, 0, 0.0
            for plane in range(10):
                seen = q >> (9 - plane)
                new, left = int((seen == 1).sum()), v.size - known
                p = new / left if left else 0
                bits += known + new + (-new * np.log2(p) - (left - new) * np.log2(1 - p) if 0 < p < 1 else 0)
                known += new
                if ((v - seen * 2.0 ** (top - plane)) ** 2).sum() <= allowed:
                    want = plane
                    break
            r = got[k, kind, target]
            assert r.plane == want and abs(r.allowed - allowed) < 1e-6 and (want is None or abs(r.bits - bits) < 1e-6)
