import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions.values import to_object_space
from voxframe.operators import compress, grids, metrics, points, rays, sampling
from voxframe.operators.scoring import Model, score
from voxframe.plans import queries_sources, registry
from voxframe.plans.bindings import images, runs, series, table
from voxframe.sources import volumes


@pytest.fixture(scope="module")
def block(spark):
    rng = np.random.default_rng(1)
    data = rng.random((4, 6, 8))  # z, y, x
    rows = [(x, y, z, float(data[z, y, x])) for z in range(4) for y in range(6) for x in range(8)]
    return data, spark.createDataFrame(rows, "x int, y int, z int, value double").cache()


def test_pooling_keeps_the_mean_where_sizes_divide(block):
    data, grid = block
    out = grids.resample(grid, (8, 6, 4), (4, 3, 2)).toPandas()
    assert len(out) == 24 and abs(out.value.mean() - data.mean()) < 1e-12


def test_bricks_round_trip(block):
    _, grid = block
    back = grids.from_bricks(grids.to_bricks(grid, 3, 1), 3)
    assert grids.compare_grids(grid, back).isEmpty() and back.count() == grid.count()


def test_brick_samples_equal_voxel_samples(spark, block):
    _, grid = block
    res = (8, 6, 4)
    p = to_object_space(points.random_points(spark, 200, 3, 5).toDF("id", "px", "py", "pz"), (0, 0, 0), (1, 1, 1), res)
    a = sampling.sample(p, grid, res, ["id"])
    b = sampling.sample_bricks(p, grids.array_bricks(grid, res, 3), res, 3, ["id"])
    pairs = sampling.pair_prediction(a, b, ["id"])
    assert pairs.count() == 200 and pairs.where("abs(truth - predicted) > 1e-9").isEmpty()


def test_unknown_mode_is_an_error(block):
    with pytest.raises(ValueError):
        sampling.sample(block[1], block[1], (8, 6, 4), ["id"], "sinc")


def test_fibonacci_views_cover_the_sphere(spark):
    v = points.fibonacci_views(spark, 4096).toPandas()
    mean = np.stack([np.cos(v.pitch) * np.cos(v.yaw), np.sin(v.pitch), np.cos(v.pitch) * np.sin(v.yaw)]).mean(axis=1)
    assert np.abs(mean).max() < 1e-2


def test_first_accepted_is_the_first_n(spark):
    ids = spark.range(0, 30000, 3)
    got = points.first_accepted(ids, 5000).toPandas().id
    assert len(got) == 5000 and got.max() == 3 * 4999


def test_acceptance_rate(spark):
    field = spark.range(20000).select("id", *(p.alias(n) for p, n in zip(points.plastic(F.col("id"), 4), ("px", "py", "pz", "u"))))
    got = points.importance_points(field, lambda c: c.withColumn("value", F.col("px")), 10**9, 0.2, 1.0).count()
    assert abs(got / 20000 - (0.2 * 0.2 + (1 - 0.04) / 2)) < 0.01


def test_split_keeps_chunks_together(spark):
    d = points.split_train_val(points.chunk(spark.range(5000), 800), 0.3)
    per = d.groupBy("chunk_id").agg(F.count_distinct("validation").alias("n"), F.max("validation").alias("v")).collect()
    assert all(r.n == 1 for r in per) and sum(r.v for r in per) == int(len(per) * 0.3)


@pytest.mark.parametrize("blend", ["beer", "alpha"])
@pytest.mark.parametrize("early", [1.0, 0.8])
def test_composite_equals_a_sequential_fold(spark, blend, early):
    rng = np.random.default_rng(2)
    a, c = rng.random((5, 12)) * 0.6, rng.random((5, 12))
    rows = [(r, k, float(k), float(c[r, k]), 0.0, 1.0, float(a[r, k])) for r in range(5) for k in range(12)]
    got = rays.composite(spark.createDataFrame(rows, "ray int, k int, t double, r double, g double, b double, a double"), blend, early, ["ray"]).toPandas().set_index("ray")
    for r in range(5):
        colour = alpha = 0.0
        for k in range(12):
            if alpha >= early:
                break
            w = 1 - np.exp(-a[r, k]) if blend == "beer" else min(1, a[r, k])
            colour, alpha = colour + (1 - alpha) * c[r, k] * w, alpha + (1 - alpha) * w
        assert abs(got.r[r] - colour) < 1e-9 and abs(got.alpha[r] - alpha) < 1e-9


def test_refined_crossing_comes_nearer(spark):
    steps = spark.range(11).select(F.lit(0).alias("ray"), F.col("id").alias("k"), (F.col("id") / 10).alias("t"), (F.col("id") / 10).alias("value"))
    hit = rays.first_crossing(steps, 0.537, ["ray"])
    got = rays.refine_crossing(hit, lambda r: r.withColumn("value", F.col("t")), 0.537, 8, ["ray"]).first().t
    assert abs(got - 0.537) < 0.1 / 2**8 + 1e-9


def test_integer_wavelet_is_lossless(spark):
    rng = np.random.default_rng(3)
    cells = [(x, y, z, int(rng.integers(-900, 900))) for x in range(4) for y in range(4) for z in range(4)]
    grid = spark.createDataFrame(cells, "x int, y int, z int, value long")
    out = grid
    for a in "xyz":
        out = compress.dwt_int_axis(out, a, 4)
    for a in "zyx":
        out = compress.idwt_int_axis(out, a, 4)
    assert grids.compare_grids(grid, out).isEmpty()


def test_code_lengths_are_optimal():
    assert compress.code_lengths([5]) == [1]
    got = compress.code_lengths([5, 9, 12, 13, 16, 45])
    assert sum(n * k for n, k in zip([5, 9, 12, 13, 16, 45], got)) == 224


def test_tucker_core_keeps_the_norm(spark, block):
    data, grid = block
    core = compress.tucker(grid.withColumn("id", F.lit(1)), "id").toPandas()
    assert abs((core.value**2).sum() - (data**2).sum()) < 1e-8


def test_gaussian_codes_follow_the_normal_distribution(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(5)
    x = rng.standard_normal(500) * 2 + 1
    out = compress.byte_gaussian(spark.createDataFrame([(1, float(v)) for v in x], "g int, value double"), ["g"]).toPandas()
    cdf = NormalDist(x.mean(), x.std(ddof=1)).cdf
    assert all(abs(c - round(255 * cdf(v))) <= 1 for c, v in zip(out.code, out.value))
    assert (out.decoded - out.value).abs().mean() < 0.02


def test_linear_codes_are_within_half_a_step(spark, block):
    data, grid = block
    out = compress.byte_linear(grid.withColumn("g", F.lit(0)), ["g"])
    limit = (data.max() - data.min()) / 510 + 1e-9
    assert out.where(F.abs(F.col("decoded") - F.col("value")) > limit).isEmpty()


def test_ssim_of_equal_images_is_one(spark):
    im = grids.cells(spark, (64, 64, 1)).select("x", "y", (F.sin(F.col("x") / 5.0) + 1).alias("truth")).withColumn("predicted", F.col("truth"))
    assert abs(metrics.ssim(im, 64, 64).first().ssim - 1) < 1e-9
    for variant in ("standard", "reference"):
        assert abs(metrics.ms_ssim(im, 64, 64, variant=variant).first().ms_ssim - 1) < 1e-9


def test_fractional_fill_keeps_full_cells(spark):
    im = grids.cells(spark, (8, 6, 1)).select("x", "y", (F.col("x") + F.col("y") * 1.0).alias("value"), F.when((F.col("x") + F.col("y")) % 3 == 0, 0.0).otherwise(1.0).alias("mask"))
    out = grids.fill_fractional(im, 8, 6).withColumnsRenamed({"value": "new", "mask": "new_mask"}).join(im, ["x", "y"])
    assert out.count() == 48 and out.where("mask = 1 and abs(new - value) > 1e-12").isEmpty() and out.where("new_mask <= 0").isEmpty()


@pytest.mark.parametrize("activation", ["ReLU", "Sine", "Snake", "SnakeAlt", "Sigmoid", "None"])
@pytest.mark.parametrize("output", ["density", "density:direct", "rgbo", "rgbo:direct", "rgbo:exp"])
def test_models_score_without_nan(activation, output):
    rng = np.random.default_rng(6)
    last = 1 if output.startswith("density") else 4
    m = Model([(rng.standard_normal((3, 8)), rng.standard_normal(8)), (rng.standard_normal((8, last)), rng.standard_normal(last))], activation, 2.0, output)
    got = m(rng.random((50, 3)))
    assert got.shape == (50, last) and np.isfinite(got).all() and (got[:, : min(last, 3)] >= 0).all() and (got[:, : min(last, 3)] <= 1).all()


def test_score_equals_the_model(spark):
    m = Model([(np.eye(3)[:, :1], np.zeros(1))])
    p = points.random_points(spark, 30, 3, 1).toDF("id", "px", "py", "pz")
    got = score(p, m, ["px", "py", "pz"], ["id"]).join(p, "id").toPandas()
    assert np.allclose(got.value, 1 / (1 + np.exp(-got.px)))


# --- files


def test_format_strings(spark):
    for fmt, want in (("files/ensemble%1$03d/time%2$03d.dat", "files/ensemble005/time007.dat"), ("files/time%2$03d.dat", "files/time007.dat"), ("files/ensemble%1$03d.dat", "files/ensemble005.dat")):
        assert volumes.ensemble_manifest(spark, fmt, (5, 1, 1), (7, 1, 1)).first().path == want
    with pytest.raises(IndexError):
        volumes.member(spark.range(0), 3, 0, (0, 1, 3), (0, 1, 1))


def _volume(path, features):
    import struct

    with open(path, "wb") as f:
        f.write(struct.pack("<4si3fii4x", b"CVOL", 1, 1.0, 1.0, 1.0, len(features), 0))
        for name, kind, data in features:  # z, y, x, c
            z, y, x, c = data.shape
            f.write(struct.pack("<i", len(name)) + name.encode() + struct.pack("<3Qii", x, y, z, c, kind) + data.tobytes())


def test_volume_files(spark, tmp_path, monkeypatch):
    import struct

    rng = np.random.default_rng(7)
    density, flow = rng.integers(0, 255, (3, 4, 5, 1), np.uint8), rng.random((3, 4, 5, 2), np.float32)
    _volume(tmp_path / "a.cvol", [("density", 0, density), ("flow", 2, flow)])
    with open(tmp_path / "b.cvol", "wb") as f:
        f.write(b"cvol" + struct.pack("<3Q3dI?7x", 5, 4, 3, 0.1, 0.1, 0.1, 2, False) + flow[..., 0].tobytes())
    manifest = spark.createDataFrame([(str(tmp_path / "a.cvol"), 0, 0), (str(tmp_path / "b.cvol"), 0, 1)], "path string, ensemble int, time int")
    got = volumes.read_volumes(manifest).toPandas()
    assert len(got) == 60 + 120 + 60
    for r in got.itertuples():
        want = density[r.z, r.y, r.x, 0] / 255 if r.time == 0 and r.feature == "density" else flow[r.z, r.y, r.x, r.channel]
        assert abs(r.value - want) < 1e-6


def test_raw_xyz_npz_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = rng.random((3, 4, 5), np.float32)
    (tmp_path / "v01.raw").write_bytes(b"header" + data.tobytes())
    (tmp_path / "v.dat").write_text("ObjectFileName: v%02d.raw\nResolution: 5 4 3\nSliceThickness: 1 1 2\nFormat: FLOAT\n")
    raw = volumes.read_raw_volumes(spark.createDataFrame([(str(tmp_path / "v.dat"), 1, 0)], "path string, ensemble int, time int")).toPandas()
    assert len(raw) == 60 and all(abs(r.value - data[r.z, r.y, r.x]) < 1e-6 for r in raw.itertuples())
    assert volumes.world_size((5, 4, 3), (1, 1, 2)) == (5 / 6, 4 / 6, 1.0)
    np.concatenate([np.array([3, 4, 5], np.uint32).view(np.uint8), np.ones(3).view(np.uint8), data.ravel().view(np.uint8)]).tofile(tmp_path / "v.xyz")
    xyz = volumes.read_xyz_volumes(spark.createDataFrame([(str(tmp_path / "v.xyz"), 0, 0)], "path string, ensemble int, time int")).toPandas()
    assert len(xyz) == 60 and all(abs(r.value - data[r.x, r.y, r.z]) < 1e-6 for r in xyz.itertuples())
    np.savez(tmp_path / "d.npz", arr_0=data[..., None] * 10)
    np.savez(tmp_path / "w.npz", arr_0=rng.random((3, 4, 5, 3), np.float32))
    npz = volumes.convert_npz_series(spark.createDataFrame([(str(tmp_path / "d.npz"), str(tmp_path / "w.npz"), 0, 0)], "density string, velocity string, ensemble int, time int")).toPandas()
    assert len(npz) == 5**3 * 4 and npz[npz.channel == 0].value.max() <= 1


@pytest.mark.parametrize("name", volumes.EQUATIONS)
def test_every_equation_has_values(spark, name):
    out = volumes.synthetic_volume(spark, 5, name)
    assert out.count() == 125 and out.where("value is null or isnan(value)").isEmpty()


def test_eval_files_hold_all_cases_in_bounded_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_sources, "CASES", 100)
    r = runs(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "cases")
    queries_sources.write_cases(r, path)
    got = volumes.read_eval_json(spark, path)
    want = r.select("config", "variant", "seq", "metric")
    back = got.select("config", "algorithm", "seq", "psnr_world")
    assert back.count() == want.count() > 1000 and back.exceptAll(want).isEmpty() and want.exceptAll(back).isEmpty()
    assert got.groupBy("file").count().agg(F.max("count")).first()[0] <= 100


def test_rates_of_all_volumes(spark):
    got = registry.QUERIES["g5_rate_by_brick"](spark, "/root/testdata/sf0.001")
    ids = table(spark, "/root/testdata/sf0.001", "embeddings").select("vec_id").collect()
    assert sorted((r.volume_id, float(r.step)) for r in got.collect()) == sorted((r.vec_id, s) for r in ids for s in (0.05, 0.1))


def test_fractional_fill_of_all_images(spark):
    got = registry.QUERIES["g7_fill_fractional"](spark, "/root/testdata/sf0.001")
    names = sorted(r.image for r in images(spark, "/root/testdata/sf0.001").select("image").distinct().collect())
    assert len(names) > 1 and sorted(r.image for r in got.collect()) == sorted(n for n in names for _ in range(720))
    im = grids.cells(spark, (8, 6, 1)).select("x", "y", (F.col("x") + F.col("y") * 1.0).alias("value"), (((F.col("x") + F.col("y")) % 3) / 2).alias("mask"))
    two = im.withColumn("image", F.lit("a")).union(im.selectExpr("x", "y", "9 - value", "1 - mask", "'b'"))
    both = grids.fill_fractional(two, 8, 6, ["image"]).cache()
    for name in "ab":
        alone = {(r.x, r.y): (r.value, r.mask) for r in grids.fill_fractional(two.where(F.col("image") == name).drop("image"), 8, 6).collect()}
        mine = {(r.x, r.y): (r.value, r.mask) for r in both.where(F.col("image") == name).collect()}
        assert len(mine) == 48 and mine.keys() == alone.keys() and all(np.allclose(mine[k], alone[k]) for k in mine)


def test_times_before_the_first_and_after_the_last_frame_are_held(spark):
    """The months that j3_time_lerp and its SQL leave out."""
    asked = series(spark, "/root/testdata/sf0.001").select("ensemble", "time").distinct().withColumn("t", (F.col("time") - 6) / 12)
    frames = asked.select("ensemble").distinct().crossJoin(spark.range(6).selectExpr("cast(id as int) as idx", "cast(10 * id + id * id as double) as value"))
    got = sampling.time_lerp(asked, frames, 6, ["ensemble", "time"], ["ensemble"]).collect()
    assert len(got) == asked.count() and {r.time < 6 for r in got} == {True, False} and max(r.time for r in got) > 66
    for r in got:
        t = min(max((r.time - 6) / 12, 0), 5)
        assert abs(r.value - np.interp(t, range(6), [10.0 * k + k * k for k in range(6)])) < 1e-9


def test_bricks_that_lack_cells_are_an_error(spark, block):
    _, grid = block
    res = (8, 6, 4)
    p = to_object_space(points.random_points(spark, 50, 3, 5).toDF("id", "px", "py", "pz"), (0, 0, 0), (1, 1, 1), res)
    with pytest.raises(Exception, match="dense"):
        sampling.sample(p, grid.where("x <> 3"), res, ["id"]).collect()
    assert sampling.sample(p, grid.where("x <> 3"), res, ["id"], "nearest").count() < 50


def test_samples_of_every_brick_size_agree(spark, block):
    """Cubic samples and gradients from small bricks, whose halos matter, against one brick that holds the grid."""
    _, grid = block
    res = (8, 6, 4)
    p = to_object_space(points.random_points(spark, 100, 3, 9).toDF("id", "px", "py", "pz"), (0, 0, 0), (1, 1, 1), res)
    small = sampling.sample_bricks(p, grids.array_bricks(grid, res, 2, 2, 3), res, 2, ["id"], "cubic")
    whole = sampling.sample(p, grid, res, ["id"], "cubic")
    pairs = sampling.pair_prediction(small, whole, ["id"])
    assert pairs.count() == 100 and pairs.where("abs(truth - predicted) > 1e-9").isEmpty()


def test_many_boxes_are_met_by_cells(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MOST_BOXES", 1)
    names = [f"{e}_{a}" for e in ("low", "high") for a in "xyz"]
    boxes = spark.createDataFrame([(0.0,) * 3 + (1.0,) * 3] * 2, names)
    rays = spark.createDataFrame([(0.5, 0.5, -1.0, 0.1, 0.1, 1.0)], ["ex", "ey", "ez", "dx", "dy", "dz"])
    monkeypatch.setattr(sampling, "CELLS", 4)
    met = sampling.ray_clip(rays, boxes).collect()
    assert len(met) == 2 and sampling.ray_clip(rays, boxes.limit(1)).collect() == met[:1]


def test_preintegrated_lookup_mixes_entries(spark):
    """In a table that is linear in both places, mixed entries are the plane's values."""
    from voxframe.operators import rays

    table = spark.range(64).selectExpr("cast(id % 8 as int) i", "cast(floor(id / 8) as int) j").selectExpr("i", "j", *(f"(i + 2 * j) * 0.01 as {c}" for c in "rgb"), "1D as a")
    asked = spark.createDataFrame([(k, 0.1 + 0.08 * k, 0.9 - 0.07 * k) for k in range(9)] + [(9, -1.0, 0.5)], "k int, before double, value double")
    for r in rays.preintegrated_2d(asked, table, 8, ["k"], "linear").collect():
        before, value = (0.5, 0.5) if r.k == 9 else (0.1 + 0.08 * r.k, 0.9 - 0.07 * r.k)
        i, j = (min(max(x * 8 - 0.5, 0), 7) for x in (before, value))
        assert abs(r.r - (i + 2 * j) * 0.01) < 1e-9 and abs(r.a - 1) < 1e-9
    near = {r.k: r.g for r in rays.preintegrated_2d(asked, table, 8, ["k"]).collect()}
    assert abs(near[9] - (4 + 2 * 4) * 0.01) < 1e-9 and len(near) == 10
    with pytest.raises(ValueError):
        rays.preintegrated_2d(asked, table, 5000, ["k"])


def test_inputs_of_a_network(spark):
    from voxframe.operators import scoring

    p = spark.createDataFrame([(0, 0.25, 0.5, 0.75, 0.0), (1, 0.5, 0.5, 0.5, 1.0)], "id int, px double, py double, pz double, t double")
    vectors = spark.createDataFrame([(k, c, float(10 * k + c)) for k in range(2) for c in range(3)], "idx int, channel int, value double")
    latent = spark.createDataFrame([(c, x, y, z, float(c + 1)) for c in range(2) for x in range(2) for y in range(2) for z in range(2)], "channel int, x int, y int, z int, value double")
    rows, names = scoring.latent_inputs(p, ["id"], latent, (2, 2, 2), vectors, 2, bands=1, time_bands=2)
    got = {r.id: r for r in rows.collect()}
    assert len(names) == 3 + 6 + 4 + 2 and got[0][names[-1]] == [0.0, 1.0, 2.0] and got[1][names[-1]] == [10.0, 11.0, 12.0]
    assert np.allclose(got[0][names[-2]], [1, 2])
    width = 3 + 6 + 4 + 2 + 3
    model = scoring.Model([(np.eye(width, 1), np.zeros(1))], output="density:direct")
    assert {r.id: r.value for r in scoring.score(rows, model, names, ["id"]).collect()} == {0: 0.25, 1: 0.5}


def test_large_files_are_cut_into_slabs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(volumes, "SLAB_VOXELS", 50)
    values = np.arange(7 * 6 * 5, dtype=np.float32).reshape(7, 6, 5)
    import struct

    with open(tmp_path / "a.xyz", "wb") as f:
        f.write(struct.pack("<3I3d", 5, 6, 7, 1.0, 1.0, 1.0))
        np.ascontiguousarray(values.transpose(2, 1, 0)).tofile(f)
    with open(tmp_path / "raw.bin", "wb") as f:
        f.write(b"header")
        values.tofile(f)
    (tmp_path / "a.dat").write_text("ObjectFileName: raw.bin\nResolution: 5 6 7\nSliceThickness: 1 1 1\nFormat: FLOAT\n")
    for name, read in (("a.xyz", volumes.read_xyz_volumes), ("a.dat", volumes.read_raw_volumes)):
        manifest = spark.createDataFrame([(f"file://{tmp_path}/{name}", 0, 0)], "path string, ensemble int, time int")
        got = read(manifest).collect()
        assert len(got) == values.size and all(values[r.z, r.y, r.x] == r.value for r in got)
    pad = np.pad(values[..., None], [(0, 0), (0, 1), (1, 1), (0, 0)])
    np.savez_compressed(tmp_path / "d.npz", values[..., None])
    np.savez(tmp_path / "v.npz", np.repeat(values[..., None], 3, axis=3))
    manifest = spark.createDataFrame([(f"{tmp_path}/d.npz", f"{tmp_path}/v.npz", 0, 0)], "density string, velocity string, ensemble int, time int")
    got = volumes.convert_npz_series(manifest).collect()
    assert len(got) == 7**3 * 4 and pad.shape == (7, 7, 7, 1)
    for r in got:
        assert abs(r.value - (min(pad[r.z, r.y, r.x, 0], 5) / 5 if r.channel == 0 else pad[r.z, r.y, r.x, 0])) < 1e-6


def test_descriptors_of_ensembles(spark, tmp_path):
    import json

    own = {
        "a/one.json": {"format": "files/ensemble%1$03d/time%2$03d.dat", "start_ensemble": 5, "start_timestep": 7},
        "a/two.json": {"format": "files/time%2$03d.dat", "start_timestep": 7},
        "b/three.json": {"format": "files/ensemble%1$03d.dat", "start_ensemble": 5},
        "b/four.json": {"format": "/far/sim_{ensemble:06d}/volume_{time}.cvol", "num_ensembles": 2, "step_ensembles": 10, "start_timestep": 1, "step_timestep": 3, "num_timesteps": 2},
        "b/none.json": {"format": "x{time}", "num_timesteps": 0},
    }
    for name, content in own.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    got = {}
    for r in volumes.described_ensembles(spark, f"{tmp_path}/*").collect():
        got.setdefault(r.descriptor.rpartition("/")[2], []).append((r.ensemble, r.time, r.path.rpartition(str(tmp_path))[2]))
    assert got == {
        "one.json": [(5, 7, "/a/files/ensemble005/time007.dat")],
        "two.json": [(0, 7, "/a/files/time007.dat")],
        "three.json": [(5, 0, "/b/files/ensemble005.dat")],
        "four.json": [(e, t, f"/far/sim_{e:06d}/volume_{t}.cvol") for e in (0, 10) for t in (1, 4)],
    }


def test_declared_equations(spark):
    known = {"Cube": "cube", "Marschner Lobb": "marschner_lobb", "Heart": "heart", "Cassini": "cassini"}
    for one in queries_sources.DECLARED:
        got = volumes.declared_volume(spark, one, 5)
        assert got.count() == 125
        if one["name"] in known:
            want = volumes.synthetic_volume(spark, 5, known[one["name"]])
            assert grids.compare_grids(got, want, 1e-12).isEmpty()
    assert volumes.declared_expression("2*x + p.a*1e-3f - x2").replace(" ", "") == "2D*x+p.a*1e-3D-x2"
    nested = volumes.declared_volume(spark, {"codeForward": "float a = sqr(x + sqr(y)); return cb(a) - 1;"}, 3)
    r = nested.where("x = 0 and y = 2 and z = 1").first()
    assert r.value == -1.0 and nested.where("x = 2 and y = 2 and z = 0").first().value == 63.0
    with pytest.raises(ValueError, match="returns nothing"):
        volumes.declared_volume(spark, {"name": "n", "codeForward": "auto a = x;"}, 3)


def test_levels_are_read_without_the_others(spark, tmp_path):
    cells = grids.cells(spark, (8, 8, 4)).selectExpr("'v' as volume_id", "x", "y", "z", "cast(x + 10 * y + 100 * z as double) as value").union(grids.cells(spark, (8, 8, 4)).selectExpr("'w'", "x", "y", "z", "cast(x * y - z as double)"))
    path = str(tmp_path / "levels")
    volumes.write_volumes(cells, path, (8, 8, 4), 3)
    for level in range(4):
        got = volumes.read_level(spark, path, level)
        want = cells if level == 0 else grids.mipmap(cells, (8, 8, 4), level, ["volume_id"])
        key = ["volume_id", "x", "y", "z"]
        both = got.join(want.withColumnRenamed("value", "own"), key)
        assert got.count() == want.count() == both.where(F.abs(F.col("value") - F.col("own")) < 1e-9).count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert f"(level#" in plan and f"= {level})]" in plan.partition("PartitionFilters")[2] and len(got.columns) == 5
        files = {r.f for r in got.select(F.input_file_name().alias("f")).distinct().collect()}
        assert files and all(f"/level={level}/" in f for f in files)
