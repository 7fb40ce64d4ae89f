"""Quantisation, wavelets and tensor decompositions as rate and error statistics."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import clamp
from ._tables import kept
from .grids import AXES
from .stencils import Stack, along, axis_of, filtered, inner, lifted, on_bricks


def byte_linear(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds code (0-255 over the group's range) and decoded."""
    ends = df.groupBy(*by).agg(F.min("value").alias("low"), (F.max("value") - F.min("value")).alias("range"))
    out = df.join(ends, list(by))
    code = clamp(F.floor(255 * (F.col("value") - F.col("low")) / F.greatest(F.lit(1e-5), F.col("range")) + 0.5), 0, 255)
    return out.withColumn("code", code.cast("int")).withColumn("decoded", F.col("low") + F.col("code") / 255.0 * F.col("range")).drop("low", "range")


def _decoded_normal() -> list[float]:
    return [NormalDist().inv_cdf(0.5 + (2 - 1e-4) * (k / 255 - 0.5) / 2) for k in range(256)]


def byte_gaussian(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds code (0-255 by the normal distribution with the group's mean and sample deviation) and decoded."""
    limits = np.array([NormalDist().inv_cdf((k + 0.5) / 255) for k in range(255)])

    @F.pandas_udf("int")
    def coded(z: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(limits, z.to_numpy(), side="left").astype(np.int32))

    table = F.array(*map(F.lit, _decoded_normal()))
    stats = df.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"))
    out = df.join(stats, list(by)).withColumn("code", coded((F.col("value") - F.col("mean")) / F.col("sigma")))
    return out.withColumn("decoded", F.col("mean") + F.col("sigma") * F.element_at(table, F.col("code") + 1)).drop("mean", "sigma")


def encoding_error(coded: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return coded.groupBy(*by).agg(F.avg(F.abs(F.col("decoded") - F.col("value"))).alias("error"))


def encoding_report(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """encoding, error, bytes of the three encodings of all values."""
    n = df.agg(F.count("*").alias("n"), F.count_distinct(*by).alias("groups"))
    plain = df.withColumn("decoded", F.col("value").cast("float").cast("double"))
    parts = []
    for name, coded, each, head in (("float", plain, 4, 0), ("linear", byte_linear(df, by), 1, 8), ("gaussian", byte_gaussian(df, by), 1, 8)):
        parts.append(encoding_error(coded).withColumn("encoding", F.lit(name)).crossJoin(F.broadcast(n.select((F.col("n") * each + F.col("groups") * head).alias("bytes")))))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def symbol_histogram(symbols: DataFrame, by: Sequence[str]) -> DataFrame:
    return symbols.groupBy(*by, "symbol").agg(F.count("*").alias("n"))


def entropy_bits(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """The least bits for each band's symbols by their frequencies."""
    total = histogram.groupBy(*by).agg(F.sum("n").alias("total"))
    return histogram.join(total, list(by)).groupBy(*by).agg(F.sum(-F.col("n") * F.log2(F.col("n") / F.col("total"))).alias("bits"))


def code_lengths(counts: Sequence[int]) -> list[int]:
    """Lengths of an optimal prefix code; one symbol alone takes one bit."""
    n = len(counts)
    if n < 2:
        return [1] * n
    heap = [(c, k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = [0] * (2 * n - 1)
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * (2 * n - 1)
    for node in range(2 * n - 3, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[:n]


def huffman_bits(histogram: DataFrame, band: str) -> DataFrame:
    """Total bits of each band under its optimal prefix code. A group holds a band's distinct symbols, not its data."""

    def lengths(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["n", "symbol"])
        return pd.DataFrame({band: own[band], "symbol": own["symbol"], "length": code_lengths(own["n"].tolist())})

    kind = histogram.schema[band].dataType.simpleString()
    coded = histogram.groupBy(band).applyInPandas(lengths, f"`{band}` {kind}, symbol long, length int")
    return histogram.join(coded, [band, "symbol"]).groupBy(band).agg(F.sum(F.col("n") * F.col("length")).alias("bits"))


def error_target(df: DataFrame, kind: str, value: float, by: Sequence[str] = (), variant: str = "exact") -> DataFrame:
    """The sum of squared errors allowed for a relative error ("eps"), an rmse or a psnr, and it relative to the norm.

    ``variant="reference"`` starts the search for the largest value just above 0, which is wrong for negative data.
    """
    high = F.max("value") if variant == "exact" else F.greatest(F.max("value"), F.lit(2.2250738585072014e-308))
    s = df.groupBy(*by).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"), F.min("value").alias("low"), high.alias("high"), F.count("*").alias("n"))
    allowed = {"eps": F.pow(F.col("norm") * value, 2), "rmse": F.lit(value * value) * F.col("n"), "psnr": F.pow((F.col("high") - F.col("low")) / 2 / (10 ** (value / 20)), 2) * F.col("n")}[kind]
    return s.withColumn("sse", allowed).withColumn("epsilon", F.sqrt("sse") / F.col("norm"))


#: Cells on each of the two other axes of the slabs in which a volume's products are made.
SLAB = 64
#: Cells an axis of volumes whose decomposition is made in one task, many of them together.
SMALL = 32


def _unfolded(array: np.ndarray, axis: str) -> np.ndarray:
    """(block, place on the axis, all others) of blocks (block, z, y, x)."""
    return np.moveaxis(array, axis_of(axis), 1).reshape(len(array), array.shape[axis_of(axis)], -1)


def tucker_gram(grid: DataFrame, axis: str, by: Sequence[str] = ()) -> DataFrame:
    """i, j, value: products of slices along an axis, summed.

    A slab is as long as the axis, so its part of the matrix is one matrix product; a task adds up its slabs of one volume before
    it hands on n x n rows. The grid must be dense.
    """
    kinds = {f.name: f.dataType.simpleString() for f in grid.schema}

    def work(stack: Stack) -> dict:
        a = _unfolded(stack.arrays[0], axis)
        return {"rows": np.arange(len(a)), "part": [x.tobytes() for x in a @ a.transpose(0, 2, 1)]}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, kind = None, None, None

        def rows() -> pa.RecordBatch:
            n = int(np.sqrt(len(total)))
            i, j = np.divmod(np.arange(n * n), n)
            names = [pa.array([v] * (n * n), t) for v, t in zip(now, kind)]
            return pa.RecordBatch.from_arrays([*names, pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total)], names=[*by, "i", "j", "value"])

        for batch in batches:
            kind = [batch.schema.field(c).type for c in by]
            for *own, part in zip(*(c.to_pylist() for c in batch.columns)):
                part = np.frombuffer(part)
                if own == now:
                    total = total + part
                    continue
                if now is not None:
                    yield rows()
                now, total = own, part
        if now is not None:
            yield rows()

    slab = {a: 1 << 30 if a == axis else SLAB for a in AXES}
    returns = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "i int, j int, value double"])
    parts = on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, {"part": "binary"}, (0, 0), AXES, by, brick=slab, cells=False, after=added, returns=returns)
    return parts.groupBy(*by, "i", "j").agg(F.sum("value").alias("value"))


def _falling(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors of symmetric matrices by falling eigenvalue; the largest entry of a vector is positive."""
    values, vectors = np.linalg.eigh(gram)
    values, vectors = values[..., ::-1], vectors[..., ::-1]
    top = np.take_along_axis(vectors, np.abs(vectors).argmax(axis=-2, keepdims=True), axis=-2)
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def tucker_factors(gram: DataFrame, key: str) -> DataFrame:
    """Eigenvectors of each key's Gram matrix by falling eigenvalue: key, i, rank, weight, eigenvalue. A task holds one matrix."""

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        n = int(own["i"].max()) + 1
        matrix = np.zeros((n, n))
        matrix[own["i"], own["j"]] = own["value"]
        values, vectors = _falling(matrix)
        i, r = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        return pd.DataFrame({key: own[key].iloc[0], "i": i.ravel(), "rank": r.ravel(), "weight": vectors.ravel(), "eigenvalue": values[r.ravel()]})

    kind = gram.schema[key].dataType.simpleString()
    return gram.groupBy(key).applyInPandas(solve, f"`{key}` {kind}, i int, rank int, weight double, eigenvalue double")


def project(grid: DataFrame, factors: DataFrame, axis: str, key: str) -> DataFrame:
    """Replaces an axis by the ranks of its factors: one matrix product for each slab that is as long as the axis.

    A key's factors travel to its slabs as one packed matrix, so no cell meets n rows of factors.
    """
    others = [a for a in AXES if a != axis]
    kind = grid.schema[key].dataType.simpleString()
    slab = [F.floor(F.col(a) / SLAB).cast("int").alias(f"s{a}") for a in others]
    weights = F.array_sort(F.collect_list(F.struct("i", "rank", "weight")))
    packed = factors.groupBy(key).agg(F.transform(weights, lambda w: w["weight"]).alias("weights"))
    left = grid.select(key, *slab, *AXES, F.col("value").cast("double").alias("value"))
    names = [key, *(f"s{a}" for a in others)]
    right = left.select(*names).distinct().join(packed, key).toDF(*(f"own_{c}" for c in names), "weights")

    def multiply(cells: pa.Table, matrix: pa.Table) -> pa.Table:
        w = matrix["weights"].combine_chunks().flatten().to_numpy()
        n = int(np.sqrt(len(w)))
        at = [cells[a].to_numpy() for a in others]
        column, where = np.unique(at[0].astype(np.int64) << 32 | at[1], return_inverse=True)
        values = np.zeros((n, len(column)))
        values[cells[axis].to_numpy(), where] = cells["value"].to_numpy()
        made = w.reshape(n, n).T @ values
        rank, place = np.divmod(np.arange(made.size), len(column))
        out = {key: cells[key].take(pa.array(np.zeros(made.size, np.int64))), axis: pa.array(rank, pa.int32()), others[0]: pa.array((column >> 32)[place], pa.int32()), others[1]: pa.array((column & 0xFFFFFFFF)[place], pa.int32()), "value": pa.array(made.ravel())}
        return pa.table([out[c] for c in (key, *AXES, "value")], names=[key, *AXES, "value"])

    return left.groupBy(*names).cogroup(right.groupBy(*(f"own_{c}" for c in names))).applyInArrow(multiply, f"`{key}` {kind}, x int, y int, z int, value double")


def tucker(grid: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """The core: the grid projected on the factors of all axes.

    Volumes of at most ``n`` cells an axis, if that is ``SMALL`` or less, are decomposed in one exchange, those of one shape together;
    larger ones by products of slabs.
    """
    if n is not None and n <= SMALL:

        def work(stack: Stack) -> dict[str, np.ndarray]:
            core = stack.arrays[0]
            for axis in AXES:
                a = _unfolded(core, axis)
                vectors = _falling(a @ a.transpose(0, 2, 1))[1]
                rest = [core.shape[k] for k in range(1, 4) if k != axis_of(axis)]
                core = np.moveaxis((vectors.transpose(0, 2, 1) @ a).reshape(len(a), a.shape[1], *rest), 1, axis_of(axis))
            return {"value": core}

        return on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, {"value": "double"}, by=[key], brick=SMALL)
    out = grid
    for axis in AXES:  # each is read for its products, for its slabs and for their projection
        out = kept(out)
        out = project(out, tucker_factors(tucker_gram(out, axis, [key]), key), axis, key)
    return out


def bitplane_profile(core: DataFrame, planes: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """Of each bit plane from the highest down: ones, newly significant coefficients, squared error after it."""
    top = core.groupBy(*by).agg(F.floor(F.log2(F.max(F.abs("value")))).alias("top"))
    scaled = (core.join(top, list(by)) if by else core.crossJoin(F.broadcast(top))).withColumn("q", F.floor(F.abs("value") * F.pow(F.lit(2.0), F.lit(planes - 1) - F.col("top"))).cast("long"))
    each = scaled.select(*by, "value", "q", "top", F.explode(F.sequence(F.lit(0), F.lit(planes - 1))).alias("plane"))
    shift = F.pow(F.lit(2.0), F.lit(planes - 1) - F.col("plane")).cast("long")
    seen = F.floor(F.col("q") / shift)
    shown = seen * shift / F.pow(F.lit(2.0), F.lit(planes - 1) - F.col("top"))
    e = F.abs("value") - shown
    return each.groupBy(*by, "plane").agg(F.sum((seen % 2).cast("long")).alias("ones"), F.sum(F.when(seen == 1, 1).otherwise(0)).alias("new"), F.sum(e * e).alias("sse"))


def plane_bits(profile: DataFrame, counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds bits, what all planes down to each one cost: a bit for each coefficient that was significant before, the entropy of which
    of the others become so, and a sign for those. ``counts``: by and n, the number of coefficients.

    One window a group over its planes, 64 at most.
    """
    line = Window.partitionBy(*by).orderBy("plane")
    met = profile.join(counts, list(by)) if by else profile.crossJoin(F.broadcast(counts))
    known = F.coalesce(F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = met.withColumn("known", known).withColumn("left", F.col("n") - F.col("known"))
    p = F.col("new") / F.col("left")
    chosen = F.when((F.col("new") > 0) & (F.col("new") < F.col("left")), -F.col("new") * F.log2(p) - (F.col("left") - F.col("new")) * F.log2(1 - p)).otherwise(0.0)
    cost = F.sum(F.col("known") + chosen + F.col("new")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    return met.withColumn("bits", cost).drop("known", "left", "n")


def target_planes(core: DataFrame, targets: Sequence[tuple[str, float]], planes: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """by, kind, target, allowed (squared error), plane, bits, sse: for each target ("eps", "rmse" or "psnr" and its value) the first
    bit plane after which the error is no larger than allowed; null where no plane reaches it.

    All targets share one pass for the profile and one for the norms.
    """
    profile = plane_bits(bitplane_profile(core, planes, by), core.groupBy(*by).agg(F.count("*").alias("n")), by)
    asked = None
    for kind, value in targets:
        own = error_target(core, kind, value, by).select(*by, F.lit(kind).alias("kind"), F.lit(float(value)).alias("target"), F.col("sse").alias("allowed"))
        asked = own if asked is None else asked.unionByName(own)
    met = asked.join(profile, list(by)) if by else asked.crossJoin(profile)
    first = F.min(F.when(F.col("sse") <= F.col("allowed"), F.struct("plane", "bits", "sse"))).alias("first")
    return met.groupBy(*by, "kind", "target", "allowed").agg(first).select(*by, "kind", "target", "allowed", "first.plane", "first.bits", "first.sse")


def tucker_ranks(core: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """axis, norm of the kept coefficients and rank (last slice with one, plus 1)."""
    large = core.where(F.abs("value") > threshold)
    out = None
    for a in AXES:
        part = large.groupBy(*by).agg(F.lit(a).alias("axis"), (F.max(a) + 1).alias("rank"), F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
        out = part if out is None else out.union(part)
    return out


def slice_norms(core: DataFrame, axis: str, by: Sequence[str] = ()) -> DataFrame:
    return core.groupBy(*by, F.col(axis).alias("index")).agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))


#: Places of a stream that one task looks at together.
STRETCH = 1 << 16


def zero_runs(symbols: DataFrame, stream: Sequence[str], position: str, most: int, stretch: int = STRETCH) -> DataFrame:
    """Runs of zeros before each non-zero symbol: position, zeros, extra (full runs of most + 1) and rest.

    A stream is cut into stretches of places. First each stretch's last non-zero place is carried into those behind it (a row for each
    stretch), then every stretch is worked on by itself, so one stream may be as long as the table.
    """
    own = symbols.where("symbol <> 0").withColumn("__stretch", F.floor(F.col(position) / stretch))
    last = own.groupBy(*stream, "__stretch").agg(F.max(position).alias("__last"))
    carried = last.select(*stream, "__stretch", F.lag("__last").over(Window.partitionBy(*stream).orderBy("__stretch")).alias("__before"))
    line = Window.partitionBy(*stream, "__stretch").orderBy(position)
    met = own.join(carried, [*stream, "__stretch"])
    before = F.coalesce(F.lag(position).over(line), F.col("__before"), F.lit(-1))
    out = met.withColumn("zeros", F.col(position) - before - 1).drop("__stretch", "__before").select(*symbols.columns, "zeros")
    return out.withColumn("extra", F.floor(F.col("zeros") / (most + 1))).withColumn("rest", F.col("zeros") % (most + 1))


# --- wavelets

#: Taps of the 9/7 filters at distances -4 .. 4, low pass and high pass, and of their inverse.
LOW = [0.0267488, -0.0168641, -0.0782233, 0.2668641, 0.6029490, 0.2668641, -0.0782233, -0.0168641, 0.0267488]
HIGH = [0.0, 0.0456359, -0.0287718, -0.2956359, 0.5575435, -0.2956359, -0.0287718, 0.0456359, 0.0]
EVEN = [0.0, 0.0337282, -0.0575435, -0.5337281, 1.1150871, -0.5337281, -0.0575435, 0.0337282, 0.0]
ODD = [0.0534975, -0.0912718, -0.1564465, 0.5912718, 1.2058980, 0.5912718, -0.1564465, -0.0912718, 0.0534975]


def _halved(axis: str, n: int) -> Column:
    """Where a cell goes: even ones to the low half, odd ones to the high half."""
    return (F.floor(F.col(axis) / 2) + (F.col(axis) % 2) * (n // 2)).cast("int")


def _woven(axis: str, n: int) -> Column:
    """Where it comes from."""
    return F.when(F.col(axis) < n // 2, 2 * F.col(axis)).otherwise(2 * (F.col(axis) - n // 2) + 1).cast("int")


def _filtered(grid: DataFrame, axes: Sequence[str], even: Sequence[float], odd: Sequence[float], by: Sequence[str]) -> DataFrame:
    def work(stack: Stack) -> dict[str, np.ndarray]:
        array = stack.arrays[0]
        for a in axes:
            array = filtered(array, a, even, odd)
        return {"value": array}

    return on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, {"value": "double"}, (4, 4), axes, by, pad="reflect")


def dwt_axes(grid: DataFrame, axes: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """One level along axes of even size n, in one exchange: the low half, then the high half; mirrored at both ends."""
    return _filtered(grid, axes, LOW, HIGH, by).withColumns({a: _halved(a, n) for a in axes})


def idwt_axes(grid: DataFrame, axes: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The inverse of dwt_axes (the taps are rounded: errors of about 1e-6)."""
    return _filtered(grid.withColumns({a: _woven(a, n) for a in axes}), axes, EVEN, ODD, by)


def dwt_axis(grid: DataFrame, axis: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    return dwt_axes(grid, [axis], n, by)


def idwt_axis(grid: DataFrame, axis: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    return idwt_axes(grid, [axis], n, by)


def _by_level(grid: DataFrame, n: int, levels: Sequence[int], one: Callable[[DataFrame, int], DataFrame], by: Sequence[str]) -> DataFrame:
    out = grid
    for level in levels:
        m = n >> level
        inside = (F.col("x") < m) & (F.col("y") < m) & (F.col("z") < m)
        low = one(out.where(inside), m).select(*by, *AXES, "value")
        out = low if m == n else low.unionByName(out.where(~inside).select(*by, *AXES, "value"))
    return out


def dwt_forward(grid: DataFrame, n: int, levels: int, by: Sequence[str] = ()) -> DataFrame:
    """All axes, each level on the low octant of the one before; one exchange a level."""
    return _by_level(grid, n, range(levels), lambda low, m: dwt_axes(low, AXES, m, by), by)


def dwt_inverse(grid: DataFrame, n: int, levels: int, by: Sequence[str] = ()) -> DataFrame:
    return _by_level(grid, n, range(levels)[::-1], lambda low, m: idwt_axes(low, AXES[::-1], m, by), by)


def dwt_int_axes(grid: DataFrame, axes: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """Integer lifting along axes of even size, in one exchange: odd cells lose their neighbours' mean, even ones gain a quarter of the odd ones."""

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array = stack.arrays[0].astype(np.int64)
        for a in axes:
            lifted(array, a, 1, 2, -1)
            lifted(array, a, 2, 4, 1)
            array = inner(array, [a], 2, 2)
        return {"value": array}

    whole = grid.withColumn("value", F.col("value").cast("long"))
    return on_bricks(whole, work, {"value": "long"}, (2, 2), axes, by, pad="reflect").withColumns({a: _halved(a, n) for a in axes})


def idwt_int_axes(grid: DataFrame, axes: Sequence[str], n: int, by: Sequence[str] = ()) -> DataFrame:
    """The inverse of dwt_int_axes, for the same axes in reverse order; it loses nothing."""

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array = stack.arrays[0].astype(np.int64)
        for a in axes:
            lifted(array, a, 2, 4, -1)
            lifted(array, a, 3, 2, 1)
            array = inner(array, [a], 2, 2)
        return {"value": array}

    woven = grid.withColumn("value", F.col("value").cast("long")).withColumns({a: _woven(a, n) for a in axes})
    return on_bricks(woven, work, {"value": "long"}, (2, 2), axes, by, pad="reflect")


def dwt_int_axis(grid: DataFrame, axis: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    return dwt_int_axes(grid, [axis], n, by)


def idwt_int_axis(grid: DataFrame, axis: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    return idwt_int_axes(grid, [axis], n, by)


def _padded(array: np.ndarray, axes: Sequence[str], width: int) -> np.ndarray:
    return np.pad(array, [(0, 0), *((width, width) if a in axes else (0, 0) for a in reversed(AXES))], mode="reflect")


def _transformed(array: np.ndarray, levels: int) -> np.ndarray:
    """All levels of whole blocks (block, z, y, x) of even sizes."""
    out = array.copy()
    for level in range(levels):
        low = tuple(slice(0, n >> level) for n in array.shape[1:])
        part = out[(slice(None), *low)]
        for a in AXES:
            part = filtered(_padded(part, [a], 4), a, LOW, HIGH)
            part = np.concatenate([along(part, a, 0, None, 2), along(part, a, 1, None, 2)], axis=axis_of(a))
        out[(slice(None), *low)] = part
    return out


def _restored(array: np.ndarray, levels: int) -> np.ndarray:
    out = array.copy()
    for level in reversed(range(levels)):
        low = tuple(slice(0, n >> level) for n in array.shape[1:])
        part = out[(slice(None), *low)]
        for a in reversed(AXES):
            woven = np.empty_like(part)
            half = part.shape[axis_of(a)] // 2
            along(woven, a, 0, None, 2)[...] = along(part, a, 0, half)
            along(woven, a, 1, None, 2)[...] = along(part, a, half, None)
            part = filtered(_padded(woven, [a], 4), a, EVEN, ODD)
        out[(slice(None), *low)] = part
    return out


def _code_bits(group: np.ndarray, symbol: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of an optimal prefix code and the entropy in bits of each group's symbols."""
    width = int(symbol.max(initial=0)) + 1
    key, n = np.unique(group * width + symbol, return_counts=True)
    of = key // width
    total = np.bincount(of, n, minlength=groups)
    entropy = np.bincount(of, -n * np.log2(n / total[of]), minlength=groups)
    ends = np.searchsorted(of, np.arange(groups + 1))
    bits = np.array([sum(c * k for c, k in zip(own, code_lengths(own))) for own in (n[a:b].tolist() for a, b in zip(ends, ends[1:]))])
    return bits, entropy


def rate_by_brick(grid: DataFrame, n: int, levels: int, steps: Sequence[float], by: str, brick: int | None = None, most: int = 255) -> DataFrame:
    """by, brick (its number: x, then y, then z), step, cells: prefix-code bits and entropy of quantised wavelet coefficients, run_bits (prefix codes of
    the non-zero symbols and of the runs of zeros before them, in the order of x, y, z and split at ``most``), rate of ``bits``
    against 32-bit floats, rmse and psnr.

    Each brick of ``brick`` cells an axis is coded on its own, as a chunk; by default a brick is the whole volume of n cells an axis.
    The step of a level's band is halved with each level, as errors of coarse bands spread further. One exchange deals cells to
    their bricks; no coefficient has a row.
    """
    size = brick or n
    if n % size or size % (1 << levels):
        raise ValueError("bricks have to divide the volume, and to be divisible by two for each level")
    made = {"step": "double", "cells": "long", "bits": "long", "entropy": "double", "run_bits": "long", "rmse": "double", "range": "double", "brick": "long"}

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array, count = stack.arrays[0], len(stack.rows)
        coefficients = _transformed(array, levels)
        places = np.meshgrid(*(np.arange(size) for _ in AXES), indexing="ij")
        largest = np.maximum.reduce(places)
        level = np.full(largest.shape, levels - 1)
        for k in range(levels - 1):
            level[(largest >= size >> (k + 1)) & (largest < size >> k)] = k
        cells = size**3
        reach = array.reshape(count, -1).max(axis=1) - array.reshape(count, -1).min(axis=1)
        number = sum((stack.first[a] // size) * (n // size) ** k for k, a in enumerate(AXES))
        out = {c: [] for c in ["rows", *made]}
        for step in steps:
            own = step / 2.0**level
            q = np.trunc(coefficients / own + np.sign(coefficients) * 0.5).astype(np.int64)
            symbol = (2 * np.abs(q) - (q < 0)).reshape(count, cells)
            bits, entropy = _code_bits(np.repeat(np.arange(count), cells), symbol.ravel(), count)
            block, at = np.nonzero(symbol)
            zeros = np.diff(at, prepend=-1) - 1
            begins = np.flatnonzero(np.diff(block, prepend=-1))
            zeros[begins] = at[begins]
            runs, extra = zeros % (most + 1), zeros // (most + 1)  # a long run is so many full ones and a rest
            owner, length = np.append(block, np.repeat(block, extra)), np.append(runs, np.full(int(extra.sum()), most))
            run_bits = _code_bits(block, symbol[block, at], count)[0] + _code_bits(owner, length, count)[0]
            error = _restored(q * own, levels) - array
            new = (np.arange(count), np.full(count, step), np.full(count, cells), bits, entropy, run_bits, np.sqrt((error * error).reshape(count, -1).mean(axis=1)), reach, number)
            for c, v in zip(out, new):
                out[c].append(v)
        return {c: np.concatenate(v) for c, v in out.items()}

    each = on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, made, (0, 0), AXES, [by], brick=size, cells=False)
    rate = 32.0 * F.col("cells") / F.col("bits")
    return each.select(by, "brick", "step", "cells", "bits", "entropy", "run_bits", rate.alias("rate"), "rmse", (20 * F.log10(F.col("range") / F.col("rmse"))).alias("psnr"))


def bricked_or_whole(grid: DataFrame, n: int, levels: int, steps: Sequence[float], by: str, brick: int) -> DataFrame:
    """by, step: bits and rmse of each volume coded in bricks and as a whole, and the bits that bricks cost more."""
    parts = rate_by_brick(grid, n, levels, steps, by, brick)
    square = F.sum(F.col("rmse") * F.col("rmse") * F.col("cells")) / F.sum("cells")
    cut = parts.groupBy(by, "step").agg(F.sum("bits").alias("brick_bits"), F.sum("entropy").alias("brick_entropy"), F.sqrt(square).alias("brick_rmse"))
    whole = rate_by_brick(grid, n, levels, steps, by).select(by, "step", F.col("bits").alias("whole_bits"), F.col("entropy").alias("whole_entropy"), F.col("rmse").alias("whole_rmse"))
    return cut.join(whole, [by, "step"]).withColumn("more", F.col("brick_bits") - F.col("whole_bits"))
