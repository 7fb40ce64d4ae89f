"""Stencils on dense grids, by array kernels on bricks with halos.

Each cell is dealt once, to its own brick and to those whose halo it lies in; a brick is an array, on which a kernel works along all axes at
once. So a stencil takes one exchange, however many axes and steps it has. Bricks stream past in the order of their keys, and those
of one shape are stacked and worked on together, so many small grids cost no more than one large one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grids import AXES

#: Cells an axis of a brick.
BRICK = 32


@dataclass(frozen=True)
class Stack:
    """Bricks of one shape: arrays (brick, z, y, x) of each value with the halo (padded beyond the grid), the first own cell of
    each brick, the number of own cells, and how many cells of the halo lie beyond the grid, by axis."""

    arrays: list[np.ndarray]
    rows: np.ndarray
    first: dict[str, np.ndarray]
    own: dict[str, int]
    beyond: dict[str, tuple[int, int]]


def axis_of(a: str) -> int:
    """The axis of a stack's array."""
    return 3 - AXES.index(a)


def along(array: np.ndarray, a: str, start: int, stop: int | None, step: int = 1) -> np.ndarray:
    cut = [slice(None)] * array.ndim
    cut[axis_of(a)] = slice(start, stop, step)
    return array[tuple(cut)]


def _stacks(table: pa.Table, starts: np.ndarray, values: Sequence[str], brick: dict[str, int], halo: tuple[int, int], axes: Sequence[str], pad: str) -> Iterator[Stack]:
    place = {a: table[a].to_numpy().astype(np.int64) for a in AXES}
    corner = {a: table[f"b{a}"].to_numpy()[starts].astype(np.int64) * brick[a] for a in AXES}
    low = {a: np.minimum.reduceat(place[a], starts) for a in AXES}
    high = {a: np.maximum.reduceat(place[a], starts) + 1 for a in AXES}
    first = {a: np.maximum(low[a], corner[a]) for a in AXES}
    last = {a: np.minimum(high[a], corner[a] + brick[a]) for a in AXES}
    count = np.diff(np.append(starts, table.num_rows))
    if (count != np.prod([high[a] - low[a] for a in AXES], axis=0)).any():
        raise ValueError("a brick lacks cells, or has some twice: the grid isn't dense")
    shape = np.stack([x for a in AXES for x in (first[a] - low[a], last[a] - first[a], high[a] - last[a])], axis=1)
    kinds, kind = np.unique(shape, axis=0, return_inverse=True)
    group = np.repeat(np.arange(len(starts)), count)
    columns = [table[v].to_numpy() for v in values]
    for k, sizes in enumerate(kinds):
        before, own, after = (dict(zip(AXES, sizes[i::3].tolist())) for i in range(3))
        if min(own.values()) <= 0:
            continue  # nothing but halo
        mine = np.flatnonzero(kind.ravel() == k)
        number = np.full(len(starts), -1)
        number[mine] = np.arange(len(mine))
        rows = np.flatnonzero(number[group] >= 0)
        at = number[group[rows]]
        for a in reversed(AXES):
            at = at * (before[a] + own[a] + after[a]) + place[a][rows] - low[a][group[rows]]
        turn = rows[np.argsort(at)]
        missing = {a: (halo[0] - before[a], halo[1] - after[a]) if a in axes else (0, 0) for a in AXES}
        arrays = []
        for c in columns:
            array = c[turn].reshape(len(mine), *(before[a] + own[a] + after[a] for a in reversed(AXES)))
            arrays.append(np.pad(array, [(0, 0), *(missing[a] for a in reversed(AXES))], mode=pad) if any(map(any, missing.values())) else array)
        yield Stack(arrays, starts[mine], {a: first[a][mine] for a in AXES}, own, missing)


def on_bricks(grid: DataFrame, work: Callable[[Stack], dict[str, np.ndarray]], made: dict[str, str], halo: tuple[int, int] = (0, 0), axes: Sequence[str] = AXES, by: Sequence[str] = (), values: Sequence[str] = ("value",), pad: str = "edge", brick: int | dict[str, int] = BRICK, cells: bool = True, after: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] | None = None, returns: str = "") -> DataFrame:
    """by, x, y, z and what ``work`` makes of each stack of bricks of a dense grid (by, x, y, z, values).

    ``made``: the types of the new columns. With ``cells``, ``work`` gives arrays of the own cells (brick, z, y, x), and may give
    "keep", which of them stay; without, an array of any number of rows, "rows", which says to which brick each belongs.
    ``brick``: own cells an axis, of all or of each axis. ``after`` works on all that a task has made, in the order of ``by``, and gives rows
    of ``returns``. ``axes``: those along which there is a halo. ``pad``: how the halo continues beyond the grid ("edge" or "reflect").
    """
    kinds = {f.name: f.dataType for f in grid.schema}
    size = brick if isinstance(brick, dict) else dict.fromkeys(AXES, brick)
    dealt = grid.select(*by, *AXES, *values)
    for a in AXES:
        if a in axes and any(halo):
            low, high = F.floor((F.col(a) - halo[1]) / size[a]), F.floor((F.col(a) + halo[0]) / size[a])
            dealt = dealt.withColumn(f"b{a}", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("int"), high.cast("int"))))
        else:
            dealt = dealt.withColumn(f"b{a}", F.floor(F.col(a) / size[a]).cast("int"))
    key = [*by, "bx", "by", "bz"]
    if "by" in by:
        raise ValueError("a key may not be called by")
    sorted_ = dealt.repartition(*key).sortWithinPartitions(*key)
    place = [f"{a} int" for a in AXES] if cells else []
    ddl = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in by), *place, *(f"{c} {t}" for c, t in made.items())])
    types = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32(), "binary": pa.binary()}

    def rows(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for stack in _stacks(table, starts, values, size, halo, axes, pad):
            out = work(stack)
            if cells:
                own = [stack.own[a] for a in reversed(AXES)]
                which = np.repeat(stack.rows, int(np.prod(own)))
                grids = np.meshgrid(*(np.arange(n) for n in own), indexing="ij")
                columns = [pa.array((stack.first[a][:, None] + grids[2 - k].ravel()[None, :]).ravel(), pa.int32()) for k, a in enumerate(AXES)]
                new = [pa.array(np.ascontiguousarray(out[c]).ravel(), types[t]) for c, t in made.items()]
            else:
                which, columns = stack.rows[out["rows"]], []
                new = [pa.array(out[c], types[t]) for c, t in made.items()]
            names = [table[c].take(pa.array(which)).combine_chunks() for c in by]
            batch = pa.RecordBatch.from_arrays([*names, *columns, *new], names=[*by, *(AXES if cells else ()), *made])
            yield batch.filter(pa.array(out["keep"].ravel())) if "keep" in out else batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rest.append(batch)
            ends = [batch.column(batch.schema.get_field_index(c)) for c in key]
            if len(rest) == 1 or any(c[0] != rest[0].column(rest[0].schema.get_field_index(n))[0] or c[0] != c[-1] for n, c in zip(key, ends)):
                table = pa.Table.from_batches(rest).combine_chunks()
                starts = _starts(table, key)
                if len(starts) > 1:
                    yield from rows(table.slice(0, starts[-1]).combine_chunks(), starts[:-1])
                rest = table.slice(starts[-1]).combine_chunks().to_batches()
        if rest:
            table = pa.Table.from_batches(rest).combine_chunks()
            yield from rows(table, _starts(table, key))

    return sorted_.mapInArrow((lambda batches: after(run(batches))) if after else run, returns or ddl)


def _starts(table: pa.Table, key: Sequence[str]) -> np.ndarray:
    """Where a new brick begins."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in key:
        codes = table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


# --- kernels


def central(array: np.ndarray, a: str, scale: float) -> np.ndarray:
    """Central differences along an axis, which gets shorter by two."""
    return (along(array, a, 2, None) - along(array, a, 0, -2)) * scale


def inner(array: np.ndarray, axes: Sequence[str], low: int, high: int) -> np.ndarray:
    """Without ``low`` and ``high`` cells of some axes."""
    for a in axes:
        array = along(array, a, low, array.shape[axis_of(a)] - high)
    return array


def gradient(grid: DataFrame, spacing: Sequence[float] = (1.0, 1.0, 1.0), by: Sequence[str] = (), value: str = "value", names: Sequence[str] = ("gx", "gy", "gz")) -> DataFrame:
    """Central differences with held borders, of a dense grid: by, x, y, z, value and names."""

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array = stack.arrays[0]
        out = {value: inner(array, AXES, 1, 1)}
        for a, h, name in zip(AXES, spacing, names):
            out[name] = central(inner(array, [b for b in AXES if b != a], 1, 1), a, 0.5 / h)
        return out

    return on_bricks(grid.withColumn(value, F.col(value).cast("double")), work, {value: "double"} | dict.fromkeys(names, "double"), (1, 1), AXES, by, [value])


def curvature(grid: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Principal curvatures k1 >= k2, their mean and product, from two rounds of central differences of a dense grid."""

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array = stack.arrays[0]
        g = {a: central(inner(array, [b for b in AXES if b != a], 1, 1), a, 0.5) for a in AXES}
        for field in g.values():  # a gradient beyond the border is that of the border
            for a in AXES:
                low, high = stack.beyond[a]
                if low == 2:
                    along(field, a, 0, 1)[...] = along(field, a, 1, 2)
                if high == 2:
                    along(field, a, -1, None)[...] = along(field, a, -2, -1)
        second = {(a, b): central(inner(g[a], [c for c in AXES if c != b], 1, 1), b, 0.5) for a in AXES for b in AXES}
        g = {a: inner(f, AXES, 1, 1) for a, f in g.items()}
        s = {(a, b): (second[a, b] + second[b, a]) * 0.5 for a in AXES for b in AXES}
        size = np.maximum(np.sqrt(sum(f * f for f in g.values())), 1e-7)
        n = {a: -f / size for a, f in g.items()}
        m = {a: sum(s[a, b] * n[b] for b in AXES) for a in AXES}  # the Hessian times n
        # trace and squared norm of -PHP / |g| with P = 1 - nn', without the products
        steep = sum(f * f for f in n.values()) >= 0.5
        way = sum(n[a] * m[a] for a in AXES)
        sent = sum(f * f for f in m.values())
        trace = -(s["x", "x"] + s["y", "y"] + s["z", "z"] - np.where(steep, way, 0)) / size
        norm = (sum(f * f for f in s.values()) + np.where(steep, way * way - 2 * sent, 0)) / (size * size)
        square = 2 * norm - trace * trace
        root = np.sqrt(np.maximum(square, 0))
        k1, k2 = (np.where(square >= 0, (trace + sign * root) * 0.5, 0.0) for sign in (1, -1))
        return {"k1": k1, "k2": k2, "mean": (k1 + k2) * 0.5, "product": k1 * k2}

    return on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, dict.fromkeys(("k1", "k2", "mean", "product"), "double"), (2, 2), AXES, by)


def weighted_ahead(array: np.ndarray, a: str, weights: Sequence[float]) -> np.ndarray:
    """The weighted sum of each cell and those behind it."""
    n = array.shape[axis_of(a)] - len(weights) + 1
    return sum(along(array, a, k, k + n) * w for k, w in enumerate(weights))


def whole_windows(stack: Stack, axes: Sequence[str]) -> np.ndarray:
    """Which own cells have all cells of the halo behind them."""
    keep = np.ones((len(stack.rows), *(stack.own[a] for a in reversed(AXES))), bool)
    for a in axes:
        along(keep, a, max(0, stack.own[a] - stack.beyond[a][1]), None)[...] = False
    return keep


def filtered(array: np.ndarray, a: str, even: Sequence[float], odd: Sequence[float]) -> np.ndarray:
    """Nine taps along an axis, other ones at even and odd places; the axis gets shorter by eight."""
    n = array.shape[axis_of(a)] - 8
    out = np.empty_like(along(array, a, 4, 4 + n))
    for first, taps in ((0, even), (1, odd)):
        along(out, a, first, None, 2)[...] = sum(along(array, a, first + k, first + k + n - first, 2) * w for k, w in enumerate(taps))
    return out


def lifted(array: np.ndarray, a: str, first: int, by: int, sign: int) -> None:
    """Adds, at each second inner place from ``first`` on, the neighbours' sum over ``by``, rounded with halves away from zero."""
    n = array.shape[axis_of(a)]
    here = along(array, a, first, n - 1, 2)
    near = along(array, a, first - 1, n - 2, 2) + along(array, a, first + 1, n, 2)
    here += sign * np.sign(near) * ((np.abs(near) + by // 2) // by)


def differences(grid: DataFrame, dims: Sequence[str] = AXES, by: Sequence[str] = ()) -> DataFrame:
    """by, axis, n, total: number and sum of the squared forward differences along each axis, in one pass."""

    def work(stack: Stack) -> dict[str, np.ndarray]:
        array, count = stack.arrays[0], len(stack.rows)
        parts = {"rows": [], "place": [], "n": [], "total": []}
        for k, a in enumerate(dims):
            others = inner(array, [b for b in dims if b != a], 0, 1)
            d = along(others, a, 1, None) - along(others, a, 0, -1)
            d = along(d, a, 0, stack.own[a] - stack.beyond[a][1])  # of the last cell there is none
            d = d.reshape(count, -1)
            for name, v in zip(parts, (np.arange(count), np.full(count, k), np.full(count, d.shape[1]), (d * d).sum(axis=1))):
                parts[name].append(v)
        return {c: np.concatenate(v) for c, v in parts.items()}

    made = on_bricks(grid.withColumn("value", F.col("value").cast("double")), work, {"place": "long", "n": "long", "total": "double"}, (0, 1), dims, by, cells=False)
    axis = F.element_at(F.array(*map(F.lit, dims)), (F.col("place") + 1).cast("int"))
    return made.groupBy(*by, axis.alias("axis")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
