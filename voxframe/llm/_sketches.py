"""Sketches of sets: bits that each element flips, and the pairs of a bucket that may be similar by them.

Two sketches differ in no more bits than their sets do in elements, so a pair that is left out is not similar. Sketches of a bucket are
compared in blocks of ``BLOCK`` by ``BLOCK``, inside tasks; no step makes a row for each pair of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._np import out_batch, trim

#: Sketches on each side of a comparison.
BLOCK = 512
#: Bits of a sketch for each element by which two similar sets may differ.
SPREAD = 16


def sketches(row: np.ndarray, h: np.ndarray, size: np.ndarray, percent: float, most: int = 13) -> list[bytes]:
    """A bit string of each row's set, of which each element flips one; its length is a power of two, ``1 << most`` at most."""
    least = SPREAD * 2 * size * (100 - percent) // (100 + percent)
    bits = 1 << np.clip(np.ceil(np.log2(np.maximum(least, 1))).astype(np.int64), 6, most)
    base = np.append(0, np.cumsum(bits))
    flips = np.bincount(base[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=base[-1]) & 1
    raw = np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(base, base[1:])]


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
    return bits


def _by_width(rows: list[tuple]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of rows (rep, component, n, sketch), for each length of the sketch its words and the rows' reps, components and sizes."""
    out = []
    for width in {len(r[3]) for r in rows}:
        own = [r for r in rows if len(r[3]) == width]
        words = np.frombuffer(b"".join(r[3] for r in own), np.uint64).reshape(len(own), -1)
        out.append((width // 8, words, *(np.array([r[k] for r in own], np.int64) for k in range(3))))
    return out


def near_sketches(met: DataFrame, percent: float, nearest: bool = False) -> DataFrame:
    """member, centre: of rows (bucket, a, b, side, rep, component, n, sketch) the pairs of sides 0 and 1 in a bucket's block (a, b) that
    are of different components and may be similar by their sketches and sizes. Side 1 streams past.

    ``nearest``: of these only one for each row of side 0, that of the fewest differing bits.
    """

    def compare(left: list, right: list) -> Iterator[tuple[int, int, int]]:
        for w, x, rep, comp, n in left:
            for v, y, rep2, comp2, n2 in right:
                xs, ys = _folded(x, min(w, v)), _folded(y, min(w, v))
                step = max(1, (1 << 20) // xs.size)
                for k in range(0, len(ys), step):
                    part = slice(k, k + step)
                    differ = np.bitwise_count(xs[:, None, :] ^ ys[None, part, :]).sum(axis=2, dtype=np.int64)
                    low, high = np.minimum(n[:, None], n2[None, part]), np.maximum(n[:, None], n2[None, part])
                    ok = (differ * (100 + percent) <= (low + high) * (100 - percent)) & (100 * low >= percent * high) & (comp[:, None] != comp2[None, part])
                    if nearest:
                        i = np.flatnonzero(ok.any(axis=1))
                        j = np.where(ok[i], differ[i], np.iinfo(np.int64).max).argmin(axis=1)
                    else:
                        i, j = np.nonzero(ok)
                    yield from zip(rep[i].tolist(), rep2[k + j].tolist(), differ[i, j].tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, left = None, [], []
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)) for c in range(4)])
            starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))) if batch.num_rows else []
            values = list(zip(*(batch.column(c).to_pylist() for c in range(4, 8))))
            found, best = set(), {}
            for a, b in zip(starts, [*starts[1:], batch.num_rows]):
                key, side = tuple(keys[:3, a].tolist()), keys[3, a]
                if key != now:
                    now, rows, left = key, [], []
                if side == 0:
                    rows += values[a:b]
                    left = []
                else:
                    left = left or _by_width(rows)
                    pairs = compare(left, _by_width(values[a:b]))
                    if nearest:
                        for one, other, differ in pairs:
                            best[one] = min(best.get(one, (differ, other)), (differ, other))
                    else:
                        found.update((min(p[:2]), max(p[:2]), 0) for p in pairs)
            found |= {(one, other, differ) for one, (differ, other) in best.items()}
            yield out_batch(schema, {n: [p[k] for p in found] for k, n in enumerate(schema.names)})
        trim()

    schema = pa.schema([(n, pa.int64()) for n in ("member", "centre", "differ")])
    met = met.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "side")
    pairs = met.mapInArrow(run, "member long, centre long, differ long")
    if nearest:
        one = pairs.groupBy("member").agg(F.min(F.struct("differ", "centre"))["centre"].alias("centre"))
        pairs = one.select(F.least("member", "centre").alias("member"), F.greatest("member", "centre").alias("centre"))
    return pairs.select("member", "centre").distinct()


def dealt(out: DataFrame, rows: DataFrame, down: Column) -> DataFrame:
    """bucket, a, b, side, rep, component of the blocks in which each row (bucket, rep, component, n) of ``out``, side 0, meets each of ``rows``,
    side 1, of its bucket; n: rows in the bucket; ``down``: blocks on side 0."""
    across = F.ceil(F.col("n") / BLOCK)
    one = out.select("bucket", F.explode(F.sequence(F.lit(0), across - 1)).alias("a"), F.pmod(F.xxhash64("rep", F.lit(1)), down).alias("b"), F.lit(0).cast("long").alias("side"), "rep", "component")
    other = rows.select("bucket", F.pmod(F.xxhash64("rep", F.lit(2)), across).alias("a"), F.explode(F.sequence(F.lit(0), down - 1)).alias("b"), F.lit(1).cast("long").alias("side"), "rep", "component")
    return one.union(other)


def spanning(shared: DataFrame, component: DataFrame) -> DataFrame:
    """The rows (bucket, rep) of buckets that span several components, with their component, n (rows in the bucket), and most (rows) and main of
    its largest component. Components are given for some reps (node); the others stand alone."""
    label = shared.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("component", "rep").alias("component"))
    count = label.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    spans = count.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("several")).where("several > 1")
    return label.join(spans.select("bucket", "n", F.col("main.n").alias("most"), F.col("main.component").alias("main")), "bucket")
