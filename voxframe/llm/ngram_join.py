"""Jaccard join of texts on distinct word n-grams by vertical partitioning.

The global order of n-grams is that of their hashes, so that fragments of it are even whatever the words' frequencies. Texts of
equal sets are collapsed first. Two sets of similar sizes that reach the similarity differ in at most H n-grams; the order is cut
into more than H + m fragments (H and m by size class, as each class is joined with itself and the next), so at least m + 1
fragments of the two are equal, and texts meet where the hash of such a fragment is equal. Fragments of fewer than ``STRONG``
n-grams say little and are left out of texts that have at most m of them; texts with more are cut a second and a third time by
other orders, and only those that stay poor after that use them. This loses no pair.

Where texts meet, the n-grams that both have are counted in each of ``FRAGMENTS`` fragments separately, in tasks of their own,
and summed for each pair; the sums decide exactly. Not all texts that meet are counted: at first each text with the one centre
that meets the most others. Then, where texts of several components meet in a bucket, those outside its largest component are
held against all others of the bucket by their sketches: bits that each n-gram flips. Two sketches differ in no more bits than
their sets do in n-grams, so what differs in more than H is no pair; only the rest is counted. While that finds links, and
``TURNS`` times at most, ``CENTRES`` of a bucket are taken at a time; at last all are, so that every two texts that meet have been compared or are connected.
Sketches of a bucket are compared in blocks of ``BLOCK`` by ``BLOCK``, inside tasks; no step makes a row for each pair of a group.
The result is exact up to equal 64-bit hashes of n-grams.

Edge cases: a text with fewer words than an n-gram is one n-gram; null texts and texts without words have the empty set and are
linked with nothing; rows with a null doc_id have a null component; repeated rows are in one component; rows of one doc_id with
different texts are one document, linked by any of them; texts of any length are read whole; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._np import SMALL_BLOCK, blocks, mix, out_batch, text_column, trim, within
from ._shared import drop, small_batches, written
from ._sketches import BLOCK, _folded, dealt, near_sketches, sketches, spanning  # noqa: F401
from .near_dup import shingles

#: N-grams that a fragment must have to count as a meeting place of its own.
STRONG = 3
#: Orders by which a text is cut while it has too many poor fragments.
CUTS = 3
#: Fragments in which the overlaps of a pair are counted.
FRAGMENTS = 8
#: Members that meet a centre's fragment in one part.
PART = 256
#: Texts of a bucket that the others are held against at a time, while that finds links.
CENTRES = 8
#: Times that this is done at most before all are taken.
TURNS = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LEVEL, _PLACE, _CUT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def size_classes(most: int, percent: int) -> np.ndarray:
    """The largest size of each class: a set and a larger similar one are in one class or in neighbouring ones."""
    ends, low = [0], 1
    while ends[-1] < most:
        ends.append(low * 100 // percent)
        low = ends[-1] + 1
    ends.append(low * 100 // percent)
    return np.array(ends[1:], np.int64)


def _cut(row: np.ndarray, h: np.ndarray, fragments: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of n-grams and sum of their hashes of each fragment, row by row."""
    order = mix(h + np.uint64(cut) * _CUT) if cut else h
    base = np.append(0, np.cumsum(fragments))
    at = base[row] + ((order >> np.uint64(32)) * fragments[row].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    if cut:
        turn = np.argsort(at, kind="stable")
        at, h = at[turn], h[turn]
    count = np.bincount(at, minlength=base[-1])
    running = np.append(np.uint64(0), np.cumsum(mix(h + np.uint64(1)), dtype=np.uint64))
    ends = np.append(0, np.cumsum(count))
    return count, running[ends[1:]] - running[ends[:-1]]


def meeting_places(row: np.ndarray, h: np.ndarray, rows: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the fragments by which each row's set (hashes in order) meets others."""
    size = np.bincount(row, minlength=rows)
    ends = size_classes(int(size.max(initial=1)), percent)
    own = np.searchsorted(ends, size)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for step in (0, 1):  # with its own class and the one below; with the one above
        level = own + step
        differ = 2 * ends[level] * (100 - percent) // (100 + percent)
        spare = differ // 16
        fragments = np.where((size > 0) & (differ > 0), differ + 1 + spare, 0)
        todo = fragments > 0
        for cut in range(CUTS):
            mine = np.where(todo, fragments, 0)
            of = todo[row]
            count, sums = _cut(row[of], h[of], mine, cut)
            at = np.repeat(np.arange(rows), mine)
            place = within(mine).astype(np.uint64)
            poor = np.bincount(at, count < STRONG, minlength=rows) > spare
            use = count >= STRONG
            if cut == CUTS - 1:
                use |= poor[at]
            name = mix(level[at].astype(np.uint64) * _LEVEL + place * _PLACE + np.uint64(cut))
            found.append((at[use], mix(sums[use] + name[use])))
            todo = todo & poor
            if not todo.any():
                break
    where, names = (np.concatenate(x) for x in zip(*found))
    turn = np.argsort(where, kind="stable")
    return where[turn], names[turn]


def _lower_shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    row, h, _ = shingles(_LOWER[data], at, size)
    return row, h


def signatures(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n (n-grams), two keys of the set, sketch, places (where it meets others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                row, h = _lower_shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], size)
                n = np.bincount(row, minlength=b - a)
                bounds = np.append(0, np.cumsum(n))
                keys = []
                for salt in (1, 2):
                    running = np.append(np.uint64(0), np.cumsum(mix(h ^ mix(np.array([salt], np.uint64))), dtype=np.uint64))
                    keys.append((running[bounds[1:]] - running[bounds[:-1]]).view(np.int64))
                where, names = meeting_places(row, h, b - a, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(b - a + 1)), pa.int32()), pa.array(names.view(np.int64)))
                yield out_batch(schema, {"doc_id": batch.column(0).slice(a, b - a), "n": n, "key1": keys[0], "key2": keys[1], "sketch": sketches(row, h, n, percent), "places": lists})
        trim()

    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("sketch", pa.binary()), ("places", pa.list_(pa.int64()))])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, key1 long, key2 long, sketch binary, places array<long>")


def _met_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (bucket, rep) in the order of buckets, those whose bucket has another row."""
    held, shared = None, False  # the last row so far, and whether the one before is of its bucket
    for batch in batches:
        if batch.num_rows == 0:
            continue
        bucket = np.asarray(batch.column(0))
        same = bucket[1:] == bucket[:-1]
        begins = held is not None and held.column(0)[0].as_py() == int(bucket[0])
        if held is not None and (shared or begins):
            yield held
        keep = np.append(begins, same) | np.append(same, False)
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        held, shared = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if held is not None and shared:
        yield held


def fragments(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, variant (first key of the set), n, frag, elements: each set in fragments of the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                row, h = _lower_shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], size)
                n = np.bincount(row, minlength=b - a)
                key = np.add.reduceat(np.append(mix(h ^ mix(np.array([1], np.uint64))), np.uint64(0)), np.minimum(np.append(0, np.cumsum(n))[:-1], len(h)))
                at_frag = row * FRAGMENTS + (h >> np.uint64(61)).astype(np.int64)
                ends = np.searchsorted(at_frag, np.arange((b - a) * FRAGMENTS + 1))
                full = np.flatnonzero(ends[1:] > ends[:-1])
                own = pa.array(full // FRAGMENTS)
                elements = [h[ends[k] : ends[k + 1]].tobytes() for k in full]
                yield out_batch(schema, {"doc_id": batch.column(0).slice(a, b - a).take(own), "variant": key.view(np.int64)[full // FRAGMENTS], "n": n[full // FRAGMENTS], "frag": full % FRAGMENTS, "elements": elements})
        trim()

    schema = pa.schema([("doc_id", pa.int64()), ("variant", pa.int64()), ("n", pa.int64()), ("frag", pa.int64()), ("elements", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, variant long, n long, frag long, elements binary")


def overlaps(held: DataFrame, pairs: DataFrame) -> DataFrame:
    """member, centre, variants, sizes and shared (n-grams that both have) of the pairs, from partial counts by fragment.

    A centre meets its members in parts of some ``PART`` of them. Each part is sorted with the centre's fragment in front, so a
    task holds that alone while the members' fragments stream past.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            centre, frag, part, member, variant, n, elements = (batch.column(c).to_pylist() for c in range(7))
            i = 0
            while i < len(centre):
                key = (centre[i], frag[i], part[i])
                if key != now:
                    now, sets = key, []
                if member[i] is None:
                    sets.append((variant[i], n[i], np.frombuffer(elements[i], np.uint64)))
                    i += 1
                    continue
                j = i
                while j < len(centre) and (centre[j], frag[j], part[j]) == key:
                    j += 1
                if sets:
                    parts = [np.frombuffer(x, np.uint64) for x in elements[i:j]]
                    flat = np.concatenate(parts)
                    begin = np.append(0, np.cumsum([len(x) for x in parts]))[:-1]
                    for v, size, own in sets:
                        hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                        shared = np.add.reduceat(hit, begin, dtype=np.int64)
                        some = np.flatnonzero(shared)
                        k = len(some)
                        yield out_batch(
                            schema,
                            {
                                "member": [member[i + x] for x in some],
                                "mv": [variant[i + x] for x in some],
                                "mn": [n[i + x] for x in some],
                                "centre": [key[0]] * k,
                                "cv": [v] * k,
                                "cn": [size] * k,
                                "shared": shared[some],
                            },
                        )
                i = j
        trim()

    names = ["member", "mv", "mn", "centre", "cv", "cn", "shared"]
    schema = pa.schema([(x, pa.int64()) for x in names])
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("member"), "parts").alias("part"), "member")
    members = dealt.join(held.withColumnRenamed("doc_id", "member"), "member").select("centre", "frag", "part", "member", "variant", "n", "elements")
    centres = dealt.select("centre", "part").distinct().join(held.withColumnRenamed("doc_id", "centre"), "centre").select("centre", "frag", "part", F.lit(None).cast("long").alias("member"), "variant", "n", "elements")
    met = members.union(centres).repartition("centre", "frag", "part").sortWithinPartitions("centre", "frag", "part", F.col("member").asc_nulls_first())
    counted = met.mapInArrow(count, ", ".join(f"{x} long" for x in names))
    return counted.groupBy("member", "mv", "mn", "centre", "cv", "cn").agg(F.sum("shared").alias("shared"))


def classes(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text): components of the pairs with
    100 * shared >= percent * union, named by their smallest doc_id."""
    small_batches(docs.sparkSession)
    own = written(signatures(docs, size, percent))
    named = own.where("doc_id is not null and n > 0")
    keys = written(named.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")))
    reps = named.join(keys.select(F.col("rep").alias("doc_id"), "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi").dropDuplicates(["doc_id", "key1", "key2"])
    buckets = reps.select(F.explode("places").alias("bucket"), F.col("doc_id").alias("rep")).repartition("bucket").sortWithinPartitions("bucket")
    shared = written(buckets.mapInArrow(_met_twice, "bucket long, rep long"), free=True)
    sizes = shared.groupBy("bucket").agg(F.count("*").alias("n"))
    weight = written(shared.join(sizes, "bucket").groupBy("rep").agg(F.sum("n").alias("weight")))  # most for a text that many others meet
    nodes = weight.select(F.col("rep").alias("doc_id"))
    sketch = written(reps.join(nodes, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "n", "sketch"))
    held = written(fragments(docs.join(nodes, "doc_id", "left_semi"), size).dropDuplicates(["doc_id", "variant", "frag"]), free=True)

    def linked(pairs: DataFrame) -> DataFrame:
        near = overlaps(held, pairs).where(F.col("shared") * 100 >= percent * (F.col("mn") + F.col("cn") - F.col("shared")))
        return written(near.select(F.col("member").alias("a"), F.col("centre").alias("b")).distinct(), free=True)

    def asked(component: DataFrame, turn: int | None) -> DataFrame:
        """The pairs of different components that meet and may be similar: of ``CENTRES`` texts a bucket outside its largest
        component (drawn anew each turn), or of all of those."""
        rest = written(spanning(shared, component))
        out = rest.where("component <> main")
        if turn is not None:
            slot = F.pmod(F.xxhash64("rep", F.lit(turn)), F.lit(CENTRES))
            best = out.groupBy("bucket", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(turn)).alias("h"), "rep", "component", "n", "most")).alias("c"))
            out = best.select("bucket", "c.rep", "c.component", "c.n", "c.most")
        down = F.lit(1).cast("long") if turn is not None else F.ceil((F.col("n") - F.col("most")) / BLOCK)
        met = dealt(out, rest, down).join(sketch, "rep").select("bucket", "a", "b", "side", "rep", "component", "n", "sketch")
        near = written(near_sketches(met, percent), free=True)
        drop(rest)
        return near

    ranked = shared.join(weight, "rep").select("bucket", F.struct((-F.col("weight")).alias("turn"), "rep").alias("c"))
    centres = ranked.groupBy("bucket").agg(F.min("c").alias("c"))
    first = shared.join(centres, "bucket").where("rep <> c.rep").groupBy("rep").agg(F.min("c").alias("c"))
    pairs = written(first.select(F.col("rep").alias("member"), F.col("c.rep").alias("centre")))
    # rows of one doc_id with different texts are one document
    several = named.groupBy("doc_id").agg(F.min("key1").alias("low"), F.max("key1").alias("high")).where("low <> high").select("doc_id")
    same = written(named.join(several, "doc_id", "left_semi").join(keys, ["key1", "key2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    found = [same, linked(pairs)]
    compared = [pairs.select(F.least("member", "centre").alias("member"), F.greatest("member", "centre").alias("centre"))]
    component = components(reduce(DataFrame.union, found))
    turn: int | None = 0
    while True:
        near = asked(component, turn)
        pairs = written(near.join(reduce(DataFrame.union, compared), ["member", "centre"], "left_anti"))
        drop(near)
        links = linked(pairs)
        compared.append(pairs)
        found.append(links)
        some = not links.isEmpty()
        component = components(reduce(DataFrame.union, found)) if some else component
        if turn is None:
            break
        turn = turn + 1 if some and turn + 1 < TURNS else None
    drop(shared, held, sketch, weight)
    member = own.select("doc_id", F.col("n").alias("n_shingles"), "key1", "key2").join(keys, ["key1", "key2"], "left")
    out = member.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    full = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), full).alias("component_id"))
