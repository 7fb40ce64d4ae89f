"""Near-duplicate documents by DartMinHash.

The shingles of a text are weighted elements (each once, or as often as it occurs). Every element throws hashed darts into
the plane of weight and rank, one for each unit of area on average; those under the element's weight and below the text's
rank limit count. Each dart belongs to one of ``bands * rows`` coordinates, and the earliest one of each is the signature:
two texts agree in a coordinate with the probability of their weighted Jaccard similarity. The limit is such that all
coordinates are hit (it is doubled where one isn't), so that a text costs about elements + k log k darts.

Texts with equal elements have equal keys and are collapsed by an aggregate first. The signatures' bands are buckets. In a
bucket, not all pairs are compared, but all members with a centre, the one that shares buckets with the most texts. Candidates whose
signatures can't belong to similar texts are left out by a look at one byte of each coordinate; the others are decided exactly on their
shingles. Only such texts are read again. Classes are connected components of the links.

Where a bucket then spans several components, there are two ways on:

* The default deals its members again by 200 longer bands (12 coordinates each, drawn from all), in which texts just below the similarity
  seldom meet, and in each of those compares two members of every component, drawn by a hash, with two of one other; ``steps`` says how
  often that is done again with other bands while it finds links. A pair that never meets with one of the two as centre and never through
  others is lost.
* ``exhaustive=True`` leaves no bucket open. Those outside its largest component are held against all others of the bucket by sketches,
  in blocks inside tasks, so that no step makes a row for each pair of a group; what sketches leave out is not similar. First each is decided
  with its nearest one only, again while most of that are links; at last all that may be similar are. Then every two texts that share a
  bucket have been compared or are connected. The comparisons of sketches, not the rows, grow with the bucket's size times the number
  outside its largest component.

With 32 bands of 5 rows, a pair at the similarity 0.8 meets in no bucket with a probability of 3e-6, and in no longer band with less than 0.01.

Edge cases: texts of fewer words than a shingle are one shingle; null texts and texts without words are one class; rows with a
null doc_id are classes of their own (null); repeated rows are in one class; rows of one doc_id with different texts are one
document, linked by any of its texts; texts of any length are read whole; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._copies import among, sized
from ._graph import components
from ._np import SMALL_BLOCK, blocks, mix, out_batch, span_hash, split_words, text_column, trim, window_hashes, within
from ._shared import drop, small_batches, written
from ._sketches import BLOCK, dealt, near_sketches, sketches, spanning

BANDS, ROWS = 32, 5
#: Bands of the second step, each of coordinates drawn from all.
LONG_BANDS, LONG_ROWS = 200, 12
#: Standard deviations by which a signature may agree less often than the similarity lets expect.
SIGMAS = 4
#: Members that meet a centre's set in one part.
PART = 256
#: The longest sketch has 1 << MOST_BITS bits.
MOST_BITS = 16
_CELL, _LEVEL, _DART, _PLACE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Distribution of the number of darts in a unit of area (Poisson with mean 1).
_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 16)]))


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of the distinct shingles of each row, in the order of row and hash."""
    starts, stops, word_at = split_words(data, at)
    words = span_hash(data, starts, stops)
    h, first = window_hashes(words, word_at, size)
    n_words = np.diff(word_at)
    row = np.repeat(np.arange(len(n_words)), np.maximum(n_words - size + 1, 0))
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    for n in range(1, size):
        own = short[n_words[short] == n]
        few = mix(sum(mix(words[word_at[own] + k] + np.uint64(k)) for k in range(n)) + np.uint64(n)) if len(own) else np.zeros(0, np.uint64)
        h, row = np.append(h, few), np.append(row, own)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    place = np.flatnonzero(new)
    return row[place], h[place], np.diff(np.append(place, len(h)))


def dart_signatures(row: np.ndarray, h: np.ndarray, weight: np.ndarray, rows: int, k: int) -> np.ndarray:
    """The earliest dart of each coordinate: a matrix of rows by k; rows without elements are 0."""
    total = np.bincount(row, weight, minlength=rows)
    out = np.zeros((rows, k), np.uint64)
    limit = np.where(total > 0, (k * np.log(k) + 3 * k) / np.maximum(total, 1e-9), 0)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[row])
        ranks, levels = np.ceil(limit[row[own]]).astype(np.int64), np.ceil(weight[own]).astype(np.int64)
        cells = ranks * levels
        element = np.repeat(own, cells)
        cell = within(cells)
        level, rank = cell // np.repeat(ranks, cells), cell % np.repeat(ranks, cells)
        seed = mix(h[element] + mix(rank.astype(np.uint64) * _CELL + level.astype(np.uint64) * _LEVEL))
        darts = np.searchsorted(_POISSON, (seed >> np.uint64(11)) / float(1 << 53), side="right")
        which = np.repeat(np.arange(len(seed)), darts)
        name = mix(seed[which] + (within(darts) + 1).astype(np.uint64) * _DART)
        place = mix(name ^ _PLACE)
        when = rank[which] + (name >> np.uint64(11)) / float(1 << 53)
        height = level[which] + (place >> np.uint64(32)) / float(1 << 32)
        at = row[element[which]]
        hit = (when <= limit[at]) & (height < weight[element[which]])
        when, name, slot = when[hit], name[hit], at[hit] * k + ((place[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k)).astype(np.int64)
        late_first = np.argsort(-when, kind="stable")
        flat = np.zeros(rows * k, np.uint64)
        flat[slot[late_first]] = np.maximum(name[late_first], np.uint64(1))  # of several, the last one written, the earliest dart, stays
        flat = flat.reshape(rows, k)
        done = todo & (flat > 0).all(axis=1)
        out[done] = flat[done]
        todo &= ~done
        limit[todo] *= 2
    return out


def signatures(docs: DataFrame, size: int, weighting: str, bands: int, band_rows: int) -> DataFrame:
    """doc_id, two keys of the elements, the bands' hashes and a byte of each coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                row, h, count = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], size)
                weight = np.ones(len(h)) if weighting == "set" else count.astype(float)
                signature = dart_signatures(row, h, weight, b - a, bands * band_rows)
                banded = signature.reshape(b - a, bands, band_rows)
                hashes = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :].repeat(b - a, 0)
                for r in range(band_rows):
                    hashes = mix(hashes * np.uint64(0x100000001B3) + banded[:, :, r])
                keys = []
                for salt in (1, 2):
                    sums = np.zeros(b - a + 1, np.uint64)
                    each = mix(mix(h + np.uint64(salt)) * weight.astype(np.uint64))
                    running = np.append(np.uint64(0), np.cumsum(each, dtype=np.uint64))
                    bounds = np.searchsorted(row, np.arange(b - a + 1))
                    sums = running[bounds[1:]] - running[bounds[:-1]]
                    keys.append(sums.astype(np.int64))
                yield out_batch(
                    schema,
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "key1": keys[0],
                        "key2": keys[1],
                        "bands": pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * bands, pa.int32()), pa.array(hashes.astype(np.int64).ravel())),
                        "look": [x.tobytes() for x in (signature & np.uint64(255)).astype(np.uint8)],
                        "empty": np.bincount(row, minlength=b - a) == 0,
                    },
                )
        trim()

    schema = pa.schema([("doc_id", pa.int64()), ("key1", pa.int64()), ("key2", pa.int64()), ("bands", pa.list_(pa.int64())), ("look", pa.binary()), ("empty", pa.bool_())])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, key1 long, key2 long, bands array<long>, look binary, empty boolean")


def _promising(pairs: DataFrame, looks: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose signatures agree as often as ``SIGMAS`` standard deviations below the similarity lets expect, or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
                k = x.shape[1]
                least = k * similarity - SIGMAS * np.sqrt(k * similarity * (1 - similarity))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= least)).select([0, 1])

    got = pairs.join(looks.toDF("member", "x"), "member").join(looks.toDF("centre", "y"), "centre").select("member", "centre", "x", "y")
    return got.mapInArrow(run, "member long, centre long").distinct()


def _sets(docs: DataFrame, size: int, weighting: str) -> DataFrame:
    """doc_id, elements, several (place among the elements and count of those that count more than once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                row, h, count = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], size)
                bounds = np.searchsorted(row, np.arange(b - a + 1))
                own = []
                for i, j in zip(bounds, bounds[1:]):
                    more = np.flatnonzero(count[i:j] > 1) if weighting == "count" else np.zeros(0, np.int64)
                    own.append(np.stack([more, count[i:j][more]]).astype(np.uint32).tobytes())
                yield out_batch(schema, {"doc_id": batch.column(0).slice(a, b - a), "elements": [h[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], "several": own})
        trim()

    schema = pa.schema([("doc_id", pa.int64()), ("elements", pa.binary()), ("several", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, elements binary, several binary")


def _read_set(elements: bytes, several: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(elements, np.uint64)
    count = np.ones(len(h), np.int64)
    place, n = np.frombuffer(several, np.uint32).reshape(2, -1)
    count[place] = n
    return h, count


def _verified(docs: DataFrame, pairs: DataFrame, size: int, weighting: str, similarity: float) -> DataFrame:
    """a, b: the pairs (member, centre) whose texts have at least the similarity, by their whole shingle sets.

    A centre meets its members in parts of some ``PART`` of them. Each part is sorted with the centre's set in front, so a task
    holds that set alone while the members' sets stream past.
    """

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, sets = None, []
        for batch in batches:
            keep = []
            for at, member, elements, several in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4))):
                one = _read_set(elements, several)
                if member is None:
                    sets = [*sets, one] if at == centre else [one]  # several where rows of one doc_id have different texts
                    centre = at
                    continue
                for other in sets:
                    both, i, j = np.intersect1d(one[0], other[0], assume_unique=True, return_indices=True)
                    shared, total = np.minimum(one[1][i], other[1][j]).sum(), one[1].sum() + other[1].sum()
                    if shared >= similarity * (total - shared) - 1e-9:
                        keep.append((min(at, member), max(at, member)))
                        break
            yield out_batch(schema, {"a": [a for a, _ in keep], "b": [b for _, b in keep]})
        trim()

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    nodes = pairs.select(F.col("member").alias("doc_id")).union(pairs.select("centre")).distinct()
    held = written(_sets(among(docs, sized(nodes)), size, weighting).dropDuplicates())
    parts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("member"), "parts").alias("part"), "member")
    members = dealt.join(held.withColumnRenamed("doc_id", "member"), "member").select("centre", "part", "member", "elements", "several")
    centres = dealt.select("centre", "part").distinct().join(held.withColumnRenamed("doc_id", "centre"), "centre").select("centre", "part", F.lit(None).cast("long").alias("member"), "elements", "several")
    met = members.union(centres).repartition("centre", "part").sortWithinPartitions("centre", "part", F.col("member").asc_nulls_first())
    links = written(met.mapInArrow(decide, "a long, b long").distinct())
    drop(held)
    return links


def _long_bands(open_: DataFrame, step: int) -> DataFrame:
    """bucket, component, rep: ``LONG_BANDS`` buckets for each row (rep, component, look), each by ``LONG_ROWS`` coordinates
    that are drawn anew in every step."""
    names = [("bucket", pa.int64()), ("component", pa.int64()), ("rep", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(step)
        chosen = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = batch.slice(at, 2000)
                look = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.uint8).reshape(rows.num_rows, -1)
                if chosen is None:
                    chosen = [rng.choice(look.shape[1], LONG_ROWS, replace=False) for _ in range(LONG_BANDS)]
                hashes = np.empty((rows.num_rows, LONG_BANDS), np.uint64)
                for k, places in enumerate(chosen):
                    part = np.zeros((rows.num_rows, -(-LONG_ROWS // 8) * 8), np.uint8)
                    part[:, :LONG_ROWS] = look[:, places]
                    h = np.full(rows.num_rows, k, np.uint64)
                    for word in part.view(np.uint64).T:
                        h = mix(h * _CELL + word)
                    hashes[:, k] = h
                rep, component = (np.repeat(np.asarray(rows.column(c)), LONG_BANDS) for c in (0, 1))
                yield out_batch(schema, {"bucket": hashes.view(np.int64).ravel(), "component": component, "rep": rep})

    schema = pa.schema(names)
    return open_.select("rep", "component", "look").mapInArrow(run, ", ".join(f"{n} long" for n, _ in names))


def _across(buckets: DataFrame) -> DataFrame:
    """member, centre: in each bucket two rows of each component, by a hash, meet those of one other component."""
    turn = F.struct(F.xxhash64("rep", "bucket").alias("turn"), "rep")
    one = written(buckets.groupBy("bucket", "component").agg(F.array_distinct(F.array(F.min(turn), F.max(turn))).alias("own")))
    first = F.min(F.struct(F.element_at("own", 1)["turn"].alias("turn"), "component", "own")).alias("c")
    centres = one.groupBy("bucket").agg(first, F.count("*").alias("n")).where("n > 1").select("bucket", "c")
    met = one.join(centres, "bucket").where("component <> c.component").select(F.explode("own.rep").alias("member"), F.col("c.own.rep").alias("centres"))
    pairs = written(met.select("member", F.explode("centres").alias("centre")).distinct())
    drop(one)
    return pairs


def _sketched(docs: DataFrame, size: int, weighting: str, percent: float) -> DataFrame:
    """rep, n (elements, each as often as it counts) and sketch of each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                row, h, count = shingles(data[at[a] : at[b]], at[a : b + 1] - at[a], size)
                if weighting == "count":
                    row, h = np.repeat(row, count), mix(np.repeat(h, count) + within(count).astype(np.uint64) * _LEVEL)
                n = np.bincount(row, minlength=b - a)
                yield out_batch(schema, {"rep": batch.column(0).slice(a, b - a), "n": n, "sketch": sketches(row, h, n, percent, MOST_BITS)})
        trim()

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    return docs.select("doc_id", "text").mapInArrow(run, "rep long, n long, sketch binary")


def classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, weighting: str = "count", bands: int = BANDS, band_rows: int = ROWS, steps: int = 1, exhaustive: bool = False) -> DataFrame:
    """doc_id and class_id (the class's smallest doc_id) of every row of ``docs`` (doc_id, text).

    ``weighting``: "count", each distinct shingle counts as often as it occurs (weighted Jaccard similarity); "set", once.
    ``steps``: of longer bands at most; they end with the first one that finds no link.
    ``exhaustive``: instead, every two rows of a bucket are compared or connected, however many those are.
    """
    small_batches(docs.sparkSession)
    own = written(signatures(docs, size, weighting, bands, band_rows))
    named = own.where("doc_id is not null")
    keys = written(named.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")))
    reps = named.where("not empty").join(keys.select(F.col("rep").alias("doc_id"), "key1", "key2"), ["doc_id", "key1", "key2"], "left_semi").dropDuplicates(["doc_id", "key1", "key2"])
    looks = written(reps.select(F.col("doc_id").alias("rep"), "bands", "look"))
    buckets = looks.select("rep", F.explode("bands").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = written(buckets.join(sizes, "bucket").select("bucket", "rep", "n"))
    weight = met.groupBy("rep").agg(F.sum("n").alias("weight"))  # most for a text that many others resemble
    shared = written(met.join(weight, "rep").select("bucket", "rep", "n", "weight"))
    drop(met)
    first = F.min(F.struct((-F.col("weight")).alias("turn"), "rep"))
    centres = shared.groupBy("bucket").agg(first.alias("c")).select("bucket", F.col("c.rep").alias("centre"))
    look = looks.select("rep", "look")

    verified = []

    def compared(pairs: DataFrame) -> DataFrame:
        near = written(_promising(pairs, look, similarity))
        verified.append(near.select(F.least("member", "centre").alias("member"), F.greatest("member", "centre").alias("centre")))
        return _verified(docs, near, size, weighting, similarity)

    def opened(component: DataFrame) -> DataFrame:
        """The rows (bucket, rep, n, weight, component) of buckets that span several components."""
        labelled = shared.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", "weight", F.coalesce("component", "rep").alias("component"))
        several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high and low is not null")
        return labelled.join(several.select("bucket"), "bucket", "left_semi")

    # rows of one doc_id with different texts are one document
    several = named.groupBy("doc_id").agg(F.min("key1").alias("low"), F.max("key1").alias("high")).where("low <> high").select("doc_id")
    same = written(named.join(several, "doc_id", "left_semi").join(keys, ["key1", "key2"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct())
    pairs = written(shared.join(centres, "bucket").where("rep <> centre").select(F.col("rep").alias("member"), "centre").distinct())
    found = [same, compared(pairs)]
    component = components(found[0].union(found[1]))
    for step in range(0 if exhaustive else steps):
        asked = written(opened(component).where("n > 2").select("rep", "component").distinct())
        long_pairs = _across(_long_bands(asked.join(look, "rep").repartition("rep"), step))
        links = compared(long_pairs.join(pairs, ["member", "centre"], "left_anti"))
        drop(long_pairs, asked)
        if links.isEmpty():
            break
        found.append(links)
        component = components(reduce(DataFrame.union, found))
    sketch, nearest, percent = None, True, 100 * similarity - 1e-7  # so that no rounding leaves a pair out
    while exhaustive:
        rest = written(spanning(shared, component))
        if sketch is None:  # buckets only close, so these are all texts that later turns need
            nodes = sized(rest.select(F.col("rep").alias("doc_id")).distinct())
            sketch = written(_sketched(among(docs, nodes), size, weighting, percent).distinct())
        met = dealt(rest.where("component <> main"), rest, F.ceil((F.col("n") - F.col("most")) / BLOCK))
        met = met.join(sketch, "rep").select("bucket", "a", "b", "side", "rep", "component", "n", "sketch")
        asked = written(near_sketches(met, percent, nearest).join(reduce(DataFrame.union, verified), ["member", "centre"], "left_anti"), free=True)
        links = _verified(docs, asked, size, weighting, similarity)
        verified.append(asked)
        n_links = links.count()
        if n_links:
            found.append(links)
            component = components(reduce(DataFrame.union, found))
        drop(rest)
        if not nearest:
            drop(sketch)
            break
        nearest = n_links > 0 and 2 * n_links >= asked.count()
    drop(shared, pairs)
    member = own.select("doc_id", "key1", "key2").join(keys, ["key1", "key2"], "left")
    labelled = member.join(component.withColumnRenamed("node", "rep"), "rep", "left")
    return labelled.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("class_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of each class of ``docs``: that of the smallest doc_id; of several rows with that doc_id, the one whose text
    is the first in order. Rows with a null doc_id all stay."""
    named = classes(docs, **how).where("doc_id is not null")
    dropped = written(named.where("doc_id <> class_id").select("doc_id").distinct())
    rest = docs.join(sized(dropped), "doc_id", "left_anti")
    often = sized(written(named.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = rest.join(often, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias("row"))
    return rest.join(often, "doc_id", "left_anti").select(docs.columns).union(first.select("row.*").select(docs.columns))
