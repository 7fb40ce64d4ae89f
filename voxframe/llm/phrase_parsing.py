"""Removal of byte strings that occur more than once in a corpus, by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes marks triggers, at which phrases begin; what is a trigger depends on those bytes alone, so
equal strings are cut alike inside. The trigger with the least hash in a window of ``size`` bytes stands for it, and the windows
of one trigger are a segment (some 100 windows). Windows are equal only if their phrases around that trigger are.

The order of all suffixes of a dictionary and a parse, from which common prefixes of neighbours follow, isn't built: only which
strings are equal is asked, and a corpus with few repeats has a dictionary about as large as itself. Classes of equal strings
take its place, level by level:

1. the phrase contents next to each segment's trigger, left and right, are counted over the corpus; segments none of whose
   contents occurs twice are out. Windows without a trigger (in texts of short periods) are counted themselves;
2. of the segments left, the strings that all their windows cover are counted; those that occur twice are repeated throughout.
   One of each such class stays, as a source for others;
3. the other ones are divided into groups of ``LEVELS`` windows around the trigger. A group whose common part occurs once is
   out, one whose whole occurs twice is repeated, and the rest go on to smaller groups, down to single windows.

Texts that are equal as wholes are found first by their hashes; one of each takes part, and all are removed whole. Counts are
aggregated before each shuffle, and frequent strings are keys of aggregates and of joins that adaptive execution splits, never
groups in a task. Strings that are removed are compared by two 64-bit hashes. Texts are shuffled only where the lists of places to look at are too
long to broadcast.

Edge cases: null and empty texts and those shorter than a window lose nothing; strings that overlap themselves count; rows with
a null doc_id lose nothing and don't count for others; repeated rows are copies of each other, and rows of one doc_id with other
texts are texts like others; texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._copies import not_among, sized, with_lists
from ._np import blocks, eights, mix, out_batch, span_hash, text_column, within
from ._shared import small_batches, written

TRIGGER = 8
#: One of so many places is a trigger, on average.
ONE_IN = 16
#: Bytes of the contents that are compared first, and up to which distance from the window's start the right one is inside.
CONTENT = 48
#: Windows of a group at each level.
LEVELS = [24, 4, 1]
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RANGES = "array<struct<lo:int,hi:int,t:int,own:boolean>>"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _standing(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window, trigger and row of each segment; the trigger is -1 where windows have none."""
    n = len(data)
    count = np.maximum(np.diff(at) - size + 1, 0)
    first = np.repeat(at[:-1], count) + within(count)
    if not len(first):
        return (np.zeros(0, np.int64),) * 4
    row = np.repeat(np.arange(len(at) - 1), count)
    value = mix(eights(data)[: max(n - TRIGGER + 1, 0)])
    value[value % np.uint64(ONE_IN) != 0] = NONE
    width = size - TRIGGER + 1
    padded = np.append(value, np.full(-len(value) % width, NONE)).reshape(-1, width)
    left = np.minimum.accumulate(padded, axis=1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[first], left[first + width - 1])
    # the trigger of a window is the first place with the least value in it: the next one of that value
    places = np.flatnonzero(value != NONE)
    order = np.lexsort((places, value[places]))
    ordered_value, ordered_place = value[places][order], places[order]
    _, block_start = np.unique(ordered_value, return_index=True)
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (row[1:] != row[:-1])
    run = np.flatnonzero(new)
    run_stop = np.append(run[1:], len(best))
    known = best[run] != NONE
    where = np.full(len(run), -1, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    plain = ~known
    out.append((first[run[plain]], first[run_stop[plain] - 1], np.full(plain.sum(), -1, np.int64), row[run[plain]]))
    group = np.searchsorted(ordered_value[block_start], best[run[known]])
    lo, hi, r = first[run[known]], first[run_stop[known] - 1], row[run[known]]
    ends = np.append(block_start[1:], len(ordered_value))
    where = _next(ordered_place, block_start[group], ends[group], lo)
    while len(lo):
        t = ordered_place[where] + TRIGGER
        stop = np.minimum(hi, t - TRIGGER)
        out.append((lo, stop, t, r))
        more = stop < hi
        lo, hi, r, where = stop[more] + 1, hi[more], r[more], where[more] + 1
    lo, hi, t, r = (np.concatenate(x) for x in zip(*out))
    return lo, hi, t, r


def _next(places: np.ndarray, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
    """In each sorted part [begin, end) of places, where the first one of at least ``least`` is."""
    begin, end = begin.copy(), end.copy()
    while (begin < end).any():
        middle = (begin + end) // 2
        low = (places[np.minimum(middle, len(places) - 1)] < least) & (begin < end)
        begin = np.where(low, middle + 1, begin)
        end = np.where(low, end, np.minimum(end, middle))
    return begin


def _halves(part: np.ndarray, lo: np.ndarray, hi: np.ndarray, t: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of segments by which content they surely contain: first and last window, trigger, key, and the segment's number."""
    edge = t + CONTENT - TRIGGER - size  # from this window on, the right content is inside
    number = np.arange(len(lo))
    some_right, some_left = hi >= edge, lo < edge
    a, b, c, n = np.maximum(lo, edge)[some_right], hi[some_right], t[some_right], number[some_right]
    key = span_hash(part, c - TRIGGER, c - TRIGGER + CONTENT)
    d, e, f, m = lo[some_left], np.minimum(hi, edge - 1)[some_left], t[some_left], number[some_left]
    left = mix(span_hash(part, f - CONTENT, f) + np.uint64(1))
    return np.append(a, d), np.append(b, e), np.append(c, f), np.append(key, left), np.append(n, m)


def _parsed(part: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """First and last window, trigger, row, key of all half segments; windows without a trigger stand alone."""
    lo, hi, t, row = _standing(part, at, size)
    has = t >= 0
    a, b, c, key, number = _halves(part, lo[has], hi[has], t[has], size)
    count = (hi - lo + 1)[~has]
    single = np.repeat(lo[~has], count) + within(count)
    own = mix(span_hash(part, single, single + size) + np.uint64(2))
    return np.append(a, single), np.append(b, single), np.append(c, np.full(len(single), -1)), np.append(row[has][number], np.repeat(row[~has], count)), np.append(key, own)


def _pass(docs: DataFrame, schema: pa.Schema, ddl: str, of_block: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at):
                yield out_batch(schema, of_block(batch.slice(a, b - a), data[at[a] : at[b]], at[a : b + 1] - at[a]))

    return docs.mapInArrow(run, ddl)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _lists(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The flattened values of the list column, and the row of each."""
    column = batch.column(2)
    return column.flatten(), np.repeat(np.arange(len(column)), np.asarray(pa.compute.list_value_length(column)))


def _contents(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, keys: the keys of half segments and single windows that occur twice in the corpus."""

    def counted(batch: pa.RecordBatch, part: np.ndarray, at: np.ndarray) -> dict:
        key, n = np.unique(_parsed(part, at, size)[4], return_counts=True)
        return {"key": key.astype(np.int64), "n": n}

    def placed(batch: pa.RecordBatch, part: np.ndarray, at: np.ndarray) -> dict:
        _, _, _, row, key = _parsed(part, at, size)
        order = np.lexsort((key, row))
        row, key = row[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
        return {"key": key[new].astype(np.int64), "doc_id": _ids(batch)[row[new]]}

    long = lambda *names: pa.schema([(n, pa.int64()) for n in names])
    twice = _pass(docs, long("key", "n"), "key long, n long", counted).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    spread = _pass(docs, long("key", "doc_id"), "key long, doc_id long", placed)
    return written(spread.join(sized(written(twice)), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("keys")))


def _whole_segments(docs: DataFrame, keys: DataFrame, size: int) -> DataFrame:
    """doc_id, lo, hi, t, whole, more: the half segments and single windows of shared keys, with two hashes of what they cover."""

    def of_block(batch: pa.RecordBatch, part: np.ndarray, at: np.ndarray) -> dict:
        lo, hi, t, row, key = _parsed(part, at, size)
        flat, list_row = _lists(batch)
        held = mix(np.asarray(flat).astype(np.uint64) + mix(list_row.astype(np.uint64)))
        some = np.flatnonzero(np.isin(mix(key + mix(row.astype(np.uint64))), held))
        lo, hi, t, row = lo[some], hi[some], t[some], row[some]
        whole, more = (span_hash(part, lo, hi + size, salt).view(np.int64) for salt in (0, 1))
        base = at[row]
        return {"doc_id": _ids(batch)[row], "lo": lo - base, "hi": hi - base, "t": np.where(t < 0, -1, t - base), "whole": whole, "more": more}

    schema = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("t", pa.int32()), ("whole", pa.int64()), ("more", pa.int64())])
    return written(_pass(with_lists(docs, keys, "keys"), schema, "doc_id long, lo int, hi int, t int, whole long, more long", of_block))


def _groups(docs: DataFrame, ranges: DataFrame, size: int, group: int) -> DataFrame:
    """doc_id, lo, hi, t, own, core, whole, more: the groups of windows in the ranges, with a hash of their common part and two of all."""

    def of_block(batch: pa.RecordBatch, part: np.ndarray, at: np.ndarray) -> dict:
        flat, row = _lists(batch)
        lo, hi, t = (np.asarray(flat.field(k)).astype(np.int64) for k in range(3))
        own = np.asarray(flat.field(3).cast(pa.int8())).astype(bool)
        inside = hi + size <= np.diff(at)[row]
        lo, hi, t, own, row = lo[inside], hi[inside], t[inside], own[inside], row[inside]
        first, last = (t - hi - TRIGGER) // group, (t - lo - TRIGGER) // group
        count = last - first + 1
        which = np.repeat(np.arange(len(lo)), count)
        j = first[which] + within(count)
        base = at[row[which]]
        top = t[which] - TRIGGER - group * j  # the last window of the whole group
        a, b = np.maximum(lo[which], top - group + 1), np.minimum(hi[which], top)
        core = mix(span_hash(part, base + top, base + top - group + 1 + size) + np.uint64(3))
        whole, more = (span_hash(part, base + a, base + b + size, salt).view(np.int64) for salt in (0, 1))
        return {"doc_id": _ids(batch)[row[which]], "lo": a, "hi": b, "t": t[which], "own": own[which], "core": core.astype(np.int64), "whole": whole, "more": more}

    schema = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("t", pa.int32()), ("own", pa.bool_()), ("core", pa.int64()), ("whole", pa.int64()), ("more", pa.int64())])
    ddl = "doc_id long, lo int, hi int, t int, own boolean, core long, whole long, more long"
    return written(_pass(with_lists(docs, ranges, "ranges"), schema, ddl, of_block))


def _classes(found: DataFrame) -> DataFrame:
    """``found`` with ``first``, for whole strings that occur twice: the smallest doc_id and place of the class; else null."""
    twice = found.groupBy("whole", "more").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "lo")).alias("first")).where("n > 1").select("whole", "more", "first")
    return found.join(sized(written(twice)), ["whole", "more"], "left")


def _ranges(rest: DataFrame) -> DataFrame:
    return written(rest.groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "t", "own")).alias("ranges")))


def repeated_windows(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, lo, hi: ranges of first bytes of strings of ``size`` bytes that occur twice in ``docs``."""
    found = written(_classes(_whole_segments(docs, _contents(docs, size), size).withColumn("own", F.lit(True))))
    sure = [found.where("first is not null").select("doc_id", "lo", "hi")]
    source = F.col("first").isNotNull()
    is_first = (F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.lo") == F.col("lo"))
    rest = found.where("t >= 0").where(~source | is_first).withColumn("own", ~source)
    for group in LEVELS:
        groups = _groups(docs, _ranges(rest), size, group)
        cores = groups.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
        found = written(_classes(groups.join(cores, "core", "left_semi")))
        sure.append(found.where("first is not null and own").select("doc_id", "lo", "hi"))
        rest = found.where(~source | is_first).withColumn("own", F.col("own") & ~source)
    out = sure[0]
    for more in sure[1:]:
        out = out.union(more)
    return out


def _cut(data: bytes, lo: np.ndarray, hi: np.ndarray, size: int) -> tuple[int, int, str]:
    inside = hi + size <= len(data)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, lo[inside], 1)
    np.add.at(edge, hi[inside] + size, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()


def _told_apart(docs: DataFrame) -> DataFrame:
    """``docs`` with ``name``: the doc_id, but a hash of id and text where one doc_id has several texts."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high"))
    several = written(ids.where("low <> high").select("doc_id", F.lit(True).alias("several")))
    if several.isEmpty():
        return docs.withColumn("name", F.col("doc_id"))
    return docs.join(sized(several), "doc_id", "left").withColumn("name", F.when(F.col("several"), F.xxhash64("doc_id", "text_hash")).otherwise(F.col("doc_id")))


def remove_repeats(docs: DataFrame, size: int = 200) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = _told_apart(docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64("text"))).select("doc_id", "text", "name")

    def whole(batch: pa.RecordBatch, part: np.ndarray, at: np.ndarray) -> dict:
        return {"doc_id": batch.column(0), "name": batch.column(2), "key1": span_hash(part, at[:-1], at[1:], 1).astype(np.int64), "key2": span_hash(part, at[:-1], at[1:], 2).astype(np.int64), "n_bytes": np.diff(at)}

    names = ["doc_id", "name", "key1", "key2", "n_bytes"]
    schema = pa.schema([(n, pa.int64()) for n in names])
    keys = written(_pass(docs, schema, ", ".join(f"{n} long" for n in names), whole).where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= size)))
    several = keys.groupBy("key1", "key2").agg(F.count("*").alias("n"), F.min("name").alias("first")).where("n > 1")
    copies = written(keys.join(written(several), ["key1", "key2"]).select("doc_id", "name", "n_bytes", "first"))
    named = docs.where("doc_id is not null").select(F.col("name").alias("doc_id"), "text")
    one_each = not_among(named, sized(copies.where("name > first").select(F.col("name").alias("doc_id")).distinct()))
    rest = docs.join(sized(copies.select("name").distinct()), "name", "left_anti")
    hits = written(repeated_windows(one_each, size).groupBy(F.col("doc_id").alias("name")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(1).cast(pa.binary()), batch.column(2) if batch.num_columns > 2 else None
            rows = []
            for k in range(batch.num_rows):
                data = texts[k].as_py() or b""
                if spans is not None and spans[k].is_valid:
                    own = spans[k].values
                    rows.append((len(data), *_cut(data, np.asarray(own.field(0)).astype(np.int64), np.asarray(own.field(1)).astype(np.int64), size)))
                else:
                    rows.append((len(data), 0, 0, sha256(data).hexdigest()))
            n, removed, number, digest = zip(*rows) if rows else ((), (), (), ())
            yield out_batch(out_schema, {"doc_id": batch.column(0), "n_bytes": n, "n_removed": removed, "n_spans": number, "kept_sha256": digest})

    out_schema = pa.schema([*((n, pa.int64()) for n in ("doc_id", "n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string())])
    all_gone = copies.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"))
    hit = sized(hits.select("name"))
    cut = rest.join(hit, "name", "left_semi").join(hits, "name").select("doc_id", "text", "spans").mapInArrow(result, SCHEMA)
    return all_gone.union(cut).union(rest.join(hit, "name", "left_anti").select("doc_id", "text").mapInArrow(result, SCHEMA))
