"""Removal of word sequences that an earlier document has, by recompression.

Recompression names runs of equal tokens and then, in rounds, pairs of neighbours: tokens are halved into left and right ones
by a bit of their name, and each left one before a right one becomes a pair with a name of its own. Names are hashes of what
they stand for, so they are global and a round needs no shuffle: equal word sequences get equal symbols on all executors,
except near their ends, where what becomes of a symbol depends on words outside. Each symbol carries the span of words on
which it depends; a window contains a symbol only if it contains that span. So equal windows contain the same symbols.

1. Of each window, the highest symbol in it (the most words, then the least hash) stands for it; a text has a symbol for about
   every six windows. Spark counts in which documents each symbol occurs and keeps those that two documents share.
2. Documents with shared symbols are read again; only their windows that such a symbol stands for are compared, by hashes
   of the whole window and the symbol (95 bits), with the smallest doc_id that has them.
3. Words of windows that a smaller doc_id has are removed.

Documents whose words are those of a smaller doc_id are known beforehand by the hash of all words; they are removed whole and
take no part in 1 and 2. Counts are aggregated before each shuffle; joins on frequent symbols and windows are left to adaptive
splitting. Lists are broadcast only up to a counted size. Texts are shuffled only for documents that lose words, and where lists
of symbols are too long to broadcast.

Edge cases: null and empty texts and those of fewer words than a window lose nothing; within one document nothing is removed;
rows with a null doc_id lose nothing and take nothing from others; rows of one doc_id are one document, of which none is earlier
than the other, and each of them is judged by its own words;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._copies import among, not_among, sized, with_lists
from ._np import blocks, mix, out_batch, span_hash, split_words, text_column, window_hashes, within
from ._shared import small_batches, written

ROUNDS = 3
_RUN, _LEFT, _TURN = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1342543DE82EF95))
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def symbols(words: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> list[tuple[np.ndarray, ...]]:
    """The runs and pairs of all rounds: name, words in it, first word and end of the span on which it depends.

    At a text's border the span reaches one word beyond the text, so that no window contains it.
    """
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = len(words)
    new = np.ones(n, bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    name, row = words[start], row[start]
    name = np.where(length > 1, mix(name * _RUN + length.astype(np.uint64)), name)
    stop = start + length
    low, high = start - 1, stop + 1
    runs = length > 1
    out = [(name[runs], length[runs], low[runs], high[runs])]
    for turn in range(1, rounds + 1):
        if len(name) < 2:
            break
        right = (mix(name + np.uint64(turn * int(_TURN) % (1 << 64))) & np.uint64(1)).astype(bool)
        same = row[1:] == row[:-1]
        merged = np.zeros(len(name), bool)  # the left one of a pair
        merged[:-1] = ~right[:-1] & right[1:] & same
        taken = np.append(False, merged[:-1])
        k = np.flatnonzero(merged)
        # what stays alone does so because of its neighbour
        alone_left, alone_right = np.flatnonzero(~right & ~merged), np.flatnonzero(right & ~taken)
        new_low, new_high = low.copy(), high.copy()
        inner = alone_left[alone_left < len(name) - 1]
        inner = inner[same[inner]]
        new_high[alone_left] = np.maximum(high[alone_left], stop[alone_left] + 1)
        new_high[inner] = np.maximum(high[inner], high[inner + 1])
        inner = alone_right[alone_right > 0]
        inner = inner[same[inner - 1]]
        new_low[alone_right] = np.minimum(low[alone_right], start[alone_right] - 1)
        new_low[inner] = np.minimum(low[inner], low[inner - 1])
        new_low[k], new_high[k] = np.minimum(low[k], low[k + 1]), np.maximum(high[k], high[k + 1])
        pair = mix(mix(name[k] + _LEFT) * _TURN + name[k + 1] + np.uint64(turn))
        name = name.copy()
        name[k] = pair
        stop = stop.copy()
        stop[k] = stop[k + 1]
        low, high = new_low, new_high
        out.append((pair, stop[k] - start[k], low[k], high[k]))
        stay = ~taken
        name, row, start, stop, low, high = name[stay], row[stay], start[stay], stop[stay], low[stay], high[stay]
    return out


def standing(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each window of ``size`` words of one row, and the symbol that stands for it.

    The upper four bits of a symbol say how long it is (less for longer ones), the others are the hash of it and of the first and last word
    of its span.
    """
    count = np.maximum(np.diff(at) - size + 1, 0)
    first = np.repeat(at[:-1], count) + within(count)
    best = np.full(len(words) + 1, NONE, np.uint64)
    parts = symbols(words, at)
    name, length, low, high = (np.concatenate(x) for x in zip(*parts))
    fits = (high - low <= size) & (low >= 0)
    name, length, low, high = name[fits], length[fits], low[fits], high[fits]
    inside = high <= len(words)  # spans that end beyond the last word are in no window
    name, length, low, high = name[inside], length[inside], low[inside], high[inside]
    name = mix(mix(name + words[low] * _LEFT) + words[high - 1] * _TURN)  # the span's ends are in the window as well, and tell more texts apart
    rank = ((np.uint64(15) - np.minimum(length, 15).astype(np.uint64)) << np.uint64(60)) | (name >> np.uint64(4))
    order = np.argsort(rank)[::-1]
    rank, low, high = rank[order], low[order], high[order]
    for back in range(size):
        some = (low - back >= high - size) & (low >= back)
        if not some.any():
            break
        at_step = np.full(len(best), NONE, np.uint64)
        at_step[low[some] - back] = rank[some]  # of several, the last one, the best, stays
        best = np.minimum(best, at_step)
    got = best[first]
    bare = np.flatnonzero(got == NONE)  # windows without a symbol: their least word
    if len(bare):
        single = (np.uint64(14) << np.uint64(60)) | (words >> np.uint64(4))
        got[bare] = single[first[bare][:, None] + np.arange(size)].min(axis=1)
    return first, got


def _each(docs: DataFrame, schema: pa.Schema, ddl: str, of_block: Callable[..., dict]) -> DataFrame:
    """A pass over blocks of texts; ``of_block`` gets the row numbers' ids, words' hashes and offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at):
                part = data[at[a] : at[b]]
                starts, stops, word_at = split_words(part, at[a : b + 1] - at[a])
                yield out_batch(schema, of_block(batch.slice(a, b - a), span_hash(part, starts, stops), word_at))

    return docs.mapInArrow(run, ddl)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)


def whole_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, two hashes of all words, n_words."""

    def of_block(batch: pa.RecordBatch, words: np.ndarray, at: np.ndarray) -> dict:
        return {"doc_id": batch.column(0), "text_hash": batch.column(2), "key1": _whole(words, at, 1), "key2": _whole(words, at, 2), "n_words": np.diff(at)}

    names = ["doc_id", "text_hash", "key1", "key2", "n_words"]
    return _each(docs.withColumn("text_hash", F.xxhash64("text")), pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names), of_block)


def _whole(words: np.ndarray, at: np.ndarray, salt: int) -> np.ndarray:
    return span_hash(words.astype('<u8').view(np.uint8), 8 * at[:-1], 8 * at[1:], salt).astype(np.int64)


def shared_symbols(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, names: of each document, the standing symbols that another document has as well."""

    def of_block(batch: pa.RecordBatch, words: np.ndarray, at: np.ndarray) -> dict:
        first, got = standing(words, at, size)
        row = np.searchsorted(at, first, side="right") - 1
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (row[1:] != row[:-1])
        return {"name": got[new].astype(np.int64), "doc_id": _ids(batch)[row[new]]}

    schema = pa.schema([("name", pa.int64()), ("doc_id", pa.int64())])
    spread = _each(docs, schema, "name long, doc_id long", of_block)
    shared = written(spread.groupBy("name").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("name"), free=True)
    return spread.join(sized(shared), "name", "left_semi").groupBy("doc_id").agg(F.collect_set("name").alias("names"))


def removable(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, gone: the first words (start) and hashes (window) of windows that a document of smaller doc_id has."""

    def of_block(batch: pa.RecordBatch, words: np.ndarray, at: np.ndarray) -> dict:
        first, got = standing(words, at, size)
        h, _ = window_hashes(words, at, size)
        row = np.searchsorted(at, first, side="right") - 1
        bounds = np.searchsorted(row, np.arange(len(at)))
        names = batch.column(2)
        flat, sizes = np.asarray(names.flatten()), np.asarray(pa.compute.list_value_length(names))
        edge = np.append(0, np.cumsum(sizes))
        held = [np.isin(got[i:j].astype(np.int64), flat[p:q]) for i, j, p, q in zip(bounds, bounds[1:], edge, edge[1:])]
        some = np.flatnonzero(np.concatenate(held)) if held else np.zeros(0, np.int64)
        more = (got[some] & np.uint64(0x7FFFFFFF)).astype(np.int32)  # of the symbol, so that windows are told apart by 95 bits
        return {"window": h[some].astype(np.int64), "more": more, "doc_id": _ids(batch)[row[some]], "start": (first - at[row])[some]}

    names = written(shared_symbols(docs, size))
    schema = pa.schema([("window", pa.int64()), ("more", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32())])
    spread = written(_each(with_lists(docs, names, "names"), schema, "window long, more int, doc_id long, start int", of_block), free=True)
    earliest = spread.groupBy("window", "more").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("window", "more", "low")
    late = spread.join(written(earliest, free=True), ["window", "more"]).where("doc_id > low")
    return late.groupBy("doc_id").agg(F.collect_set(F.struct("start", "window")).alias("gone"))


def _kept(words: list[bytes], starts: np.ndarray, size: int) -> tuple[int, str]:
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    kept = np.cumsum(edge[:-1]) == 0
    return int(len(words) - kept.sum()), sha256(b" ".join([w for w, k in zip(words, kept) if k])).hexdigest()


def _own(data: np.ndarray, start: np.ndarray, window: np.ndarray, size: int) -> np.ndarray:
    """Of the windows found in the rows of a doc_id, the starts of those that are this text's."""
    at = np.array([0, len(data)])
    starts, stops, word_at = split_words(data, at)
    h, _ = window_hashes(span_hash(data, starts, stops), word_at, size)
    inside = start < len(h)
    start, window = start[inside], window[inside]
    return start[h[start].view(np.int64) == window]


def remove_repeats(docs: DataFrame, size: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    keys = written(whole_keys(docs))
    first = keys.where("doc_id is not null").groupBy("key1", "key2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    copies = written(keys.where(F.col("n_words") >= size).join(written(first), ["key1", "key2"]).where("doc_id > first").select("doc_id", "text_hash", "n_words"))
    copied = sized(copies.select("doc_id", "text_hash").distinct())
    rest = docs.withColumn("text_hash", F.xxhash64("text")).join(copied, ["doc_id", "text_hash"], "left_anti").select("doc_id", "text")
    hits = written(removable(rest.where("doc_id is not null"), size), free=True)
    hit = sized(hits.select("doc_id"))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, gone = batch.column(1).cast(pa.binary()), batch.column(2) if batch.num_columns > 2 else None
            n, removed, digest = [], [], []
            for k in range(batch.num_rows):
                data = texts[k].as_py() or b""
                words = data.split()
                count, sha = 0, None
                if gone is not None:
                    own = gone[k].values
                    count, sha = _kept(words, _own(np.frombuffer(data, np.uint8), np.asarray(own.field(0)).astype(np.int64), np.asarray(own.field(1)), size), size)
                n.append(len(words))
                removed.append(count)
                digest.append(sha or sha256(b" ".join(words)).hexdigest())
            yield out_batch(out_schema, {"doc_id": batch.column(0), "n_words": n, "n_removed": removed, "kept_sha256": digest})

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    whole = copies.select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(sha256(b"").hexdigest()).alias("kept_sha256"))
    cut = among(rest, hit).join(hits, "doc_id").select("doc_id", "text", "gone").mapInArrow(result, SCHEMA)
    return whole.union(cut).union(not_among(rest, hit).mapInArrow(result, SCHEMA))
