"""Divergence of the sources of each language by in-mapper stripes.

A partition folds whole documents into a hash table of stripes: for each term of a language, the documents and occurrences in
each source. A table that has grown to ``MOST_ENTRIES`` is spilled to the shuffle and begun anew. Stripes of one term are merged by
key, entry by entry, so a term that every partition has sends a row for each partition and source at most. Terms in at least
``min_docs`` documents of their language stay. Their merged stripes are dealt evenly into buckets of ``BUCKET_CELLS`` counts, each
met by its language's list of sources, and emit divergences directly: sums for each pair of sources, and the best terms of each
source. Where a language has so many sources that their pairs exceed ``MOST_CELLS``, the sources are cut into blocks as well.

A source's share of a term is p = 1 + floor(10^9 * (count + 2) / (N + 2 * V)), with N its occurrences of kept terms and V their
number; f = floor((p - q)^2 / (p + q)). All is done on whole numbers; N + 2 * V has to stay below 9 * 10^15.

Edge cases: null text, language and source are ''; sources without terms are sources nevertheless; languages without kept terms
have pairs of value 0; repeated rows are documents of their own; texts of any length are read whole; an empty table gives an
empty result; doc_id and other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._np import BLOCK_BYTES, blocks, text_column, trim
from ._shared import small_batches, written

#: Entries of a partition's stripes that are held at most before they are handed on.
MOST_ENTRIES = 1 << 18
#: Counts (terms by sources) of a bucket, and pairs of sources of a block.
BUCKET_CELLS, MOST_CELLS = 1 << 16, 1 << 20
#: 10^9, by which shares are scaled, is taken in steps of this.
_STEP, _STEPS = 1000, 3

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def terms(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of a block's rows as bytes, and the row of each: runs of letters and of signs beyond ASCII, A-Z lower-cased."""
    letter = _LETTER[data]
    starts = letter.copy()
    starts[1:] &= ~letter[:-1]
    rows = at[(at > 0) & (at < len(data))]
    starts[rows] = letter[rows]
    place = np.flatnonzero(starts)
    ends = np.append(place[1:], len(data))
    size = np.add.reduceat(letter, place, dtype=np.int64) if len(place) else ends[:0]
    offsets = np.append(0, np.cumsum(size)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]])])
    return found, np.searchsorted(at, place, side="right") - 1


def _block_stripes(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> pa.Table:
    """grp, term, df, n of a block: documents and occurrences of each term in each group of rows."""
    found, row = terms(data, at)
    coded = found.dictionary_encode()
    own, code = max(len(coded.dictionary), 1), coded.indices.to_numpy().astype(np.int64)
    each, n = np.unique(row * own + code, return_counts=True)
    key, place = np.unique(group[each // own] * own + each % own, return_inverse=True)
    return pa.table(
        {
            "grp": key // own,
            "term": coded.dictionary.take(pa.array(key % own)),
            "df": np.bincount(place, minlength=len(key)),
            "n": np.bincount(place, n, minlength=len(key)).astype(np.int64),
        }
    )


def fold(docs: DataFrame) -> DataFrame:
    """lang, term, entries (source, df, n): the stripes of each partition. The term '' has an entry for each source that occurs."""
    entry = pa.struct([("source", pa.string()), ("df", pa.int64()), ("n", pa.int64())])
    schema = pa.schema([("lang", pa.string()), ("term", pa.string()), ("entries", pa.list_(entry))])

    def merged(parts: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(parts).group_by(["grp", "term"]).aggregate([("df", "sum"), ("n", "sum")]).rename_columns(["grp", "term", "df", "n"])

    def stripes(table: pa.Table, names: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
        lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
        table = table.append_column("lang", lang.take(table["grp"])).append_column("source", source.take(table["grp"])).sort_by([("lang", "ascending"), ("term", "ascending")]).combine_chunks()
        for at in range(0, table.num_rows, MOST_ENTRIES // 4):  # a stripe may be cut here: parts are merged by key anyway
            part = table.slice(at, MOST_ENTRIES // 4).combine_chunks()
            words, langs = part["term"].combine_chunks(), part["lang"].combine_chunks()
            new = np.ones(part.num_rows, bool)
            new[1:] = pc.or_(pc.not_equal(words[1:], words[:-1]), pc.not_equal(langs[1:], langs[:-1])).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(new)
            entries = pa.StructArray.from_arrays([part[c].combine_chunks() for c in ("source", "df", "n")], fields=list(entry))
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, part.num_rows), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(first)), words.take(pa.array(first)).cast(pa.binary()).cast(pa.string()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        parts: list[pa.Table] = []
        rows = bound = 0
        for batch in batches:
            data, at = text_column(batch)
            keys = zip(*(batch.column(c).fill_null("").to_pylist() for c in (1, 2)))
            group = np.array([number.setdefault(key, len(number)) for key in keys], np.int64)
            for a, b in blocks(at, BLOCK_BYTES):
                part = _block_stripes(data[at[a] : at[b]], at[a : b + 1] - at[a], group[a:b])
                parts.append(part)
                rows += part.num_rows
                if rows > bound + MOST_ENTRIES:
                    parts = [merged(parts)]
                    rows = bound = parts[0].num_rows
                    if rows > MOST_ENTRIES:
                        yield from stripes(parts[0], list(number))
                        parts, rows, bound = [], 0, 0
        if number:
            seen = pa.table({"grp": np.arange(len(number)), "term": pa.array([b""] * len(number), pa.large_binary()), "df": np.zeros(len(number), np.int64), "n": np.zeros(len(number), np.int64)})
            yield from stripes(merged([*parts, seen]), list(number))
        trim()

    small_batches(docs.sparkSession)
    return docs.select("text", "lang", "source").mapInArrow(run, "lang string, term string, entries array<struct<source:string,df:long,n:long>>")


def merge(stripes: DataFrame, min_docs: int) -> DataFrame:
    """lang, term, entries (source, n) of the terms in at least ``min_docs`` documents of the language, and of the term ''."""
    entries = stripes.repartition("lang", "term").select("lang", "term", F.inline("entries"))
    summed = entries.groupBy("lang", "term", "source").agg(F.sum("df").alias("df"), F.sum("n").alias("n"))
    whole = summed.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("entries"))
    return whole.where((F.col("df") >= min_docs) | (F.col("term") == "")).select("lang", "term", "entries")


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 2) / total), by long division, as the product may not fit 64 bits."""
    whole, rest = np.divmod(count + 2, total)
    for _ in range(_STEPS):
        digit, rest = np.divmod(rest * _STEP, total)
        whole = whole * _STEP + digit
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _emit(stripes: pa.Table, header: pa.Table, top: int) -> pa.Table:
    """lang, source, part, item, value of a bucket: its part of each pair's sum, and the best terms of each source."""
    head = header.to_pylist()[0]
    sources, n = [g["source"] for g in head["groups"]], np.array([g["n"] for g in head["groups"]], np.int64)
    stripes = stripes.sort_by("term").combine_chunks()
    words, lists = stripes["term"].combine_chunks(), stripes["entries"].combine_chunks()
    entries = lists.flatten()
    count = np.zeros((len(words), len(sources)), np.int64)
    place = pc.index_in(entries.field("source"), pa.array(sources, pa.string()).cast(entries.field("source").type)).to_numpy(zero_copy_only=False)
    count[np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy(zero_copy_only=False)), place.astype(np.int64)] = entries.field("n").to_numpy(zero_copy_only=False)
    kept = head["terms"]
    p = shares(count, np.maximum(n + 2 * kept, 1)[None, :])
    q = shares(count.sum(axis=1), max(int(n.sum()) + 2 * kept, 1))
    each = -(-len(sources) // head["blocks"])
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def put(source: list[str], part: str, item: list[str], value: list[int]) -> None:
        for name, new in zip(out, (source, [part] * len(item), item, value)):
            out[name] += new

    for g in range(each * head["block"], min(each * (head["block"] + 1), len(sources))):
        own = p[:, g]
        sums = divergence(own[:, None], p[:, g + 1 :]).sum(axis=0).tolist()
        others = sources[g + 1 :]
        put([sources[g]] * len(others), "pair", others, sums)
        put(others, "pair", [sources[g]] * len(others), sums)
        more = np.flatnonzero((count[:, g] > 0) & (own > q))
        value = divergence(own[more], q[more])
        best = np.argsort(-value, kind="stable")[:top]
        put([sources[g]] * len(best), "term", words.take(pa.array(more[best])).to_pylist(), value[best].tolist())
    made = {"lang": [head["lang"]] * len(out["part"]), **out}
    kinds = [pa.string()] * 4 + [pa.int64()]
    return pa.table([pa.array(v, k) for v, k in zip(made.values(), kinds)], names=list(made))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs`` (text, lang, source).

    Part "pair": the divergence from each other source of the language, the largest first. Part "term": the ``top`` terms that
    the source has a larger share of than its language has.
    """
    merged = written(merge(fold(docs), min_docs))
    kept = merged.where("term <> ''")
    entries = kept.select("lang", F.inline("entries")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = merged.where("term = ''").select("lang", F.inline("entries")).select("lang", "source").join(entries, ["lang", "source"], "left")
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("n", F.lit(0)).alias("n")))).alias("groups"))
    number = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    several = F.size("groups").cast("long")
    plan = listed.join(number, "lang", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    plan = written(plan.withColumns({"buckets": F.ceil(F.greatest(F.col("terms") * several, F.lit(1)) / BUCKET_CELLS), "blocks": F.least(several, F.ceil(several * several / MOST_CELLS))}))
    header = plan.select("*", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = kept.join(plan.select("lang", "buckets", "blocks"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    key = ["lang", "bucket", "block"]
    left, right = dealt.select(*key, "term", "entries").groupBy(*key), header.groupBy(*key)
    made = left.cogroup(right).applyInArrow(lambda a, b: _emit(a, b, top), "lang string, source string, part string, item string, value long")
    summed = made.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    line = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(line)).where((F.col("part") == "pair") | (F.col("rank") <= top))
