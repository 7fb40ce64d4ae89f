"""The trie of conversations' prefixes by union-find over the common prefixes of sorted neighbours.

A conversation is the list of its turns' digests (128 bits). Equal lists are collapsed, the rest is sorted by ranges of equal
size. Neighbours in that order are joined by an edge as deep as their longest common prefix (LCP). In a range's task, edges are taken in
descending depth; components are runs of neighbours, so find is a look at a run's ends, and all unions of a depth are done at once.
A component at a depth is a node of the trie there, which sums up the components of the next depth, its children.

Nodes that reach across a border between ranges are known by the LCP of the two conversations on both sides. A node is owned by
the first range in which it occurs, and only there counted as its parent's child. So all sums of the parts of such nodes are added
up by key (depth, digest of the prefix), and only they are shuffled again; all others are complete where they were made.

SHA-256 needs a node's ids one after another: they are sorted by ranges and packed, and one task hashes the packed pieces.

Edge cases: rows with a null conv_id belong to no conversation and are left out; null roles and texts are empty; a null turn
comes first; turns of equal number are ordered by their digest, and repeated rows are repeated turns; texts of any length are
read whole; an empty table gives an empty result, not even the root; other columns are ignored. A conversation's digests must
fit a task (16 bytes a turn).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._np import within
from ._shared import drop, written

#: Turns of a range on average.
RANGE_TURNS = 1 << 18
#: Ids of a packed piece at most.
PIECE = 1 << 16
_NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "parent_key": pa.string(), "key": pa.string(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "read": pa.int64(), "needed": pa.int64(), "ends_sha256": pa.string()}
_NODE_DDL = ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in _NODE.items())


def said(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (an array of structs first, turn, digest, chars) in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turn = F.struct(F.col("turn").isNotNull().alias("first"), F.coalesce("turn", F.lit(0)).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def rebuilt(turns: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """The turns of each conversation after those of the first one of its group: h of that one, own ones after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = turns.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    met = turns.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h}).join(base, "base", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, first, n, ids (joined by commas): sorted rows (key, conv_id) in pieces."""
    schema = pa.schema([("key", pa.string()), ("first", pa.int64()), ("n", pa.int64()), ("ids", pa.string())])
    for batch in batches:
        keys, ids = batch.column(0), np.asarray(batch.column(1))
        codes = keys.dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if batch.num_rows else []
        rows = []
        for a, b in zip(starts, [*starts[1:], batch.num_rows]):
            rows += [(keys[int(a)].as_py(), int(ids[x]), min(x + PIECE, b) - x, ",".join(map(str, ids[x : min(x + PIECE, b)].tolist()))) for x in range(a, b, PIECE)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv_id (the smallest), n, ends_sha256, from the sorted pieces of a key, which stream past."""
    schema = pa.schema([("key", pa.string()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends_sha256", pa.string())])
    key, first, n, sha = None, 0, 0, hashlib.sha256()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        rows = []
        for own, low, count, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                if key is not None:
                    rows.append((key, first, n, sha.hexdigest()))
                key, first, n, sha = own, low, 0, hashlib.sha256()
            else:
                sha.update(b",")
            n += count
            sha.update(ids.encode())
        yield made(rows)
    if key is not None:
        yield made([(key, first, n, sha.hexdigest())])


def _neighbours(m: np.ndarray, off: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """The longest common prefix of each row and the next."""
    both = np.minimum(m[:-1], m[1:])
    k = within(both)
    same = (digests[np.repeat(off[:-2], both) + k] == digests[np.repeat(off[1:-1], both) + k]).all(axis=1)
    out = both.copy()
    differ = np.flatnonzero(~same)
    pair = np.repeat(np.arange(len(both)), both)[differ]
    np.minimum.at(out, pair, k[differ])
    return out


def forest(table: pa.Table) -> pa.Table:
    """The nodes of a range (place, conv_id, n, ends_sha256, digests, chars, left, right): components by descending depth.

    left and right: LCPs with the conversations before and behind the range, -1 where there is none.
    """
    table = table.sort_by("place").combine_chunks()
    left, right = table["left"][0].as_py(), table["right"][0].as_py()
    lists = table["digests"].combine_chunks()
    m = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.append(0, np.cumsum(m))
    flat = lists.flatten().cast(pa.large_binary())
    raw = b"".join(flat.to_pylist())
    digests = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    chars = table["chars"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    weight, ids = table["n"].to_numpy(), table["conv_id"].to_numpy()
    shas = table["ends_sha256"].combine_chunks()
    rows = table.num_rows
    lcp = np.append(_neighbours(m, off, digests), -1)
    by_depth = np.argsort(m, kind="stable")
    bounds = np.searchsorted(m[by_depth], np.arange(int(m.max()) + 2))
    zero = np.zeros(0, np.int64)
    comp = {c: zero for c in ("first", "last", "n", "conv", "leaves", "read", "needed", "owned")}
    made: list[dict[str, np.ndarray]] = []
    for d in range(int(m.max()), -1, -1):
        new = np.sort(by_depth[bounds[d] : bounds[d + 1]])
        none = np.zeros(len(new), np.int64)
        single = {"first": new, "last": new, "n": weight[new], "conv": ids[new], "leaves": none, "read": none, "needed": none, "owned": none}
        turn = np.argsort(np.append(comp["first"], new), kind="stable")
        part = {c: np.append(comp[c], single[c])[turn] for c in comp}
        is_new = turn >= len(comp["first"])
        joined = (part["first"][1:] == part["last"][:-1] + 1) & (lcp[part["last"][:-1]] >= d)
        start = np.flatnonzero(np.append(True, ~joined))
        root = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(turn))))
        if made:  # the components of the depth below are the children
            made[-1]["parent"] = root[~is_new]
        sums = {c: np.add.reduceat(part[c], start) for c in ("n", "leaves", "read", "needed", "owned")}
        first, last = part["first"][start], part["last"][np.append(start[1:], len(turn)) - 1]
        begun, behind = (first == 0) & (d <= left), (last == rows - 1) & (d <= right)
        has_child = np.add.reduceat(~is_new, start, dtype=np.int64) > 0
        size = chars[off[first] + d - 1] if d else np.zeros(len(first), np.int64)
        owned = (~begun).astype(np.int64)
        comp = {
            "first": first,
            "last": last,
            "n": sums["n"],
            "conv": np.minimum.reduceat(part["conv"], start),
            "leaves": sums["leaves"] + ~(has_child | behind),
            "read": sums["read"] + sums["n"] * size,
            "needed": sums["needed"] + owned * size,
            "owned": owned,
        }
        end = np.where(is_new[start], part["first"][start], -1)
        made.append({"depth": np.full(len(first), d), "open": begun | behind, "children": sums["owned"], "end": end, **comp})
    made[-1]["parent"] = np.full(len(made[-1]["first"]), -1)
    out: dict[str, list] = {c: [] for c in _NODE}
    for k, own in enumerate(made):
        above = made[k + 1] if k + 1 < len(made) else None

        def key(of: dict[str, np.ndarray], i: int) -> str:
            begin = int(off[of["first"][i]]) * 16
            return hashlib.md5(raw[begin : begin + 16 * int(of["depth"][i])]).hexdigest()

        count = len(own["first"])
        keys: list[str | None] = [None] * count
        for i in np.flatnonzero(own["open"]):
            keys[i] = key(own, i)
        parent_keys: list[str | None] = [None] * count
        if above is None:
            parents = pa.nulls(count, pa.int64())
        else:
            far = above["open"][own["parent"]]
            parents = pa.array(above["conv"][own["parent"]], mask=far)
            names = {i: key(above, i) for i in np.unique(own["parent"][far])}
            for i in np.flatnonzero(far):
                parent_keys[i] = names[own["parent"][i]]
        sha = shas.take(pa.array(own["end"], mask=own["end"] < 0))
        for c, v in zip(_NODE, (own["conv"], own["depth"], parents, parent_keys, keys, own["n"], own["children"], own["leaves"], own["read"], own["needed"], sha)):
            out[c].append(pa.array(v, _NODE[c]) if not isinstance(v, pa.Array) else v.cast(_NODE[c]))
    return pa.table([pa.chunked_array(v, _NODE[c]) for c, v in out.items()], names=list(_NODE))


def _common(a: Column, b: Column) -> Column:
    """The length of the longest common prefix of two arrays."""
    k = F.least(F.size(a), F.size(b))
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(1), k), F.lit(0), lambda s, i: F.when((s == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(s))).otherwise(0)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of
    ``conversations`` (conv_id, turns as ``said`` gives them)."""
    digests, chars = F.col("turns.digest"), F.col("turns.chars")
    key = F.md5(F.array_join(F.transform(digests, F.hex), "").cast("binary"))
    whole = written(conversations.select("conv_id", digests.alias("digests"), chars.alias("chars"), key.alias("key")))
    sorted_ids = whole.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = sorted_ids.mapInArrow(_packed, "key string, first long, n long, ids string")
    ends = pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed, "key string, conv_id long, n long, ends_sha256 string")
    one = whole.groupBy("key").agg(F.first("digests").alias("digests"), F.first("chars").alias("chars"))
    lists = written(one.join(ends, "key").drop("key"))
    drop(whole)
    turns = lists.agg(F.sum(F.size("digests") + 1)).first()[0] or 0
    ranged = lists.repartitionByRange(-(-turns // RANGE_TURNS) or 1, "digests").sortWithinPartitions("digests")
    placed = written(ranged.select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place")))
    drop(lists)
    line = Window.orderBy("range")  # a row for each range
    borders = placed.groupBy("range").agg(F.min_by("digests", "place").alias("low"), F.max_by("digests", "place").alias("high")).withColumn("before", F.lag("high").over(line))
    borders = borders.withColumn("left", F.when(F.col("before").isNotNull(), _common(F.col("before"), F.col("low"))).otherwise(-1)).select("range", "left")
    borders = written(borders.withColumn("right", F.coalesce(F.lead("left").over(line), F.lit(-1))))
    nodes = written(placed.join(F.broadcast(borders), "range").groupBy("range").applyInArrow(forest, _NODE_DDL))  # borders: a row for each range
    drop(placed, borders)
    sums = ("n_convs", "n_children", "n_leaves", "read", "needed")
    joint = nodes.where("key is not null").groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *(F.sum(c).alias(c) for c in sums), F.max("ends_sha256").alias("ends_sha256"))
    joint = written(joint)
    names = joint.select(F.col("key").alias("parent_key"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    every = nodes.where("key is null").drop("key").unionByName(joint.drop("key").withColumn("parent_conv_id", F.lit(None).cast("long")))
    got = every.join(names, ["parent_key", "depth"], "left")
    return got.select(
        "conv_id",
        "depth",
        F.coalesce("parent_conv_id", "parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("read") - F.col("needed")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
