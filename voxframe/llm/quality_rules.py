"""Quality rules: statistics of each text, fixed limits, and isolation forests on the statistics.

One pass over the table gives every text's statistics. Forests, one for each group of statistics, are grown on the driver: random splits
isolate unusual statistics after few steps, so a short mean path means an anomaly. Ranges of statistics are those of all labelled rows.
Trees are grown on one half of the good rows, each, as isolation forests are defined, on a random part of ``part`` of them; the largest
score of each forest that still counts as normal is calibrated on all rows of the other half, of which at most ``lost_share`` are above a
limit, and on all bad rows. Forests and limits are some 500 kB and travel with the tasks;
scoring needs no shuffle.

Edge cases: a null or empty text has no words, fails the base rules and is not kept; without labels of good rows there are no
forests and the base rules decide alone; labels of rows that don't exist are ignored, of several labels of one row the lowest
counts; repeated rows are each judged; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._np import SMALL_BLOCK, blocks, char_starts, mix, out_batch, span_hash, split_words, text_column, trim, window_hashes
from ._shared import drop, small_batches, written

#: The signs that count as symbols.
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbols_a_word", "dup_line_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "line_words", "digit_share"]
#: Statistics that one forest judges together.
GROUPS = [["symbols_a_word", "mark_share"], ["word_length", "distinct_share"], ["upper_share", "digit_share"], ["dup_line_share", "repeat_share"], ["log_words", "line_words"]]
OUT = [("doc_id", "long"), *((c, "long") for c in COUNTS), ("base_failed", "boolean"), ("kept", "boolean"), ("excess", "double")]


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT, _MARK = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"0123456789"), _table(b"!?")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    return np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[at])


def _share(part: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The root of a share, which spreads small ones."""
    return np.sqrt(part / (part + rest))


def _distinct(keys: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Distinct keys of each row."""
    _, first = np.unique(keys + mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    return np.bincount(row[first], minlength=rows)


def statistics(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of each row; ``at``: the rows' offsets in ``data``."""
    rows = len(at) - 1
    starts, stops, word_at = split_words(data, at)
    n_words = np.diff(word_at)
    word_row = np.repeat(np.arange(rows), n_words)
    in_word = np.zeros(len(data) + 1, np.int8)
    in_word[starts] += 1
    in_word[stops] -= 1
    in_word = np.cumsum(in_word, dtype=np.int8)[:-1].astype(bool)
    word_chars = _sums(in_word & char_starts(data), at)

    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(at) > 0)
    line_start = np.unique(np.concatenate([at[filled], breaks + 1]))
    line_start = line_start[line_start < len(data)]
    line_stop = np.append(line_start[1:], len(data))[: len(line_start)]
    line_stop = line_stop - (data[np.maximum(line_stop - 1, 0)] == 10)
    words_before = np.append(0, np.cumsum(in_word, dtype=np.int64))
    worded = words_before[line_stop] > words_before[line_start]
    line_start, line_stop = line_start[worded], line_stop[worded]
    line_row = np.searchsorted(at, line_start, side="right") - 1
    n_lines = np.bincount(line_row, minlength=rows)
    n_dup_lines = n_lines - _distinct(span_hash(data, line_start, line_stop), line_row, rows)

    words = span_hash(data, starts, stops)
    windows, first = window_hashes(words, word_at, 3)
    window_row = word_row[first]
    _, which, times = np.unique(windows + mix(window_row.astype(np.uint64) + np.uint64(1)), return_inverse=True, return_counts=True)
    again = first[times[which] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat_words = _sums(covered, word_at)

    some = np.maximum(n_words, 1)
    chars = np.maximum(word_chars, 1)
    features = [
        np.log1p(n_words),
        word_chars / some,
        _share(_sums(_SYMBOL[data], at), some),
        n_dup_lines / np.maximum(n_lines, 1),
        n_repeat_words / some,
        _share(_sums(_UPPER[data], at), chars),
        _share(_sums(_MARK[data], at), some),
        _distinct(words, word_row, rows) / some,
        np.log1p(n_words / np.maximum(n_lines, 1)),
        _share(_sums(_DIGIT[data], at), chars),
    ]
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": _sums(_SYMBOL[data], at),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat_words,
        "base_failed": (n_words < 50) | (100 * n_repeat_words > 50 * n_words),
        "features": np.stack(features, axis=1),
    }


def _expected_path(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), (n == 2).astype(float))


@dataclass
class IsolationForest:
    """Trees of random splits over some of the statistics.

    A tree is grown on a random part of the ordinary rows, but a split lies anywhere in the range that all labelled rows span,
    so that a value which no ordinary row has is cut off from all of them after few splits.
    """

    columns: list[int]
    trees: int = 50
    part: int = 256
    deepest: int = 12
    seed: int = 7
    grown: list = field(default_factory=list)
    limit: float = np.inf

    def fit(self, ordinary: np.ndarray, low: np.ndarray, high: np.ndarray) -> IsolationForest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = ordinary[rng.choice(len(ordinary), min(self.part, len(ordinary)), replace=False)]
            feature, split, child, length = [], [], [], []
            todo = [(rows, low, high, 0, -1)]
            while todo:
                own, lo, hi, depth, parent = todo.pop()
                here = len(feature)
                if parent >= 0:
                    child[parent].append(here)
                child.append([])
                wide = [f for f in self.columns if hi[f] > lo[f]]
                if depth >= self.deepest or len(own) < 2 or not wide:
                    feature.append(-1)
                    split.append(0.0)
                    length.append(depth + float(_expected_path(len(own))))
                    continue
                f = wide[int(rng.integers(len(wide)))]
                s = float(rng.uniform(lo[f], hi[f]))
                feature.append(f)
                split.append(s)
                length.append(0.0)
                left = own[:, f] < s
                above, below = lo.copy(), hi.copy()
                above[f] = below[f] = s
                todo += [(own[~left], above, hi, depth + 1, here), (own[left], lo, below, depth + 1, here)]  # the left one comes next
            self.grown.append((np.array(feature), np.array(split), np.array([c or [0, 0] for c in child]), np.array(length)))
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the mean path of a row, the higher."""
        total = np.zeros(len(rows))
        for feature, split, child, length in self.grown:
            node = np.zeros(len(rows), np.int64)
            inner = np.flatnonzero(feature[node] >= 0)
            while len(inner):
                at = node[inner]
                node[inner] = child[at, (rows[inner, feature[at]] >= split[at]).astype(int)]
                inner = inner[feature[node[inner]] >= 0]
            total += length[node]
        return 2.0 ** (-total / len(self.grown) / self.deepest)


@dataclass
class Forests:
    """A forest with a limit of its own for each group of statistics; a text is kept if no score is above its limit."""

    members: list[IsolationForest]

    def excess(self, rows: np.ndarray) -> np.ndarray:
        """How far the worst score is above its limit; at most 0 for texts that are kept."""
        return np.max([f.score(rows) - f.limit for f in self.members], axis=0)


def calibrate(members: list[IsolationForest], good: np.ndarray, bad: np.ndarray, lost_share: float) -> None:
    """Sets the forests' limits by labelled rows.

    All limits stand at one rank of the good rows' scores in their forest, the lowest at which the forests together reject no more than
    ``lost_share`` of the good rows. Each is then raised halfway to the next bad row's score above it.
    """
    limits = joint_limits([f.score(good) for f in members], len(good), lost_share)
    for forest, limit in zip(members, limits):
        of_bad = forest.score(bad) if len(bad) else np.zeros(0)
        above = of_bad[of_bad > limit]
        forest.limit = (limit + float(above.min())) / 2 if len(above) else 1.0


def joint_limits(scores: list[np.ndarray], rows: int, lost_share: float) -> list[float]:
    """Each forest's limit of ``rows`` good rows. ``scores`` may be of only some of them, if those with the ``lost_share * rows + 1`` highest scores
    of each forest are there: at any rank beyond, the limits that lose no more are the same."""
    falling = [np.sort(s)[::-1] for s in scores]
    low, high = 0, min(int(lost_share * rows), len(falling[0]) - 1)  # at rank 0 no good row is rejected, and the more the higher the rank
    while low < high:
        rank = (low + high + 1) // 2
        lost = np.any([s > f[rank] for s, f in zip(scores, falling)], axis=0).sum()
        low, high = (rank, high) if lost <= lost_share * rows else (low, rank - 1)
    return [float(own[low]) for own in falling]


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                s = statistics(data[at[a] : at[b]], at[a : b + 1] - at[a])
                yield out_batch(schema, {"doc_id": batch.column(0).slice(a, b - a), "features": list(s["features"]), "base_failed": s["base_failed"]})

    schema = pa.schema([("doc_id", pa.int64()), ("features", pa.list_(pa.float64())), ("base_failed", pa.bool_())])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<double>, base_failed boolean")


def fit_forests(docs: DataFrame, labels: DataFrame, lost_share: float = 0.002, trees: int = 50) -> Forests | None:
    """Forests calibrated by all labelled rows; None without good ones.

    Trees are grown on good rows that pass the base rules; bad ones only take part in ranges and limits. The forests together
    reject at most ``lost_share`` of the half of the good rows on which the limits are set. To the driver come ``part`` good rows for each
    tree, the rows at the limits (``lost_share`` of that half for each forest), and sums. Statistics of all rows are taken before
    they meet the labels, so that texts are never shuffled, however many labels there are.
    """
    small_batches(docs.sparkSession)
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    measured = _measured(docs.where("doc_id is not null")).where(~F.col("base_failed")).select("doc_id", "features")
    labelled = measured.join(told, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.min("quality").alias("quality"))  # a row for each id
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    rows = written(labelled.select("doc_id", "features", (F.col("quality") == 1).alias("good"), half.alias("half")))
    counts = {(r.good, r.half): r.n for r in rows.groupBy("good", "half").agg(F.count("*").alias("n")).collect()}
    if not counts.get((True, 0), 0) + counts.get((True, 1), 0):
        drop(rows)
        return None
    ends = rows.agg(*(f(F.get("features", F.lit(k))).alias(f"{n}{k}") for k in range(len(FEATURES)) for n, f in (("low", F.min), ("high", F.max)))).first()
    low, high = (np.array([ends[f"{n}{k}"] for k in range(len(FEATURES))]) for n in ("low", "high"))
    grown = 0 if counts.get((True, 0)) else 1
    other = 1 if counts.get((True, 1)) else 0  # of a single good row there is only one half
    few = rows.where(F.col("good") & (F.col("half") == grown)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(trees * IsolationForest.part).collect()
    ordinary = np.array([r.features for r in few])
    members = [IsolationForest([FEATURES.index(f) for f in group], trees).fit(ordinary, low, high) for group in GROUPS]
    scored = written(_scored(rows.where(~F.col("good") | (F.col("half") == other)), members))
    names = [f"s{k}" for k in range(len(members))]
    n = counts[(True, other)]
    top = [scored.where("good").orderBy(F.desc(c), "doc_id").limit(int(lost_share * n) + 1) for c in names]
    highest = np.array([r[1:] for r in reduce(DataFrame.union, (t.select("doc_id", *names) for t in top)).distinct().collect()])
    limits = joint_limits(list(highest.T), n, lost_share)
    above = scored.where("not good").agg(*(F.min(F.when(F.col(c) > limit, F.col(c))).alias(c) for c, limit in zip(names, limits))).first()
    for forest, c, limit in zip(members, names, limits):
        forest.limit = 1.0 if above[c] is None else (limit + above[c]) / 2
    drop(rows, scored)
    return Forests(members)


def _scored(rows: DataFrame, members: list[IsolationForest]) -> DataFrame:
    """doc_id, good and the forests' scores, s0, s1, ..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                features = np.asarray(batch.column(2).flatten()).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(f.score(features)) for f in members)], names=names)

    names = ["doc_id", "good", *(f"s{k}" for k in range(len(members)))]
    return rows.select("doc_id", "good", "features").mapInArrow(run, ", ".join(["doc_id long", "good boolean", *(f"{n} double" for n in names[2:])]))


def grow(good: np.ndarray, bad: np.ndarray, lost_share: float, trees: int) -> Forests:
    both = np.concatenate([good, bad])
    low, high = both.min(axis=0), both.max(axis=0)
    turn = np.random.default_rng(len(good)).permutation(len(good))
    grown, other = good[turn[::2]], good[turn[1::2]] if len(good) > 1 else good
    members = [IsolationForest([FEATURES.index(f) for f in group], trees).fit(grown, low, high) for group in GROUPS]
    calibrate(members, other, bad, lost_share)
    return Forests(members)


def _verdict(forests: Forests | None, s: dict) -> tuple[np.ndarray, np.ndarray]:
    excess = forests.excess(s["features"]) if forests else np.zeros(len(s["features"]))
    return excess, ~s["base_failed"] & (excess <= 0)


def judge(docs: DataFrame, forests: Forests | None) -> DataFrame:
    """doc_id, the counts, base_failed, kept and excess (of the worst anomaly score over its limit) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, SMALL_BLOCK):
                s = statistics(data[at[a] : at[b]], at[a : b + 1] - at[a])
                excess, kept = _verdict(forests, s)
                yield out_batch(schema, s | {"doc_id": batch.column(0).slice(a, b - a), "kept": kept, "excess": excess})
        trim()

    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in OUT])
    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {t}" for n, t in OUT))


def keep_good(docs: DataFrame, forests: Forests | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            kept = [_verdict(forests, statistics(data[at[a] : at[b]], at[a : b + 1] - at[a]))[1] for a, b in blocks(at, SMALL_BLOCK)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))
        trim()

    return docs.mapInArrow(run, docs.schema)
