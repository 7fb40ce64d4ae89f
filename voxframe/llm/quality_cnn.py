"""Quality classifier: a convolutional network over bytes, in NumPy.

A text is cut into overlapping chunks that cover all of it. Each byte has a learned vector; learned filters pass over all
windows of a chunk, one at each byte, and the largest answer of each filter is kept. Largest and mean answers over the chunks, and the text's
length, give one probability. Training takes a bounded sample of labelled rows (``train_rows``, whole texts) on the driver;
scoring is one pass over the table without a shuffle, in which the weights (some 10 kB) travel with the tasks.

Edge cases: a null or empty text is one chunk of padding and gets a score like any other; without labels of both kinds every
score is the share of label 1 (0.5 without labels); repeated rows get equal scores; texts of any length are read whole, some
chunks at a time, so a long text takes no more memory than its own bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._np import blocks, out_batch, text_column, within
from ._shared import small_batches

CHUNK, STEP, WIDTH, VECTOR, FILTERS = 512, 1, 8, 8, 24
PAD = 256
#: Chunks that are read at once.
AT_ONCE = 64
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and first byte of each chunk, and the rows' offsets in chunks."""
    count = np.maximum(1, -(-np.diff(at) // CHUNK))
    return np.repeat(np.arange(len(count)), count), np.repeat(at[:-1], count) + CHUNK * within(count), np.append(0, np.cumsum(count))


def chunks(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The bytes of each chunk (WIDTH more than CHUNK, so that no window is lost between two), padded behind its row's end."""
    index = begin[:, None] + np.arange(CHUNK + WIDTH)
    padded = np.append(data, np.uint8(0))
    out = padded[np.minimum(index, len(data))].astype(np.int16)
    out[index >= stop[:, None]] = PAD
    return out


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.standard_normal((257, VECTOR)) * 0.5).astype(np.float32)
        self.vectors[PAD] = 0
        self.filters = (rng.standard_normal((WIDTH * VECTOR, FILTERS)) * np.sqrt(2 / (WIDTH * VECTOR))).astype(np.float32)
        self.shift = np.zeros(FILTERS, np.float32)
        self.dense = (rng.standard_normal(2 * FILTERS + 1) * 0.1).astype(np.float32)
        self.level = np.zeros(1, np.float32)
        self.constant: float | None = None

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.filters, self.shift, self.dense, self.level]

    def answers(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answer of each filter in each chunk, and the window that gave it."""
        best, where = np.empty((len(cut), FILTERS), np.float32), np.empty((len(cut), FILTERS), np.int64)
        for k in range(0, len(cut), AT_ONCE):
            seen = np.ascontiguousarray(self.vectors[cut[k : k + AT_ONCE]])
            n, length, _ = seen.shape
            windows = (length - WIDTH) // STEP + 1
            s = seen.strides
            view = np.lib.stride_tricks.as_strided(seen, (n, windows, WIDTH * VECTOR), (s[0], s[1] * STEP, s[2]))
            got = view.reshape(-1, WIDTH * VECTOR) @ self.filters
            got = got.reshape(n, windows, FILTERS)
            best[k : k + AT_ONCE] = got.max(axis=1)
            if self.training:
                where[k : k + AT_ONCE] = (got == best[k : k + AT_ONCE, None]).argmax(axis=1)
        return np.maximum(best + self.shift, 0), where

    training = False

    def pooled(self, best: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        most = np.maximum.reduceat(best, at[:-1], axis=0)
        mean = np.add.reduceat(best, at[:-1], axis=0) / np.diff(at)[:, None]
        return self.joined(most, mean, size)

    def joined(self, most: np.ndarray, mean: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.concatenate([most, mean, np.log1p(size)[:, None] / 10], axis=1).astype(np.float32)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        row, begin, place = places(at)
        most, total = (np.zeros((len(at) - 1, FILTERS), np.float32) for _ in range(2))
        padded = np.append(data, np.uint8(0))
        for k in range(0, len(row), AT_ONCE):
            own = slice(k, k + AT_ONCE)
            first = int(begin[own][0])
            near = padded[first : int(begin[own][-1]) + CHUNK + WIDTH]
            best = self.answers(chunks(near, begin[own] - first, at[row[own] + 1] - first))[0]
            np.maximum.at(most, row[own], best)
            np.add.at(total, row[own], best)
        z = self.joined(most, total / np.diff(place)[:, None], np.diff(at)) @ self.dense + self.level
        return 1 / (1 + np.exp(-z.astype(np.float64)))

    def slopes(self, cut: np.ndarray, at: np.ndarray, size: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Gradients of the mean log loss in the order of parts()."""
        best, where = self.answers(cut)
        seen = self.pooled(best, at, size)
        z = seen @ self.dense + self.level
        error = ((1 / (1 + np.exp(-z)) - label) / len(label)).astype(np.float32)
        count = np.diff(at)
        row = np.repeat(np.arange(len(count)), count)
        to_most, to_mean = error[:, None] * self.dense[:FILTERS], error[:, None] * self.dense[FILTERS : 2 * FILTERS]
        back = (to_mean / count[:, None])[row]
        top = best == seen[row, :FILTERS]
        ties = np.add.reduceat(top.astype(np.float32), at[:-1], axis=0)
        back += np.where(top, (to_most / np.maximum(ties, 1))[row], 0)
        back[best <= 0] = 0
        c, f = np.nonzero(back)
        worth = back[c, f]
        symbols = cut[c[:, None], where[c, f][:, None] * STEP + np.arange(WIDTH)]
        seen_there = self.vectors[symbols].reshape(len(c), WIDTH * VECTOR)
        d_filters = np.zeros_like(self.filters)
        for k in range(FILTERS):
            own = f == k
            d_filters[:, k] = worth[own] @ seen_there[own]
        d_seen = (worth[:, None] * self.filters[:, f].T).reshape(-1, VECTOR)
        flat = symbols.ravel()
        d_vectors = np.stack([np.bincount(flat, d_seen[:, v], minlength=257) for v in range(VECTOR)], axis=1)
        d_vectors[PAD] = 0
        return [d_vectors.astype(np.float32), d_filters, back.sum(axis=0), error @ seen, np.array([error.sum()], np.float32)]

    def fit(self, texts: list[bytes], labels: np.ndarray, rounds: int, seed: int = 3) -> Network:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        self.level[0] = np.log(labels.mean() / (1 - labels.mean()))
        first = [np.zeros_like(p) for p in self.parts()]
        second = [np.zeros_like(p) for p in self.parts()]
        size = np.array([len(t) for t in texts], np.int64)
        step, self.training = 0, True
        for turn in range(rounds):
            order = rng.permutation(len(texts))
            rate = 0.01 * (1 - turn / rounds) + 0.0005
            for k in range(0, len(order), 32):
                own = order[k : k + 32]
                at = np.append(0, np.cumsum(size[own]))
                row, begin, place = places(at)
                cut = chunks(np.frombuffer(b"".join(texts[i] for i in own), np.uint8), begin, at[row + 1])
                step += 1
                for p, g, m, v in zip(self.parts(), self.slopes(cut, place, size[own], labels[own]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.training = False
        return self


def fit_network(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, rounds: int = 6, longest: int = 200_000) -> Network:
    """A network trained on at most ``train_rows`` labelled rows that are not held out, chosen by a hash of their id, but for
    texts of more than ``longest`` characters: so the driver takes a bounded part."""
    small_batches(docs.sparkSession)
    sample = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(train_rows)
    )
    got = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= longest).join(F.broadcast(sample), "doc_id")
    got = got.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).orderBy("doc_id").select("quality", "text").toPandas()  # a row for each id, however often it occurs
    return Network().fit([(t or "").encode() for t in got.text], got.quality.to_numpy(np.float32), rounds)


def held_out(doc_id: str):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def score(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_column(batch)
            for a, b in blocks(at, 1 << 20):
                p = network.score(data[at[a] : at[b]], at[a : b + 1] - at[a])
                yield out_batch(schema, {n: batch.column(k).slice(a, b - a) for n, k in (("doc_id", 0), ("held_out", 2))} | {"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    out = docs.select("doc_id", "text", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")).mapInArrow(run, SCHEMA)
    return out
