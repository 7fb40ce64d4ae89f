"""Packing of tokenised documents into sequences of a fixed length.

Bounded-space online packing: a task keeps ``open_windows`` unfinished sequences. A document's full windows are emitted at
once; its rest goes to the fullest open window in which it fits (best fit). If it fits in none and no further window may be
opened, the fullest one is topped up with the rest's first tokens and emitted, so that it has no padding. What is still open
when a task ends goes, with its tokens, to a merge of the leftovers of ``merge_tasks`` tasks, which again leaves one
unfinished sequence. So a table of n tasks has about n / merge_tasks sequences with padding.

One shuffle, of rows of some 60 bytes for each piece; only leftovers (open_windows * length tokens a task at most) carry
tokens. The documents' texts are never shuffled. Results depend only on how rows lie in the input's partitions: a task that
is run again gives the same rows.

Edge cases: a null or empty text is one token, the closing id; a null doc_id stays null; repeated rows are each packed;
texts of any length are cut into windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._classes import byte_level_cuts
from ._np import blocks, char_starts, out_batch, span_hash, text_column, trim, within
from ._shared import small_batches

PIECE = [("doc_id", "long"), ("start", "long"), ("length", "long"), ("ids_crc32", "long"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long")]
#: Distinct pieces whose ids a worker keeps, and the ids of all of them together.
MOST_PIECES = 600_000
MOST_KEPT_IDS = 4_000_000


class Encoder:
    """Ids of whole texts by a byte-level tokenizer of ``tokenizers``: the library encodes each distinct piece once.

    Known pieces are found by two 64-bit hashes, in sorted arrays. Beyond ``MOST_PIECES`` or ``MOST_KEPT_IDS`` those that only
    one block had are forgotten, or all.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.name, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)  # pieces that a second block had
        self.ids = np.zeros(0, np.uint32)

    def _forget(self) -> None:
        keep = self.again
        if 2 * keep.sum() > MOST_PIECES or 2 * self.size[keep].sum() > MOST_KEPT_IDS:
            keep = np.zeros(len(keep), bool)
        size = self.size[keep]
        self.ids = self.ids[np.repeat(self.begin[keep], size) + within(size)]
        self.name, self.check, self.begin, self.size = self.name[keep], self.check[keep], np.cumsum(size) - size, size
        self.again = np.zeros(len(size), bool)

    def _learn(self, name: np.ndarray, check: np.ndarray, pieces: list[str]) -> None:
        """Adds pieces with their names, which are sorted."""
        ids = [x.ids for x in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        to = np.searchsorted(self.name, name)
        self.begin = np.insert(self.begin, to, len(self.ids) + np.cumsum(size) - size)
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))])
        self.name, self.check = np.insert(self.name, to, name), np.insert(self.check, to, check)
        self.size, self.again = np.insert(self.size, to, size), np.insert(self.again, to, False)

    def _places(self, raw: bytes, name: np.ndarray, check: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray | None:
        """Where the pieces with these sorted names stand among the known ones; None if two pieces share a name."""
        place = np.searchsorted(self.name, name)
        known = place < len(self.name)
        known[known] = self.name[place[known]] == name[known]
        self.again[place[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            pieces = [raw[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist())]
            self._learn(name[new], check[new], pieces)
            place = np.searchsorted(self.name, name)
        return place if (self.check[place] == check).all() else None

    def _by_library(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = [self.library.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(offsets, offsets[1:])]
        return np.array([i for r in rows for i in r], np.uint32), np.append(0, np.cumsum([len(r) for r in rows], dtype=np.int64))

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and each row's offsets in them."""
        raw = data[at[0] : at[-1]].tobytes()
        offsets = at - at[0]
        if any(s in raw for s in self.special):
            return self._by_library(raw, offsets)
        data = np.frombuffer(raw, np.uint8)
        cp = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero(char_starts(data))
        start = byte_level_cuts(cp, np.searchsorted(lead, offsets))
        begin = lead[start]
        end = np.append(begin[1:], len(data))[: len(begin)]
        name, one, which = np.unique(span_hash(data, begin, end), return_index=True, return_inverse=True)
        place = self._places(raw, name, span_hash(data, begin[one], end[one], 1), begin[one], end[one])
        if place is None:
            return self._by_library(raw, offsets)
        place = place[which]
        size = self.size[place]
        ids = self.ids[np.repeat(self.begin[place], size) + within(size)]
        if len(self.name) > MOST_PIECES or len(self.ids) > MOST_KEPT_IDS:
            self._forget()
        return ids, np.append(0, np.cumsum(size))[np.searchsorted(begin, offsets)]


@lru_cache(1)
def worker_encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker, which so share the pieces that it knows."""
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Packer:
    """Places pieces in open windows; ``done`` collects the rows of emitted ones, each with its tokens."""

    def __init__(self, length: int, open_windows: int, first_id: int):
        self.length, self.most, self.next_id = length, open_windows, first_id
        self.open: list[list] = []  # [fill, pieces]
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids, total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def _put(self, window: list, piece: tuple) -> None:
        window[0] += len(piece[2])
        window[1].append(piece)
        if window[0] == self.length:
            self.open.remove(window)
            self._emit(window[1])

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.length:
            self._emit([(doc, start, ids[: self.length], total)])
            start, ids = start + self.length, ids[self.length :]
        if not len(ids):
            return
        fits = [w for w in self.open if w[0] + len(ids) <= self.length]
        if fits:
            self._put(max(fits, key=lambda w: w[0]), (doc, start, ids, total))
            return
        if len(self.open) == self.most:
            fullest = max(self.open, key=lambda w: w[0])
            room = self.length - fullest[0]
            self._put(fullest, (doc, start, ids[:room], total))
            start, ids = start + room, ids[room:]
        self.open.append([0, []])
        self._put(self.open[-1], (doc, start, ids, total))

    def close(self) -> None:
        for _, pieces in self.open:
            self._emit(pieces)
        self.open = []


def _rows(done: list[tuple], schema: pa.Schema, group=None) -> pa.RecordBatch:
    columns = {
        "doc_id": [r[0] for r in done],
        "start": [r[1] for r in done],
        "length": [len(r[2]) for r in done],
        "ids_crc32": [crc(r[2]) for r in done],
        "doc_tokens": [r[3] for r in done],
        "sequence_id": [r[4] for r in done],
        "offset": [r[5] for r in done],
        "group": [group] * len(done),
        "ids": [None if group is None else r[2].astype("<u4").tobytes() for r in done],
    }
    return out_batch(schema, columns)


def pack(docs: DataFrame, tokenizer_path: str, length: int = 2048, open_windows: int = 8, end_id: int = 1, merge_tasks: int = 16) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces of one sequence_id stand one after another from offset 0 without gaps and fill ``length`` tokens, but for the
    last sequence of each merge. ``tokenizer_path`` must be readable on every executor.
    """
    small_batches(docs.sparkSession)
    plain = pa.schema([(n, pa.int64()) for n, _ in PIECE])
    wide = plain.append(pa.field("group", pa.int64())).append(pa.field("ids", pa.binary()))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, packer = None, Packer(length, open_windows, task << 36)
        for batch in batches:
            encoder = encoder or worker_encoder(tokenizer_path)
            data, at = text_column(batch)
            doc_ids = batch.column(0).to_pylist()
            for a, b in blocks(at):
                ids, place = encoder.encode(data, at[a : b + 1])
                for k in range(a, b):
                    own = np.append(ids[place[k - a] : place[k - a + 1]], np.uint32(end_id))
                    packer.add(doc_ids[k], 0, own, len(own))
                yield _rows(packer.done, wide)
                packer.done = []
                for window in packer.open:  # so that no block's ids stay in memory for a small piece of them
                    window[1] = [(d, s, x.copy(), t) for d, s, x, t in window[1]]
        packer.close()
        yield _rows(packer.done, wide, task // merge_tasks)
        del encoder, packer
        trim()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        group = None
        for batch in batches:
            is_left = np.asarray(batch.column(7).is_valid())
            yield batch.filter(pa.array(~is_left)).select(range(7))
            for r in batch.filter(pa.array(is_left)).to_pylist():
                if r["group"] != group:
                    if packer:
                        packer.close()
                        yield _rows(packer.done, plain)
                    group, packer = r["group"], Packer(length, 1, (1 << 62) | (r["group"] << 36))
                packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        if packer:
            packer.close()
            yield _rows(packer.done, plain)

    pieces = docs.select("doc_id", "text").mapInArrow(local, ", ".join(f"`{n}` {t}" for n, t in [*PIECE, ("group", "long"), ("ids", "binary")]))
    dealt = pieces.withColumn("key", F.coalesce("group", -1 - F.abs(F.xxhash64("doc_id", "start")) % (1 << 40)))
    merged = dealt.repartition("key").sortWithinPartitions("key", "sequence_id", "offset").drop("key")
    return merged.mapInArrow(merge, ", ".join(f"`{n}` {t}" for n, t in PIECE))
