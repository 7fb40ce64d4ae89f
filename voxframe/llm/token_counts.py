"""Token counts by a tokenizer that is compiled into a deterministic finite-state transducer.

The transducer reads the bytes of a piece; the last byte of a piece is a symbol of its own, as word ends take part in the
merges. A state is what the count of any continuation depends on: the unfinished tokens that end here, each with the
token before it and how many tokens that prefix has more than the whole. That is finite, as a token sequence is the
tokenizer's own exactly if each pair of neighbours is. Every transition is annotated with the number of tokens it emits
(it may be negative: a longer token can replace two). Transitions are compiled when a text first takes them.

A block of texts is cut into chunks that are read in lockstep. A chunk's state map is constant behind the first place
where a piece begins, so that part is read at once in all chunks; the bytes before it are read from the state in which
the chunk before it ends. Maps compose in that way along the chunks, by a scan over them.

Edge cases: a null or empty text has 0 bytes and 0 tokens; repeated rows are each counted; texts of any length are read
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._classes import SPACE, classes, word_cuts
from ._np import LARGE_BLOCK, blocks, char_starts, out_batch, text_column
from ._shared import small_batches

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Transitions are dropped and compiled anew beyond so many states, so that their table stays small.
MOST_STATES = 180_000
CHUNK_BYTES = 512


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    START = 0

    def __init__(self, path: str):
        model = json.load(open(path, encoding="utf-8"))
        self.special = [x["content"] for x in model["added_tokens"]]
        suffix, letters = model["model"]["end_of_word_suffix"], byte_letters()
        vocabulary = model["model"]["vocab"]
        self.rank = {}
        for k, (a, b) in enumerate(model["model"]["merges"]):
            self.rank[vocabulary[a], vocabulary[b]] = (k, vocabulary[a + b])
        self.spelled: dict[int, tuple[int, ...]] = {}  # the symbols of each token
        self.symbol: dict[int, int] = {}  # the token of each single symbol
        special = set(self.special)
        for token, k in vocabulary.items():
            if token in special:
                continue
            ends = token.endswith(suffix) and token != suffix
            spelled = [letters[c] for c in (token[: -len(suffix)] if ends else token)]
            if ends:
                spelled[-1] += 256
            self.spelled[k] = tuple(spelled)
            if len(spelled) == 1:
                self.symbol[spelled[0]] = k
        self.children: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for k, spelled in self.spelled.items():
            if self._merged(spelled) != [k]:
                continue  # never a result of the merges
            node = 0
            for s in spelled:
                if s not in self.children[node]:
                    self.children[node][s] = len(self.children)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][s]
            self.token[node] = k
        self.fits: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.column = np.full(512, -1, np.int32)
        self.columns = 0
        self.items = [((0, -1, 0),)]
        self.states = {self.items[0]: self.START}
        self.to = np.full((1024, 64), -1, np.int32)
        self.emits = np.zeros((1024, 64), np.int8)

    def _merged(self, spelled: tuple[int, ...]) -> list[int]:
        """The tokens of a spelling by merges in the order of their ranks."""
        tokens = [self.symbol[s] for s in spelled]
        while len(tokens) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(tokens, tokens[1:])) if p in self.rank), default=None)
            if best is None:
                break
            a, b = tokens[best[1]], tokens[best[1] + 1]
            new, out, k = self.rank[a, b][1], [], 0
            while k < len(tokens):
                if k + 1 < len(tokens) and (tokens[k], tokens[k + 1]) == (a, b):
                    out.append(new)
                    k += 2
                else:
                    out.append(tokens[k])
                    k += 1
            tokens = out
        return tokens

    def _fit(self, left: int, right: int) -> bool:
        if left < 0:
            return True
        got = self.fits.get((left, right))
        if got is None:
            got = self.fits[left, right] = self._merged(self.spelled[left] + self.spelled[right]) == [left, right]
        return got

    def compile(self, state: int, symbol: int) -> None:
        """Adds the transition from a state by a symbol."""
        column = self.column[symbol]
        if column < 0:
            column = self.column[symbol] = self.columns
            self.columns += 1
            if self.columns > self.to.shape[1]:
                self.to = np.concatenate([self.to, np.full_like(self.to, -1)], axis=1)
                self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)], axis=1)
        last, emitted, open_items = -1, 1, []
        for node, left, more in self.items[state]:
            child = self.children[node].get(symbol)
            if child is None:
                continue
            token = self.token[child]
            if token >= 0 and last < 0 and self._fit(left, token):
                last, emitted = token, more + 1
            if self.children[child]:
                open_items.append((child, left, more))
        if symbol >= 256:
            target = self.START
        else:
            items = tuple(sorted([(0, last, 0), *((c, t, more - emitted) for c, t, more in open_items)]))
            target = self.states.get(items)
            if target is None:
                target = self.states[items] = len(self.items)
                self.items.append(items)
                if target >= len(self.to):
                    self.to = np.concatenate([self.to, np.full_like(self.to, -1)])
                    self.emits = np.concatenate([self.emits, np.zeros_like(self.emits)])
        self.to[state, column], self.emits[state, column] = target, emitted

    def _read(self, stream: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray, emitted: np.ndarray) -> np.ndarray:
        """Reads all spans [begin, end) of the stream in lockstep, each from its state; returns their last states."""
        state = state.copy()
        order = np.argsort(begin - end, kind="stable")  # the longest first
        begin, length = begin[order], (end - begin)[order]
        alive = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")
        now = state[order]
        for step, n in enumerate(alive):
            at = begin[:n] + step
            symbol, q = stream[at], now[:n]
            column = self.column[symbol]
            to = self.to[q, column]
            missing = (to < 0) | (column < 0)
            if missing.any():
                for s, x in set(zip(q[missing].tolist(), symbol[missing].tolist())):
                    self.compile(s, x)
                column = self.column[symbol]
                to = self.to[q, column]
            emitted[at] = self.emits[q, column]
            now[:n] = to
        state[order] = now
        return state

    def emissions(self, stream: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens emitted at each symbol; ``first``: True where a piece begins."""
        n, emitted = len(stream), np.zeros(len(stream), np.int8)
        if not n:
            return emitted
        if len(self.items) > MOST_STATES:
            self.reset()
        cut = np.arange(0, n, CHUNK_BYTES)
        end = np.append(cut[1:], n)
        begins = np.append(np.flatnonzero(first), n)
        sync = np.minimum(begins[np.searchsorted(begins, cut)], end)  # behind it a chunk's map is constant
        leaves = self._read(stream, sync, end, np.zeros(len(cut), np.int32), emitted)
        todo = np.flatnonzero(sync > cut)  # parts that depend on the chunk before
        known = sync < end
        while len(todo):
            ready = known[todo - 1]
            now, todo = todo[ready], todo[~ready]
            left = self._read(stream, cut[now], sync[now], leaves[now - 1], emitted)
            through = sync[now] == end[now]
            leaves[now[through]] = left[through]
            known[now] = True
        return emitted


def _normal(text: str) -> str:
    """NFC, then each letter in lower case by itself."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def count_block(machine: Transducer, texts: list[str]) -> np.ndarray:
    """Tokens of each text."""
    extra = np.zeros(len(texts), np.int64)
    plain = []
    for k, text in enumerate(texts):
        if "<|" in text:
            for token in machine.special:
                extra[k] += text.count(token)
                text = text.replace(token, "\n")
        plain.append(_normal(text))
    joined = "\n".join(plain)
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = classes()[cp]
    ends = np.minimum(np.cumsum(sizes), len(cp))
    row = np.repeat(np.arange(len(plain)), np.diff(np.append(0, ends)))
    start = word_cuts(cp, row, kind)
    data = np.frombuffer(joined.encode(), np.uint8)
    if len(data) != len(cp):
        lead = char_starts(data)
        char = np.cumsum(lead) - 1
        start, kind, ends = start[char] & lead, kind[char], np.append(np.flatnonzero(lead), len(data))[ends]
    keep = kind != SPACE
    first = start[keep]
    stream = data[keep].astype(np.int16)
    stream[np.append(first[1:], True)[: len(stream)]] += 256
    total = np.append(0, np.cumsum(machine.emissions(stream, first), dtype=np.int64))
    place = np.append(0, np.cumsum(keep))[ends]
    return np.diff(np.append(0, total[place])) + extra


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text). No shuffle: one pass over the table.

    The tokenizer file must be readable at that path on every executor.
    """

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            machine = machine or Transducer(tokenizer_path)
            _, at = text_column(batch)
            n_tokens = np.zeros(len(at) - 1, np.int64)
            column = batch.column(1)
            for a, b in blocks(at, LARGE_BLOCK):
                n_tokens[a:b] = count_block(machine, [t or "" for t in column.slice(a, b - a).to_pylist()])
            yield out_batch(
                schema, {"doc_id": batch.column(0), "n_bytes": np.diff(at), "n_tokens": n_tokens, "over_limit": n_tokens > limit}
            )

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
