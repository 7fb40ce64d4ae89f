"""NumPy helpers shared by the text operators: everything here runs inside Spark tasks on Arrow batches.

Texts arrive as Arrow string columns. Work is done on the raw UTF-8 buffer of a block of rows at a time, so memory is
bounded by ``BLOCK_BYTES`` (or by the one text that is longer than that).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
#: For passes that take less memory for each byte and gain from seeing more words at once.
LARGE_BLOCK = 4 << 20
#: For passes that take some hundred bytes for each byte of text.
SMALL_BLOCK = 1 << 19

#: Chunks of spans that are hashed at once.
MOST_CHUNKS = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)


def trim() -> None:
    """Hands what a task has freed back to the system: a Python worker outlives its tasks, and others share the machine."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads each 64-bit value over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte, it and the seven behind it as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each span [start, stop) of bytes: equal spans have equal hashes, wherever they stand.

    Each eight bytes of a span are mixed with their number in it before they are added up, so neither an exchange nor a
    pattern of parts leaves the sum as it is. Hashes of other ``salt`` are independent.
    """
    size = stops - starts
    count = np.maximum((size + 7) >> 3, 1)
    total = np.append(0, np.cumsum(count))
    out = np.empty(len(starts), np.uint64)
    source = eights(data)
    begin = 0
    while begin < len(starts):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + MOST_CHUNKS, side="right")) - 1)
        own = count[begin:end]
        number = within(own)
        left = np.repeat(size[begin:end], own) - 8 * number
        chunk = source[np.repeat(starts[begin:end], own) + 8 * number]
        short = np.flatnonzero(left < 8)
        chunk[short] &= (np.uint64(1) << (8 * np.maximum(left[short], 0)).astype(np.uint64)) - np.uint64(1)
        chunk ^= mix(np.arange(int(own.max()), dtype=np.uint64) * _STEP + np.uint64(salt))[number]
        out[begin:end] = np.add.reduceat(mix(chunk), total[begin:end] - total[begin])
        begin = end
    return mix(out + mix(size.astype(np.uint64) * _STEP + np.uint64(salt)))


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null counts as an empty text."""
    column = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, stop
        row = stop


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space, never across rows: start byte, stop byte, and the row offsets in words."""
    word = ~_SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    rows = offsets[(offsets > 0) & (offsets < len(data))]
    start = word & ~before[:-1]
    start[rows] = word[rows]
    stop = before[1:] & ~np.append(word[1:], False)
    stop[rows - 1] = word[rows - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` consecutive words of one row, and the word at which it starts.

    Windows of 1, 2, 4, ... words are mixed from two halves; the last step joins two of them that cover the window.
    """
    count = np.maximum(np.diff(at) - size + 1, 0)
    first = np.repeat(at[:-1], count) + within(count)
    half, width = mix(words + np.uint64(salt)), 1
    while 2 * width <= size:
        half = mix(half[: max(len(half) - width, 0)] * _NEXT + half[width:])
        width *= 2
    return mix(half[first] * _NEXT + half[first + size - width] + np.uint64(size)), first


def within(count: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)


def char_starts(data: np.ndarray) -> np.ndarray:
    """True at each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def out_batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
