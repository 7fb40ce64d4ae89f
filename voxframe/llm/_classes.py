"""Unicode classes of code points, and where the two pre-tokenizers cut a text."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: The code points with Unicode's White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that both pre-tokenizers cut off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kind = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(sys.maxunicode + 1)], np.uint8)
    out[kind == ord("L")] = LETTER
    out[kind == ord("N")] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


def cut_endings(cp: np.ndarray, at: np.ndarray, row: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
    """Makes each apostrophe of ``at`` one piece with the ending behind it, if one of ENDINGS follows in its row."""
    for ending in ENDINGS:
        n = len(ending)
        hit = at[at + n < len(cp)]
        hit = hit[row[hit] == row[hit + n]]
        for k, letter in enumerate(ending, 1):
            hit = hit[cp[hit + k] == ord(letter)]
        start[hit] = True
        start[hit + 1] = False
        behind = hit[hit + n + 1 < len(cp)] + n + 1
        behind = behind[(row[behind] == row[behind - 1]) & (kind[behind] == LETTER)]
        start[behind] = True


def byte_level_cuts(cp: np.ndarray, at: np.ndarray) -> np.ndarray:
    """True at each code point that begins a piece of the byte-level pre-tokenizer; ``at``: the rows' offsets.

    A run of letters, of numbers or of other signs is a piece and takes one blank before it along. Of white space before
    a run, the last one stands apart. At the end of a row, white space is one piece.
    """
    kind, n = classes()[cp], len(cp)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
    start = first.copy()
    run = np.flatnonzero(first)
    follow = run[1:]
    ends = follow[(kind[follow - 1] == SPACE) & (row[follow - 1] == row[follow])]  # a run that white space precedes
    start[ends - 1] = True
    start[ends] = cp[ends - 1] != 0x20
    quote = run[cp[run] == 0x27]
    blank = np.zeros(len(quote), bool)
    inner = quote > 0
    blank[inner] = (cp[quote[inner] - 1] == 0x20) & (row[quote[inner] - 1] == row[quote[inner]])
    cut_endings(cp, quote[~blank], row, kind, start)
    return start


def word_cuts(cp: np.ndarray, row: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """True at each code point that begins a piece of the word pre-tokenizer, where each number sign is a piece and
    white space is none."""
    first = np.ones(len(cp), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (row[1:] != row[:-1])
    start = (first | (kind == NUMBER)) & (kind != SPACE)
    cut_endings(cp, np.flatnonzero(first & (cp == 0x27)), row, kind, start)
    return start
