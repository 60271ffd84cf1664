"""Texts as arrays of lower-case letters, for models of characters."""

from __future__ import annotations

import functools
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb

STEP = np.uint64(0x9E3779B97F4A7C15)


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; an id that is null counts as the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


@functools.cache
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


ENDS = np.zeros(128, bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, the first position of each text (one more at the end), and at each position the
    sentence, counted over the whole column.

    Every run of other characters is one 0, and each text begins and ends with one, so that a
    word stands between zeros. Sentences end at . ! ? or a line end."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    codes = np.frombuffer("".join(f"\0{t}\0" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    codes = np.where(letter_table()[codes], codes, np.where((codes < 128) & ENDS[np.minimum(codes, 127)], np.uint32(1), np.uint32(0)))
    ends = codes == 1
    ends[first[:-1]] = True
    codes[ends] = 0
    sentence = np.cumsum(ends) - 1
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    keep[first[:-1]] = True
    # The last zero of a text stays only where a letter stands before it, the first always does.
    moved = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], moved[first], sentence[keep]


def gram_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` codes from each position on; the length takes part."""
    size = max(0, len(codes) - n + 1)
    h = np.full(size, n, np.uint64)
    for j in range(n):
        h = (h ^ codes[j : j + size]) * STEP
        h ^= h >> np.uint64(32)
    return h


def spelled(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each word, which of the distinct words it is, and the distinct words one
    after another, each between zeros.

    What a model says of a word follows from its letters, so it is worked out once for each
    distinct word of a chunk."""
    mark = codes != 0
    edge = np.flatnonzero(mark[1:] != mark[:-1]) + 1  # arrays begin and end with a zero
    start, end = edge[::2], edge[1::2]
    h = tb.xxh64(codes.view(np.uint8), 4 * start, 4 * (end - start))
    _, at, of = np.unique(h, return_index=True, return_inverse=True)
    size = end[at] - start[at] + 2
    first = np.cumsum(size) - size
    own = codes[np.repeat(start[at] - 1 - first, size) + np.arange(int(size.sum()))]
    return start, of, own


def word_grams(own: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of ``n`` codes within one word and its zeros: their positions and hashes."""
    size = max(0, len(own) - n + 1)
    inner = np.ones(size, bool)
    for j in range(1, n - 1):
        inner &= own[j : j + size] != 0
    if n == 2:
        inner &= (own[:-1] != 0) | (own[1:] != 0)
    at = np.flatnonzero(inner)
    return at, gram_hash(own, n)[at]


def word_of(own: np.ndarray) -> np.ndarray:
    """For each code of the distinct words which word it belongs to."""
    opens = np.zeros(len(own), bool)
    opens[0:1] = True
    opens[1:] = (own[1:] == 0) & (own[:-1] == 0)
    return np.cumsum(opens) - 1


class SortedTable:
    """Sorted hashes with an index of their leading bits: places of many hashes at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        bounds = np.arange((1 << self.bits) + 1, dtype=np.float64) * 2.0 ** (64 - self.bits)
        self.start = np.searchsorted(keys, bounds[:-1].astype(np.uint64)).astype(np.int32)
        self.start = np.append(self.start, len(keys)).astype(np.int32)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash among the keys, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1, np.int64)
        head = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[head].astype(np.int64), self.start[head + 1]
        out = np.full(len(h), -1, np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            here = at[open_]
            same = self.keys[here] == h[open_]
            out[open_[same]] = here[same]
            at[open_] += 1
            open_ = open_[~same & (here + 1 < stop[open_])]
        return out
