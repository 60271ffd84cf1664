"""Arrow texts as byte arrays: words, exact XXH64 of slices, bounded chunks.

Tasks see texts as one UTF-8 buffer with offsets, so a word is a pair of positions and work on
millions of words is a handful of array operations. Delimiters are ASCII in every word rule
used here, and no byte of a longer UTF-8 sequence is below 0x80, so splitting bytes splits
code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


CHUNK_BYTES = 2 << 20  # text handled at once in a task; a longer single text forms its own chunk
LETTER_BYTES = CHUNK_BYTES // 4  # the same where every letter becomes some numbers of eight bytes

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

NOT_SPACE = np.ones(256, bool)  # [^\x20\x09-\x0D]
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

ALNUM = np.zeros(256, bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F] of lower-cased text
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; null counts as the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def released() -> None:
    """Give freed memory back to the machine: a worker waits for its next task with all it ever held
    otherwise, beside the workers and the executor that are at work. Does nothing without glibc."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each piece has at most ``limit`` bytes of text, or one row. Memory is
    :func:`released` after each batch."""
    for batch in batches:
        _, at = texts(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
        del batch, at
        released()


def with_columns(
    docs: DataFrame, text: str, made: str, run: Callable[[pa.Array], list[pa.Array]], keep_text: bool = True, limit: int = CHUNK_BYTES,
) -> DataFrame:
    """The frame with columns (``made``, as DDL) that ``run`` works out from its text, chunk by
    chunk; columns of these names are replaced. Every column passes through the task once."""
    more = T.StructType.fromDDL(made).fields
    names = [f.name for f in more]
    kept = [c for c in docs.columns if c not in names]
    at = kept.index(text)
    body = docs.select(*(F.col(f"`{c}`").cast("string" if i == at else docs.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(kept)))
    left = [i for i in range(len(kept)) if keep_text or i != at]
    schema = T.StructType([*(body.schema.fields[i] for i in left), *(T.StructField(f"m{i}", f.dataType) for i, f in enumerate(more))])

    def each(batches):
        for batch in chunks(batches, f"c{at}", limit):
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), *run(batch.column(at))], names=schema.names)

    return body.mapInArrow(each, schema).toDF(*(kept[i] for i in left), *names)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of the first word of each text (one more at
    the end). ``inside`` tells which bytes belong to words; words end where their text ends."""
    mark = inside[data]
    if not len(mark):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    begins, ends = mark.copy(), mark.copy()
    begins[1:] &= ~mark[:-1]
    ends[:-1] &= ~mark[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begins[first], ends[last] = mark[first], mark[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, offsets)


def single_spaced(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """The words of each text joined by one space: bytes, then starts, ends and first words."""
    start, end, first = word_spans(data, offsets, inside)
    keep = inside[data]
    after = end[end < len(data)]
    after = after[~keep[after]]
    keep[after] = True
    moved = np.cumsum(keep)
    out = np.where(inside[data], data, np.uint8(32))[keep]
    return out, moved[start] - 1 if len(start) else start, moved[end - 1] if len(end) else end, first


P1, P2, P3, P4, P5 = (np.uint64(x) for x in (
    11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each slice, computed for all slices of one length together."""
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    data = np.concatenate([data, np.zeros(32, np.uint8)])
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, 0, (1,))
    short = np.minimum(length, 65535).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    cuts = np.flatnonzero(np.diff(short[order])) + 1
    with np.errstate(over="ignore"):
        for rows in np.split(order, cuts):
            n = int(length[rows[0]])
            if n > 256 or len(rows) < 4:
                out[rows] = [xxhash.xxh64_intdigest(data[s : s + k].tobytes(), seed) for s, k in zip(start[rows], length[rows])]
            else:
                out[rows] = _xxh64_of(data, words, halves, start[rows], n, np.uint64(seed))
    return out


def _xxh64_of(data, words, halves, at, n, seed):
    end = at + n
    if n >= 32:
        acc = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        for _ in range(n // 32):
            for j in range(4):
                acc[j] = _mixed(acc[j], words[at + 8 * j])
            at = at + 32
        h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            h = (h ^ _mixed(np.uint64(0), a)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h = h + np.uint64(n)
    left = n % 32
    while left >= 8:
        h = _turn(h ^ _mixed(np.uint64(0), words[at]), 27) * P1 + P4
        at, left = at + 8, left - 8
    if left >= 4:
        h = _turn(h ^ (halves[at].astype(np.uint64) * P1), 23) * P2 + P3
        at, left = at + 4, left - 4
    while left:
        h = _turn(h ^ (data[at].astype(np.uint64) * P5), 11) * P1
        at, left = at + 1, left - 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return xxh64(data, start, end - start)


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at ``first[i]`` and end at ``first[i + 1]``; empty runs are 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(first[:-1] < first[1:])
    if len(full):
        out[full] = np.add.reduceat(values[: first[-1]], first[full], axis=0)
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each run of ``words`` words joined by spaces, and their number in each text; a
    text of fewer words is one run, one without words has none."""
    data, start, end, first = single_spaced(data, offsets, NOT_SPACE)
    n = np.diff(first)
    made = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    head = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    tail = head + np.repeat(np.minimum(n, words), made) - 1
    return xxh64(data, start[head], end[tail] - start[head], seed), made


ONES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray, made: np.ndarray) -> np.ndarray:
    """For each run of ``made[i]`` hashes how many have each of the 64 bits set.

    Bits are counted in eight byte lanes at once, over pieces too short for a lane to overflow."""
    pieces = -(-made // 255)
    piece_of = np.concatenate([[0], np.cumsum(pieces)])
    at = np.cumsum(made) - made
    begin = np.repeat(at - 255 * piece_of[:-1], pieces) + 255 * np.arange(piece_of[-1])
    out = np.zeros((len(made), 64), np.int64)
    for bit in range(8):
        lanes = (h >> np.uint64(bit)) & ONES
        part = np.add.reduceat(lanes, begin) if len(begin) else lanes
        out[:, bit::8] = sums_by(part.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), piece_of)
    return out
