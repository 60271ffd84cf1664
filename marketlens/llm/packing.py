"""Packing tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import base64
import functools
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.session import broadcast_if_small, stored

SEQUENCE = 1024
END_ID = 0
GAP = 0.001  # the linear program stops when this near to its bound
MAX_COLUMNS = 3000
COLUMNS_PER_PRICING = 24

@functools.cache
def encoding(path: str, added: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary of ranks at ``path``; its ids are those of the same vocabulary
    in other libraries. ``added`` are strings with an id of their own."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))


def added_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """The added tokens of the JSON of the same name beside the ranks, none if there is no JSON."""
    beside = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(beside):
        return ()
    with open(beside, encoding="utf-8") as f:
        return tuple((t["content"], t["id"]) for t in json.load(f)["added_tokens"])


def text_ids(path: str, text: str, added: tuple[tuple[str, int], ...] = ()) -> bytes:
    """The ids of a text, little-endian 32-bit; but for those ``added``, strings of special tokens
    are ordinary text."""
    return encoding(path, added).encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4").tobytes()


# ---------------------------------------------------------------------------------------------
# The linear program


def knapsack(value: np.ndarray, sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack by dynamic programming: for each room the most value, and the size
    taken last (-1: none, the room is that of one less)."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(room + 1), "right")
    for space in range(int(sizes[0]), room + 1):
        fits = fitting[space]
        gain = best[space - sizes[:fits]] + value[:fits]
        j = int(np.argmax(gain))
        best[space], took[space] = (gain[j], j) if gain[j] > best[space - 1] else (best[space - 1], -1)
    return best, took


def taken(took: np.ndarray, sizes: np.ndarray, space: int) -> np.ndarray:
    pattern = np.zeros(len(sizes), np.int64)
    while space > 0:
        if took[space] < 0:
            space -= 1
        else:
            pattern[took[space]] += 1
            space -= int(sizes[took[space]])
    return pattern


def greedy(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A first basis: the largest size left with the fullest filling, until a size runs out.

    Column i is the pattern that used up size i, and holds no size used up before it, so the
    columns form a triangle; their inverse follows row by row."""
    left = demand.astype(np.float64)
    columns, use, order = np.diag(room // sizes), np.zeros(len(sizes)), []
    while (some := np.flatnonzero(left > 1e-9)).size:
        here = sizes[some]
        _, took = knapsack(here * (1 + here / (8 * room)), here, room - int(here[-1]))
        pattern = np.zeros(len(sizes), np.int64)
        pattern[some] = taken(took, here, room - int(here[-1]))
        pattern[some[-1]] += 1
        held = np.flatnonzero(pattern)
        out = held[np.argmin(left[held] / pattern[held])]
        times = left[out] / pattern[out]
        left -= times * pattern
        left[out] = 0
        columns[out], use[out] = pattern, times
        order.append(out)
    order += sorted(set(range(len(sizes))) - set(order))  # used up together with another
    inverse = np.zeros((len(sizes), len(sizes)))
    for i in order:
        inverse[i, i] = 1
        for j in np.flatnonzero(columns[:, i]):
            if j != i:
                inverse[i] -= columns[j, i] * inverse[j]
        inverse[i] /= columns[i, i]
    return columns, use, inverse


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP, most: int = MAX_COLUMNS):
    """Patterns (rows: pieces of each size) and how often to use each, in whole numbers.

    Revised simplex over patterns: the basis starts with a greedy filling and the knapsack
    prices columns, of which those that still pay enter one after another. It stops within
    ``gap`` of the bound that the prices prove, or after ``most`` columns. Counts are rounded
    down within the demand; what is left over is the caller's."""
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), np.int64), np.zeros(0, np.int64)
    columns, use, inverse = greedy(sizes, demand, room)
    price, entered = inverse.sum(axis=0), 0
    while entered < most:
        best, took = knapsack(price, sizes, room)
        if best[room] <= 1 + 1e-9 or use.sum() <= (price * demand).sum() / best[room] * (1 + gap):
            break
        with_each = price + best[room - sizes]
        for i in np.argsort(-with_each)[:COLUMNS_PER_PRICING]:
            pattern = taken(took, sizes, room - int(sizes[i]))
            pattern[i] += 1
            held = np.flatnonzero(pattern)
            worth = (price[held] * pattern[held]).sum()
            if worth <= 1 + 1e-9:
                continue
            move = (inverse[:, held] * pattern[held]).sum(axis=1)
            up = move > 1e-9
            ratio = np.divide(use, move, out=np.full(m, np.inf), where=up)
            out = int(np.argmin(ratio))
            use -= ratio[out] * move
            use[out] = ratio[out]
            np.maximum(use, 0, out=use)
            row = inverse[out] / move[out]
            price += row * (1 - worth)
            others = np.flatnonzero(np.abs(move) > 1e-12)
            inverse[others] -= move[others, None] * row
            inverse[out] = row
            columns[out] = pattern
            entered += 1
        price = inverse.sum(axis=0)
    times = np.floor(use + 1e-6).astype(np.int64)
    for j in np.flatnonzero(times @ columns > demand):  # rounding noise must not use a piece twice
        while times @ columns[:, j] > demand[j]:
            times[np.argmax(np.where(times > 0, columns[:, j], 0))] -= 1
    return columns[times > 0], times[times > 0]


def plan(sizes: np.ndarray, demand: np.ndarray, room: int, most_padding: int = 0):
    """Where the pieces of each size go: rows (size, from rank, to rank, pieces of the size in
    the pattern, first sequence, first offset), the number of sequences, and how many pieces of
    each size were placed. Patterns that leave more than ``most_padding`` unused are not used."""
    patterns, times = cutting_stock(sizes, demand, room)
    placed = np.zeros(len(sizes), np.int64)
    rows, sequence = [], 0
    for pattern, count in zip(patterns, times):
        if room - int(pattern @ sizes) > most_padding:
            continue
        offset = 0
        for i in np.flatnonzero(pattern):
            each = int(pattern[i])
            rows.append((int(sizes[i]), int(placed[i]), int(placed[i] + each * count), each, sequence, offset))
            placed[i] += each * count
            offset += each * int(sizes[i])
        sequence += int(count)
    return rows, sequence, placed


# ---------------------------------------------------------------------------------------------
# The documents

PIECES = "part long, doc_id long, doc_tokens long, full long, before long, rest long, rank long, crcs array<long>, rest_ids binary"


def _tokenise(batches, path: str, room: int, added: tuple[tuple[str, int], ...]):
    """One row per document: its full sequences with their checksums, and the rest's ids.

    ``before`` numbers the full sequences and ``rank`` the rests of a length, within the task."""
    from pyspark import TaskContext

    part, before, ranks = TaskContext.get().partitionId(), 0, np.zeros(room, np.int64)
    tail = np.array([END_ID], "<u4").tobytes()
    wide = 4 * room
    for batch in tb.chunks(batches):
        out = {name.split()[0]: [] for name in PIECES.split(", ")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            ids = text_ids(path, text or "", added) + tail
            full = len(ids) // wide
            rest = (len(ids) - full * wide) // 4
            crcs = [zlib.crc32(ids[i * wide : (i + 1) * wide]) for i in range(full)]
            if rest:
                crcs.append(zlib.crc32(ids[full * wide :]))
            row = (part, doc_id, len(ids) // 4, full, before, rest, int(ranks[rest]), crcs, ids[full * wide :])
            before += full
            ranks[rest] += rest > 0
            for column, x in zip(out.values(), row):
                column.append(x)
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[n], t) for n, t in zip(out, [*[pa.int64()] * 7, pa.list_(pa.int64()), pa.binary()])], names=list(out))


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", room: int = SEQUENCE, most_padding: int = 0,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``: one row per piece.

    ``tokenizer`` is the path of a byte-level vocabulary of ranks; the added tokens of the JSON
    beside it are found inside texts, as its own library finds them. A document is its ids and an
    end id; a null text is empty, so every row has at least one id. Full sequences are cut off
    each document; the lengths of the rests form a histogram of fewer than ``room`` rows, over
    which patterns are generated. Rests are ranked within their length and the ranks dealt out to
    the rounded patterns; this takes counts per task and length, not a sorted group. Rests that
    no pattern without padding takes are laid end to end and cut at the ends of sequences, the
    last, partly filled one into powers of two, which need no padding. Rows without ``doc_id``
    are packed like others. Ids are stored for rests only, as some of them are cut later."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    added = added_tokens(tokenizer)
    rows = stored(body.mapInArrow(lambda batches: _tokenise(batches, tokenizer, room, added), PIECES), "pieces")

    # Numbers given within a task become numbers over all tasks by the counts of earlier tasks.
    per_task = rows.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full"))
    counts = stored(per_task, "counts")
    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("rank0", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    by_task = ranked.groupBy("part").agg(F.sum("full").alias("full"), F.map_from_entries(F.collect_list(F.struct("rest", "rank0"))).alias("rank0"))
    tasks = by_task.withColumn("before0", F.coalesce(F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("full")
    histogram = counts.groupBy("rest").agg(F.sum("n").alias("n"), F.sum("full").alias("full")).orderBy("rest").collect()  # at most `room` rows
    full_total = sum(r["full"] for r in histogram)
    sizes = np.array([r["rest"] for r in histogram if r["rest"]], np.int64)
    demand = np.array([r["n"] for r in histogram if r["rest"]], np.int64)
    places, patterned, placed = plan(sizes, demand, room, most_padding)

    numbered = rows.join(broadcast_if_small(stored(tasks, "tasks")), "part")
    numbered = numbered.withColumn("rank", F.col("rank") + F.element_at("rank0", F.col("rest"))).withColumn("before", F.col("before") + F.col("before0"))
    left = demand - placed
    ahead = np.concatenate([[0], np.cumsum(left * sizes)]).astype(np.int64)
    layout = _Layout(np.array(places, np.int64).reshape(-1, 6), sizes, placed, ahead, patterned, patterned + full_total, room)
    return numbered.select("doc_id", "doc_tokens", "full", "before", "rest", "rank", "crcs", "rest_ids").mapInArrow(
        layout.pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


class _Layout:
    """The place of every piece, from its document's numbers alone.

    Sequence ids: patterns first, then full sequences, then the rests laid end to end. Held in a
    task: a few rows for each length of the histogram."""

    def __init__(self, places, sizes, placed, ahead, patterned, cut_from, room):
        self.room, self.patterned, self.cut_from = room, patterned, cut_from
        self.placed = dict(zip(sizes.tolist(), zip(placed.tolist(), ahead.tolist())))
        self.total = int(ahead[-1])
        self.places = {int(s): places[places[:, 0] == s] for s in np.unique(places[:, 0])}

    def pieces(self, batches):
        for batch in batches:
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            out = []
            for doc_id, tokens, full, before, rest, rank, crcs, ids in zip(*(c.to_pylist() for c in batch.columns)):
                for i in range(full):
                    out.append((doc_id, i * self.room, self.room, crcs[i], tokens, self.patterned + before + i, 0))
                start = full * self.room
                if not rest:
                    continue
                covered, ahead = self.placed[rest]
                if rank < covered:
                    rows = self.places[rest]
                    _, low, _, each, sequence, offset = (int(x) for x in rows[np.searchsorted(rows[:, 1], rank, "right") - 1])
                    out.append((doc_id, start, rest, crcs[-1], tokens, sequence + (rank - low) // each, offset + (rank - low) % each * rest))
                else:
                    at = ahead + (rank - covered) * rest
                    for a, b, sequence, offset in self._cut(at, at + rest):
                        part = ids[4 * (a - at) : 4 * (b - at)]
                        out.append((doc_id, start + a - at, b - a, zlib.crc32(part), tokens, sequence, offset))
            for lo in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out[lo : lo + 50_000])], names=names)

    def _cut(self, begin: int, end: int):
        """The stretch of the end-to-end line cut at sequence ends: (from, to, sequence, offset)."""
        whole = self.total // self.room
        last = whole * self.room
        while begin < end:
            if begin < last:
                sequence, edge = begin // self.room, (begin // self.room + 1) * self.room
                first = sequence * self.room
            else:  # the remainder's binary digits, from the highest
                sequence, first, left = whole, last, self.total - last
                edge = first + (1 << left.bit_length() - 1)
                while begin >= edge:
                    left -= edge - first
                    sequence, first = sequence + 1, edge
                    edge = first + (1 << left.bit_length() - 1)
            stop = min(end, edge)
            yield begin, stop, self.cut_from + sequence, begin - first
            begin = stop
