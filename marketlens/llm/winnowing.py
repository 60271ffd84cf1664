"""Benchmark decontamination: winnowed fingerprints of items met in documents, hits extended."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb

WINDOW_WORDS = 10
INDEX_BYTES = 32 << 20  # item words held by a task at once; more items are taken in blocks
ANSWER = "n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>"
NAMES = ("n_words", "n_hit", "items", "spans")
STEP = np.uint64(0x9E3779B97F4A7C15)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (the last ``k - 1`` positions have none)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * STEP + words[j : j + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def winnow(words: np.ndarray, first: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some window of ``span`` words.

    Grams have half the span, so two texts that share ``span`` words share all grams of that
    window and with them its least one, ties included."""
    k = -(-span // 2)
    wide = span - k + 1
    g = grams(words, k)
    n = len(words) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = g[:n].copy()
    for j in range(1, wide):
        np.minimum(low, g[j : j + n], out=low)
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = text_of[:n] == text_of[span - 1 :]
    chosen = np.zeros(len(g), bool)
    for j in range(wide):
        chosen[j : j + n] |= whole & (g[j : j + n] == low)
    at = np.flatnonzero(chosen)
    return at, g[at]


class ItemIndex:
    """Fingerprints of a block of items, sorted, with the items' words for the extension."""

    def __init__(self, ids: list, words: np.ndarray, first: np.ndarray, window: int):
        self.ids, self.words, self.first = ids, words, first
        n = np.diff(first)
        self.levels = []
        for span in sorted({min(int(x), window) for x in n if x}):
            mine = np.flatnonzero((n >= window) if span == window else (n == span))
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in mine])
            part = np.concatenate([[0], np.cumsum(n[mine])])
            pos, h = winnow(words[at], part, span)
            order = np.argsort(h, kind="stable")
            self.levels.append((span, h[order], at[pos[order]]))
        self.item_of = np.repeat(np.arange(len(n)), n)

    def hits(self, words: np.ndarray, first: np.ndarray):
        """(begin, end, item) word spans of documents that items share, window by window."""
        text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for span, keys, places in self.levels:
            k = -(-span // 2)
            pos, h = winnow(words, first, span)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            met = np.flatnonzero(hi > lo)
            reach = 1 << 18
            heavy = np.concatenate([[0], np.cumsum(hi[met] - lo[met])])
            for cut in range(0, int(heavy[-1]), reach):  # many items may share a fingerprint
                pair = np.arange(cut, min(cut + reach, int(heavy[-1])))
                row = np.searchsorted(heavy, pair, "right") - 1
                p, q = pos[met[row]], places[lo[met[row]] + pair - heavy[row]]
                yield self._extended(words, first, text_of, p, q, k, span)

    def _extended(self, words, first, text_of, p, q, k, span):
        item, text = self.item_of[q], text_of[p]
        low_p, high_p, low_q, high_q = first[text], first[text + 1], self.first[item], self.first[item + 1]
        same = np.ones(len(p), bool)
        for j in range(k):
            same &= words[p + j] == self.words[q + j]
        left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
        for move, sign, start in ((left, -1, -1), (right, 1, k)):
            on = same.copy()
            for j in range(span - k):
                a, b = p + start + sign * j, q + start + sign * j
                on &= (a >= low_p) & (a < high_p) & (b >= low_q) & (b < high_q)
                on &= words[np.where(on, a, 0)] == self.words[np.where(on, b, 0)]
                move += on
        full = same & (left + k + right >= span)
        return (p - left)[full], (p + k + right)[full], item[full]


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = tb.texts(column)
    data = tb.LOWER[data]
    start, end, first = tb.word_spans(data, offsets, tb.ALNUM)
    return tb.word_hashes(data, start, end), first


def _item_blocks(items: DataFrame, item_id: str, text: str, bound: int):
    """Blocks of items whose texts have at most ``bound`` bytes (a longer text is a block)."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).distinct()
    size = F.octet_length("text").cast("long")
    total = rows.agg(F.sum(size).alias("b")).first()["b"] or 0
    blocks = 2 * total // bound + 1
    for b in range(blocks):
        yield rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).toArrow()


def contamination(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS, index_bytes: int = INDEX_BYTES, keep_text: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: its columns (the text only if asked for), ``n_words``, ``n_hit``, ``items`` (sorted
    ids as strings) and ``spans`` (array of begin, end in words, merged).

    Words are runs of letters and digits after lower-casing A-Z. Every run of ``window`` words of
    an item, or a shorter item whole, is found wherever it occurs in a document. Items without a
    word match nothing; equal items count once per id; an item without id marks words but is not
    named. A null text has no words. Documents are read once per block of items, and not
    shuffled unless there are several blocks; an index block is bounded by ``index_bytes``."""
    spark = docs.sparkSession
    parts = []
    for block in _item_blocks(items, item_id, item_text, index_bytes):
        words, first = _words(block.column("text").combine_chunks()) if len(block) else (np.zeros(0, np.uint64), np.zeros(1, np.int64))
        index = spark.sparkContext.broadcast(ItemIndex(block.column("item").to_pylist(), words, first, window))
        parts.append(index)
    scan = lambda frame, index: tb.with_columns(frame, text, ANSWER, lambda column: _found(column, index.value), keep_text)
    if len(parts) == 1:
        return scan(docs, parts[0])
    told = docs.withColumn("__told", F.md5(F.coalesce(F.col(text), F.lit(""))))  # tells rows apart beside their columns
    found = [scan(told, index) for index in parts]
    return _joined(found, [c for c in found[0].columns if c not in NAMES]).drop("__told")


def _found(column: pa.Array, index: ItemIndex) -> list[pa.Array]:
    words, first = _words(column)
    change = np.zeros(len(words) + 1, np.int32)
    texts, items = [], []
    for begin, end, item in index.hits(words, first):
        np.add.at(change, begin, 1)
        np.add.at(change, end, -1)
        pair = np.unique((np.searchsorted(first, begin, "right") - 1) * len(index.ids) + item)
        texts.append(pair // len(index.ids))
        items.append(pair % len(index.ids))
    rows = len(column)
    # A span that ends where its text ends must not run into the next one.
    hit = np.cumsum(change)[:-1] > 0
    text_of = np.repeat(np.arange(rows), np.diff(first))
    before = np.concatenate([[False], hit[:-1]]) if len(hit) else hit
    new_text = np.zeros(len(hit), bool)
    new_text[first[:-1][np.diff(first) > 0]] = True
    opens = np.flatnonzero(hit & (~before | new_text))
    closes = np.flatnonzero(hit & np.concatenate([~hit[1:] | new_text[1:], [True]])) + 1 if len(hit) else opens
    named = [[] for _ in range(rows)]
    if texts:
        pair = np.unique(np.concatenate(texts) * len(index.ids) + np.concatenate(items))
        for t, i in zip(pair // len(index.ids), pair % len(index.ids)):
            if index.ids[i] is not None:
                named[t].append(index.ids[i])
    home = text_of[opens]
    ranges = pa.StructArray.from_arrays([pa.array(opens - first[home]), pa.array(closes - first[home])], names=["begin", "end"])
    cuts = np.searchsorted(home, np.arange(rows + 1)).astype(np.int32)
    return [
        pa.array(np.diff(first).astype(np.int64)),
        pa.array(tb.sums_by(hit.astype(np.int64), first)),
        pa.array([sorted(set(x)) for x in named], pa.list_(pa.string())),
        pa.ListArray.from_arrays(pa.array(cuts), ranges),
    ]


def _joined(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The blocks' answers of each row as one: item ids united, spans merged.

    ``keys`` hold a digest of the text, so rows that share them have equal answers; their number
    is kept."""
    every = None
    for n, part in enumerate(parts):
        part = part.withColumn("__block", F.lit(n))
        every = part if every is None else every.union(part)
    per_block = every.groupBy(*keys, "n_words", "__block", "items", "spans").agg(F.count(F.lit(1)).alias("__copies"))
    grouped = per_block.groupBy(*keys, "n_words", "__copies").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("__all"),
    )
    merged = F.expr(
        "aggregate(__all, cast(array() as array<struct<begin:bigint,end:bigint>>), (done, s) -> "
        "CASE WHEN size(done) > 0 AND done[size(done) - 1].end >= s.begin THEN concat(slice(done, 1, size(done) - 1), "
        "array(named_struct('begin', done[size(done) - 1].begin, 'end', greatest(done[size(done) - 1].end, s.end)))) "
        "ELSE concat(done, array(s)) END)"
    )
    out = grouped.withColumn("spans", merged).withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)"))
    return out.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)"))).select(*keys, *NAMES)
