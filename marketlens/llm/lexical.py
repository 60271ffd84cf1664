"""Ranked lexical search: an automaton of all items' terms reads every text.

Terms stand between blanks in the automaton, and a text is scanned with a blank in place of every
character that belongs to no term, so only whole terms are found. Texts are read twice, once for
the statistics of the collection and once to score; no index of the documents is made.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import textbytes as tb

TOP = 10
BLOCK_BYTES = 32 << 20  # terms of items held by a task at once; more items are taken in blocks
SALTS = 64  # parts of an item whose best documents are found first
PAIRS = 1 << 21  # (term of a document, item) pairs scored at once

TO_BLANK = np.where(tb.ALNUM, np.arange(256), 0x20).astype(np.uint8)


def _item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``(item, term)``, each term of an item once; items with equal ids are one item."""
    rows = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("term", T.StringType())])

    def run(batches):
        for batch in tb.chunks(batches):
            data, offsets = tb.texts(batch.column("text"))
            data = tb.LOWER[data]
            start, end, first = tb.word_spans(data, offsets, tb.ALNUM)
            raw = data.tobytes()
            terms = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start, end)]
            home = np.repeat(np.arange(len(first) - 1), np.diff(first))
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(home)), pa.array(terms, pa.string())], names=["item", "term"])

    return rows.mapInArrow(run, schema).distinct()


class TermScan:
    """The terms of a block of items, the items that hold each, and the automaton over them.

    Only terms and items travel; each Python worker builds the automaton once."""

    def __init__(self, items: pa.Array, item: np.ndarray, term: pa.Array):
        words = term.dictionary_encode()
        self.items, self.terms = items, words.dictionary.to_pylist()
        at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((item, at))
        self.holder = item[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        self._automaton = None

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def automaton(self) -> ahocorasick.Automaton:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(self.terms):
                self._automaton.add_word(f" {term} ", i)
            self._automaton.make_automaton()
        return self._automaton

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of all terms of each text, then text, term and occurrences of what was found."""
        data, offsets = tb.texts(column)
        _, _, first = tb.word_spans(tb.LOWER[data], offsets, tb.ALNUM)
        found, sizes = [], np.zeros(len(column), np.int64)
        if self.terms:
            raw, read = TO_BLANK[tb.LOWER[data]].tobytes(), self.automaton().iter
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if a < b:
                    before = len(found)
                    found += [term for _, term in read(f" {raw[a:b].decode('utf-8', 'replace')} ")]
                    sizes[i] = len(found) - before
        n = max(1, len(self.terms))
        key, tf = np.unique(np.repeat(np.arange(len(column)), sizes) * n + np.array(found, np.int64), return_counts=True)
        return np.diff(first), key // n, key % n, tf


def _statistics(batches, scan: TermScan):
    """(term, n): documents that hold each term; under -1 documents with a term, under -2 terms."""
    df, docs, length = np.zeros(len(scan.terms), np.int64), 0, 0
    for batch in tb.chunks(batches):
        n, _, term, _ = scan.counts(batch.column("text"))
        df += np.bincount(term, minlength=len(df))
        docs, length = docs + int((n > 0).sum()), length + int(n.sum())
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])), pa.array(np.concatenate([[length, docs], df[held]]))], names=["term", "n"])


def _best(item: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, top: int):
    """The first ``top`` rows of each item by score, then by document, those without an id last."""
    order = np.lexsort((doc, null, -score, item))
    item = item[order]
    begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]])) if len(item) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(item)))
    rank = np.arange(len(item)) - np.repeat(begin, size)
    return order[rank < top]


def _scored(batches, scan: TermScan, weight: np.ndarray, docs: int, length: int, top: int):
    """A task's best documents of each item: ``top`` rows an item are held, whatever is read."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
    least = np.zeros(len(scan.items), np.int64)  # a lower score cannot be among an item's best
    each = np.diff(scan.first)
    for batch in tb.chunks(batches):
        n, text, term, tf = scan.counts(batch.column("text"))
        ids = batch.column("doc_id")
        null = ids.is_null().to_numpy(zero_copy_only=False)
        name = ids.fill_null(0).to_numpy()
        m = 10 + (90 * n * docs) // max(1, length)
        part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[text]))
        many = np.concatenate([[0], np.cumsum(each[term])])
        cuts = _text_cuts(text, many)
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            pairs = np.repeat(np.arange(lo, hi), each[term[lo:hi]])
            if not len(pairs):
                continue
            at = scan.first[term[pairs]] + np.arange(many[lo], many[hi]) - many[pairs]
            key = text[pairs] * len(scan.items) + scan.holder[at]
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            score = np.add.reduceat(part[pairs][order], new)
            doc, item = np.divmod(key[new], len(scan.items))
            keep = (score > 0) & (score >= least[item])
            more = [item[keep], name[doc[keep]], null[doc[keep]], score[keep]]
            held = [np.concatenate(x) for x in zip(held, more)]
            held = _cut(held, top)
            size = np.bincount(held[0], minlength=len(least))
            full = np.flatnonzero(size == top)
            low = np.full(len(least), np.iinfo(np.int64).max)
            np.minimum.at(low, held[0], held[3])
            least[full] = low[full]
    item, name, null, score = held
    yield pa.RecordBatch.from_arrays([scan.items.take(pa.array(item)), pa.array(name, mask=null), pa.array(score)], names=["item", "doc_id", "score"])


def _cut(held: list, top: int) -> list:
    keep = _best(*held, top)
    return [x[keep] for x in held]


def _text_cuts(text: np.ndarray, many: np.ndarray) -> list[int]:
    """Cuts between texts, so that about ``PAIRS`` pairs lie between two."""
    begin = np.concatenate([np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]])), [len(text)]]) if len(text) else np.zeros(1, np.int64)
    cuts = [0]
    for b in begin[1:].tolist():
        if b == len(text) or many[b] - many[cuts[-1]] >= PAIRS:
            cuts.append(b)
    return cuts


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item its ``top`` documents with a score above 0: ``item_id, rank, doc_id, score``.

    Terms are runs of letters and digits with A-Z in lower case. A document scores the sum, over the
    item's terms, of ``w * (10^9 tf div (1000 tf + 8 m))``, ``w`` being
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and ``m`` its length, 90 parts of a hundred relative
    to the mean; all in 64-bit integers. Equal scores go by ascending ``doc_id`` (an integer), rows
    without an id last.

    Every row of ``docs`` is a document, also repeated ones; null and empty texts have no term and
    do not count. Items with equal ids are one item, those without an id too; an item without a
    term that occurs gets no row. Empty tables give an empty result. Items are taken in blocks
    whose terms have at most ``block_bytes``, measured; a block's automaton is broadcast, and
    texts are read twice a block. A task keeps ``top`` rows an item, so that nothing grows with
    the documents; a second round over parts of each item's rows leaves few for the last."""
    spark = docs.sparkSession
    body = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    terms = _item_terms(items, item_id, item_text)
    kind = terms.schema["item"].dataType
    size = terms.agg(F.sum(F.octet_length("term") + 16).alias("b")).first()["b"] or 0
    blocks = 2 * size // block_bytes + 1
    out = T.StructType([T.StructField("item", kind), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], out)
    for block in range(blocks):
        mine = terms.filter(F.pmod(F.xxhash64(F.col("item").cast("string")), F.lit(blocks)) == block).orderBy("item", "term").toArrow()
        named = mine.column("item").combine_chunks().dictionary_encode("encode")
        held = named.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        scan = spark.sparkContext.broadcast(TermScan(named.dictionary, held, mine.column("term").combine_chunks()))
        counted = body.select("text").mapInArrow(lambda batches, s=scan: _statistics(batches, s.value), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        counted = {int(r["term"]): int(r["n"]) for r in counted.collect()}  # a row for each term of the block
        total, length = counted.get(-1, 0), counted.get(-2, 0)
        df = np.array([counted.get(i, 0) for i in range(len(scan.value.terms))], np.float64)
        weight = np.floor(1000 * np.log((2 * total + 2) / (2 * df + 1))).astype(np.int64)
        found = found.union(body.mapInArrow(lambda batches, s=scan, w=weight, t=total, n=length: _scored(batches, s.value, w, t, n, top), out))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    best = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
    return best.select(F.col("item").alias("item_id"), "rank", "doc_id", "score")
