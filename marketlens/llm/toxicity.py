"""Toxicity by multiple-instance learning: sentences scored, combined by noisy-or."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import textbytes as tb
from marketlens.llm.letters import SortedTable, letters, spelled, word_grams, word_of
from marketlens.session import stored

GRAMS = (3, 4, 5, 6)  # characters, the ends of a word included
FEATURES = 20_000  # grams that the model may use
LEAST_DOCS = 3  # occurrences in documents labelled 1 that a gram must have
TRAIN_DOCS = 60_000  # labelled documents that a model is fitted to, at most (about)
ROUNDS = 500


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and number of each word, and the hashes of the distinct words' grams with the word
    they are of. A gram counts once in a word."""
    start, of, own = spelled(codes)
    word = word_of(own)
    found = [word_grams(own, n) for n in GRAMS]
    h, whose = np.concatenate([x[1] for x in found]), word[np.concatenate([x[0] for x in found])]
    return start, of, h, whose


def held_grams(codes: np.ndarray, sentence: np.ndarray, table: SortedTable) -> np.ndarray:
    """The distinct pairs of a sentence and a gram of the table in it, as one number."""
    start, of, h, whose = grams(codes)
    place = table.places(h)
    met = np.flatnonzero(place >= 0)
    met = met[np.argsort(whose[met], kind="stable")]
    words = int(of.max()) + 1 if len(of) else 0
    cut = np.searchsorted(whose[met], np.arange(words + 1))
    each = np.diff(cut)
    hit = np.flatnonzero(each[of] > 0) if words else np.zeros(0, np.int64)
    n = each[of[hit]] if words else hit
    ahead = np.cumsum(n) - n
    at = np.repeat(cut[of[hit]] - ahead, n) + np.arange(int(n.sum())) if len(hit) else hit
    return np.unique(np.repeat(sentence[start[hit]], n) * len(table.keys) + place[met[at]])


@dataclass
class ToxicityModel:
    """Weights of grams; a sentence's score is the logistic of the bias and the grams it holds."""

    table: SortedTable
    weights: np.ndarray
    bias: float

    def sentences(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score of each sentence, the first sentence of each text, the first position of each
        sentence among the letters. Sentences without letters have score 0."""
        codes, first, sentence = letters(column)
        total = int(sentence[-1]) + 1 if len(sentence) else 0
        begin = np.searchsorted(sentence, np.arange(total + 1))
        pair = held_grams(codes, sentence, self.table)
        score = np.bincount(pair // max(1, len(self.weights)), self.weights[pair % max(1, len(self.weights))] if len(pair) else None, minlength=total)
        has_letter = tb.sums_by((codes != 0).astype(np.int64), begin) > 0
        p = np.where(has_letter, 1 / (1 + np.exp(-np.clip(score + self.bias, -30, 30))), 0.0)
        text_first = np.append(sentence[first[:-1]], total) if len(first) > 1 else np.zeros(1, np.int64)
        return p, text_first, begin

    def score(self, column: pa.Array) -> np.ndarray:
        p, first, _ = self.sentences(column)
        return -np.expm1(tb.sums_by(np.log1p(-np.minimum(p, 1 - 1e-12)), first))


def _gram_counts(batches):
    """Per chunk: in how many documents of either label the words with a gram occur."""
    for batch in tb.chunks(batches, limit=tb.LETTER_BYTES):
        codes, first, _ = letters(batch.column("text"))
        start, of, h, whose = grams(codes)
        if not len(h):
            continue
        text = np.searchsorted(first, start, "right") - 1
        words = int(of.max()) + 1
        once = np.unique(text * words + of)
        label = batch.column("label").to_numpy()[once // words]
        docs = np.bincount(once % words, minlength=words)
        pos = np.bincount(once % words, label, words).astype(np.int64)
        keys, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, docs[whose], len(keys)).astype(np.int64)
        hits = np.bincount(at, pos[whose], len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(hits), pa.array(total - hits)], names=["gram", "pos", "neg"])


def _bags(batches, table: SortedTable):
    """Per document: its label, the number of sentences with letters, and the (sentence, gram)
    pairs of the model's grams."""
    for batch in tb.chunks(batches, limit=tb.LETTER_BYTES):
        codes, first, sentence = letters(batch.column("text"))
        pair = held_grams(codes, sentence, table)
        total = int(sentence[-1]) + 1
        begin = np.searchsorted(sentence, np.arange(total + 1))
        lettered = (tb.sums_by((codes != 0).astype(np.int64), begin) > 0).astype(np.int64)
        text_first = np.append(sentence[first[:-1]], total)
        cuts = np.searchsorted(pair // len(table.keys), text_first)
        pairs = [pair[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(tb.sums_by(lettered, text_first)), pa.array(pairs, pa.binary())], names=["label", "sentences", "pairs"])


def fit_noisy_or(label, sentences, rows, grams, bags, features: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps (Adam) on the documents' likelihood.

    ``rows`` and ``grams`` say which sentence holds which gram and ``bags`` whose sentence it is;
    a document's other sentences have the bias alone. Its probability is one less the product of
    its sentences' complements."""
    w, b = np.zeros(features), -4.0
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    own = np.bincount(bags, minlength=len(label)) if len(bags) else np.zeros(len(label), np.int64)
    plain = np.maximum(sentences - own, 0)
    n = max(1, len(label))
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[grams], len(bags)) + b if len(rows) else np.full(len(bags), b)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clear = np.bincount(bags, np.log1p(-np.minimum(p, 1 - 1e-12)), len(label)) + plain * np.log1p(-p0)
        clear = np.exp(np.minimum(clear, -1e-9))
        pull = np.where(label == 1, -clear / (1 - clear), 1.0)  # d loss / d z is p times this
        back = pull[bags] * p if len(bags) else np.zeros(0)
        grad = np.append(np.bincount(grams, back[rows], features) if len(rows) else np.zeros(features), back.sum() + (pull * plain * p0).sum()) / n
        grad[:-1] += 1e-6 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w -= move[:-1]
        b = float(np.clip(b - 0.5 * move[-1], -12, 4))
    return w, b


def train(labelled: DataFrame, text: str = "text", label: str = "label", features: int = FEATURES) -> ToxicityModel:
    """A model from whole documents and their labels (0, 1; others and null are left out).

    Used are the grams whose documents are labelled 1 more often than chance explains, the
    strongest first. Without any labelled document the model gives every sentence the same low
    score."""
    rows = labelled.select(F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.filter("label IN (0, 1) AND text IS NOT NULL")
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    pos, neg = sizes.get(1, 0), sizes.get(0, 0)
    counted = rows.mapInArrow(_gram_counts, "gram long, pos long, neg long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counted = counted.filter(F.col("pos") >= LEAST_DOCS)
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    lift = F.log(rate("pos", pos) / rate("neg", neg))
    chosen = counted.withColumn("weight", lift * F.sqrt("pos")).filter(lift > 1.0).orderBy(F.desc("weight"), "gram").limit(features)
    found = chosen.select("gram").toArrow().column(0).to_numpy().view(np.uint64)
    table = SortedTable(np.sort(found))
    if not len(found):
        return ToxicityModel(table, np.zeros(0), -9.0)
    bags = rows.mapInArrow(lambda batches: _bags(batches, table), "label int, sentences long, pairs binary").toArrow()
    names, sentence, grams = [], [], []
    for doc, pairs in enumerate(bags.column("pairs").to_pylist()):
        pair = np.frombuffer(pairs, np.int64)
        sentence.append(pair // len(found))
        grams.append(pair % len(found))
        names.append(np.full(len(pair), doc))
    doc, sentence, grams = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (names, sentence, grams))
    keys, at, of = np.unique(doc * (1 << 32) + sentence % (1 << 32), return_index=True, return_inverse=True)
    weights, bias = fit_noisy_or(bags.column("label").to_numpy(), bags.column("sentences").to_numpy(), of, grams, doc[at], len(found))
    return ToxicityModel(table, weights, bias)


def scored(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxic_score") -> DataFrame:
    """The frame with the score of each whole text, 0 to 1, in ``out`` (replaced if there).

    A null text, an empty one or one without letters has no sentence and score 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of features
    return tb.with_columns(docs, text, f"`{out}` double", lambda column: [pa.array(shared.value.score(column))], limit=tb.LETTER_BYTES)


def offending_sentences(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``(doc_id, sentence, words, score)`` of the sentences that score ``least`` or more, with
    their number in the text and their letters; other characters are single spaces."""
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([body.schema.fields[0], *T.StructType.fromDDL("sentence long, words string, score double").fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in tb.chunks(batches, limit=tb.LETTER_BYTES):
            p, first, begin = shared.value.sentences(batch.column("text"))
            codes, _, _ = letters(batch.column("text"))
            hit = np.flatnonzero(p >= least)
            doc = np.searchsorted(first, hit, "right") - 1
            words = ["".join(chr(c) if c else " " for c in codes[begin[s] : begin[s + 1]]).strip() for s in hit]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc)), pa.array(hit - first[doc]), pa.array(words, pa.string()), pa.array(p[hit])],
                names=["doc_id", "sentence", "words", "score"])

    return body.mapInArrow(run, schema)


def training_rows(
    docs: DataFrame, labels: DataFrame, only: Column | None = None, label: str = "toxic", doc_id: str = "doc_id", at_most: int = TRAIN_DOCS,
) -> DataFrame:
    """``(text, label)`` of labelled documents, those that ``only`` (on the id) allows.

    Beyond ``at_most`` labels a share of them is drawn by a hash of the id, so that their number
    is bounded (about) and their ids can be broadcast. Several labels of one document make it 1
    if any is 1."""
    marks = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("label"))
    rows = docs.select(doc_id, "text")
    if only is not None:
        rows, marks = rows.filter(only), marks.filter(only)
    share = min(1.0, at_most / max(1, marks.count()))
    drawn = marks.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < int(share * (1 << 20)))
    return stored(rows.join(F.broadcast(drawn), doc_id).select("text", "label"), "labelled")
