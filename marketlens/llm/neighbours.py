"""Quality by nearest neighbours: labelled documents vote in a space of latent meanings.

A text becomes weights of its words and of the shapes of its characters, a projection fitted to
labelled documents takes these to a few dimensions, and every document is held against every
labelled one, block by block, as products of matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.session import stored

WORDS, SHAPES = 1 << 14, 1 << 12  # buckets of hashed words and of hashed shape grams
REPEATS = 4  # words back within which a repeated word is noted
FEATURES = WORDS + SHAPES + REPEATS
GRAM = 4  # characters of a shape gram
DIMENSIONS = 64
ROUNDS = 4  # of subspace iteration
TRAIN_DOCS = 6000  # labelled documents that fit the space and vote, at most (about)
TRAIN_ENTRIES = 8_000_000  # weights of them all, at most (about); longer documents have more
NEIGHBOURS = 25
PRIOR = 1.0  # votes that the share of label 1 among all counts for
SEGMENT = 1 << 20  # positions whose grams are counted at once
BLOCK = 256  # documents held against all labelled ones at once

# Characters by kind: letters small and capital, digits, blanks; any other one is itself.
SHAPE = np.arange(256, dtype=np.uint32)
SHAPE[ord("a") : ord("z") + 1] = SHAPE[0x80:] = 1
SHAPE[ord("A") : ord("Z") + 1] = 2
SHAPE[ord("0") : ord("9") + 1] = 3
SHAPE[[0x20, 0x09]] = 4
_MUL = np.uint32(0x9E3779B1)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and occurrences: words (A-Z in lower case) first, then shape grams, then words
    that stand a few places before as well. A null text is empty and has none."""
    data, offsets = tb.texts(column)
    low = tb.LOWER[data]
    start, end, first = tb.word_spans(low, offsets, tb.ALNUM)
    hashed = tb.word_hashes(low, start, end)
    word = (hashed % np.uint64(WORDS)).astype(np.int64)
    text_of = np.repeat(np.arange(len(column)), np.diff(first))
    keys, counts = [], []
    for back in range(1, REPEATS + 1):
        again = (hashed[back:] == hashed[:-back]) & (text_of[back:] == text_of[:-back])
        n = np.bincount(text_of[back:][again], minlength=len(column))
        keys.append(np.flatnonzero(n) * FEATURES + WORDS + SHAPES + back - 1)
        counts.append(n[n > 0])
    for lo in range(0, len(word), SEGMENT):
        key, n = np.unique(text_of[lo : lo + SEGMENT] * FEATURES + word[lo : lo + SEGMENT], return_counts=True)
        keys.append(key)
        counts.append(n)
    for lo in range(0, max(0, len(data) - GRAM + 1), SEGMENT):
        code = SHAPE[data[lo : lo + SEGMENT + GRAM - 1]]
        n = len(code) - GRAM + 1
        h = np.zeros(n, np.uint32)
        for j in range(GRAM):
            h = (h ^ code[j : j + n]) * _MUL
            h ^= h >> np.uint32(15)
        at = np.arange(lo, lo + n)
        home = np.searchsorted(offsets, at, "right") - 1
        whole = at + GRAM <= offsets[home + 1]  # a gram does not cross into the next text
        key, n = np.unique(home[whole] * FEATURES + WORDS + (h[whole] % np.uint32(SHAPES)), return_counts=True)
        keys.append(key)
        counts.append(n)
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key // FEATURES, key % FEATURES, np.bincount(of, np.concatenate(counts), len(key)).astype(np.int64)


def _document_counts(batches):
    """(bucket, n): documents that hold each bucket; under -1 the documents with any."""
    df, docs = np.zeros(FEATURES, np.int64), 0
    for batch in tb.chunks(batches):
        text, bucket, _ = features(batch.column("text"))
        df += np.bincount(bucket, minlength=FEATURES)
        docs += len(np.unique(text))
    held = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(df[held], docs))], names=["bucket", "n"])


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight of each bucket by the documents that hold it, over all of ``docs``."""
    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    counted = rows.mapInArrow(_document_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # FEATURES rows at most
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    total, df = int(n[bucket < 0].sum()), np.zeros(FEATURES)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return np.log((1 + total) / (1 + df)).astype(np.float32)


def weights(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, bucket and weight; words and shapes have length 1 each in every text that has them,
    repeats the share of words that are repeats, twice."""
    text, bucket, n = features(column)
    w = (1 + np.log(n)) * idf[bucket]
    part = 2 * text + (bucket >= WORDS)
    again = bucket >= WORDS + SHAPES
    norm = np.sqrt(np.bincount(part, np.where(again, 0, w) ** 2, 2 * len(column)))
    words = np.bincount(text[bucket < WORDS], n[bucket < WORDS], len(column))
    return text, bucket, np.where(again, 2 * n / np.maximum(words[text], 1), w / np.maximum(norm[part], 1e-12)).astype(np.float32)


def _times(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, dense: np.ndarray) -> np.ndarray:
    """Product of a sparse matrix, sorted by row, and a dense one."""
    out = np.zeros((rows, dense.shape[1]), np.float32)
    step = 1 << 16
    for lo in range(0, len(row), step):
        r = row[lo : lo + step]
        new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        out[r[new]] += np.add.reduceat(value[lo : lo + step, None] * dense[col[lo : lo + step]], new, axis=0)
    return out


def latent_space(row: np.ndarray, col: np.ndarray, value: np.ndarray, rows: int, dimensions: int = DIMENSIONS, rounds: int = ROUNDS) -> np.ndarray:
    """The buckets' coordinates along the leading right singular vectors, by subspace iteration."""
    wide = min(dimensions + 8, rows, FEATURES)
    if not wide:
        return np.zeros((FEATURES, 1), np.float32)
    by_col = np.lexsort((row, col))
    basis = np.random.default_rng(13).standard_normal((FEATURES, wide)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(basis)
        image = _times(row, col, value, rows, basis)
        basis = _times(col[by_col], row[by_col], value[by_col], FEATURES, image)
    basis, _ = np.linalg.qr(basis)
    image = _times(row, col, value, rows, basis).astype(np.float64)
    _, turn = np.linalg.eigh(image.T @ image)
    return (basis @ turn[:, ::-1][:, :dimensions]).astype(np.float32)


def _unit(z: np.ndarray) -> np.ndarray:
    return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


@dataclass
class Voters:
    """Labelled documents in the latent space; bounded by ``TRAIN_DOCS`` and ``DIMENSIONS``."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray  # unit length, a row for each labelled document
    labels: np.ndarray  # of equal documents, which are one voter, the mean
    share: float  # of label 1 among all that were drawn
    neighbours: int = NEIGHBOURS

    def place(self, column: pa.Array) -> np.ndarray:
        return _unit(_times(*weights(column, self.idf), len(column), self.space))

    def votes(self, z: np.ndarray) -> np.ndarray:
        """Score of each vector: labels of its nearest neighbours, weighted by the cosine.

        All that are as near as the last of them, to four digits, vote, so that ties depend neither on
        an order nor on the rounding of products."""
        k = min(self.neighbours, len(self.labels))
        out = np.full(len(z), self.share)
        for lo in range(0, len(z) if k else 0, BLOCK):
            near = np.round(z[lo : lo + BLOCK] @ self.vectors.T, 4)
            least = np.partition(near, len(self.labels) - k, axis=1)[:, len(self.labels) - k, None]
            near = np.where(near >= least, np.maximum(near, 0), 0).astype(np.float64)
            out[lo : lo + BLOCK] = (near @ self.labels + PRIOR * self.share) / (near.sum(axis=1) + PRIOR)
        return out


def training_rows(docs: DataFrame, labels: DataFrame, only: Column | None = None, label: str = "quality", doc_id: str = "doc_id", at_most: int = TRAIN_DOCS) -> DataFrame:
    """``(doc_id, text, label)`` of labelled documents, those that ``only`` (on the id) allows.

    Beyond ``at_most`` labels a share of them is drawn by a hash of the id. Labels other than 0 and 1
    are left out; of several labels of one document the least counts. A null id names nothing."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.min(label).cast("int").alias("label"))
    rows = docs.select(F.col(doc_id), F.col("text").cast("string").alias("text"))
    if only is not None:
        rows, marks = rows.filter(only), marks.filter(only)
    share = min(1.0, at_most / max(1, marks.count()))
    drawn = stored(marks.filter(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) < int(share * (1 << 20))), "drawn")
    return rows.join(F.broadcast(drawn), doc_id).select(F.col(doc_id).alias("doc_id"), "text", "label")


def train(labelled: DataFrame, idf: np.ndarray, entries: int = TRAIN_ENTRIES, dimensions: int = DIMENSIONS) -> Voters:
    """The latent space and the voters, from ``training_rows``; ``idf`` as of :func:`rarity`.

    Rows without any feature do not vote, and equal ones have one vote together. If the drawn documents have more than ``entries`` weights,
    a share of them is drawn again by a hash. Without any labelled document all scores are 0.5."""

    def run(batches):
        for batch in tb.chunks(batches):
            text, bucket, w = weights(batch.column("text"), idf)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            raw = [(bucket[a:b].astype(np.int32).tobytes(), w[a:b].tobytes()) for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.string()), batch.column("label"), pa.array(np.diff(cut)), pa.array([x for x, _ in raw], pa.binary()), pa.array([x for _, x in raw], pa.binary())],
                names=["doc_id", "label", "size", "buckets", "weights"])

    made = labelled.mapInArrow(run, "doc_id string, label int, size long, buckets binary, weights binary")
    rows = stored(made.filter("size > 0"), "voters")
    found = rows.agg(F.sum("size").alias("n"), F.avg("label").alias("share")).first()
    share = min(1.0, entries / max(1, found["n"] or 0))
    kept = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)))
    taken = kept.groupBy("buckets", "weights").agg(F.avg("label").alias("label"), F.first("size").alias("size"))
    taken = taken.orderBy("buckets", "weights").toArrow()
    size = taken.column("size").to_numpy()
    row = np.repeat(np.arange(len(size)), size)
    col = np.frombuffer(b"".join(taken.column("buckets").to_pylist()), np.int32).astype(np.int64)
    value = np.frombuffer(b"".join(taken.column("weights").to_pylist()), np.float32)
    space = latent_space(row, col, value, len(size), dimensions)
    vectors = _unit(_times(row, col, value, len(size), space))
    return Voters(idf, space, vectors, taken.column("label").to_numpy(), 0.5 if found["share"] is None else float(found["share"]))


def scored(docs: DataFrame, voters: Voters, text: str = "text", out: str = "quality_score") -> DataFrame:
    """The frame with the score of each whole text, 0 to 1, in ``out`` (replaced if there).

    A null or empty text, or one too short for any feature, has no neighbours and scores the share
    of label 1. Equal texts score alike. An empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    return tb.with_columns(docs, text, f"`{out}` double", lambda column: [pa.array(shared.value.votes(shared.value.place(column)))])
