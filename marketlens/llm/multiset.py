"""Document fingerprints that add up: a multiset hash of paragraphs with a measure of likeness."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm import textbytes as tb

EXACT = 8  # lanes of 64 bits, sums of uniform hashes modulo 2^64
SOFT = 256  # lanes of 32 bits, sums of signs modulo 2^32
SHINGLE_WORDS = 3
RUNS = 16  # stretches of the id order for each partition, so that partitions get about the same

NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[0x0A] = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def vectors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact and the soft lanes of each text: sums over its paragraphs (lines with a byte).

    A paragraph adds eight 64-bit words grown from its 128-bit hash, and for each of its runs of
    three words a vector of signs. The first tell any two multisets apart; the distance of the
    second estimates how many runs differ."""
    start, end, first = tb.word_spans(data, offsets, NOT_NEWLINE)
    raw = data.tobytes()
    digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(start, end)), ">u8").astype(np.uint64).reshape(-1, 2)
    grown = _mix(digest[:, :1] + digest[:, 1:] * np.arange(1, EXACT + 1, dtype=np.uint64) | np.uint64(1))
    exact = tb.sums_by(grown, first)
    h, made = tb.shingles(data, np.append(start, len(data)) if len(start) else np.zeros(1, np.int64), SHINGLE_WORDS)
    # Runs are counted by text, so that a text's signs add up in one pass.
    by_text = tb.sums_by(made, first)
    soft = np.empty((len(by_text), SOFT), np.int64)
    for k in range(SOFT // 64):
        soft[:, 64 * k : 64 * k + 64] = 2 * tb.bit_counts(h, by_text) - by_text[:, None]
        h = _mix(h + np.uint64(0x9E3779B97F4A7C15))
    return exact, soft.astype(np.uint32).view(np.int32)


def encoded(exact: np.ndarray, soft: np.ndarray) -> list[str]:
    rows = np.concatenate([exact.astype("<u8").view(np.uint8), soft.astype("<i4").view(np.uint8)], axis=1)
    return [base64.b64encode(row).decode() for row in rows]


def decoded(prints) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(map(base64.b64decode, prints)), np.uint8).reshape(-1, 8 * EXACT + 4 * SOFT)
    return raw[:, : 8 * EXACT].copy().view("<u8"), raw[:, 8 * EXACT :].copy().view("<i4")


def nearness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1 for equal multisets, near 0 for unrelated ones: one less the share of differing runs."""
    norm = lambda x: (x.astype(np.float64) ** 2).sum(axis=1)
    both = norm(a[1]) + norm(b[1])
    apart = norm((a[1].view(np.uint32) - b[1].view(np.uint32)).view(np.int32))
    like = np.clip(1 - np.divide(apart, both, out=np.ones_like(both), where=both > 0), 0, 1)
    return np.where((a[0] == b[0]).all(axis=1), 1.0, like)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two fingerprint columns, 0 to 1."""
    return pd.Series(nearness(decoded(a), decoded(b)))


@F.pandas_udf(T.StringType())
def inserted(a: pd.Series, b: pd.Series) -> pd.Series:
    """The fingerprint of the multiset ``a`` with the paragraphs of ``b`` added."""
    (x, u), (y, v) = decoded(a), decoded(b)
    return pd.Series(encoded(x + y, (u.view(np.uint32) + v.view(np.uint32)).view(np.int32)))


@F.pandas_udf(T.StringType())
def deleted(a: pd.Series, b: pd.Series) -> pd.Series:
    """The fingerprint of the multiset ``a`` with the paragraphs of ``b`` taken away."""
    (x, u), (y, v) = decoded(a), decoded(b)
    return pd.Series(encoded(x - y, (u.view(np.uint32) - v.view(np.uint32)).view(np.int32)))


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """The frame with the fingerprint of its text added (a column of that name is replaced).

    The order of paragraphs does not matter, their number does; null counts as the empty text,
    whose fingerprint is that of no paragraphs."""
    return tb.with_columns(docs, text, f"`{out}` string", lambda column: [pa.array(encoded(*vectors(*tb.texts(column))), pa.string())])


def _cuts(docs: DataFrame, parts: int) -> np.ndarray:
    """Ids of ``docs`` that cut them into about ``parts`` runs; the first is the smallest."""
    at = [i / parts for i in range(1, parts)]
    row = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", at or [0.5], min(1 << 20, 100 * parts)).alias("cuts")).first()
    return np.unique([row["least"], *row["cuts"]]) if row["least"] is not None else np.zeros(0, np.int64)


def compare_with_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each text's fingerprint, that of an edited text, and their likeness.

    The edited text has the last half (rounded down) of the code points replaced by as many from
    the start of the next document in the order of ``doc_id`` (rows of one id by a hash of their
    text), or by all it has; after the last comes the first. A row without ``doc_id`` has no
    place in that order and no next document, that is, an empty one.

    Texts are shuffled once: ids cut the order into runs, a run is one sorted stretch of a task,
    and the text that begins the next run is sent to both."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(body, RUNS * parts)

    def deal(batches):
        for batch in tb.chunks(batches):
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            run = np.searchsorted(cuts, ids, "right") - 1
            run[~known] = -1 - np.flatnonzero(~known) % (RUNS * parts)
            twice = np.flatnonzero(known & np.isin(ids, cuts))
            before = (run[twice] - 1) % max(1, len(cuts))
            rows = np.concatenate([np.arange(len(ids)), twice])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([run, before])), pa.array(np.arange(len(rows)) >= len(ids)), *(batch.take(pa.array(rows)).columns)],
                names=["run", "again", "doc_id", "text"])

    dealt = body.mapInArrow(deal, "run long, again boolean, doc_id long, text string").repartition(parts, "run")
    ordered = dealt.sortWithinPartitions("run", "again", "doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _compare(batches):
    held = None
    for batch in tb.chunks(batches):
        rows = batch if held is None else pa.concat_batches([held, batch])
        yield from _compared(rows, False)
        held = rows.slice(rows.num_rows - 1)
    if held is not None:
        yield from _compared(held, True)


def _compared(rows: pa.RecordBatch, last: bool):
    """Results of all rows but the last, or of it too if no row follows."""
    n = rows.num_rows if last else rows.num_rows - 1
    if not n:
        return
    run, again = rows.column("run").to_numpy(), rows.column("again").to_numpy(zero_copy_only=False)
    texts = rows.column("text").to_pylist()
    follows = np.append(run[1:] == run[:-1], False) & (run >= 0)
    after = [texts[i + 1] if follows[i] else "" for i in range(n)]
    edited = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after)]
    own = vectors(*tb.texts(rows.column("text")))
    new = vectors(*tb.texts(pa.array(edited, pa.large_string())))
    empty = tuple(np.zeros_like(x[:1]) for x in own)
    next_ = tuple(np.where(follows[:n, None], np.concatenate([x[1:], e])[:n], e) for x, e in zip(own, empty))
    mine = tuple(x[:n] for x in own)
    keep = pa.array(~again[:n])
    yield pa.RecordBatch.from_arrays([
        rows.column("doc_id").slice(0, n), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(encoded(*mine), pa.string()), pa.array(encoded(*new), pa.string()),
        pa.array(nearness(mine, new)), pa.array(nearness(mine, next_)),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).filter(keep)
