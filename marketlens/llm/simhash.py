"""Near-duplicates by SimHash, found through one-wildcard variants of fingerprint segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.llm.graph import components
from marketlens.session import stored

SHINGLE_WORDS = 3
BUCKET_ROWS = 64  # larger buckets are linked through midpoints instead of pairs


def simhash_array(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprint of each text: a bit is 1 if set in over half the shingle hashes."""
    h, made = tb.shingles(tb.LOWER[data], offsets, words)
    most = 2 * tb.bit_counts(h, made) > made[:, None]
    return np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()


def simhash(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, keep_text: bool = False) -> DataFrame:
    """The frame's columns, ``text`` only if asked for, and ``fp`` (long). A null or empty text, or one without
    words, has fingerprint 0; a text of fewer words than a shingle is one shingle."""
    return tb.with_columns(docs, text, "fp long", lambda column: [pa.array(simhash_array(*tb.texts(column), words).view(np.int64))], keep_text)


def _variants(fps: DataFrame, segments: int, bits: int) -> DataFrame:
    """(bucket, fp): for each segment and each of its bits, the segment without that bit."""
    width = bits // segments

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for s in range(segments):
                part = (fp >> np.uint64(s * width)) & np.uint64((1 << width) - 1)
                for bit in range(width):
                    rest = part & ~np.uint64(1 << bit)
                    key = rest | np.uint64((s * width + bit) << width)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["bucket", "fp"])

    return fps.select("fp").mapInArrow(run, "bucket long, fp long")


def _bucket_links(variants: DataFrame, most_bits: int, bucket_rows: int) -> DataFrame:
    """Verified links (a, b) of each bucket, or its members (a, null) where the bucket is large
    or may go on in a neighbouring partition.

    Rows are range-partitioned by bucket and fingerprint, so a large bucket spreads over tasks."""

    def run(batches):
        held_k, held_f, first = np.zeros(0, np.int64), np.zeros(0, np.uint64), True
        for batch in batches:
            k = np.concatenate([held_k, batch.column(0).to_numpy()])
            f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            open_rows = len(k) - cut
            if open_rows > bucket_rows:  # the last bucket is large already: none of it need wait
                k2, f2 = k, f
                held_k, held_f = k[:0], f[:0]
                yield from emit(k2, f2, first, k[-1])
                first = True  # what follows of that bucket is in another batch
            else:
                held_k, held_f = k[cut:], f[cut:]
                yield from emit(k[:cut], f[:cut], first, None)
                first = first and cut == 0
        yield from emit(held_k, held_f, True, held_k[-1] if len(held_k) else None)

    def emit(k, f, first, last):
        if not len(k):
            return
        edges = np.flatnonzero(np.diff(k)) + 1
        begin = np.concatenate([[0], edges])
        size = np.diff(np.concatenate([begin, [len(k)]]))
        cold = size <= bucket_rows
        if first:
            cold[0] = False
        if last is not None:
            cold[-1] = False
        in_cold = np.repeat(cold, size)
        ck, cf = k[in_cold], f[in_cold]
        for step in range(1, int(size[cold].max()) if cold.any() else 0):
            same = np.flatnonzero(ck[step:] == ck[:-step])
            if not len(same):
                break
            near = same[np.bitwise_count(cf[same] ^ cf[same + step]) <= most_bits]
            if len(near):
                yield out(cf[near], cf[near + step])
        hot = np.unique(f[~in_cold])
        if len(hot):
            yield out(hot, None)

    def out(a, b):
        second = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second], names=["a", "b"])

    return variants.mapInArrow(run, "a long, b long")


def _midpoints(fps: DataFrame) -> DataFrame:
    """(mid, a): each fingerprint under itself and its 64 one-bit neighbours."""

    def run(batches):
        for batch in batches:
            a = batch.column(0).to_numpy().view(np.uint64)
            for flip in (np.uint64(0), *(np.uint64(1 << bit) for bit in range(64))):
                yield pa.RecordBatch.from_arrays([pa.array((a ^ flip).view(np.int64)), batch.column(0)], names=["mid", "a"])

    return fps.mapInArrow(run, "mid long, a long")


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``fp``) that connect exactly what
    pairs at two or fewer differing bits connect.

    A fingerprint is cut into two segments of 32 bits; of two that differ in at most two bits,
    one segment differs in at most one, so they share a variant of that segment with one bit
    left out. Small buckets of equal variants are compared pair by pair. The members of large
    buckets are filed under themselves and their 64 one-bit neighbours instead: two differ in at
    most two bits exactly if they share such a midpoint, at most 65 share one, and a midpoint's
    members are linked to its smallest."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fps = stored(fps.select("fp").distinct(), "fps")
    spread = _variants(fps, 2, 64).repartitionByRange(parts, "bucket", "fp").sortWithinPartitions("bucket", "fp")
    found = stored(_bucket_links(spread, 2, BUCKET_ROWS), "found")
    pairs = found.filter("b IS NOT NULL").select("a", "b")
    middle = _midpoints(found.filter("b IS NULL").select("a").distinct()).groupBy("mid").agg(F.collect_set("a").alias("near")).filter(F.size("near") > 1)
    stars = middle.select(F.explode("near").alias("a"), F.array_min("near").alias("b")).filter("a <> b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``: the class of its document
    under links of fingerprints at two or fewer differing bits.

    ``component_id`` is the smallest ``doc_id`` of the class; rows whose ``doc_id`` is null link
    like others and take the class's id (null if the class has no other). Equal texts have equal
    fingerprints and so one class. An empty table gives an empty result."""
    rows = stored(simhash(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words), "fingerprints")
    return classes(rows, fingerprint_links(rows))


def classes(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows(doc_id, fp)`` with the smallest ``doc_id`` of each row's class under ``links(a, b)``
    of values of ``fp``."""
    roots = components(links).toDF("fp", "root")
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classed = fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = classed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = classed.join(least, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")
