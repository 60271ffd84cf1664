"""Near-copies: documents whose sets of shingles have a Jaccard similarity of at least a bound.

Bands of minimum hashes propose pairs, one bit of each minimum drops most that are too far apart,
and the sets themselves decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import simhash
from marketlens.llm import textbytes as tb
from marketlens.llm.graph import components
from marketlens.llm.simhash import classes
from marketlens.session import broadcast_if_small, discard, stored

SHINGLE_WORDS = 5
LEAST_JACCARD = 0.8
BANDS, BAND_HASHES = 20, 6  # a pair at 0.8 shares a band with chance 0.998
HASHES = 128  # the first BANDS * BAND_HASHES form bands, one bit of each the sketch
SLACK = 4  # standard deviations by which a sketch may understate a pair
BUCKET_ROWS = 2048  # sketches of a bucket that are searched at once for the nearest; a larger bucket is cut into pieces
CELL_ROWS = 512  # sets of a bucket that are held against as many others at once
ROUNDS = 2  # in which sets meet their nearest only, before all that is left between classes is held together

_DRAW = np.random.default_rng(20)
_FLIP = _DRAW.integers(0, 1 << 64, HASHES, np.uint64)
_ODD = _DRAW.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin."""
    h, made = tb.shingles(tb.LOWER[data], offsets, words)
    of = np.repeat(np.arange(len(made)), made)
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    return h[new], np.searchsorted(of[new], np.arange(len(made) + 1))


def set_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64 bits that name each set; the empty set is 0."""
    return np.where(np.diff(first) > 0, _mix(tb.sums_by(_mix(h), first) + np.diff(first).astype(np.uint64)), np.uint64(0))


def sketches(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the keys of its bands, and one bit of each minimum hash as two words."""
    n, full = len(first) - 1, np.flatnonzero(np.diff(first))
    least = np.zeros((HASHES, n), np.uint64)
    if len(full):
        for k in range(HASHES):
            least[k, full] = np.minimum.reduceat((h ^ _FLIP[k]) * _ODD[k], first[full])
    in_bands = _mix(least[: BANDS * BAND_HASHES] ^ _FLIP[: BANDS * BAND_HASHES, None])
    keys = in_bands.reshape(BANDS, BAND_HASHES, n)
    key = np.zeros((BANDS, n), np.uint64)
    for j in range(BAND_HASHES):
        key = _mix(key * _ODD[j] + keys[:, j])
    key += np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
    bits = (_mix(_mix(least)) >> np.uint64(63)).astype(np.uint8)
    words = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view("<u8") if n else np.zeros((0, 2), np.uint64)
    return _mix(key).T, words


def named(docs: DataFrame, text: str = "text", words: int = SHINGLE_WORDS, keep_text: bool = False) -> DataFrame:
    """The frame's columns, ``text`` only if asked for, and ``fp`` (long), the name of its set."""
    return tb.with_columns(docs, text, "fp long", lambda c: [pa.array(set_names(*shingle_sets(*tb.texts(c), words)).view(np.int64))], keep_text)


def _sketched(column: pa.Array, words: int) -> list[pa.Array]:
    h, first = shingle_sets(*tb.texts(column), words)
    keys, bits = sketches(h, first)
    return [pa.array(set_names(h, first).view(np.int64)), *(pa.array(bits[:, i].copy().view(np.int64)) for i in (0, 1)),
            pa.array([k.tobytes() for k in np.ascontiguousarray(keys)], pa.binary()), pa.array(simhash.simhash_array(*tb.texts(column)).view(np.int64))]


def _banded(batches):
    """(bucket, fp, s0, s1): a row for each band."""
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<i8").reshape(-1, BANDS)
        for band in range(BANDS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, band].copy()), *batch.columns[:3]], names=["bucket", "fp", "s0", "s1"])


MET = "bucket long, fp long, s0 long, s1 long"
FOUND = "a long, b long, kind int, apart int"


def _distance(s, t):
    return np.bitwise_count(s[0] ^ t[0]).astype(np.int64) + np.bitwise_count(s[1] ^ t[1])


def _not_alone(batches):
    """Rows sorted by bucket without those that have a bucket to themselves; a partition's first and
    last bucket may go on in a neighbouring one and is kept."""
    held, first = None, True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        k = rows.column(0).to_numpy()
        same = k[1:] == k[:-1]
        met = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        yield rows.slice(0, len(k) - 1).filter(pa.array(met[:-1]))
        held, first = rows.slice(len(k) - 1), bool(met[-1])
    if held is not None:
        yield held


def _by_cell(batches):
    """Rows sorted by cell, the rows of a cell at a time."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0][0] != tuple(key[:, lo]):
                yield pa.Table.from_batches([x for _, x in held]).combine_chunks().to_batches()[0]
                held.clear()
            held.append((tuple(key[:, lo]), batch.slice(lo, hi - lo)))
    if held:
        yield pa.Table.from_batches([x for _, x in held]).combine_chunks().to_batches()[0]


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a cell that are held against which: side 0 against side 1, or all against all."""
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(side))


def _apart(s, root, mine, right) -> np.ndarray:
    """Bits in which the sketches of rows differ, more than there are for rows of one root."""
    d = _distance([x[mine, None] for x in s], [x[None, right] for x in s])
    d[root[mine, None] == root[None, right]] = HASHES + 1
    return d


def _nearest(batches, far: int):
    """Rows sorted by cell to pairs of sets of different roots whose sketches are near: of each row its
    nearest (kind 0) and the cell's most typical (kind 1)."""
    for rows in _by_cell(batches):
        f, *s, root = (rows.column(c).to_numpy() for c in ("fp", "s0", "s1", "root"))
        s = [x.view(np.uint64) for x in s]
        bits = np.unpackbits(np.stack(s, axis=1).view(np.uint8), axis=1)
        middle = int(np.argmax((bits == (2 * bits.sum(axis=0) > len(f))).sum(axis=1)))
        for lo in range(0, len(f), 256):
            mine = np.arange(lo, min(lo + 256, len(f)))
            d = _apart(s, root, mine, np.arange(len(f)))
            for kind, j in ((0, d.argmin(axis=1)), (1, np.full(len(mine), middle))):
                apart = d[np.arange(len(mine)), j]
                i = np.flatnonzero(apart <= far)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f[mine[i]]), pa.array(f[j[i]]), pa.array(np.full(len(i), kind, np.int32)), pa.array(apart[i].astype(np.int32))], names=NAMES)


def _in_question(batches, far: int):
    """Of rows sorted by cell those with a row of another root in their cell whose sketch is near."""
    for rows in _by_cell(batches):
        side, *s, root = (rows.column(c).to_numpy() for c in ("side", "s0", "s1", "root"))
        s = [x.view(np.uint64) for x in s]
        left, right = _sides(side)
        met = np.zeros(len(side), bool)
        for lo in range(0, len(left), 256):
            near = _apart(s, root, left[lo : lo + 256], right) <= far
            met[left[lo : lo + 256]] |= near.any(axis=1)
            met[right] |= near.any(axis=0)
        yield rows.select(["bucket", "i", "j", "side", "fp", "root"]).filter(pa.array(met))


def _linked(batches, least: float):
    """Rows sorted by cell, with their sets, to links: of each set one to every other root in its cell
    that has a set with the similarity."""
    for rows in _by_cell(batches):
        side, f, root = (rows.column(c).to_numpy() for c in ("side", "fp", "root"))
        sets = [unpacked_set(x.as_py()) for x in rows.column("hashes")]
        size = np.array([len(x) for x in sets])
        left, right = _sides(side)
        names, at = np.unique(np.concatenate(sets), return_inverse=True)
        own = np.split(at, np.cumsum(size)[:-1])
        others, first = np.concatenate([own[r] for r in right]), np.concatenate([[0], np.cumsum(size[right])])
        marked, a, b = np.zeros(len(names), np.int64), [], []
        for i in left:
            marked[own[i]] = 1
            both = np.add.reduceat(marked[others], first[:-1])  # no set here is empty
            marked[own[i]] = 0
            like = np.flatnonzero((both >= least * (size[i] + size[right] - both)) & (root[right] != root[i]))
            like = right[like[np.unique(root[right[like]], return_index=True)[1]]]
            a.append(np.full(len(like), f[i]))
            b.append(f[like])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])


NAMES = [x.split()[0] for x in FOUND.split(", ")]


SET_BYTES = 6  # of a shingle's hash in a set that travels
FILTER_BITS = 1 << 28  # of a filter that tells which sets are wanted, at most: 32 MB
CHUNK_PAIRS = 512  # partners of a set that are held against it in one place


def packed_sets(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each set as its hashes' leading ``SET_BYTES`` bytes in ascending order."""
    cut = (h >> np.uint64(64 - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES]
    return [cut[i:j].tobytes() for i, j in zip(first[:-1], first[1:])]


def unpacked_set(raw: bytes) -> np.ndarray:
    body = np.zeros((len(raw) // SET_BYTES, 8), np.uint8)
    body[:, :SET_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SET_BYTES)
    return np.unique(body.view("<u8").ravel())


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def _agreeing(batches, least: float):
    """Rows (a, chunk, b, hashes) sorted by a and chunk, first the set of a itself (b null), to the
    pairs whose sets have the similarity. One set is held at a time, besides the row at hand."""
    at, held = None, None
    for batch in batches:
        a, b, hashes, keep = batch.column("a").to_pylist(), batch.column("b"), batch.column("hashes"), []
        for i, (x, chunk, other) in enumerate(zip(a, batch.column("chunk").to_pylist(), b.to_pylist())):
            if other is None:
                at, held = (x, chunk), unpacked_set(hashes[i].as_py())
            elif (x, chunk) == at and similar(held, unpacked_set(hashes[i].as_py()), least):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column("a"), b], names=["a", "b"]).take(pa.array(keep, pa.int64()))


def _filter_slots(names: np.ndarray, bits: int) -> np.ndarray:
    h = _mix(names.view(np.uint64) ^ _FLIP[0])
    return np.stack([h % np.uint64(bits), _mix(h * _ODD[1]) % np.uint64(bits)])


def name_filter(names: DataFrame, most_bits: int = FILTER_BITS) -> np.ndarray:
    """Packed bits in which each name (a long) of the frame has its two set, so that rows that are
    surely not wanted are left where they are. With more names than fit it holds back fewer; it
    never holds back a wanted one."""
    bits = min(most_bits, max(1 << 13, 1 << int(16 * names.count()).bit_length()))

    def words(batches):
        for batch in batches:
            slot = np.unique(_filter_slots(batch.column(0).to_numpy(), bits))
            word, of = np.unique(slot >> np.uint64(6), return_inverse=True)
            mask = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(mask, of, np.uint64(1) << (slot & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    made = names.mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    out[made.column("word").to_numpy()] = made.column("mask").to_numpy().view(np.uint64)
    return out


def in_filter(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    slots = _filter_slots(names, 64 * len(words))
    return ((words[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1)).astype(bool).all(axis=0)


def verified(source: DataFrame, reps: DataFrame, pairs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs ``(a, b)`` of names whose sets have the similarity.

    ``source(row, text)`` is read and its sets are made once more; only the wanted set of the one
    row that ``reps(fp, row)`` gives for a name leaves its task, however many copies it has. The set
    of ``a`` goes once to every ``CHUNK_PAIRS`` of its partners, that of ``b`` to each pair, so a
    set that is in many pairs is neither repeated for each nor makes one task hold them all."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    chunk = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK_PAIRS)).cast("int").alias("chunk")
    dealt = stored(pairs.join(degree, "a").select("a", chunk, "b"), "dealt")
    own = dealt.select(F.col("a").alias("fp"), "a", "chunk", F.lit(None).cast("long").alias("b")).distinct()
    places = stored(own.union(dealt.select(F.col("b").alias("fp"), "a", "chunk", "b")).join(reps, "fp"), "places")
    met = with_sets(source, places, words).select("a", "chunk", "b", "hashes")
    ordered = met.repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.asc_nulls_first("b"))
    found = stored(ordered.mapInArrow(lambda batches: _agreeing(batches, least), "a long, b long").distinct(), "agreeing")
    discard(dealt, places)
    return found


def with_sets(source: DataFrame, places: DataFrame, words: int) -> DataFrame:
    """``places``, which is written and has ``fp`` and ``row``, with the set of that row of ``source(row, text)``
    as ``hashes``. Sets are made once more from the texts; only wanted ones leave their task."""
    wanted = source.sparkSession.sparkContext.broadcast(name_filter(places.select(F.col("fp").bitwiseXOR(F.col("row"))).distinct()))

    def sets(batches):
        for batch in tb.chunks(batches):
            h, first = shingle_sets(*tb.texts(batch.column("text")), words)
            names, row = set_names(h, first).view(np.int64), batch.column("row").to_numpy()
            at = np.flatnonzero(in_filter(names ^ row, wanted.value))
            cut = [h[first[i] : first[i + 1]] for i in at]
            ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
            raw = packed_sets(np.concatenate([np.zeros(0, np.uint64), *cut]), ends)
            yield pa.RecordBatch.from_arrays([pa.array(names[at]), pa.array(row[at]), pa.array(raw, pa.binary())], names=["fp", "row", "hashes"])

    made = source.mapInArrow(sets, "fp long, row long, hashes binary")
    return made.join(broadcast_if_small(places), ["fp", "row"])


def _met(fps: DataFrame) -> DataFrame:
    """``bucket, fp, s0, s1`` of ``fps(fp, s0, s1, bands)``, without buckets that hold a single set."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = fps.select("fp", "s0", "s1", "bands").mapInArrow(_banded, MET)
    return rows.repartitionByRange(parts, "bucket", "fp").sortWithinPartitions("bucket", "fp").mapInArrow(_not_alone, MET)


CELL = "bucket long, i int, j int, side int, fp long, root long"
FAR = lambda chance: int(HASHES * chance + SLACK * (HASHES * chance * (1 - chance)) ** 0.5)  # noqa: E731  bits, of a chance to differ


def _placed(met: DataFrame, roots: DataFrame | None, rows: int) -> DataFrame:
    """``met`` with the root of each set and, of its bucket, the sets ``n``, the most frequent root ``most``, the
    sets ``beside`` that; buckets whose sets have one root are left out. ``rows`` is a piece's size."""
    if roots is None:
        placed = met.withColumn("root", F.col("fp"))
    else:
        placed = met.join(broadcast_if_small(roots.withColumnRenamed("node", "fp")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    by_root = placed.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("m"))
    size = by_root.groupBy("bucket").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("most"), F.count(F.lit(1)).alias("r")).filter("r > 1")
    pieces = lambda n: F.ceil(n / rows).cast("int")
    beside = F.col("n") - F.col("most.m")
    size = size.select("bucket", F.col("most.root").alias("most"), pieces(F.col("n")).alias("pieces"), pieces(beside).alias("beside"))
    return placed.join(broadcast_if_small(stored(size, "sizes")), "bucket")


def _piece(pieces: str) -> Column:
    return F.pmod(F.xxhash64("fp"), F.col(pieces)).cast("int")


def _dealt(cells: DataFrame) -> DataFrame:
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")


def _proposed(met: DataFrame, roots: DataFrame | None, least: float) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of sets that share a bucket, have different roots and near sketches: of
    each set its nearest and the nearest typical one. Large buckets are searched piece by piece."""
    far = FAR((1 - least) / 2)
    cells = _placed(met, roots, BUCKET_ROWS).withColumns({"i": _piece("pieces"), "j": F.lit(0)}).select("bucket", "i", "j", "fp", "s0", "s1", "root")
    found = _dealt(cells).mapInArrow(lambda batches: _nearest(batches, far), FOUND)
    found = found.groupBy("a", "kind").agg(F.min(F.struct("apart", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _left(source: DataFrame, reps: DataFrame, met: DataFrame, roots: DataFrame | None, words: int, least: float) -> DataFrame:
    """Links ``(a, b)`` that join all that is left to join: every two sets that share a bucket, have
    different roots and near sketches are held against each other, sets and not pairs being moved.

    In a bucket larger than ``CELL_ROWS`` every set that does not have the most frequent root meets
    every piece; those that have it need not meet each other, so that a class of any size is met
    in one pass by what stands beside it."""
    far, zero, one = FAR((1 - least) / 2), F.lit(0), F.lit(1)
    placed = _placed(met, roots, CELL_ROWS)
    columns = ["bucket", "i", "j", "side", "fp", "s0", "s1", "root"]
    large = F.col("pieces") > 1
    small = placed.filter(~large).withColumns({"i": zero, "j": zero, "side": zero}).select(columns)
    beside = placed.filter(large & (F.col("root") != F.col("most"))).withColumns({"i": _piece("beside"), "side": zero})
    every = placed.filter(large).withColumns({"j": _piece("pieces"), "side": one})
    cells = small.union(beside.withColumn("j", F.explode(F.sequence(zero, F.col("pieces") - 1))).select(columns))
    cells = cells.union(every.withColumn("i", F.explode(F.sequence(zero, F.col("beside") - 1))).select(columns))
    asked = _dealt(cells).mapInArrow(lambda batches: _in_question(batches, far), CELL)
    asked = stored(asked.join(reps, "fp"), "in-question")
    found = _dealt(with_sets(source, asked, words)).mapInArrow(lambda batches: _linked(batches, least), "a long, b long")
    return stored(found.distinct(), "left")


def _fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links of set names in ``rows(fp, sim)`` whose fingerprints ``sim`` are equal or, as op2 has it, linked."""
    named_by = stored(rows.groupBy("sim").agg(F.min("fp").alias("least"), F.max("fp").alias("most")), "by-fingerprint")
    several = named_by.filter("least <> most").select("sim", "least")
    equal = rows.select("sim", "fp").distinct().join(broadcast_if_small(several), "sim").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    near = simhash.fingerprint_links(named_by.select(F.col("sim").alias("fp")))
    for c in ("a", "b"):
        near = near.join(named_by.select(F.col("sim").alias(c), F.col("least").alias(f"{c}_name")), c)
    return equal.union(near.select("a_name", "b_name")).filter("a <> b").distinct()


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, least: float = LEAST_JACCARD,
                fingerprints: bool = False) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``: the class of its document under
    links of documents whose sets of ``words``-word shingles have similarity ``least`` or more.

    A text of fewer words is one shingle; texts without words are copies of each other. Every link
    is verified on the sets; which pairs are held against each other is drawn by minimum hashes, so
    a pair just at the bound is missed with chance 0.002, a closer one more rarely. Buckets have no
    cap: a pair that shares one is left out only if its ends are linked already or its sketches
    are too far apart. ``component_id`` is as in ``near_duplicates``. With ``fingerprints`` documents are
    linked as well that ``simhash.near_duplicates`` links."""
    given = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id)).alias("row"), F.col(text).cast("string").alias("text"))
    made = tb.with_columns(given, "text", "fp long, s0 long, s1 long, bands binary, sim long", lambda c: _sketched(c, words), keep_text=False)
    rows = stored(made, "sketches")
    fps = rows.filter("fp <> 0").groupBy("fp").agg(F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("s0", "s1", "bands")))
    fps = stored(fps, "fps")
    met = stored(_met(fps), "met")
    links = stored(_fingerprint_links(rows.select("fp", "sim")), "fingerprint-links") if fingerprints else None
    # Each set meets its nearest and the nearest typical set of its buckets first, then again of other
    # classes, then all that is left between classes; sets that are linked already need not meet.
    source, reps, roots = given.select("row", "text"), fps.select("fp", "row"), None
    for _ in range(ROUNDS):
        roots = roots if links is None else stored(components(links), "roots")
        sure = verified(source, reps, stored(_proposed(met, roots, least), "proposed"), words, least)
        links = sure if links is None else links.union(sure)
    roots = roots if links is None else stored(components(links), "roots")
    rest = _left(source, reps, met, roots, words, least)
    links = rest if links is None else links.union(rest)
    discard(fps, met)
    return classes(rows.select("doc_id", "fp"), links)
