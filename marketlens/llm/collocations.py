"""Phrase collocations from truncated suffix subtrees, built group by group of word prefixes.

The suffixes of a language's text, word by word and cut at three words, are dealt out by their
prefix: one word, or two or three where fewer words are too frequent for one group. Each group then
holds whole subtrees, which are built by themselves as sorted paths with the number of leaves
below, and every phrase's count is the total of the leaves under its node.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.operators.skew import salted_join
from marketlens.session import fits_broadcast, stored

LEAST = 10  # occurrences of a candidate
TOP = 2000  # phrases returned for a language
COVERED = 50  # percent of a candidate's occurrences inside a longer one from which it goes
CHUNK_BYTES = 16 << 20  # text whose suffixes are counted together before they are sent
GROUP_SUFFIXES = 1_000_000  # suffixes of a group: what one subtree is built from
HELD_SUFFIXES = 500_000  # suffixes read before they are merged into the subtree
PACK_ROWS = 8192  # suffixes in one row
HOT_SHARE = 2.0**-15  # of all words: a prefix with as many may be too frequent for one group
SALTS = 64  # parts of a language whose best phrases are found first
UNKNOWN = "und"

# The characters between words, and those between pieces.
GAPS = b"\x20\x09"
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"

IS_BREAK = np.zeros(256, bool)
IS_BREAK[list(BREAKS)] = True
IN_WORD = ~IS_BREAK
IN_WORD[list(GAPS)] = False

_MUL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * _MUL)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(31))


def _hashed(words: pa.Array) -> np.ndarray:
    """Hash of each of the words, a binary array with 64-bit offsets."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return tb.xxh64(raw, at[:-1], np.diff(at))


@dataclass
class Suffixes:
    """Distinct suffixes of at most three words in ascending order, with their numbers; words and
    languages are numbered as in ``words`` and ``langs``, 0 stands for no word."""

    langs: pa.Array
    words: pa.Array  # binary; word i has number i + 1
    rows: np.ndarray  # language, first, second, third word
    count: np.ndarray


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _grouped(cols: list, sizes: list, count: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of numbers below ``sizes`` in ascending order, and how often they occur."""
    if float(np.prod([float(n) for n in sizes])) < 2.0**62:
        key = cols[0]
        for c, n in zip(cols[1:], sizes[1:]):
            key = key * n + c
        if count is None:
            key = np.sort(key)
        else:
            order = np.argsort(key)
            key, count = key[order], count[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.diff(np.append(new, len(key))) if count is None else np.add.reduceat(count, new) if len(new) else count
        key, out = key[new], []
        for n in reversed(sizes[1:]):
            key, last = np.divmod(key, n)
            out.append(last)
        return np.stack([key, *reversed(out)]), total
    # Too many to number in 64 bits: the first columns' distinct values are numbered first.
    lead, of = np.unique(np.stack(cols[:2]), axis=1, return_inverse=True)
    rows, total = _grouped([of.ravel(), *cols[2:]], [lead.shape[1], *sizes[2:]], count)
    return np.vstack([lead[:, rows[0]], rows[1:]]), total


def _merged(langs: pa.Array, words: pa.Array, rows: np.ndarray, count: np.ndarray) -> Suffixes:
    """Equal suffixes as one; equal words and languages get one number first."""
    langs, words = langs.dictionary_encode(), words.dictionary_encode()
    word = np.concatenate([[0], _numbers(words.indices) + 1])
    size = len(words.dictionary) + 1
    cols = [_numbers(langs.indices)[rows[0]], *(word[r] for r in rows[1:])]
    rows, total = _grouped(cols, [len(langs.dictionary), size, size, size], count)
    return Suffixes(langs.dictionary, words.dictionary, rows, total)


@dataclass
class Words:
    """Words of a chunk in order: their numbers, languages (as numbers) and pieces."""

    langs: pa.Array
    words: pa.Array
    at: np.ndarray
    lang: np.ndarray
    piece: np.ndarray


def _words(langs: pa.Array, texts: pa.Array) -> Words:
    data, offsets = tb.texts(texts)
    data = tb.LOWER[data]
    start, end, first = tb.word_spans(data, offsets, IN_WORD)
    edge = IS_BREAK[data]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    piece = np.cumsum(edge, dtype=np.int32)[start] if len(start) else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    body = np.ascontiguousarray(data[IN_WORD[data]])
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
    langs = pc.fill_null(langs.cast(pa.large_binary()), UNKNOWN.encode()).dictionary_encode()
    lang = np.repeat(_numbers(langs.indices), np.diff(first))
    return Words(langs.dictionary, words.dictionary, _numbers(words.indices) + 1, lang, piece)


def _following(w: Words, by: int) -> np.ndarray:
    """The word ``by`` places on in the same piece, 0 where there is none."""
    out = np.zeros(len(w.at), np.int64)
    if len(out) > by:
        out[:-by] = np.where(w.piece[by:] == w.piece[:-by], w.at[by:], 0)
    return out


def suffixes(langs: pa.Array, texts: pa.Array) -> Suffixes:
    """The truncated suffixes that begin at each word, within their piece."""
    w = _words(langs, texts)
    size = len(w.words) + 1
    rows, count = _grouped([w.lang, w.at, _following(w, 1), _following(w, 2)], [len(w.langs), size, size, size], None)
    return Suffixes(w.langs, w.words, rows, count)


class Hashes:
    """Hashes of prefixes: language and first word, and with one word more."""

    def __init__(self, langs: pa.Array, words: pa.Array):
        self.lang = _hashed(langs)
        self.word = np.concatenate([np.zeros(1, np.uint64), _hashed(words)])

    def of(self, lang: np.ndarray, *words: np.ndarray) -> np.ndarray:
        h = self.lang[lang]
        for w in words:
            h = _mixed(h, self.word[w])
        return h


def _in_sorted(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), bool)
    return keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h


def _prefix_counts(batches):
    """(prefix, lang, n): of each chunk the prefixes of one and two words with a good share of its
    words, and under prefix 0 all words of each language."""
    for batch in tb.chunks(batches, limit=CHUNK_BYTES):
        w = _words(batch.column("lang"), batch.column("text"))
        if not len(w.at):
            continue
        least = max(2, int(len(w.at) * HOT_SHARE / 2))
        size, hashes = len(w.words) + 1, Hashes(w.langs, w.words)
        one, of = np.unique(w.lang * size + w.at, return_inverse=True)
        n1 = np.bincount(of)
        often = np.flatnonzero((n1 >= least)[of])  # only what begins with a frequent word can be frequent
        two, n2 = _grouped([w.lang[often], w.at[often], _following(w, 1)[often]], [len(w.langs), size, size], None)
        two, n2 = two[:, (two[2] > 0) & (n2 >= least)], n2[(two[2] > 0) & (n2 >= least)]
        one, n1 = one[n1 >= least], n1[n1 >= least]
        keys = [hashes.of(one // size, one % size), hashes.of(*two), np.zeros(len(w.langs), np.uint64)]
        langs = pa.concat_arrays([pa.nulls(len(one) + len(n2), pa.large_binary()), w.langs])
        n = np.concatenate([n1, n2, np.bincount(w.lang, minlength=len(w.langs))]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), _strings(langs), pa.array(n)], names=["prefix", "lang", "n"])


def _strings(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).cast(pa.string())


@dataclass
class Partition:
    """How prefixes are dealt out: number of groups, and the prefixes too frequent for one."""

    groups: int
    hot: np.ndarray

    def split(self, found: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Group of each suffix, and whether its first word and its first two are spread over groups."""
        hashes = Hashes(found.langs, found.words)
        key = hashes.of(*found.rows[:2])
        hot1 = _in_sorted(self.hot, key)
        hot2 = np.zeros(len(key), bool)
        at = np.flatnonzero(hot1)
        key[at] = _mixed(key[at], hashes.word[found.rows[2, at]])
        at = at[_in_sorted(self.hot, key[at])]
        hot2[at] = True
        key[at] = _mixed(key[at], hashes.word[found.rows[3, at]])
        return (key % np.uint64(self.groups)).astype(np.int64), hot1, hot2


def partition(rows: DataFrame, budget: int = GROUP_SUFFIXES) -> tuple[Partition, DataFrame]:
    """Prefixes grouped by a budget of suffixes, and ``(lang, n)``, the words of each language.

    A prefix is hot, and its suffixes are told apart by one word more, if it has over half the
    budget and at least ``HOT_SHARE`` of all words, so that there are at most ``2 / HOT_SHARE`` of
    them. Only the layout depends on this, no count does."""
    counted = rows.mapInArrow(_prefix_counts, "prefix long, lang string, n long").groupBy("prefix", "lang").agg(F.sum("n").alias("n"))
    counted = stored(counted, "prefixes")
    words = counted.filter("lang IS NOT NULL").select("lang", "n")
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 0
    least = max(budget // 2, int(total * HOT_SHARE))
    hot = counted.filter(F.col("lang").isNull() & (F.col("n") >= least)).select("prefix").toArrow().column(0).to_numpy()
    return Partition(int(-(-total // budget)) or 1, np.sort(hot.view(np.uint64))), words


def _packed(found: Suffixes, rows: np.ndarray) -> list:
    """Some suffixes of one language as one row: its words, and the numbers in them."""
    parts = pa.array(found.rows[1:, rows].ravel()).dictionary_encode()
    used, at = _numbers(parts.dictionary), _numbers(parts.indices)
    zero = np.flatnonzero(used == 0)
    if len(zero):  # no word keeps the number 0
        at = np.where(at == zero[0], 0, at + (at < zero[0]))
        used = np.delete(used, zero[0])
    else:
        at = at + 1
    words = found.words.take(pa.array(used - 1))
    words = pc.binary_join(pa.LargeListArray.from_arrays([0, len(words)], words), pa.scalar(b" ", words.type))
    count = found.count[rows]
    wide = "<u1" if count.max() < 256 else "<u4" if count.max() < 1 << 32 else "<u8"
    return [words[0].as_py(), at.astype("<u2" if len(used) < 65535 else "<u4").tobytes(), count.astype(wide).tobytes()]


SENT = "grp long, lang string, suffixes int, words binary, paths binary, counts binary"


def _sent(batches, how: Partition):
    """Each chunk's suffixes packed by group and language."""
    names = [x.split()[0] for x in SENT.split(", ")]
    for batch in tb.chunks(batches, limit=CHUNK_BYTES):
        found = suffixes(batch.column("lang"), batch.column("text"))
        if not len(found.count):
            continue
        group, lang = how.split(found)[0], found.rows[0]
        key = group * len(found.langs) + lang
        order = np.argsort(key.astype(np.min_scalar_type(how.groups * len(found.langs))), kind="stable")  # suffixes stay in their order
        cut = np.flatnonzero(np.diff(key[order])) + 1
        out = []
        for part in np.split(order, cut):
            for lo in range(0, len(part), PACK_ROWS):
                piece = part[lo : lo + PACK_ROWS]
                out.append([int(group[piece[0]]), found.langs[int(lang[piece[0]])].as_py().decode(), len(piece), *_packed(found, piece)])
        for lo in range(0, len(out), 256):
            cols = list(zip(*out[lo : lo + 256]))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def _unpacked(rows: pa.RecordBatch) -> Suffixes:
    """Rows of :func:`_packed` as one set of suffixes, with equal ones merged."""
    words = pc.split_pattern(rows.column("words").cast(pa.large_binary()), b" ")
    before = np.cumsum(_numbers(pc.list_value_length(words)))
    paths, counts = [], []
    for i, (n, path, count) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("suffixes", "paths", "counts")))):
        path = np.frombuffer(path, f"<u{len(path) // (3 * n)}").reshape(3, n).astype(np.int64)
        paths.append(np.vstack([np.full((1, n), i), np.where(path > 0, path + (before[i - 1] if i else 0), 0)]))
        counts.append(np.frombuffer(count, f"<u{len(count) // n}").astype(np.int64))
    return _merged(rows.column("lang").cast(pa.large_binary()), words.flatten(), np.hstack(paths), np.concatenate(counts))


def _joined(a: Suffixes | None, b: Suffixes) -> Suffixes:
    if a is None:
        return b
    moved = b.rows.copy()
    moved[0] += len(a.langs)
    moved[1:][moved[1:] > 0] += len(a.words)
    return _merged(pa.concat_arrays([a.langs, b.langs]), pa.concat_arrays([a.words, b.words]), np.hstack([a.rows, moved]), np.concatenate([a.count, b.count]))


NODES = "lang string, w1 string, w2 string, w3 string, f long, part boolean"


def _nodes(tree: Suffixes, how: Partition, least: int):
    """The nodes of a subtree: a phrase of one to three words and the leaves under it. Of a prefix
    that other groups share any number counts (``part``), of others ``least`` or more."""
    _, hot1, hot2 = how.split(tree)
    shared = [hot1, hot2, np.zeros(len(hot1), bool)]
    new = np.zeros(len(hot1), bool)  # a suffix that begins a node; those under a node are a run
    new[0] = True
    new[1:] = tree.rows[0, 1:] != tree.rows[0, :-1]
    for depth in (1, 2, 3):
        new[1:] |= tree.rows[depth, 1:] != tree.rows[depth, :-1]
        at = np.flatnonzero(new)
        f = np.add.reduceat(tree.count, at)
        part = shared[depth - 1][at]
        keep = (tree.rows[depth, at] > 0) & (part | (f >= least))
        at, f, part = at[keep], f[keep], part[keep]
        if not len(at):
            continue
        words = [_strings(tree.words.take(pa.array(tree.rows[j, at] - 1))) if j <= depth else pa.nulls(len(at), pa.string()) for j in (1, 2, 3)]
        yield pa.RecordBatch.from_arrays(
            [_strings(tree.langs.take(pa.array(tree.rows[0, at]))), *words, pa.array(f), pa.array(part)], names=[x.split()[0] for x in NODES.split(", ")])


def _pieces(batches, most: int):
    """(group, rows): the rows of a group in pieces of about ``most`` suffixes."""
    for batch in batches:
        group, size = batch.column("grp").to_numpy(), np.cumsum(batch.column("suffixes").to_numpy().astype(np.int64))
        lo = 0
        while lo < len(group):
            hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right"))
            hi = min(max(hi, lo + 1), int(np.searchsorted(group, group[lo], "right")))
            yield int(group[lo]), batch.slice(lo, hi - lo)
            lo = hi


def _subtrees(batches, how: Partition, least: int, held_rows: int):
    """Packed suffixes sorted by group to the nodes of each group's subtrees.

    What is read is merged into the subtree piece by piece, so a task holds the distinct suffixes
    of a group, however often they occur."""
    group, tree = None, None
    for now, rows in _pieces(batches, held_rows):
        if now != group and tree is not None:
            yield from _nodes(tree, how, least)
            tree = None
        group, tree = now, _joined(tree, _unpacked(rows))
    if tree is not None:
        yield from _nodes(tree, how, least)


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST,
                  budget: int = GROUP_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """``(lang, w1, w2, w3, f)``, every phrase of one to three words with ``least`` or more
    occurrences in its language, and ``(lang, n)``, each language's words."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).filter("text IS NOT NULL")
    how, words = partition(rows, budget)
    shared = docs.sparkSession.sparkContext.broadcast(how)  # at most 2 / HOT_SHARE prefixes
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = HELD_SUFFIXES
    sent = rows.mapInArrow(lambda batches: _sent(batches, shared.value), SENT)
    sent = sent.repartition(parts, "grp").sortWithinPartitions("grp")
    nodes = stored(sent.mapInArrow(lambda batches: _subtrees(batches, shared.value, least, held), NODES), "nodes")
    spread = nodes.filter("part").groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(nodes.filter("NOT part").drop("part").unionByName(spread), "counts"), words


def _met(large: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """Join with a side unique by key; a word or pair in many phrases is split over tasks."""
    if fits_broadcast(small):
        return large.join(F.broadcast(small), keys)
    return salted_join(large, small, keys, salt_by=[c for c in large.columns if c not in keys], hot_pairs=4_000_000)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP,
                 covered: int = COVERED, budget: int = GROUP_SUFFIXES) -> DataFrame:
    """Per language its ``top`` phrases of two or three words: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends and the pieces
    into words at blanks and tabs; a phrase lies within a piece and counts wherever it occurs, also
    overlapping itself. A candidate occurs ``least`` times (``a``) or more. It is cut in two where
    ``1000000 a a / (l r)``, rounded down, is least, after the fewest words among ties; ``l`` and
    ``r`` are the counts of the two parts and ``n`` that of all words of the language. Candidates
    inside a longer one that has ``covered`` percent of their occurrences or more are left out.
    Order: score, then ``a``, both descending, then the phrase by its bytes.

    A null language is ``und``; a null or empty text has no words; repeated rows count each. No
    word is cut or dropped however long a text is. Empty tables give an empty result. Numbers are
    exact: scores are worked out in decimals of 38 digits, enough for ``a`` below 10^15."""
    counts, words = phrase_counts(docs, lang, text, least, budget)
    score = lambda a, l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * (cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)))) div (cast({l} as decimal(15,0)) * cast({r} as decimal(15,0)))")
    one = counts.filter("w2 IS NULL").select("lang", "w1", "f")
    two = counts.filter("w2 IS NOT NULL AND w3 IS NULL").select("lang", "w1", "w2", "f")
    three = stored(counts.filter("w3 IS NOT NULL").select("lang", "w1", "w2", "w3", "f"), "three")
    pairs = _met(two, one.select("lang", "w1", F.col("f").alias("l")), ["lang", "w1"])
    pairs = stored(_met(pairs, one.select("lang", F.col("w1").alias("w2"), F.col("f").alias("r")), ["lang", "w2"]), "pairs")

    head = pairs.select("lang", "w1", "w2", F.col("f").alias("l2"), F.col("l").alias("l1"))
    tail = pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r1"), F.col("r").alias("r2"))
    triples = _met(_met(three, head, ["lang", "w1", "w2"]), tail, ["lang", "w2", "w3"])
    triples = triples.select("*", score("f", "l1", "r1").alias("s1"), score("f", "l2", "r2").alias("s2"))
    first = F.col("s1") <= F.col("s2")
    long = triples.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"), F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))

    inside = three.select("lang", "w1", "w2", "f").union(three.select("lang", "w2", "w3", "f"))
    inside = inside.groupBy("lang", "w1", "w2").agg(F.max("f").alias("most"))
    free = pairs.join(inside, ["lang", "w1", "w2"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("f")))
    short = free.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"), "l", "r", score("f", "l", "r").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = short.unionByName(long).withColumn("salt", salt)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(F.broadcast(words), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
