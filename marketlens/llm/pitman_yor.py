"""Language-model scores of documents: a hierarchical Pitman-Yor model of words in context.

``score`` has a restaurant for every whole word before, see ``word_contexts``; its parent is the
restaurant of single words. What both models share is here: tokens, seats, packed numbers.

``score_by_class`` is the coarser model, with a restaurant for every class of the word before.
Counts cover the whole corpus, so nothing of it is broadcast but the totals of its restaurants,
whose number is fixed. Documents do not travel either: a task turns its texts into blocks, a
block asks for each of its distinct words once, and answers come back by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.session import stored

CLASS_BITS = 10
CLASSES = 1 << CLASS_BITS  # context restaurants: classes of the previous word, by its hash
BLOCK_TOKENS = 4_000_000  # tokens of a block; a longer text makes a longer one
SWEEPS, BURN_IN = 5, 2
END = np.uint64(xxhash.xxh64_intdigest(b"\n", 42))  # no word, as words hold no white space


@dataclass
class Prior:
    """Discounts and strengths of the context restaurants and of the root."""

    discount: float = 0.8
    strength: float = 50.0
    root_discount: float = 0.8
    root_strength: float = 100.0


def _packed(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpacked(raw: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(dtype).ravel()


def _bundle(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _unbundled(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    at = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(raw[8 : 8 * (n + 1)], "<i8"))])
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _squeezed(x: np.ndarray) -> bytes:
    """Packed if there is enough to pack; the first byte tells."""
    return b"\1" + _packed(x) if len(x) >= 64 else b"\0" + x.tobytes()


def _loose(raw: bytes, dtype: str) -> np.ndarray:
    return _unpacked(raw[1:], dtype) if raw[0] else np.frombuffer(raw[1:], dtype)


def _ragged(data: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary column whose rows are the stretches of ``data`` that begin at ``first``."""
    offsets = (first * data.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _flat(column: pa.Array, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column in a row, and how many each row has (null: none)."""
    column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.copy().view(dtype), np.diff(at) // np.dtype(dtype).itemsize


def _slices(columns: list, names: list[str], step: int = 50_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for lo in range(0, whole.num_rows, step):
        yield whole.slice(lo, step)


# ---------------------------------------------------------------------------------------------
# Blocks

BLOCKS = "block long, texts binary, words binary, sizes binary, classes binary, counts binary"
NUMBER_BITS = 28  # of a word's number in its block; with the block's they make a place


def token_parts(batches):
    """Of some documents at once: ids, whether there is one, whether held out, numbers of tokens, and
    the tokens' hashes with an end after each document."""
    for batch in tb.chunks(batches):
        data, offsets = tb.texts(batch.column("text"))
        data = tb.LOWER[data]
        start, end, first = tb.word_spans(data, offsets, tb.NOT_SPACE)
        n = np.diff(first)
        tokens = np.insert(tb.word_hashes(data, start, end), first[1:], END)
        ids = batch.column("doc_id")
        yield ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), batch.column("held_out").to_numpy(zero_copy_only=False), n + 1, tokens


def _blocks(batches, block_tokens: int):
    """One row per block: its documents, each token as a number of a (word, class) cell, and its
    cells with their counts in documents that are learned from."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 12
    held, size = [], 0
    for part in token_parts(batches):
        held.append(part)
        size += len(part[-1])
        if size >= block_tokens:
            yield _block(block, held)
            block, held, size = block + 1, [], 0
    if held:
        yield _block(block, held)


def _block(block: int, parts: list) -> pa.RecordBatch:
    ids, known, held, lengths, tokens = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    classes = (np.concatenate([[END], tokens[:-1]]) >> np.uint64(64 - CLASS_BITS)).astype(np.uint16)
    words, number, times = np.unique(tokens, return_inverse=True, return_counts=True)
    del tokens
    by_use = np.argsort(-times, kind="stable")  # frequent words get small numbers, which pack well
    rank = np.empty(len(words), np.int64)
    rank[by_use] = np.arange(len(words)) << CLASS_BITS
    words = words[by_use]
    number = rank[number]
    number |= classes
    del classes
    cells, number = np.unique(number, return_inverse=True)
    counts = np.bincount(number, np.repeat(~held, lengths), len(cells)).astype(np.uint32)
    sizes = np.bincount(cells >> CLASS_BITS, minlength=len(words)).astype(np.uint32)
    texts = _bundle([_packed(x) for x in (ids.astype(np.int64), known.astype(np.uint8), held.astype(np.uint8), lengths.astype(np.int64), number.astype(np.uint32))])
    columns = [words, sizes, (cells & (CLASSES - 1)).astype(np.uint16), counts]
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), pa.array([texts], pa.binary()), *(pa.array([_packed(x)], pa.binary()) for x in columns)], names=[x.split()[0] for x in BLOCKS.split(", ")])


def _requests(batches):
    """A row for each block and word: the classes it stands in there and its counts."""
    for batch in batches:
        for block, words, sizes, classes, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "sizes", "classes", "counts"))):
            words = _unpacked(words, "<u8")
            first = np.concatenate([[0], np.cumsum(_unpacked(sizes, "<u4"))])
            yield from _slices(
                [pa.array(words.view(np.int64)), pa.array((block << NUMBER_BITS) + np.arange(len(words))),
                 _ragged(_unpacked(classes, "<u2"), first), _ragged(_unpacked(counts, "<u4"), first)],
                ["word", "place", "classes", "counts"])


# ---------------------------------------------------------------------------------------------
# The model

WORDS = "word long, classes binary, counts binary"


def _words(batches):
    """Requests sorted by word to one row per word that was learned: its classes and counts.

    A word's requests may fill many batches; only its sums are held."""
    held_word, held = None, None
    for batch in batches:
        word = batch.column("word").to_numpy()
        if not len(word):
            continue
        classes, n = _flat(batch.column("classes"), "<u2")
        counts, _ = _flat(batch.column("counts"), "<u4")
        begin = np.concatenate([[True], word[1:] != word[:-1]])
        which = np.cumsum(begin) - 1
        words = word[begin]
        cell, at = np.unique(np.repeat(which, n) * CLASSES + classes, return_inverse=True)
        total = np.bincount(at, counts, len(cell)).astype(np.int64)
        if held_word is not None and words[0] != held_word:
            yield from _word_rows(np.array([held_word]), np.flatnonzero(held), held[held > 0])
            held_word = None
        if held_word is not None:
            own = cell < CLASSES
            held[cell[own]] += total[own]
            cell, total = np.concatenate([np.flatnonzero(held), cell[~own]]), np.concatenate([held[held > 0], total[~own]])
        last = (len(words) - 1) * CLASSES
        tail = cell >= last
        held = np.zeros(CLASSES, np.int64)
        held[cell[tail] - last] = total[tail]
        held_word = words[-1]
        yield from _word_rows(words[:-1], cell[~tail], total[~tail])
    if held_word is not None:
        yield from _word_rows(np.array([held_word]), np.flatnonzero(held), held[held > 0])


def _word_rows(words, cell, total):
    cell, total = cell[total > 0], total[total > 0]
    has = np.bincount(cell // CLASSES, minlength=len(words))
    first = np.concatenate([[0], np.cumsum(has[has > 0])])
    yield from _slices(
        [pa.array(words[has > 0]), _ragged((cell % CLASSES).astype("<u2"), first), _ragged(total.astype("<u8"), first)],
        ["word", "classes", "counts"])


def _uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the key and the turn only, so that every run and every
    retry of a task seats customers alike."""
    x = key + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def seated(customers: np.ndarray, discount: float, opens: np.ndarray, key: np.ndarray, turn: int) -> np.ndarray:
    """Tables of each cell after its customers took seats one after another, given all others.

    A customer opens a table with weight ``opens`` (what the restaurant gives to new tables of
    the word) against ``seated - discount * tables``. Beyond eight, customers of a large cell
    come in groups of an eighth of those seated, whose new tables are drawn together."""
    tables = np.minimum(customers, 1).astype(np.float64)
    seats = tables.copy()
    open_ = np.flatnonzero(customers > 1)
    step = 0
    while len(open_):
        n, t = seats[open_], tables[open_]
        group = np.minimum(np.maximum(1, n // 8), customers[open_] - n)
        p = opens[open_] / (opens[open_] + n - discount * t)
        new = np.minimum(np.floor(group * p + _uniform(key[open_], turn * 4096 + step)), group)
        tables[open_] += new
        seats[open_] += group
        open_ = open_[seats[open_] < customers[open_]]
        step += 1
    return tables


@dataclass
class Totals:
    """Of the restaurants after a sweep: tables by class, customers and tables of the root."""

    tables: np.ndarray
    root_customers: float
    root_tables: float


class Cells:
    """The cells of some whole words, seated anew sweep by sweep."""

    def __init__(self, batch: pa.RecordBatch, prior: Prior, kinds: int):
        self.word = batch.column("word").to_numpy().view(np.uint64)
        self.classes, self.size = _flat(batch.column("classes"), "<u2")
        counts, _ = _flat(batch.column("counts"), "<u8")
        self.counts = counts.astype(np.float64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.of = np.repeat(np.arange(len(self.word)), self.size)
        self.key = self.word[self.of] * np.uint64(0xD6E8FEB86659FD93) + self.classes
        self.prior, self.even = prior, 1.0 / (kinds + 1)
        self.tables = np.ones(len(self.counts))
        self.root = np.ones(len(self.word))

    def root_prob(self, totals: Totals) -> np.ndarray:
        p = self.prior
        mine = tb.sums_by(self.tables, self.first) - p.root_discount * self.root
        return (mine + (p.root_strength + p.root_discount * totals.root_tables) * self.even) / (totals.root_customers + p.root_strength)

    def sweep(self, totals: Totals, turn: int) -> None:
        p = self.prior
        opens = (p.strength + p.discount * totals.tables[self.classes]) * self.root_prob(totals)[self.of]
        self.tables = seated(self.counts, p.discount, opens, self.key, 2 * turn)
        each = np.full(len(self.word), (p.root_strength + p.root_discount * totals.root_tables) * self.even)
        self.root = seated(tb.sums_by(self.tables, self.first), p.root_discount, each, self.word, 2 * turn + 1)


def _totals_of(batches, prior: Prior, kinds: int, before: list[Totals]):
    """Sums of this task's cells after the sweeps that ``before`` allows."""
    tables, customers, root = np.zeros(CLASSES), 0.0, 0.0
    for batch in batches:
        cells = Cells(batch, prior, kinds)
        for turn, totals in enumerate(before):
            cells.sweep(totals, turn)
        tables += np.bincount(cells.classes, cells.tables, CLASSES)
        customers += cells.tables.sum()
        root += cells.root.sum()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(CLASSES + 2)), pa.array(np.concatenate([tables, [customers, root]]))], names=["part", "n"])


def _sums(df: DataFrame, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in df.groupBy("part").agg(F.sum("n").alias("n")).collect():  # one row per restaurant
        out[r["part"]] = r["n"]
    return out


@dataclass
class Model:
    """What all tasks know: totals of the kept sweeps, customers by class, and corpus counts."""

    prior: Prior
    kinds: int
    tokens: int
    customers: np.ndarray
    before: list[Totals]

    @property
    def kept(self) -> list[Totals]:
        return self.before[BURN_IN:]

    def backing(self) -> np.ndarray:
        """By kept sweep and class, the weight that the parent's probability gets."""
        p = self.prior
        return np.array([(p.strength + p.discount * t.tables) / (p.strength + self.customers) for t in self.kept])

    def unknown(self) -> np.ndarray:
        p = self.prior
        return np.array([(p.root_strength + p.root_discount * t.root_tables) / (self.kinds + 1) / (t.root_customers + p.root_strength) for t in self.kept])


def fit(words: DataFrame, prior: Prior, sweeps: int = SWEEPS) -> Model:
    """Seats all customers ``sweeps`` times.

    A sweep seats each cell's customers given the tables of all other cells after the sweep
    before, so tasks need only the restaurants' totals; a task repeats earlier sweeps instead of
    storing them. Predictions are averaged over the sweeps after the first ones."""

    def counted(batches):
        n, kinds, total = np.zeros(CLASSES), 0, 0
        for batch in batches:
            classes, _ = _flat(batch.column("classes"), "<u2")
            counts, _ = _flat(batch.column("counts"), "<u8")
            n += np.bincount(classes, counts, CLASSES)
            kinds, total = kinds + batch.num_rows, total + int(counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES + 2)), pa.array(np.concatenate([n, [kinds, total]]))], names=["part", "n"])

    sums = _sums(words.mapInArrow(counted, "part long, n double"), CLASSES + 2)
    customers, kinds, tokens = sums[:CLASSES], int(sums[CLASSES]), int(sums[CLASSES + 1])
    before: list[Totals] = []
    for _ in range(sweeps):
        done = list(before)
        sums = _sums(words.mapInArrow(lambda batches, done=done: _totals_of(batches, prior, kinds, done), "part long, n double"), CLASSES + 2)
        before.append(Totals(sums[:CLASSES], sums[CLASSES], sums[CLASSES + 1]))
    return Model(prior, kinds, tokens, customers, before)


def _word_model(batches, model: Model):
    """Per word: its count, the root's probability in each kept sweep, and its seen cells'
    probabilities beyond what the root gives, averaged over the kept sweeps."""
    for batch in batches:
        cells = Cells(batch, model.prior, model.kinds)
        own, roots = np.zeros(len(cells.counts)), []
        for turn, totals in enumerate(model.before):
            if turn >= BURN_IN:
                roots.append(cells.root_prob(totals))
                own += (cells.counts - model.prior.discount * cells.tables) / (model.prior.strength + model.customers[cells.classes]) / len(model.kept)
            cells.sweep(totals, turn)
        count = tb.sums_by(cells.counts, cells.first).astype(np.int64)
        roots = np.ascontiguousarray(np.array(roots).T.astype("<f4")).ravel()
        yield pa.RecordBatch.from_arrays(
            [batch.column("word"), pa.array(count), _ragged(roots, np.arange(len(count) + 1) * len(model.kept)),
             _ragged(cells.classes.astype("<u2"), cells.first), _ragged(own.astype("<f4"), cells.first)],
            names=["word", "count", "roots", "seen", "own"])


def _answers(batches, model: Model):
    """Per block the answers to a batch of its requests: the words' numbers and counts, and the
    log10 probability of each of their cells."""
    backing, unknown = model.backing(), model.unknown()
    for batch in batches:
        if not batch.num_rows:
            continue
        classes, n = _flat(batch.column("classes"), "<u2")
        seen, m = _flat(batch.column("seen"), "<u2")
        own, _ = _flat(batch.column("own"), "<f4")
        known = batch.column("roots").is_valid().to_numpy(zero_copy_only=False)
        roots = np.tile(unknown, (len(known), 1))
        roots[known] = _flat(batch.column("roots"), "<f4")[0].reshape(-1, len(unknown))
        row = np.repeat(np.arange(len(n)), n)
        p = (roots[row] * backing[:, classes].T).mean(axis=1)
        keys = np.repeat(np.arange(len(m)), m) * CLASSES + seen
        want = row * CLASSES + classes
        place = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
        if len(keys):
            p += np.where(keys[place] == want, own[place], 0.0)
        logs = np.log10(p).astype("<f4")
        place = batch.column("place").to_numpy()
        count = batch.column("count").fill_null(0).to_numpy()
        order = np.argsort(place, kind="stable")
        logs = logs[np.argsort(place[row], kind="stable")]
        place, count, n = place[order], count[order], n[order]
        blocks, first = np.unique(place >> NUMBER_BITS, return_index=True)
        cell = np.concatenate([[0], np.cumsum(n)])
        cuts = [*first, len(place)]
        data = [
            _bundle([_squeezed(x) for x in (
                np.diff(place[a:b] & ((1 << NUMBER_BITS) - 1), prepend=0).astype("<u4"), count[a:b].astype("<i8"), n[a:b].astype("<u2"), logs[cell[a] : cell[b]])])
            for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([None] * len(data), pa.binary()), pa.array(data, pa.binary())], names=["block", "texts", "answers"])


# ---------------------------------------------------------------------------------------------
# The documents

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(batches, model: Model):
    """The answers of a block, then its documents, to document scores."""
    block, held = None, []
    for batch in batches:
        for now, texts, answers in zip(*(batch.column(c) for c in ("block", "texts", "answers"))):
            if now.as_py() != block:
                block, held = now.as_py(), []
            if answers.is_valid:
                held.append([_loose(x, t) for x, t in zip(_unbundled(answers.as_py()), ("<u4", "<i8", "<u2", "<f4"))])
                held[-1][0] = np.cumsum(held[-1][0])  # numbers travel as steps
            else:
                yield _block_scores(_unbundled(texts.as_py()), held, model)
                held = []


def _block_scores(texts: list[bytes], answers: list, model: Model) -> pa.RecordBatch:
    number, count, size, logs = (np.concatenate(x) for x in zip(*answers))
    answers.clear()
    by_cell = np.argsort(np.repeat(number, size), kind="stable")
    logs = logs[by_cell].astype(np.float64)
    count = np.repeat(count, size)[by_cell]
    ids, known, held, lengths, tokens = (_unpacked(x, t) for x, t in zip(texts, ("<i8", "<u1", "<u1", "<i8", "<u4")))
    return document_scores(ids, known, held, lengths, tokens, count, logs, model)


def document_scores(ids, known, held, lengths, tokens, count, logs, model) -> pa.RecordBatch:
    """From documents as tokens that number cells, and their cells' counts and probabilities."""
    first = np.concatenate([[0], np.cumsum(lengths)])
    base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.kinds + 1)))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, mask=known == 0), pa.array(held == 1), pa.array(lengths),
        pa.array(tb.sums_by((count > 0).astype(np.int32)[tokens], first).astype(np.int64)), pa.array(np.full(len(lengths), model.tokens)),
        pa.array(tb.sums_by(base[tokens], first)), pa.array(tb.sums_by(logs[tokens], first)),
    ], names=[x.split()[0] for x in SCORES.split(", ")])


def _body(docs: DataFrame, held_out: Column, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", prior: Prior | None = None, sweeps: int = SWEEPS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``, the last the model's log10 probability of the text.

    The context of a word is the whole word before it; each has a restaurant of its own.
    Learned from are the rows for which ``held_out`` is not true. Tokens are runs of characters
    other than white space, A-Z in lower case, and one end for each text, also an empty or null
    one. ``base_score`` smooths single words by 0.1. All words that were not learned count as one
    kind, in either score. Perplexity of a text is 10 to the power of ``-score / n_tokens``.

    Words are told apart by a 64-bit hash. An empty table gives an empty result; if nothing is
    learned from, every token has the probability of the unknown kind."""
    from marketlens.llm import word_contexts

    return word_contexts.score(_body(docs, held_out, doc_id, text), prior or Prior(), sweeps, block_tokens)


def score_by_class(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", prior: Prior | None = None, sweeps: int = SWEEPS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """As :func:`score`, with words before told apart only by ``CLASS_BITS`` of their hash, which is
    coarser and takes less disk. No query uses it."""
    prior = prior or Prior()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = stored(_body(docs, held_out, doc_id, text).mapInArrow(lambda batches: _blocks(batches, block_tokens), BLOCKS), "blocks")
    requests = blocks.select("block", "words", "sizes", "classes", "counts").mapInArrow(
        _requests, "word long, place long, classes binary, counts binary")
    learned = requests.select("word", "classes", "counts").repartition(parts, "word").sortWithinPartitions("word")
    words = stored(learned.mapInArrow(_words, WORDS), "words")
    model = fit(words, prior, sweeps)
    known = words.mapInArrow(lambda batches: _word_model(batches, model), "word long, count long, roots binary, seen binary, own binary")
    answers = requests.drop("counts").join(known, "word", "left").mapInArrow(lambda batches: _answers(batches, model), "block long, texts binary, answers binary")
    met = answers.union(blocks.select("block", "texts", F.lit(None).cast("binary").alias("answers")))
    ordered = met.repartition(parts, "block").sortWithinPartitions("block", F.col("texts").isNotNull())
    return ordered.mapInArrow(lambda batches: _scores(batches, model), SCORES)
