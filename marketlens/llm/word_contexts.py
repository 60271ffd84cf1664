"""The Pitman-Yor model whose context restaurants are whole words before: one for every distinct word.

Cells, a word after a word, are dealt out on a grid: the row is chosen by the word before, the column
by the word itself, so that a frequent word's cells lie in many groups. A group never holds the
totals of its words and contexts, since those lie in other groups as well: after every sweep it sends
the tables it added for them, and is told the sums. Only cells of two customers or more are seated
anew and only they are talked about; a cell of one customer always has one table.

What a word is called on the way is its rank among frequent words or its hash; no result depends on it.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm import pitman_yor as py
from marketlens.llm import textbytes as tb
from marketlens.session import discard, remove_folder, scratch_dir, stored

FREQUENT = 1 << 16  # words that get a short name
NAMED_FROM = 1 / 16  # rows in which frequent words are looked for
LONG = np.uint64(1 << 63)  # marks a name that is a hash

PIECES = "block long, grp int, data binary"
GROUPS = "grp int, hot binary, cells binary, asked binary"
NOTES = "part int, grp int, data binary"
TABLES = "part int, codes binary, base binary, counts binary, kinds long, tokens long"
SUMS = "grp int, part int, data binary, customers double, tables double"


@dataclass(frozen=True)
class Grid:
    """``side`` rows and columns of groups; the words of a column and the contexts of a row each
    have ``sub`` parts that add up for them."""

    side: int
    sub: int

    def row(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(33)) % np.uint64(self.side)).astype(np.int64)

    def column(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes & np.uint64((1 << 32) - 1)) % np.uint64(self.side)).astype(np.int64)

    def parts(self, group: int, words: np.ndarray, contexts: np.ndarray):
        """Each part that a group has to do with, whether for contexts, and which of these they are."""
        for kind, line, codes in ((0, group % self.side, words), (1, group // self.side, contexts)):
            own = (py._uniform(codes, 77) * self.sub).astype(np.int64)
            for j in range(self.sub):
                at = np.flatnonzero(own == j)
                if len(at):
                    yield (kind * self.side + line) * self.sub + j, kind, at

    def of_contexts(self, part: int) -> bool:
        return part >= self.side * self.sub


def _pack(*arrays: np.ndarray) -> bytes:
    return py._bundle([py._squeezed(np.ascontiguousarray(x)) for x in arrays])


def _unpack(raw: bytes, dtypes: str) -> list[np.ndarray]:
    return [py._loose(x, t) for x, t in zip(py._unbundled(raw), dtypes.split())]


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.table({n: pa.array(list(c), kinds[t]) for (n, t), c in zip(fields, columns)})


def _by_row(run, ddl: str):
    """A function of rows, as one of batches of them."""

    def each(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _table(list(run(*row)), ddl).to_batches()

    return each


def _by_group(run):
    """A function of grouped tables that gives memory back after each."""

    def each(*tables):
        out = run(*tables)
        tb.released()
        return out

    # Spark takes the number of arguments for whether it passes the key.
    if run.__code__.co_argcount == 2:
        return lambda key, table: each(key, table)
    return lambda key, left, right: each(key, left, right)


def _bucketed(df: DataFrame, by: str, buckets: int, name: str) -> DataFrame:
    """As ``stored``, in buckets by a column, so that grouping by it again moves nothing."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = scratch_dir(spark, name)
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    out = spark.table(table).select("*")
    spark.sql(f"DROP TABLE {table}")  # the files stay
    out._scratch = path
    return out


# ---------------------------------------------------------------------------------------------
# From texts to cells


def _names(body: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words, in order, and their ranks."""

    def counted(batches):
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for _, _, _, lengths, tokens in py.token_parts(batches):
            words, at = np.unique(np.concatenate([words, tokens]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(tokens), np.int64)]), len(words)).astype(np.int64)
            if len(words) > 8 * FREQUENT:
                top = np.sort(np.argsort(-counts, kind="stable")[: 4 * FREQUENT])
                words, counts = words[top], counts[top]
        top = np.argsort(-counts, kind="stable")[:FREQUENT]
        yield from py._slices([pa.array(words[top].view(np.int64)), pa.array(counts[top])], ["word", "n"])

    sample = body.sample(fraction=NAMED_FROM, seed=9).mapInArrow(counted, "word long, n long")
    found = stored(sample.groupBy("word").agg(F.sum("n").alias("n"), F.floor(4 * F.log2(F.sum("n"))).alias("size")).filter("n > 1"), "names")
    least, taken = None, 0
    for r in sorted(found.groupBy("size").count().collect(), reverse=True):  # at most 256 rows
        taken += r["count"]
        if taken > FREQUENT:
            break
        least = r["size"]
    rows = sorted(found.filter(F.col("size") >= F.lit(least)).select("word", "n").collect(), key=lambda r: (-r["n"], r["word"]))
    discard(found)
    words = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    rank = np.argsort(words)
    return words[rank], rank.astype(np.uint64)


def _codes(words: np.ndarray, names: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    hashes, ranks = names
    if not len(hashes):
        return words | LONG
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[at] == words, ranks[at], words | LONG)


def _pieces(batches, block_tokens: int, grid: Grid, names):
    """By block a row for each group with the block's cells there, and one with its documents, each
    token as the number of its cell."""
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 12
    held, size = [], 0
    for part in py.token_parts(batches):
        held.append(part)
        size += len(part[-1])
        if size >= block_tokens:
            yield from _piece(block, held, grid, names)
            tb.released()
            block, held, size = block + 1, [], 0
    if held:
        yield from _piece(block, held, grid, names)
    del held
    tb.released()


def _piece(block: int, parts: list, grid: Grid, names):
    ids, known, held, lengths, tokens = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    words, number = np.unique(tokens, return_inverse=True)
    del tokens
    code = _codes(words, names)
    order = np.argsort(code)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    number = rank.astype(np.int32)[number]
    words, code = words[order], code[order]
    del order, rank
    before = np.concatenate([number[-1:], number[:-1]])  # the last token is an end, as that before the first
    number = number * np.int64(len(words))
    number += before
    del before
    pair, number = np.unique(number, return_inverse=True)
    counts = np.bincount(number, np.repeat(~held, lengths), len(pair)).astype(np.uint32)
    word, context = pair // len(words), pair % len(words)
    group = grid.row(words)[context] * grid.side + grid.column(words)[word]
    by = np.argsort(group, kind="stable")
    place = np.empty(len(pair), np.uint32)
    place[by] = np.arange(len(pair), dtype=np.uint32)
    number = place[number]
    word, context, counts, group = word[by], context[by], counts[by], group[by]
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_word = new_group | np.concatenate([[True], word[1:] != word[:-1]])
    cuts = [*np.flatnonzero(new_group), len(group)]
    texts = _pack(ids.astype(np.int64), known.astype(np.uint8), held.astype(np.uint8), lengths.astype(np.int64), number,
                  group[new_group].astype(np.int32), np.diff(cuts).astype(np.int64), np.packbits(new_word))
    yield from _table([(block, -1, texts)], PIECES).to_batches()
    for lo in range(0, len(cuts) - 1, 64):
        rows = []
        for a, b in zip(cuts[lo : lo + 64], cuts[lo + 1 : lo + 65]):
            first = np.flatnonzero(new_word[a:b])
            sizes = np.diff(first, append=b - a).astype(np.uint32)
            rows.append((block, int(group[a]), _pack(code[word[a:b][first]], sizes, code[context[a:b]], counts[a:b])))
        yield from _table(rows, PIECES).to_batches()


class Cells:
    """Cells of a group, by word and context; both are numbered in the order of their codes."""

    def __init__(self, raw: bytes):
        self.words, self.contexts, sizes, context, counts = _unpack(raw, "<u8 <u8 <u4 <u4 <u8")
        self.first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.word = np.repeat(np.arange(len(self.words)), sizes)
        self.context = context.astype(np.int64)
        self.counts = counts.astype(np.float64)

    @staticmethod
    def packed(words, contexts, word, context, counts) -> bytes:
        sizes = np.bincount(word, minlength=len(words)).astype(np.uint32)
        return _pack(words, contexts, sizes, context.astype(np.uint32), counts.astype(np.uint64))

    def hot(self) -> bytes:
        """Those of two customers or more, on their own."""
        at = np.flatnonzero(self.counts > 1)
        words, word = np.unique(self.word[at], return_inverse=True)
        contexts, context = np.unique(self.context[at], return_inverse=True)
        return self.packed(self.words[words], self.contexts[contexts], word, context, self.counts[at])

    def sums(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.bincount(self.word, values, len(self.words)), np.bincount(self.context, values, len(self.contexts))


def _grouped(key, pieces):
    """A group's cells, and which of them each block asks for."""
    pieces = pieces.sort_by("block")
    blocks = pieces.column("block").to_numpy()
    words, contexts, counts = [], [], []
    for raw in pieces.column("data").to_pylist():
        word, sizes, context, n = _unpack(raw, "<u8 <u4 <u8 <u4")
        words.append(np.repeat(word, sizes))
        contexts.append(context)
        counts.append(n)
    lengths = np.array([len(x) for x in counts], np.int64)
    words, word = np.unique(np.concatenate(words), return_inverse=True)
    contexts, context = np.unique(np.concatenate(contexts), return_inverse=True)
    word *= len(contexts)
    word += context
    del context
    cell, at = np.unique(word, return_inverse=True)
    del word
    counts = np.bincount(at, np.concatenate(counts), len(cell))
    steps = np.diff(at, prepend=0)
    begin = np.cumsum(lengths)[:-1]
    steps[begin] = at[begin]
    cells = Cells.packed(words, contexts, cell // len(contexts), cell % len(contexts), counts)
    return _table([(key[0].as_py(), Cells(cells).hot(), cells, _pack(blocks, lengths, steps.astype(np.uint32)))], GROUPS)


# ---------------------------------------------------------------------------------------------
# Sums of words and contexts, sweep by sweep


@dataclass
class Model:
    """What all tasks know: the priors, corpus counts, and the root's customers and tables by state.

    State 0 has one table in each cell, state k is that after k sweeps."""

    grid: Grid
    prior: py.Prior
    named: np.ndarray  # hashes of frequent words by rank
    kinds: int = 0
    tokens: int = 0
    roots: list[tuple[float, float]] = field(default_factory=list)

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Of words, whatever they are called, for draws that must not depend on it."""
        out = codes.copy()
        short = codes < LONG
        out[short] = self.named[codes[short].astype(np.int64)] | LONG
        return out

    def new_kind(self, state: int) -> float:
        """What the root gives to new tables, for each kind of word."""
        return (self.prior.root_strength + self.prior.root_discount * self.roots[state][1]) / (self.kinds + 1)

    def root_prob(self, rest: np.ndarray, state: int) -> np.ndarray:
        """From what words have at the root, their customers less what their tables cost them."""
        return (rest + self.new_kind(state)) / (self.roots[state][0] + self.prior.root_strength)


def _base_notes(model: Model):
    def run(group, raw):
        cells = Cells(raw)
        tables, customers = cells.sums((cells.counts > 0) * 1.0), cells.sums(cells.counts)
        for part, kind, at in model.grid.parts(group, cells.words, cells.contexts):
            at = at[customers[kind][at] > 0]
            if len(at):
                yield part, group, _pack((cells.words, cells.contexts)[kind][at], tables[kind][at].astype(np.uint64), customers[kind][at].astype(np.uint64))

    return _by_row(run, NOTES)


def _base(model: Model):
    def run(key, notes):
        codes, tables, customers = (np.concatenate(x) for x in zip(*(_unpack(raw, "<u8 <u8 <u8") for raw in notes.column("data").to_pylist())))
        codes, at = np.unique(codes, return_inverse=True)
        tables, customers = (np.bincount(at, x, len(codes)).astype(np.uint64) for x in (tables, customers))
        part = key[0].as_py()
        size = (0, 0) if model.grid.of_contexts(part) else (len(codes), int(customers.sum()))
        return _table([(part, _pack(codes), _pack(tables), _pack(customers), *size)], TABLES)

    return run


def _told(cells: Cells, model: Model, group: int, rows, values: int = 1) -> list[tuple[np.ndarray, ...]]:
    """What the parts told, in the order of a group's words and of its contexts."""
    by_part = dict(rows)
    out = [[np.zeros(n) for _ in range(values + 1)] for n in (len(cells.words), len(cells.contexts))]
    for part, kind, at in model.grid.parts(group, cells.words, cells.contexts):
        if part in by_part:
            for to, x in zip(out[kind], _unpack(by_part[part], "<f4 " * values + "<u8")):
                if len(x):
                    to[at] = x
    return out


def _seats(cells: Cells, model: Model, group: int, rows, state: int) -> np.ndarray:
    """Tables of a group's hot cells after a sweep, given the sums of the state before."""
    p = model.prior
    (rest, _), (tables, _) = _told(cells, model, group, rows)
    opens = (p.strength + p.discount * tables[cells.context]) * model.root_prob(rest, state - 1)[cells.word]
    key = model.hashes(cells.words)[cells.word] * np.uint64(0xD6E8FEB86659FD93) + model.hashes(cells.contexts)[cells.context] * np.uint64(0xC2B2AE3D27D4EB4F)
    return py.seated(cells.counts, p.discount, opens, key, 2 * (state - 1))


def _notes_of(cells: Cells, model: Model, group: int, tables: np.ndarray):
    more = cells.sums(tables - 1)
    for part, kind, at in model.grid.parts(group, cells.words, cells.contexts):
        yield part, group, _pack((cells.words, cells.contexts)[kind][at], more[kind][at].astype(np.uint64))


def _first_notes(model: Model):
    def run(group, raw):
        cells = Cells(raw)
        yield from _notes_of(cells, model, group, np.ones(len(cells.counts)))

    return _by_row(run, NOTES)


def _swept(model: Model, state: int):
    def run(key, groups, sums):
        rows, group = [], key[0].as_py()
        for raw in groups.column("hot").to_pylist():
            cells = Cells(raw)
            told = zip(sums.column("part").to_pylist(), sums.column("data").to_pylist())
            rows += _notes_of(cells, model, group, _seats(cells, model, group, told, state))
        return _table(rows, NOTES)

    return run


def _summed(model: Model, state: int):
    """A part's sums: told to the groups that sent notes, and kept whole as group -1."""

    def run(key, tables, notes):
        rows, part, p = [], key[0].as_py(), model.prior
        for codes, base in zip(tables.column("codes").to_pylist(), tables.column("base").to_pylist()):
            (codes,), (base,) = _unpack(codes, "<u8"), _unpack(base, "<u8")
            total, asked = base.astype(np.float64), []
            for group, raw in zip(notes.column("grp").to_pylist(), notes.column("data").to_pylist()):
                names, more = _unpack(raw, "<u8 <u8")
                asked.append((group, np.searchsorted(codes, names)))
                total[asked[-1][1]] += more
            sums = 0.0, 0.0
            if not model.grid.of_contexts(part):
                seats = np.ones(len(codes))
                if state:
                    seats = py.seated(total, p.root_discount, np.full(len(codes), model.new_kind(state - 1)), model.hashes(codes), 2 * (state - 1) + 1)
                sums = total.sum(), seats.sum()
                total = total - p.root_discount * seats
            total = total.astype("<f4")
            none = np.zeros(0, np.uint64)
            rows = [(group, part, _pack(total[at], none), 0.0, 0.0) for group, at in asked]
            rows.append((-1, part, _pack(total, none), *map(float, sums)))
        return _table(rows, SUMS)

    return run


# ---------------------------------------------------------------------------------------------
# Answers


def _asks(model: Model):
    def run(group, raw):
        cells = Cells(raw)
        for part, kind, at in model.grid.parts(group, cells.words, cells.contexts):
            yield part, group, _pack((cells.words, cells.contexts)[kind][at])

    return _by_row(run, NOTES)


def _known(model: Model, kept: list[int]):
    """For all words and contexts that groups ask for, their sums in the kept states and customers."""

    def run(key, tables, asks):
        by_state = {s: (a, b) for s, a, b in zip(*(tables.column(c).to_pylist() for c in ("state", "data", "counts")))}
        rows, part = [], key[0].as_py()
        codes, values, counts = np.zeros(0, np.uint64), [np.zeros(0, "<f4") for _ in kept], np.zeros(0, np.uint64)
        if -1 in by_state:
            (codes,), (counts,) = _unpack(by_state[-1][0], "<u8"), _unpack(by_state[-1][1], "<u8")
            values = [_unpack(by_state[s][0], "<f4")[0] for s in kept]
        for group, raw in zip(asks.column("grp").to_pylist(), asks.column("data").to_pylist()):
            (names,) = _unpack(raw, "<u8")
            at = np.searchsorted(codes, names)
            there = at < len(codes)
            there[there] = codes[at[there]] == names[there]
            told = []
            for x in (*values, counts):
                told.append(np.zeros(len(names), x.dtype))
                told[-1][there] = x[at[there]]
            rows.append((group, part, _pack(*told), 0.0, 0.0))
        return _table(rows, SUMS)

    return run


def probabilities(cells: Cells, model: Model, group: int, kept: list[int], told: dict[int, list]) -> tuple[np.ndarray, np.ndarray]:
    """Of each cell the probability of the word after the context, averaged over the kept states,
    and of each word its count. ``told`` holds the sums by state, and all that ``_known`` gave as -1."""
    p = model.prior
    (*rest, count), (*tables, customers) = _told(cells, model, group, told.get(-1, []), len(kept))
    seen, hot, hot_cells = cells.counts > 0, cells.counts > 1, Cells(cells.hot())
    out = np.zeros(len(cells.counts))
    for i, state in enumerate(kept):
        seats = seen * 1.0
        if state:
            seats[hot] = _seats(hot_cells, model, group, told.get(state - 1, []), state)
        root = model.root_prob(rest[i], state)
        out += (cells.counts - p.discount * seats + (p.strength + p.discount * tables[i][cells.context]) * root[cells.word]) / (p.strength + customers[cells.context])
    return out / len(kept), count.astype(np.uint64)


def _answered(model: Model, kept: list[int]):
    def run(key, groups, sums):
        rows, group, told = [], key[0].as_py(), {}
        for state, *row in zip(*(sums.column(c).to_pylist() for c in ("state", "part", "data"))):
            told.setdefault(state, []).append(row)
        for raw, asked in zip(groups.column("cells").to_pylist(), groups.column("asked").to_pylist()):
            cells = Cells(raw)
            p, count = probabilities(cells, model, group, kept, told)
            logs = np.log10(p).astype("<f4")
            blocks, lengths, steps = _unpack(asked, "<i8 <i8 <u4")
            ends = np.cumsum(lengths)
            for block, lo, hi in zip(blocks, ends - lengths, ends):
                at = np.cumsum(steps[lo:hi], dtype=np.int64)
                word = cells.word[at]
                rows.append((int(block), group, _pack(logs[at], count[word[np.concatenate([[True], word[1:] != word[:-1]])]])))
        return _table(rows, PIECES)

    return run


def _scored(model: Model):
    def run(key, texts, answers):
        by_group = dict(zip(answers.column("grp").to_pylist(), answers.column("data").to_pylist()))
        out = []
        for raw in texts.column("data").to_pylist():
            ids, known, held, lengths, tokens, groups, sizes, new = _unpack(raw, "<i8 <u1 <u1 <i8 <u4 <i4 <i8 <u1")
            logs, counts = zip(*(_unpack(by_group[int(g)], "<f4 <u8") for g in groups))
            logs = np.concatenate(logs).astype(np.float64)
            count = np.concatenate(counts)[np.cumsum(np.unpackbits(new, count=len(logs)).astype(np.int64)) - 1]
            out.append(py.document_scores(ids, known, held, lengths, tokens, count, logs, model))
        return pa.Table.from_batches(out)

    return run


def score(body: DataFrame, prior: py.Prior, sweeps: int, block_tokens: int) -> DataFrame:
    """Scores of rows with ``doc_id, held_out, text``, see :func:`marketlens.llm.pitman_yor.score`."""
    spark = body.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    side = int(np.ceil(np.sqrt(parts)))
    grid, names = Grid(side, -(-side // 4)), _names(body)
    path = scratch_dir(spark, "pieces")
    made = body.mapInArrow(lambda batches: _pieces(batches, block_tokens, grid, names), PIECES)
    made.withColumn("texts", F.col("grp") < 0).write.partitionBy("texts").parquet(path)
    pieces, texts = (spark.read.schema(PIECES + ", texts boolean").parquet(path).filter(F.col("texts") == x).drop("texts") for x in (False, True))
    groups = _bucketed(pieces.groupBy("grp").applyInArrow(_by_group(_grouped), GROUPS), "grp", parts, "cells")
    remove_folder(spark, f"{path}/texts=false")
    model = Model(grid, prior, names[0][np.argsort(names[1])])
    notes = groups.select("grp", "cells").mapInArrow(_base_notes(model), NOTES)
    tables = _bucketed(notes.groupBy("part").applyInArrow(_base(model), TABLES), "part", parts, "sums")
    size = tables.agg(F.sum("kinds"), F.sum("tokens")).first()
    model.kinds, model.tokens = size[0] or 0, size[1] or 0
    hot, mine, states = groups.select("grp", "hot"), tables.select("part", "codes", "base"), []
    for state in range(sweeps):
        if state:
            notes = hot.groupBy("grp").cogroup(states[-1].filter("grp >= 0").groupBy("grp")).applyInArrow(_swept(model, state), NOTES)
        else:
            notes = hot.mapInArrow(_first_notes(model), NOTES)
        states.append(stored(mine.groupBy("part").cogroup(notes.groupBy("part")).applyInArrow(_summed(model, state), SUMS), "state"))
        root = states[-1].filter("grp < 0").agg(F.sum("customers"), F.sum("tables")).first()
        model.roots.append((root[0] or 0.0, root[1] or 0.0))
    kept = list(range(py.BURN_IN, sweeps))
    whole = tables.select("part", F.lit(-1).alias("state"), F.col("codes").alias("data"), "counts")
    for s in kept:
        whole = whole.union(states[s].filter("grp < 0").select("part", F.lit(s), "data", F.lit(None).cast("binary")))
    asks = groups.select("grp", "cells").mapInArrow(_asks(model), NOTES)
    known = whole.groupBy("part").cogroup(asks.groupBy("part")).applyInArrow(_known(model, kept), SUMS)
    told = known.select("grp", "part", "data", F.lit(-1).alias("state"))
    for s in kept:
        if s:
            told = told.union(states[s - 1].filter("grp >= 0").select("grp", "part", "data", F.lit(s - 1)))
    answers = groups.select("grp", "cells", "asked").groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(_by_group(_answered(model, kept)), PIECES)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_by_group(_scored(model)), py.SCORES)
