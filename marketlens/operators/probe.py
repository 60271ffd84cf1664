"""Texts held against all clauses at once, inside tasks.

A chunk of records is one array of word numbers. The phrases of all clauses are a trie over word
numbers, which every word of the chunk enters side by side. What was found is a bit per phrase and
record, so a clause is the AND of some rows of bits and a term the OR of some clauses: work on whole
arrays, in which only what is satisfied becomes a row. Nothing here depends on Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ROWS = 512  # records looked at together, fewer if they have many fields or long texts
TEXTS = 4 * ROWS
TEXT_BYTES = 1 << 20
OUT_ROWS = 1 << 16  # rows of a batch that is handed back

EXPLICIT, IMPLIED = 1, 2


def words_of(phrase: str) -> list[str]:
    return [w for w in phrase.split(" ") if w]


class Probe:
    """Clauses ``term_id, tier, clause_no, scope, anti, phrases`` made ready; small enough to be broadcast.

    ``anti`` names a mode; ``flags`` says for each mode by which words a record carries it. Clauses
    without a word, with a null among their phrases or without a term find nothing."""

    def __init__(self, clauses: pa.Table, flags: dict[str, list[str]]):
        words: dict[str, int] = {}
        self.words = words
        self.flags = [[words.setdefault(w, len(words) + 1) for w in flags[mode]] for mode in flags]
        self.modes, modes = list(flags), {mode: i for i, mode in enumerate(flags, 1)}
        flat = clauses.column("phrases").combine_chunks()
        lists = flat.to_pylist()
        spelled = {p: tuple(words.setdefault(w, len(words) + 1) for w in words_of(p)) for p in {p for x in lists for p in x or () if p is not None}}
        width = self.width = len(words) + 1
        # States 1 to ``width - 1`` are the single words, the others follow.
        step, state_of = {}, {}
        for p, ids in spelled.items():
            state = ids[0] if ids else 0
            for w in ids[1:]:
                state = step.setdefault(state * width + w, width + len(step))
            state_of[p] = state
        order = sorted(step)
        self.keys = np.array(order, np.int64)
        self.next = np.array([step[k] for k in order], np.int64)
        self.goes_on = np.zeros(width + len(step), bool)
        self.goes_on[self.keys // width] = True
        ends = sorted({s for s in state_of.values() if s})
        self.phrase = np.full(width + len(step), -1, np.int64)
        self.phrase[ends] = np.arange(len(ends))
        self.phrases = len(ends)
        number = self.number = {p: int(self.phrase[s]) for p, s in state_of.items() if s}

        # Clauses that ask for the same thing are one condition.
        conditions: dict[tuple, int] = {}
        users, asks = [], []
        scope, anti = clauses.column("scope").to_pylist(), clauses.column("anti").to_pylist()
        known = pc.is_valid(clauses.column("term_id")).to_pylist()
        for i, said in enumerate(lists):
            if not known[i] or not said or any(p is None for p in said):
                continue
            found = tuple(sorted({number[p] for p in said if p in number}))
            if found:
                key = (scope[i] == "same" and len(found) > 1, len(found), found, modes.get(anti[i], 0))
                users.append(i)
                asks.append(conditions.setdefault(key, len(conditions)))
        by = sorted(conditions)
        place = np.empty(len(by), np.int64)
        place[[conditions[k] for k in by]] = np.arange(len(by))
        self.anti = np.array([k[3] for k in by], np.int8)
        self.kinds = []  # (one field, phrases of each condition, first condition)
        lo = 0
        while lo < len(by):
            hi = next((j for j in range(lo, len(by)) if by[j][:2] != by[lo][:2]), len(by))
            self.kinds.append((by[lo][0], np.array([k[2] for k in by[lo:hi]], np.int64), lo))
            lo = hi

        users, asks = np.array(users, np.int64), place[np.array(asks, np.int64)] if asks else np.zeros(0, np.int64)
        self.terms, code = _numbered(clauses.column("term_id").combine_chunks().take(pa.array(users)))
        tier = clauses.column("tier").to_numpy().astype(np.int32)[users]
        of_condition = np.argsort(asks, kind="stable")
        self.first = np.searchsorted(asks[of_condition], np.arange(len(by) + 1))
        self.user_term = code[of_condition]
        self.user_tier, self.user_no = (clauses.column(c).combine_chunks().take(pa.array(users[of_condition])) for c in ("tier", "clause_no"))
        of_term = np.lexsort((tier, code))
        self.asks, self.term, self.tier = asks[of_term], code[of_term], tier[of_term]
        small = not len(tier) or 1 <= tier.min() and tier.max() <= 8
        self.mask_type = np.uint8 if small else np.int32


def _numbered(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values and the number of each."""
    if pa.types.is_nested(column.type):
        named: dict[str, int] = {}
        code = np.array([named.setdefault(repr(v), len(named)) for v in column.to_pylist()], np.int64)
        return column.take(pa.array(np.unique(code, return_index=True)[1])), code
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece has few records and fields, and little text unless it is one record."""
    for batch in batches:
        if "texts" in batch.schema.names:
            texts = batch.column("texts")
            size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
            weight = pc.fill_null(pc.binary_length(texts.flatten()), 0).to_numpy(zero_copy_only=False)
            end = np.concatenate([[0], np.cumsum(weight.astype(np.int64))])[np.cumsum(size)]
            fields = int(size.max(initial=0))
        else:
            end, fields = np.zeros(len(batch), np.int64), (pc.max(batch.column("fields").flatten()).as_py() or 0) + 1
        rows = max(1, min(ROWS, TEXTS // max(1, fields)))
        lo = 0
        while lo < len(batch):
            before = end[lo - 1] if lo else 0
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(end, before + TEXT_BYTES, "right"))))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _read(piece: pa.RecordBatch, probe: Probe) -> tuple[np.ndarray, ...]:
    """Word numbers of all texts of a piece (0: no clause has the word), and for each the text it is in;
    for each text its record and its place among that record's fields."""
    texts = piece.column("texts")
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy().astype(np.int64)
    flat = texts.flatten()
    record = np.repeat(np.arange(len(piece)), size)
    field = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    split = pc.split_pattern(flat, " ")
    coded = split.flatten().dictionary_encode()
    number = probe.words.get
    ids = np.array([number(w, 0) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(flat)), pc.fill_null(pc.list_value_length(split), 0).to_numpy())
    return ids, text, record, field


def _phrases(ids: np.ndarray, text: np.ndarray, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin anywhere, and the text each is in."""
    at = np.flatnonzero(ids)
    state, found, where, depth = ids[at], [], [], 1
    while len(at):
        phrase = probe.phrase[state]
        met = phrase >= 0
        found.append(phrase[met])
        where.append(text[at[met]])
        on = probe.goes_on[state]
        on &= at + depth < len(ids)
        at, state = at[on], state[on]
        on = text[at + depth] == text[at]
        at, state = at[on], state[on]
        key = state * probe.width + ids[at + depth]
        place = np.minimum(np.searchsorted(probe.keys, key), len(probe.keys) - 1)
        on = probe.keys[place] == key if len(key) else np.zeros(0, bool)
        at, state = at[on], probe.next[place[on]]
        depth += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found]), np.concatenate([none, *where])


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.packbits(marks, axis=-1, bitorder="little").view(np.uint64)


def _marks(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=-1, bitorder="little")


def _sought(piece: pa.RecordBatch, probe: Probe) -> tuple:
    """Phrases in the texts of a piece, the record and field of each, and per mode whether a record carries it."""
    ids, text, record, field = _read(piece, probe)
    found, where = _phrases(ids, text, probe)
    carries = np.zeros((len(probe.flags), len(piece)), bool)
    for mode, words in enumerate(probe.flags):
        carries[mode, record[text[np.isin(ids, words)]]] = True
    return found, record[where], field[where], carries


def _told(piece: pa.RecordBatch, probe: Probe) -> tuple:
    """As :func:`_sought` for records whose phrases were found elsewhere: lists ``phrases`` and ``fields``
    beside each other, and a column for each mode."""
    said = piece.column("phrases")
    coded = said.flatten().dictionary_encode()
    found = np.array([probe.number.get(p, -1) for p in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    record = np.repeat(np.arange(len(piece)), pc.fill_null(pc.list_value_length(said), 0).to_numpy())
    field = piece.column("fields").flatten().to_numpy().astype(np.int64)
    known = found >= 0
    carries = np.array([pc.fill_null(piece.column(mode), False).to_numpy(zero_copy_only=False) for mode in probe.modes], bool)
    return found[known], record[known], field[known], carries


def _met(piece: pa.RecordBatch, probe: Probe) -> tuple[np.ndarray, np.ndarray]:
    """Conditions that some record may meet, and a row of bits for each: the records that do."""
    found, record, field, carries = (_sought if "texts" in piece.schema.names else _told)(piece, probe)
    wide = -(-len(piece) // 64) * 64
    seen = np.zeros(probe.phrases, bool)
    seen[found] = True
    rank = np.cumsum(seen) - 1
    marks = np.zeros((int(seen.sum()), int(field.max(initial=0)) + 1, wide), bool)
    marks[rank[found], field, record] = True
    by_field = _bits(marks)
    anywhere = np.bitwise_or.reduce(by_field, axis=1)
    names, rows = [np.zeros(0, np.int64)], [np.zeros((0, wide // 64), np.uint64)]
    for same, phrases, first in probe.kinds:
        live = np.flatnonzero(seen[phrases].all(axis=1))
        if not len(live):
            continue
        wanted = rank[phrases[live]]
        held = by_field if same else anywhere
        met = held[wanted[:, 0]]
        for j in range(1, wanted.shape[1]):
            met = met & held[wanted[:, j]]
        names.append(first + live)
        rows.append(np.bitwise_or.reduce(met, axis=1) if same else met)
    names, met = np.concatenate(names), np.concatenate(rows)
    for mode, carried in enumerate(carries, 1):
        whole = np.zeros(wide, bool)
        whole[: len(piece)] = carried
        met[probe.anti[names] == mode] &= _bits(whole)
    some = met.any(axis=1)
    return names[some], met[some]


def _handed(columns: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    batch = pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])
    for lo in range(0, len(batch), OUT_ROWS):
        yield batch.slice(lo, OUT_ROWS)


def facts(batches: Iterable[pa.RecordBatch], probe: Probe, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """``keep..., term_id, tier, clause_no``: a row for each record and clause it satisfies."""
    for piece in _pieces(batches):
        names, met = _met(piece, probe)
        record, at = np.nonzero(np.ascontiguousarray(_marks(met).T))
        name = names[at]
        users = probe.first[name + 1] - probe.first[name]
        record, start = np.repeat(record, users), probe.first[name] - (np.cumsum(users) - users)
        user = np.repeat(start, users) + np.arange(len(record))
        rows = pa.array(record)
        yield from _handed({
            **{k: piece.column(k).take(rows) for k in keep}, "term_id": probe.terms.take(pa.array(probe.user_term[user])),
            "tier": probe.user_tier.take(pa.array(user)), "clause_no": probe.user_no.take(pa.array(user))})


def masks(batches: Iterable[pa.RecordBatch], probe: Probe, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """``term_id, keep..., tiers``: a row for each record and term it satisfies in some tier."""
    place = np.full(len(probe.anti), -1, np.int64)
    for piece in _pieces(batches):
        names, met = _met(piece, probe)
        if not len(names):
            continue
        place[names] = np.arange(len(names))
        live = np.flatnonzero(place[probe.asks] >= 0)
        rows, term, tier = place[probe.asks[live]], probe.term[live], probe.tier[live]
        place[names] = -1
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tier[1:] != tier[:-1])]))
        tiers, term, tier = np.bitwise_or.reduceat(met[rows], new, axis=0), term[new], tier[new]
        one = (np.int64(1) << ((tier - 1) & 31)).astype(probe.mask_type)
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        both = np.bitwise_or.reduceat(_marks(tiers).astype(probe.mask_type, copy=False) * one[:, None], new, axis=0)
        by_record = np.ascontiguousarray(both.T)
        record, at = np.nonzero(by_record)
        rows = pa.array(record)
        yield from _handed({
            "term_id": probe.terms.take(pa.array(term[new][at])), **{k: piece.column(k).take(rows) for k in keep},
            "tiers": pa.array(by_record[record, at].astype(np.int32))})
