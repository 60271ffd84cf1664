"""Language identification by interpolated Kneser-Ney models of the characters of words."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm import textbytes as tb
from marketlens.llm.letters import SortedTable, gram_hash, letters, spelled, word_of

ORDER = 5
DISCOUNT = 0.75
TRAIN_CHARS = 4_000_000  # characters that one language's model is fitted to (about)
ALL_CHARS = 64_000_000  # characters that the models of all languages are fitted to, which bounds what the driver holds
ENOUGH_DOCS = 64  # drawn documents of a language from which some are kept back to calibrate its rejection
LEAST_SPREAD = 0.15  # of the cost of a letter between documents, in nats
MOST_ODD = 8.0  # spreads above the mean cost from which a text counts as none of the languages
UNKNOWN = "und"


def predicted(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes to predict, every letter and the zero that ends a word; the word of each, and
    how many codes stand before it there, the zero that begins the word included."""
    at = np.flatnonzero(own[1:] | own[:-1]) + 1 if len(own) else np.zeros(0, np.int64)
    begin = np.flatnonzero((own == 0) & np.append(own[1:] != 0, np.zeros(min(1, len(own)), bool)))
    word = word_of(own)[at]
    return at, word, at - begin[word]


def _gram_counts(batches):
    """Per chunk and language: counts of the grams of each order that end at a predicted code
    and stay within one word and the zero before it."""
    for batch in tb.chunks(batches, limit=tb.LETTER_BYTES):
        langs = batch.column("lang").to_pylist()
        for lang in sorted(set(langs)):
            part = batch.column("text").filter(pa.array([x == lang for x in langs]))
            codes, _, _ = letters(part)
            _, of, own = spelled(codes)
            if not len(own):
                continue
            at, word, back = predicted(own)
            times = np.bincount(of)[word]
            for n in range(1, ORDER + 1):
                long = back >= n - 1
                full = at[long]
                grams, where, number = np.unique(gram_hash(own, n)[full - n + 1], return_index=True, return_inverse=True)
                seen = np.bincount(number, times[long], len(grams)).astype(np.int64)
                spelling = own[(full[where] - n + 1)[:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), n)), pa.array([row.astype("<u4").tobytes() for row in spelling], pa.binary()), pa.array(seen)],
                    names=["lang", "n", "gram", "seen"])


@dataclass
class LanguageModels:
    """For each order, the grams of all languages in a sorted hash array, with each language's
    log probability of the last code, and the log weight that a context gives to shorter ones."""

    langs: list[str]
    grams: list[SortedTable]
    logs: list[np.ndarray]
    contexts: list[SortedTable]
    backs: list[np.ndarray]
    floor: np.ndarray
    typical: np.ndarray = None  # per language: mean and spread of a letter's cost

    def word_costs(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats of each distinct word in each language, and its number of predicted codes."""
        at, word, back = predicted(own)
        cost = np.zeros((len(at), len(self.langs)))
        open_ = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            here = open_[back[open_] >= n - 1]
            place = self.grams[n - 1].places(gram_hash(own, n)[at[here] - n + 1])
            found = place >= 0
            cost[here[found]] -= self.logs[n - 1][place[found]]
            left = here[~found]
            if n > 1 and len(left):
                context = self.contexts[n - 1].places(gram_hash(own, n - 1)[at[left] - n + 1])
                known = context >= 0
                cost[left[known]] -= self.backs[n - 1][context[known]]
            open_ = np.concatenate([left, open_[back[open_] < n - 1]])
        cost[open_] -= self.floor
        words = int(word[-1]) + 1 if len(word) else 0
        first = np.searchsorted(word, np.arange(words + 1))
        return tb.sums_by(cost, first), np.diff(first)

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The language's number (-1: no letter, or none learned), the chance that it is that one
        of those learned, and the standardised cost of a letter in it (high: like none of them)."""
        codes, first, _ = letters(column)
        start, of, own = spelled(codes)
        rows = len(first) - 1
        cuts = np.searchsorted(start, first)
        costs, size = self.word_costs(own) if len(own) else (np.zeros((0, len(self.langs))), np.zeros(0, np.int64))
        total, n = tb.sums_by(costs[of], cuts), tb.sums_by(size[of], cuts)
        if not self.langs:
            return np.full(rows, -1), np.zeros(rows), np.zeros(rows)
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmin(axis=1)
        gap = (mean - mean.min(axis=1, keepdims=True)) * np.minimum(n, 50)[:, None]
        chance = 1 / np.exp(-gap).sum(axis=1)
        middle, spread = self.typical[best, 0], self.typical[best, 1]
        odd = (mean[np.arange(rows), best] - middle) / (spread * np.sqrt(1 + 300 / np.maximum(n, 1)))
        return np.where(n > 0, best, -1), np.where(n > 0, chance, 0.0), np.where(n > 0, odd, np.inf)


def _interpolated(counts: dict[int, dict[bytes, int]]) -> tuple[list[dict], list[dict], float]:
    """One language's probabilities and back-off weights from counts of grams by order.

    The highest order uses counts, and so do grams at the start of a word, which have nothing
    before them; lower orders count the different codes before a gram."""
    kinds: dict[int, dict[bytes, int]] = {ORDER: counts.get(ORDER, {})}
    for n in range(ORDER - 1, 0, -1):
        kinds[n] = {}
        for g in counts.get(n + 1, {}):
            kinds[n][g[4:]] = kinds[n].get(g[4:], 0) + 1
        for g, c in counts.get(n, {}).items():
            if g[:4] == b"\0\0\0\0" and n > 1:
                kinds[n][g] = c
    letters_ = len(kinds[1]) + 1
    floor = 1.0 / letters_
    total = sum(kinds[1].values())
    back0 = DISCOUNT * len(kinds[1]) / total
    probs: list[dict] = [{g: (c - DISCOUNT) / total + back0 * floor for g, c in kinds[1].items()}]
    backs: list[dict] = [{b"": back0}]
    for n in range(2, ORDER + 1):
        sums, kinds_of = {}, {}
        for g, c in kinds[n].items():
            sums[g[:-4]] = sums.get(g[:-4], 0) + c
            kinds_of[g[:-4]] = kinds_of.get(g[:-4], 0) + 1
        back = {h: DISCOUNT * kinds_of[h] / sums[h] for h in sums}
        low = probs[-1]
        probs.append({g: (c - DISCOUNT) / sums[g[:-4]] + back[g[:-4]] * low.get(g[4:], back0 * floor) for g, c in kinds[n].items()})
        backs.append(back)
    return probs, backs, back0 * floor


def _hash_of(grams: list[bytes], n: int) -> np.ndarray:
    codes = np.frombuffer(b"".join(grams), "<u4").reshape(len(grams), n)
    h = np.full(len(grams), n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = (h ^ codes[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h


def _assembled(by_lang: dict[str, dict[int, dict[bytes, int]]]) -> LanguageModels:
    langs = sorted(by_lang)
    models = [_interpolated(by_lang[x]) for x in langs]
    floor = np.log([m[2] for m in models]) if models else np.zeros(0)

    def prob(model, g):
        """Interpolated probability of the last code of any gram."""
        weight = 1.0
        while g:
            n = len(g) // 4
            if g in model[0][n - 1]:
                return weight * model[0][n - 1][g]
            weight *= model[1][n - 1].get(g[:-4], 1.0) if n > 1 else 1.0
            g = g[4:]
        return weight * model[2]

    tables, logs, contexts, backs = [], [], [], []
    for n in range(1, ORDER + 1):
        grams = sorted(set().union(*(m[0][n - 1] for m in models))) if models else []
        h = _hash_of(grams, n)
        order = np.argsort(h)
        tables.append(SortedTable(h[order]))
        logs.append(np.log([[prob(m, grams[i]) for m in models] for i in order]).reshape(len(grams), len(langs)))
        heads = sorted(set().union(*(m[1][n - 1] for m in models))) if models and n > 1 else []
        h = _hash_of(heads, n - 1) if heads else np.zeros(0, np.uint64)
        order = np.argsort(h)
        contexts.append(SortedTable(h[order]))
        backs.append(np.log([[m[1][n - 1].get(heads[i], 1.0) for m in models] for i in order]).reshape(len(heads), len(langs)))
    return LanguageModels(langs, tables, logs, contexts, backs, floor)


def train(docs: DataFrame, only: Column | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_chars: int = TRAIN_CHARS,
          all_chars: int = ALL_CHARS) -> LanguageModels:
    """Models of all languages that label documents with letters (null labels are left out).

    A language with more than about ``train_chars`` characters, or its even share of ``all_chars``,
    is fitted to documents drawn by a hash of their id, always the one of least hash among them;
    counting is distributed, and the bounded counts make the models. Of a language with
    ``ENOUGH_DOCS`` drawn documents an eighth is kept back to learn what a letter costs in its
    documents, by which a text can be rejected; a language with fewer is learned from all of them
    and rejects nothing."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if only is not None:
        rows = rows.filter(only)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))
    rows = rows.filter(F.col("text").rlike(r"\p{L}"))
    size = F.sum(F.length("text").cast("long")).alias("chars")
    known = sorted(tuple(r) for r in rows.groupBy("lang").agg(size, F.count(F.lit(1)).alias("n"), F.min(draw).alias("least")).collect())
    if not known:
        return _assembled({})
    most = min(train_chars, all_chars / len(known))

    def of_lang(values):
        return F.element_at(F.create_map(*[F.lit(x) for (k, *_), v in zip(known, values) for x in (k, v)]), F.col("lang"))

    shares = [min(1.0, most / n) for _, n, *_ in known]
    drawn = rows.filter((draw < of_lang([int((1 << 40) * x) for x in shares])) | (draw == of_lang([least for *_, least in known])))
    spare = of_lang([n * x >= ENOUGH_DOCS for x, (_, _, n, _) in zip(shares, known)])
    kept_back = spare & (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(8)) == 0) & (draw != of_lang([least for *_, least in known]))
    counted = drawn.filter(~kept_back).select("text", "lang").mapInArrow(_gram_counts, "lang string, n long, gram binary, seen long")
    counts = counted.groupBy("lang", "n", "gram").agg(F.sum("seen").alias("seen")).toArrow()
    by_lang: dict = {}
    for k, n, g, c in zip(*(counts.column(x).to_pylist() for x in ("lang", "n", "gram", "seen"))):
        by_lang.setdefault(k, {}).setdefault(n, {})[g] = c
    models = _assembled(by_lang)
    models.typical = np.tile([0.0, np.inf], (len(models.langs), 1))  # rejects nothing
    if not models.langs:
        return models
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def costs(batches):
        for batch in tb.chunks(batches, limit=tb.LETTER_BYTES):
            m = shared.value
            codes, first, _ = letters(batch.column("text"))
            start, of, own = spelled(codes)
            if not len(own):
                continue
            cost, size = m.word_costs(own)
            cuts = np.searchsorted(start, first)
            n = tb.sums_by(size[of], cuts)
            total = tb.sums_by(cost[of], cuts)
            number = np.array([m.langs.index(x) if x in m.langs else -1 for x in batch.column("lang").to_pylist()])
            ok = np.flatnonzero((n >= 50) & (number >= 0))
            yield pa.RecordBatch.from_arrays([pa.array(number[ok]), pa.array(total[ok, number[ok]] / n[ok])], names=["lang", "cost"])

    seen = drawn.filter(kept_back).select("text", "lang").mapInArrow(costs, "lang long, cost double")
    for r in seen.groupBy("lang").agg(F.avg("cost").alias("m"), F.stddev_pop("cost").alias("s")).collect():
        models.typical[r["lang"]] = (r["m"], max(r["s"], LEAST_SPREAD))
    return models


def rejected() -> Column:
    """Whether a text of :func:`identified` is in none of the learned languages."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("lang_odd") > MOST_ODD)


def identified(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """The frame with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_odd`` added.

    ``lang_pred`` is the language of least cross-entropy per letter, ``und`` for a null text, one
    without a letter, or if no language was learned (score 0, ``lang_odd`` infinite or 0).
    ``lang_odd`` is how many spreads a letter costs above the mean of that language's documents;
    short texts are given more room. Texts beyond ``MOST_ODD`` are to be rejected. Languages of equal cost go by name."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the training share
    labels = np.array([*models.langs, UNKNOWN], object)

    def run(column):
        best, chance, odd = shared.value.predict(column)
        return [pa.array(labels[best], pa.string()), pa.array(chance), pa.array(odd)]

    return tb.with_columns(docs, text, "lang_pred string, lang_score double, lang_odd double", run, limit=tb.LETTER_BYTES)
