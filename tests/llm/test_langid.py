import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import langid
from marketlens.llm.letters import letters, remainder, spelled
from marketlens.llm.queries import QUERIES

SYLLABLES = {"xx": ["ka", "to", "mi", "re"], "yy": ["scht", "ung", "ei", "ver"], "zz": ["ção", "lh", "eu", "da"]}


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(6)
    rows = []
    for i in range(400):
        lang = draw.choice(sorted(SYLLABLES))
        word = lambda: "".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4)))  # noqa: E731, B023
        rows.append((i, " ".join(word() for _ in range(draw.randrange(5, 80))), lang))
    return spark.createDataFrame(rows + [(900, "ignored text", None), (901, None, "xx"), (902, "12", "nn")], "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def models(corpus):
    return langid.train(corpus, remainder("doc_id", 3) != 1)


def test_held_out_languages(corpus, models):
    assert models.langs == ["xx", "yy", "zz"]
    rows = langid.identified(corpus, models).filter(remainder("doc_id", 3) == 1).collect()
    assert all(r.lang_pred == r.lang and r.lang_score > 0.9 and r.lang_odd < langid.MOST_ODD for r in rows if r.doc_id < 900)


def _cost_of(models, own, position, k):
    """Cost of one code: the difference of the word's cost with all other codes left out."""
    at, _, back = langid.predicted(own)
    i = int(np.flatnonzero(at == position)[0])
    total = 0.0
    for n in range(langid.ORDER, 0, -1):
        if back[i] < n - 1:
            continue
        h = langid.gram_hash(own[position - n + 1 : position + 1], n)
        place = models.grams[n - 1].places(h)[0]
        if place >= 0:
            return total - models.logs[n - 1][place][k]
        if n > 1:
            context = models.contexts[n - 1].places(langid.gram_hash(own[position - n + 1 : position], n - 1))[0]
            if context >= 0:
                total -= models.backs[n - 1][context][k]
    return total - models.floor[k]


def _mass_of_seen(models, context, seen, k):
    mass = 0.0
    for c in seen:
        codes, _, _ = letters(pa.array([context + c + ("q" if c != " " else "")]))
        _, _, own = spelled(codes)
        at, _, _ = langid.predicted(own)
        mass += math.exp(-_cost_of(models, own, at[len(context)], k))
    return mass


def test_seen_letters_and_one_unseen_make_one(models):
    for k, lang in enumerate(models.langs):
        seen = {c for p in SYLLABLES[lang] for c in p} | {" ", "q"}
        for context in ("k", "ka", "to", "ver", "eu", "q"):
            assert _mass_of_seen(models, context, seen, k) == pytest.approx(1, abs=1e-6)


def test_word_costs_equal_code_by_code(models):
    codes, _, _ = letters(pa.array(["katomi verung q çãoq kato"]))
    _, of, own = spelled(codes)
    cost, n = models.word_costs(own)
    at, word, _ = langid.predicted(own)
    for w in range(len(n)):
        for k in range(3):
            assert cost[w, k] == pytest.approx(sum(_cost_of(models, own, p, k) for p in at[word == w]))


def test_odd_texts(models, docs):
    table = docs(None, "", "12 !!", "qqxj wwpf qzzk " * 30, "kato " * 60_000, "Kato")
    rows = {r.doc_id: r for r in langid.identified(table, models).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].lang_score == 0.0
    assert rows[3].lang_odd > langid.MOST_ODD > rows[4].lang_odd
    assert rows[4].lang_pred == rows[5].lang_pred == "xx"
    assert langid.identified(docs(), models).count() == 0


def test_nothing_learned(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    rows = langid.identified(docs("abc", None), langid.train(empty)).collect()
    assert [(r.lang_pred, r.lang_score) for r in rows] == [("und", 0.0)] * 2


def kneser_ney(texts):
    """Probability of a code after a context by the textbook recursion, from plain counts."""
    grams = {n: Counter() for n in range(1, langid.ORDER + 1)}
    for word in (w for t in texts for w in t.split()):
        codes = "\0" + word + "\0"
        for end in range(1, len(codes)):
            for n in range(1, min(langid.ORDER, end + 1) + 1):
                grams[n][codes[end - n + 1 : end + 1]] += 1

    def count(n):
        if n == langid.ORDER:
            return grams[n]
        before = Counter(g[1:] for g in grams[n + 1])
        return Counter({g: c if g[0] == "\0" and n > 1 else before[g] for g, c in grams[n].items()})

    counts = {n: count(n) for n in grams}

    def p(code, context):
        n = len(context) + 1
        follow = {g: c for g, c in counts[n].items() if g[:-1] == context}
        lower = p(code, context[1:]) if context else 1 / (len(follow) + 1)
        if not follow:
            return lower
        total = sum(follow.values())
        return max(follow.get(context + code, 0) - langid.DISCOUNT, 0) / total + langid.DISCOUNT * len(follow) / total * lower

    return p


def test_costs_equal_an_independent_kneser_ney(corpus):
    some = corpus.filter("doc_id < 24")
    learned = langid.train(some)
    asked = ["katomi", "to", "schtei", "verq", "leu", "k"]
    codes, _, _ = letters(pa.array([" ".join(asked)]))
    _, words, own = spelled(codes)
    cost, _ = learned.word_costs(own)
    for k, lang in enumerate(learned.langs):
        p = kneser_ney([r.text for r in some.filter(F.col("lang") == lang).collect()])
        for at, word in enumerate(asked):
            s = "\0" + word + "\0"
            want = -sum(math.log(p(s[i], s[max(0, i - langid.ORDER + 1) : i])) for i in range(1, len(s)))
            assert cost[words[at], k] == pytest.approx(want, rel=1e-9), (lang, word)


def test_no_language_is_lost(spark, docs):
    """Languages of one document each, one of them far beyond the share, and of documents without letters."""
    rows = [(i, f"{'abcdefghijklmnopqrst'[i] * 3} wort", f"l{i:02d}") for i in range(20)] + [(50, "zu " * 4000, "long"), (51, "12 34", "none")]
    learned = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_chars=200, all_chars=4000)
    assert learned.langs == sorted([f"l{i:02d}" for i in range(20)] + ["long"])
    found = langid.identified(docs("aaa", "zu zu", "qqq"), learned).filter(~langid.rejected()).orderBy("doc_id").collect()
    assert [r.lang_pred for r in found] == ["l00", "long", "l16"]


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op7_language"](spark, sf).collect()
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in rows)
