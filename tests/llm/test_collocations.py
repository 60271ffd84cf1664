import random
import re
from collections import Counter

import pytest

from marketlens.llm import collocations as co


def brute(rows, least, top, covered=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {}
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(p)):
            l, r = f[lang, *p[:k]], f[lang, *p[k:]]
            cuts.append((1000000 * a * a // (l * r), k, l, r))
        found[lang, *p] = a, min(cuts)
    out = []
    for (lang, *p), (a, (score, _, l, r)) in found.items():
        longer = [x for (m, *q), (x, _) in found.items() if m == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * x >= covered * a for x in longer):
            continue
        out.append((lang, score, a, " ".join(p), l, r, n[lang]))
    ranked, result = sorted(out, key=lambda x: (x[0], -x[1], -x[2], x[3].encode())), []
    for lang, score, a, phrase, l, r, words in ranked:
        rank = sum(x[0] == lang for x in result) + 1
        if rank <= top:
            result.append((lang, rank, phrase, a, l, r, words, score))
    return result


def corpus():
    draw = random.Random(7)
    pool = ["the", "The", "of", "a", "été", "x y", "new", "york", "city", "über", "'s", "a-b"]
    rows = [(None, "the a the a the a"), ("en", None), ("en", ""), (None, None), ("de", " .,; \n\t!"), ("en", "york " * 3000)]
    for i in range(150):
        words = draw.choices(pool, weights=[30, 5, 12, 9, 3, 2, 6, 6, 4, 2, 1, 1], k=draw.randrange(40))
        if i % 3 == 0:
            words += ["new", "york", "city"]
        text = "".join(w + draw.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", " : ", "\x0b"]) for w in words)
        rows.append((draw.choice(["en", "en", "de", None]), text))
    return rows + rows[10:14]


@pytest.mark.parametrize("budget, least, top", [(2_000_000, 10, 2000), (60, 2, 2000), (7, 3, 9)])
def test_equals_brute_force(spark, monkeypatch, budget, least, top):
    rows = corpus()
    docs = spark.createDataFrame([(i, l, t, "x", 1) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, f long").repartition(3)
    monkeypatch.setattr(co, "CHUNK_BYTES", 500)
    monkeypatch.setattr(co, "PACK_ROWS", 50)
    got = co.collocations(docs, least=least, top=top, budget=budget)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows, least, top))


def test_hot_prefixes_are_spread_and_summed(spark):
    rows = [("en", "the end of the end of the road " * 40)] * 20
    docs = spark.createDataFrame(rows, "lang string, text string")
    how, _ = co.partition(docs, budget=500)
    assert how.groups > 10 and len(how.hot) >= 3
    counts, words = co.phrase_counts(docs, budget=500)
    f = {(r.w1, r.w2, r.w3): r.f for r in counts.collect()}
    assert f["the", None, None] == 2400 and f["the", "end", None] == 1600 and f["the", "end", "of"] == 1600 and f["of", "the", "road"] == 800
    assert [tuple(r) for r in words.collect()] == [("en", 6400)]


def test_empty_tables(spark):
    for rows in ([], [("en", None)], [("en", " .. ")]):
        assert co.collocations(spark.createDataFrame(rows, "lang string, text string")).collect() == []


def test_many_words_in_a_chunk_are_numbered_in_steps():
    import numpy as np

    draw = np.random.default_rng(1)
    cols = [draw.integers(0, 4, 3000) for _ in range(4)]
    for sizes in ([4, 4, 4, 4], [1 << 10, 1 << 20, 1 << 20, 1 << 20]):
        rows, n = co._grouped(cols, sizes, None)
        want = Counter(zip(*(c.tolist() for c in cols)))
        assert [tuple(r) for r in rows.T.tolist()] == sorted(want) and n.tolist() == [want[k] for k in sorted(want)]
        rows, n = co._grouped(cols, sizes, np.full(3000, 2))
        assert n.tolist() == [2 * want[k] for k in sorted(want)]
