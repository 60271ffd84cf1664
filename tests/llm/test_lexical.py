import math
import random
import re
from collections import Counter

import pytest

from marketlens.llm import lexical


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(rows, items, top):
    tf = [Counter(terms(t)) for _, t in rows]
    n = [sum(c.values()) for c in tf]
    count, length = sum(x > 0 for x in n), sum(n)
    df = Counter(w for c in tf for w in c)
    named = {}
    for i, t in items:
        named.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in named.items():
        scored = []
        for (doc, _), c, size in zip(rows, tf, n):
            if size:
                m = 10 + (90 * size * count) // length
                weight = lambda w: math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1)))
                score = sum(weight(w) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in wanted if c[w])
                if score > 0:
                    scored.append((-score, doc is None, doc))
        best = sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top]
        out += [(i, r + 1, doc, -s) for r, (s, _, doc) in enumerate(best)]
    return out


ITEMS = [(1, "The quick brown fox"), (2, "Übermaß the the"), (3, ""), (4, None), (5, " ... !!"), (None, "dog"), (None, "fox cat"),
         (7, "nowhere"), (1, "lazy dog"), (8, "a1 b2-c3 the"), (9, " ".join(f"w{i}" for i in range(300)))]


def corpus():
    draw = random.Random(5)
    pool = ["the", "The", "quick", "brown", "fox", "foxes", "dog", "ÜBERMAß", "übermaß", "a1", "b2", "c3", "x", "lazy", "w7", "w299", "cat"]
    texts = [None, "", "!!", "fox", "fox", "the" * 9, "THE fox\x00dog\n", "é the é", "the quick " * 20_000]
    texts += [draw.choice([" ", "-", "."]).join(draw.choices(pool, k=draw.randrange(60))) for _ in range(150)]
    return [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(3, "fox"), (3, "fox"), (-5, "fox")]


@pytest.mark.parametrize("block_bytes, top", [(32 << 20, 10), (2000, 3)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, top):
    rows = corpus()
    monkeypatch.setattr(lexical, "PAIRS", 100)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, item_id string, rank long").repartition(5)
    got = lexical.ranked(docs, spark.createDataFrame(ITEMS, "item_id long, text string"), top=top, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, ITEMS, top), key=key)


def test_items_may_have_names(spark, docs):
    items = spark.createDataFrame([("b", "fox"), ("a", "fox dog")], "item_id string, text string")
    rows = lexical.ranked(docs("fox", "dog", "fox dog", "cat cat"), items).orderBy("item_id", "rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [("a", 1, 2), ("a", 2, 0), ("a", 3, 1), ("b", 1, 0), ("b", 2, 2)]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "fox")], "item_id long, text string")
    assert lexical.ranked(docs("fox"), none).count() == 0
    assert lexical.ranked(docs(), some).count() == 0
    assert lexical.ranked(docs(None, "", "??"), some).count() == 0
