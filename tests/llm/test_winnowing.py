import random
import re

import pytest

from marketlens.llm import winnowing


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window=10):
    w, hit, named = words(text), set(), set()
    for i, t in items:
        v = words(t)
        n = min(window, len(v))
        for j in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[j : j + n]:
                    hit |= set(range(p, p + n))
                    named |= {i} - {None}
    return len(w), len(hit), sorted(str(i) for i in named)


ITEMS = [
    (1, "The quick brown fox jumps over a lazy dog and then runs off to the wide woods"),
    (2, "one two three"), (3, "Übermaß"), (4, ""), (5, None), (6, " ... "), (None, "alpha beta gamma delta epsilon"),
    (7, "a a a a a a a a a a a a a a"), (1, "one two three four five"), (10, "one two three"),
]


def make_docs():
    draw = random.Random(3)
    pool = [w for _, t in ITEMS for w in words(t)] + ["zzz", "the"]
    texts = [None, "", "!!", "a " * 40, "ONE, two; three", "x one two", "three übermaß", "Übermaß"]
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 6)):
            v = words(draw.choice(ITEMS)[1])
            i = draw.randrange(len(v) + 1)
            parts += [*v[i : i + draw.randrange(1, 16)], *draw.choices(pool, k=draw.randrange(4))]
        texts.append(" ".join(parts))
    return texts + ["the quick " * 30_000 + ITEMS[0][1]]


@pytest.mark.parametrize("index_bytes", [1 << 20, 60])
def test_hits_equal_brute_force(spark, docs, index_bytes):
    texts = make_docs()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    table = docs(*texts, *texts[:3], ids=[*range(len(texts)), 0, None, None])
    got = winnowing.contamination(table, items, index_bytes=index_bytes)
    assert got.columns == ["doc_id", "word", "c0", "n_words", "n_hit", "items", "spans"]
    rows = got.collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        if r.doc_id is not None and r.doc_id < len(texts) - 1:
            assert (r.n_words, r.n_hit, r["items"]) == brute(texts[r.doc_id], ITEMS), texts[r.doc_id]
            assert sum(s.end - s.begin for s in r.spans) == r.n_hit
        elif r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"]) == (60_017, 17, ["1"])


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = winnowing.contamination(docs("some text", None), none).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.spans) for r in sorted(rows, key=lambda r: r.doc_id)] == [(2, 0, [], []), (0, 0, [], [])]
    assert winnowing.contamination(docs(), none).count() == 0
