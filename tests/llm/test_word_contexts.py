import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketlens.llm import pitman_yor as py
from marketlens.llm import word_contexts as wc


def test_words_of_one_hash_class_are_contexts_of_their_own(spark, docs):
    """Two words before, alike in the first ten bits of their hashes, are followed by different words."""
    seen = {}
    for i in range(10_000):
        top = xxhash.xxh64_intdigest(f"w{i}".encode(), 42) >> 54
        if top in seen:
            a, b = seen[top], f"w{i}"
            break
        seen[top] = f"w{i}"
    texts = [f"{a} left"] * 200 + [f"{b} right"] * 200 + [f"{a} left", f"{a} right", f"{b} right", f"{b} left"]
    rows = py.score(docs(*texts), F.col("doc_id") >= 400).filter("held_out").orderBy("doc_id").collect()
    al, ar, br, bl = (r.score for r in rows)
    assert al > ar + 0.5 and br > bl + 0.5


def test_probabilities_of_a_context_sum_to_one():
    """Over all learned words and the unknown kind, also after an unknown word."""
    draw = np.random.default_rng(3)
    n, m = 41, 8  # the last of either is unknown
    counts = draw.integers(0, 5, (n, m)) * (draw.random((n, m)) < 0.4)
    counts[:, 0] += 1
    counts[-1], counts[:, -1] = 0, 0
    words, contexts = np.arange(n, dtype=np.uint64), np.arange(100, 100 + m, dtype=np.uint64)
    raw = wc.Cells.packed(words, contexts, np.repeat(np.arange(n), m), np.tile(np.arange(m), n), counts.ravel())
    model = wc.Model(wc.Grid(1, 1), py.Prior(), np.arange(200, dtype=np.uint64), kinds=n - 1)
    tables = counts > 0
    at_root = tables.sum(1)
    model.roots.append((float(at_root.sum()), float(n - 1)))
    rest = np.where(at_root > 0, at_root - model.prior.root_discount, 0).astype("<f4")
    told = [(0, wc._pack(rest, counts.sum(1).astype("<u8"))), (1, wc._pack(tables.sum(0).astype("<f4"), counts.sum(0).astype("<u8")))]
    p, count = wc.probabilities(wc.Cells(raw), model, 0, [0], {-1: told})
    assert count.tolist() == counts.sum(1).tolist()
    assert p.min() > 0 and p.reshape(n, m).sum(0) == pytest.approx(np.ones(m), abs=1e-6)


def test_names_and_grid_change_no_score(spark, docs, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(1, 40)) for i in range(60)] + [None, "", "w1 new"]
    runs = []
    for shares, parts in ((1 / 16, "4"), (1.0, "4"), (1.0, "23")):
        monkeypatch.setattr(wc, "NAMED_FROM", shares)
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = py.score(docs(*texts), F.col("doc_id") % 5 == 0, block_tokens=300).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        runs.append([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
    assert runs[0] == pytest.approx(runs[1], rel=1e-5) and runs[0] == pytest.approx(runs[2], rel=1e-5)
