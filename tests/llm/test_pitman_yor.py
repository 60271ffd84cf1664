import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import pitman_yor as py
from marketlens.llm.letters import remainder


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def make_texts():
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "A,", "b."]
    texts = [None, "", " \n", "The end", "a " * 30_000]
    for _ in range(120):
        words = [vocabulary[min(62, int(draw.expovariate(0.07)))]]
        for _ in range(draw.randrange(1, 60)):
            words.append(vocabulary[(vocabulary.index(words[-1]) * 7 + draw.randrange(6)) % 63])
        texts.append("  ".join(words) + " new" * draw.randrange(2))
    return texts + texts[10:14]


@pytest.mark.parametrize("block_tokens,parts", [(10_000_000, 1), (300, 5)])
def test_counts_and_base_equal_brute_force(spark, docs, block_tokens, parts):
    texts = make_texts()
    rows = py.score(docs(*texts).repartition(parts), remainder("doc_id", 10) == 0, block_tokens=block_tokens).collect()
    assert len(rows) == len(texts)
    held = {r.doc_id: r.held_out for r in rows}
    count = Counter(t for i, text in enumerate(texts) if not held[i] for t in tokens(text))
    total, kinds = sum(count.values()), len(count)
    for r in rows:
        own = tokens(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[t] > 0 for t in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.1) / (total + 0.1 * (kinds + 1))) for t in own))
        assert r.score < 0
    learned = [r for r in rows if not r.held_out and r.n_tokens > 5]
    assert sum(r.score for r in learned) > sum(r.base_score for r in learned)


def test_scores_do_not_depend_on_blocks_or_partitions(spark, docs):
    texts = make_texts()[5:]
    runs = []
    for block_tokens, parts in ((10_000_000, 1), (200, 4)):
        rows = py.score(docs(*texts).repartition(parts), F.col("doc_id") % 5 == 0, block_tokens=block_tokens).collect()
        runs.append([r.score for r in sorted(rows, key=lambda r: r.doc_id)])
    assert runs[0] == pytest.approx(runs[1], rel=1e-5)


def test_probabilities_sum_to_one(spark):
    """Over all learned words and the unknown kind, in every class of the word before."""
    draw = np.random.default_rng(3)
    rows = []
    for w in range(40):
        classes = np.sort(draw.choice(6, draw.integers(1, 6), replace=False)).astype("<u2")
        rows.append((w * 7919 + 11, bytearray(classes.tobytes()), bytearray(draw.integers(1, 400, len(classes)).astype("<u8").tobytes())))
    words = spark.createDataFrame(rows, py.WORDS).repartition(3).cache()
    model = py.fit(words, py.Prior())
    known = list(words.mapInArrow(lambda b: py._word_model(b, model), "word long, count long, roots binary, seen binary, own binary").collect())
    names = ("place", "count", "roots", "seen", "own", "classes")
    schema = pa.schema([("place", pa.int64()), ("count", pa.int64()), *((n, pa.binary()) for n in names[2:])])
    for c in range(7):
        asked = [(i, r["count"], bytes(r["roots"]), bytes(r["seen"]), bytes(r["own"]), np.array([c], "<u2").tobytes()) for i, r in enumerate(known)]
        asked.append((40, None, None, None, None, np.array([c], "<u2").tobytes()))
        batch = pa.RecordBatch.from_pylist([dict(zip(names, x)) for x in asked], schema=schema)
        (answer,) = py._answers([batch], model)
        parts = py._unbundled(answer.column("answers")[0].as_py())
        number, _, size, logs = (py._loose(x, t) for x, t in zip(parts, ("<u4", "<i8", "<u2", "<f4")))
        assert np.cumsum(number).tolist() == list(range(41)) and set(size) == {1}
        assert (10 ** logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def test_seats_follow_the_process():
    """The mean number of tables of many equal cells meets the exact recursion."""
    for customers, opens, d in ((1, 5.0, 0.5), (6, 2.0, 0.8), (300, 1.5, 0.6)):
        key = np.arange(4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        got = py.seated(np.full(4000, float(customers)), d, np.full(4000, opens), key, 3)
        tables = np.zeros(customers + 1)
        tables[1] = 1.0
        for n in range(1, customers):
            t = np.arange(customers + 1)
            p = opens / (opens + n - d * t)
            p = np.where(t <= n, p, 0)
            tables = tables * (1 - p) + np.concatenate([[0], (tables * p)[:-1]])
        mean = (tables * np.arange(customers + 1)).sum()
        assert got.mean() == pytest.approx(mean, rel=0.06) and got.max() <= customers and got.min() >= 1


def test_empty_tables_and_nothing_to_learn_from(spark, docs):
    assert py.score(docs(), F.lit(False)).count() == 0
    rows = py.score(docs("a b", None, ids=[None, 4]), F.lit(True)).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 3] and all(r.n_known == r.train_tokens == 0 and r.score == pytest.approx(0, abs=1e-6) for r in rows)
    assert {r.doc_id for r in rows} == {None, 4}
