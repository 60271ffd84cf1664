import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import toxicity
from marketlens.llm.letters import SortedTable, gram_hash, letters, remainder
from marketlens.llm.queries import QUERIES


def test_sentences_and_words_of_texts():
    codes, first, sentence = letters(pa.array(["Ab c. dé!", None, "", "12 ...", "x"]))
    parts = ["".join(chr(c) if c else "_" for c in codes[a:b]) for a, b in zip(first, first[1:])]
    assert parts == ["_ab_c_dé_", "_", "_", "_", "_x_"]
    assert (np.diff(sentence) >= 0).all() and sentence[first[0]] == 0


def test_table_finds_all_and_only_its_keys():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64))
    t = SortedTable(keys)
    assert (t.places(keys) == np.arange(3000)).all()
    assert (t.places(keys + np.uint64(1)) == -1).all()
    assert (SortedTable(keys[:0]).places(keys[:3]) == -1).all()
    assert len(set(gram_hash(codes=np.arange(1, 500, dtype=np.uint32), n=3).tolist())) == 497


def test_noisy_or_gradient_matches_differences():
    draw = np.random.default_rng(2)
    label, sentences = np.array([1, 0, 1, 0]), np.array([3, 2, 1, 4])
    bags = np.array([0, 0, 1, 2, 3])
    rows, grams = np.array([0, 0, 1, 2, 3, 4]), np.array([0, 1, 2, 1, 0, 2])
    w, b = toxicity.fit_noisy_or(label, sentences, rows, grams, bags, 3, rounds=400)

    def loss(w, b):
        z = np.bincount(rows, w[grams], len(bags)) + b
        clear = np.ones(4)
        np.multiply.at(clear, bags, 1 - 1 / (1 + np.exp(-z)))
        clear *= (1 - 1 / (1 + np.exp(-b))) ** (sentences - np.bincount(bags, minlength=4))
        return -np.log(np.where(label == 1, 1 - clear, clear)).mean()

    best = loss(w, b)
    for _ in range(50):
        assert best <= loss(w + draw.normal(0, 0.3, 3), b + draw.normal(0, 0.3)) + 0.02


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(4)
    word = lambda: "".join(draw.choice(["ba", "no", "ri", "te", "lu"]) for _ in range(draw.randrange(1, 5)))
    rows = []
    for i in range(600):
        lines = [" ".join(word() for _ in range(draw.randrange(3, 12))) for _ in range(draw.randrange(1, 9))]
        bad = i % 6 == 0
        if bad:
            lines.insert(draw.randrange(len(lines) + 1), f"{word()} zogg{word()} {word()}")
        rows.append((i, ". ".join(lines), int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_held_out_documents_and_their_sentences(spark, corpus, docs):
    labels = corpus.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (3, None), (99999, 1)], "doc_id long, toxic int"))
    model = toxicity.train(toxicity.training_rows(corpus, labels, remainder("doc_id", 4) != 2))
    rows = toxicity.scored(corpus, model).filter(remainder("doc_id", 4) == 2).collect()
    assert sum((r.toxic_score >= 0.3) == (r.toxic == 1) for r in rows) >= 0.98 * len(rows)
    found = toxicity.offending_sentences(corpus, model).collect()
    assert len(found) >= 95 and sum("zogg" in r.words for r in found) >= 0.95 * len(found)
    edge = toxicity.scored(docs(None, "", "123 !!", "zoggba " * 50_000, "Zoggno, ri"), model, out="c0")
    got = {r.doc_id: r.c0 for r in edge.collect()}
    assert edge.columns == ["doc_id", "text", "word", "c0"]
    assert got[0] == got[1] == got[2] == 0.0 and got[3] > 0.3 and got[4] > 0.3
    assert toxicity.scored(docs(), model).count() == 0


def test_without_labels_or_with_one_class(spark, corpus):
    none = corpus.select("doc_id", "toxic").limit(0)
    model = toxicity.train(toxicity.training_rows(corpus, none))
    assert toxicity.scored(corpus, model).agg(F.max("toxic_score")).first()[0] < 0.3
    clean = toxicity.train(toxicity.training_rows(corpus, corpus.select("doc_id", F.lit(0).alias("toxic"))))
    assert toxicity.scored(corpus, clean).agg(F.max("toxic_score")).first()[0] < 0.3


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = QUERIES["op8_toxicity"](spark, sf).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.toxic for r in rows)
    assert right >= 0.9 * len(rows)
    assert spark.read.parquet(f"{sf}/documents.parquet").count() == QUERIES["op8_toxicity"](spark, sf).select("doc_id").distinct().count()


def test_a_task_holds_the_letters_of_little_text_and_gives_memory_back(monkeypatch):
    """A task on 4 MB of text in two batches: no more than 512 kB of it become letters at once, and what
    was held goes back after each batch."""
    seen, back = [], []
    plain = toxicity.letters
    monkeypatch.setattr(toxicity, "letters", lambda column: seen.append(sum(map(len, column.to_pylist()))) or plain(column))
    monkeypatch.setattr(toxicity.tb, "released", lambda: back.append(len(seen)), raising=False)
    text = "some plain words of a text. " * 350
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 200), pa.array([1, 0] * 100)], names=["text", "label"])
    rows = pa.Table.from_batches(toxicity._gram_counts([batch, batch]))
    assert max(seen) <= 512 << 10
    assert sum(seen) == 400 * len(text)
    assert len(back) == 2 and back[0] == len(seen) // 2
    total = rows.group_by("gram").aggregate([("pos", "sum"), ("neg", "sum")])
    assert set(total.column("pos_sum").to_pylist()) <= {200, 400, 600, 800}
