import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import neighbours as nb
from marketlens.llm.letters import remainder
from marketlens.llm.queries import QUERIES


def brute_features(text):
    """Words and shape grams of one text, counted one by one."""
    out = {}
    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    words, word = [], b""
    for b in [*low, 0x20]:
        if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80:
            word += bytes([b])
        elif word:
            words.append(word)
            word = b""
    import xxhash

    for i, w in enumerate(words):
        k = xxhash.xxh64_intdigest(w, 42) % nb.WORDS
        out[k] = out.get(k, 0) + 1
        for back in range(1, nb.REPEATS + 1):
            if i >= back and words[i - back] == w:
                out[nb.WORDS + nb.SHAPES + back - 1] = out.get(nb.WORDS + nb.SHAPES + back - 1, 0) + 1
    for i in range(len(raw) - nb.GRAM + 1):
        h = 0
        for b in raw[i : i + nb.GRAM]:
            h = ((h ^ int(nb.SHAPE[b])) * 0x9E3779B1) & 0xFFFFFFFF
            h ^= h >> 15
        k = nb.WORDS + h % nb.SHAPES
        out[k] = out.get(k, 0) + 1
    return out


def test_features_of_whole_texts(monkeypatch):
    draw = random.Random(3)
    texts = [None, "", "a", "The  the THE x\ty\nz", "été été $$$ 12", "ab" * 700]
    texts += ["".join(draw.choices("ab AB1.é\n#", k=draw.randrange(90))) for _ in range(60)]
    for segment in (1 << 20, 64):
        monkeypatch.setattr(nb, "SEGMENT", segment)
        text, bucket, n = nb.features(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert dict(zip(bucket[text == i].tolist(), n[text == i].tolist())) == brute_features(t)


def test_space_holds_the_leading_singular_vectors():
    draw = np.random.default_rng(4)
    dense = (draw.random((60, nb.FEATURES)) < 0.002) * draw.random((60, nb.FEATURES))
    dense[:30, :40] += 1
    dense[30:, 40:80] += 2
    row, col = np.nonzero(dense)
    space = nb.latent_space(row, col, dense[row, col].astype(np.float32), 60, dimensions=5, rounds=12)
    want = np.linalg.svd(dense, full_matrices=False)
    image, best = np.linalg.norm(dense @ space, axis=0), want[1][:5]
    assert np.allclose(space.T @ space, np.eye(5), atol=1e-3) and np.allclose(image[:2], best[:2], rtol=1e-3) and (image >= 0.9 * best).all()


@pytest.mark.parametrize("k", [1, 5, 40, 1000])
def test_votes_equal_brute_force(k):
    draw = np.random.default_rng(k)
    vectors, labels = draw.integers(-1, 2, (300, 8)).astype(np.float32) / 4, draw.integers(0, 2, 300).astype(float)  # exact products, many ties
    voters = nb.Voters(np.zeros(0), np.zeros((0, 8)), vectors, labels, 0.3, k)
    z = draw.integers(-1, 2, (500, 8)).astype(np.float32) / 2
    for x, score in zip(z, voters.votes(z)):
        near = vectors @ x
        cut = np.sort(near)[::-1][min(k, 300) - 1]
        w = [(max(float(s), 0), y) for s, y in zip(near, labels) if s >= cut]
        assert abs(score - (sum(s * y for s, y in w) + 0.3) / (sum(s for s, _ in w) + 1)) < 1e-9


@pytest.fixture(scope="module")
def corpus(spark):
    draw = random.Random(6)
    word = lambda: "".join(draw.choice(["ba", "no", "ri", "te", "lu"]) for _ in range(draw.randrange(1, 5)))
    rows = []
    for i in range(500):
        words = [word() for _ in range(draw.randrange(5, 80))]
        bad = i % 5 == 0
        rows.append((i, " | ".join(w.upper() for w in words) if bad else " ".join(words) + ".", int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_held_out_documents_and_edge_cases(spark, corpus, docs):
    labels = corpus.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None), (99999, 1), (4, 7)], "doc_id long, quality int"))
    rows = nb.training_rows(corpus, labels, remainder("doc_id", 3) != 1)
    voters = nb.train(rows, nb.rarity(corpus))
    assert rows.count() >= len(voters.labels) > 300 and set(voters.labels) == {0.0, 1.0}
    got = nb.scored(corpus, voters).filter(remainder("doc_id", 3) == 1).collect()
    assert sum((r.quality_score >= 0.5) == (r.quality == 1) for r in got) >= 0.98 * len(got)
    edge = nb.scored(docs(None, "", "ba", "BA | NO | " * 60_000, "banori lu te.", "banori lu te."), voters, out="c0")
    score = {r.doc_id: r.c0 for r in edge.collect()}
    assert edge.columns == ["doc_id", "text", "word", "c0"]
    assert score[0] == score[1] == pytest.approx(voters.share) and score[3] < 0.5 and score[4] == score[5] > 0.5
    assert nb.scored(docs(), voters).count() == 0


def test_bounded_rows_and_weights(spark, corpus):
    labels = corpus.select("doc_id", "quality")
    assert 30 < nb.training_rows(corpus, labels, at_most=100).count() < 200
    voters = nb.train(nb.training_rows(corpus, labels), nb.rarity(corpus), entries=10_000)
    assert 10 < len(voters.labels) < 400


def test_without_labels_or_documents(spark, corpus):
    none = corpus.select("doc_id", "quality").limit(0)
    idf = nb.rarity(corpus.limit(0))
    voters = nb.train(nb.training_rows(corpus, none), nb.rarity(corpus))
    assert nb.scored(corpus, voters).agg(F.min("quality_score"), F.max("quality_score")).first() == (0.5, 0.5)
    assert not idf.any() and nb.train(nb.training_rows(corpus.limit(0), none), idf).share == 0.5


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    found = QUERIES["op13_neighbours"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    assert len(found) == len({r.doc_id for r in found}) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
