import random

import pytest

import corpus_pipeline
from marketlens.llm import minhash


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def planted(draw, pairs):
    """Texts of random words, each with a copy in which a few words are replaced."""
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    for _ in range(pairs):
        words = [word() for _ in range(draw.choice([60, 100, 250, 500]))]
        copy = list(words)
        for k in draw.sample(range(len(copy)), max(1, round(len(copy) * draw.uniform(0, 0.03)))):
            copy[k] = word()
        yield " ".join(words), " ".join(copy)


def classes(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in minhash.near_copies(rows).collect()}


def test_planted_copies_are_found_and_others_are_not(spark):
    texts = [t for pair in planted(random.Random(3), 800) for t in pair]
    found = classes(spark, texts)
    near = [jaccard(texts[2 * i], texts[2 * i + 1]) for i in range(800)]
    got = [found[2 * i] == found[2 * i + 1] for i in range(800)]
    assert sum(0.8 <= j < 0.9 for j in near) > 150 and sum(j < 0.8 for j in near) > 30
    assert not any(g for g, j in zip(got, near) if j < 0.8)
    assert sum(g for g, j in zip(got, near) if j >= 0.8) >= 0.99 * sum(j >= 0.8 for j in near)
    assert len(set(found.values())) == 1600 - sum(got)


@pytest.mark.parametrize("bucket_rows", [2, 64])
def test_large_group_joins_through_its_original(spark, monkeypatch, bucket_rows):
    """Copies at 0.85 to one text, most of them below 0.8 to each other."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", bucket_rows)
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(300):
        copy = list(base)
        for k in draw.sample(range(200), 3):
            copy[k] = word()
        texts.append(" ".join(copy))
    texts.insert(150, " ".join(base))
    assert min(jaccard(t, texts[150]) for t in texts) >= 0.8
    found = classes(spark, texts)
    assert sum(c == 0 for c in found.values()) >= 0.99 * len(texts)


def group_of_copies(draw, n, changed, words=200):
    word = lambda: "".join(draw.choices("abcdefghij", k=7))
    base = [word() for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for k in draw.sample(range(words), changed):
            copy[k] = word()
        yield " ".join(copy)


def test_pairs_held_together_follow_the_sets_not_their_square(spark, monkeypatch):
    """Pipeline on check_h: copies of which most are near but below the bound to each other."""
    counts, verified = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda source, reps, pairs, *rest: counts.append(pairs.count()) or verified(source, reps, pairs, *rest))
    texts = list(group_of_copies(random.Random(5), 250, 5))
    assert sum(c == i for i, c in classes(spark, texts).items()) > 150
    assert 0 < max(counts) <= 4 * len(texts)


@pytest.mark.parametrize("cell_rows", [8, 512])
def test_no_link_is_lost_in_a_large_bucket(spark, monkeypatch, cell_rows):
    """in a bucket beyond every size the pairs that are alike are found among those that are not."""
    monkeypatch.setattr(minhash, "BUCKET_ROWS", cell_rows)
    monkeypatch.setattr(minhash, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(minhash, "ROUNDS", 0)  # all is left to the search without a cap
    draw = random.Random(6)
    texts = list(group_of_copies(draw, 120, 6))
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts]  # each at 0.99 to its own
    found = classes(spark, texts)
    assert all(found[i] == found[i + 120] for i in range(120))
    alike = [(i, j) for i in range(240) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    root = list(range(240))
    for _ in range(240):
        for i, j in alike:
            root[i] = root[j] = min(root[i], root[j])
    assert sum(found[i] != root[i] for i in range(240)) <= 2
    assert len(set(root)) > 60


def test_stage_links_by_fingerprint_too(spark):
    """the stage keeps op2's SimHash; repeated words outweigh what differs."""
    tail = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = spark.createDataFrame([(1, "a b c d e " * 300 + tail("x")), (2, "a b c d e " * 300 + tail("y")), (3, tail("z") * 2)], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, rows, "").collect()) == [1, 3]
    assert len({r.component_id for r in minhash.near_copies(rows).collect()}) == 3


def test_stage_drops_a_copy_with_changed_words(spark):
    base = [f"w{i}" for i in range(250)]
    copy = ["other" if i in (60, 160, 200) else w for i, w in enumerate(base)]
    rows = spark.createDataFrame(
        [(3, " ".join(base)), (5, " ".join(copy)), (6, " ".join(base[:120])), (7, "a b c"), (8, "a b c d"), (9, None), (1, " "), (None, " ".join(copy))],
        "doc_id long, text string")
    assert jaccard(rows.collect()[0].text, rows.collect()[1].text) > 0.8
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 6, 7, 8]
    assert minhash.near_copies(rows.limit(0)).count() == 0
