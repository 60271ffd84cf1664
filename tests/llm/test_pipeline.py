import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_minhash import jaccard
from tests.llm.test_packing import check
from tests.llm.test_winnowing import brute

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short item")]
PARTS = {"xx": ["ka", "to", "mi", "re", "lon"], "yy": ["scht", "ung", "ei", "ver", "tau"]}


def make_docs():
    draw = random.Random(11)
    rows, toxic = [], set()
    for i in range(300):
        lang = draw.choice(sorted(PARTS))
        word = lambda: "".join(draw.choice(PARTS[lang]) for _ in range(draw.randrange(1, 5)))  # noqa: E731, B023
        words = [word() for _ in range(draw.randrange(40, 120))]
        if i % 9 == 0 and i != 9:
            words.insert(draw.randrange(len(words)), draw.choice(["zoggba", "zoggri", "zoggno"]))
            toxic.add(i)
        if i % 11 == 3:
            k = draw.randrange(len(words))
            words[k:k] = ITEMS[0][1].split() if i % 2 else ["short", "item"]
        rows.append((i, " ".join(words) + ".", lang, "s"))
    copies = [(400 + k, rows[1 + k % 5 * 2][1], "xx", "t") for k in range(40)]
    near = [(500 + k, rows[7][1] + f" {PARTS['xx'][k % 5]}", None, "t") for k in range(10)]
    odd = [(600, None, "xx", "s"), (601, "", "yy", "s"), (602, "12 + 7 = 19", "xx", "s"), (603, "qqwzx jjfpq wwzzq xqqjp " * 20, None, "s"), (4, rows[4][1], "xx", "s"), (None, rows[2][1], "xx", "s"), (None, "kato " * 50, "xx", "s"), (None, "kato " * 50, "xx", "s")]
    return rows + copies + near + odd, toxic


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    rows, toxic = make_docs()
    sf = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, len(r[1] or ""), "more") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 600 and r[0] % 5], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf, toxic


@pytest.fixture(scope="module")
def chain(spark, given, tmp_path_factory):
    """What each stage was given, each written and reread, and the last one's rows."""
    sf, _ = given
    folder, docs, inputs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        out = stage(spark, docs, sf)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return inputs, out


def near_classes(texts):
    """The smallest index reachable over pairs of similarity 0.8 or more, by comparing all."""
    least = list(range(len(texts)))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    while any(least[i] != least[j] for i, j in near):
        for i, j in near:
            least[i] = least[j] = min(least[i], least[j])
    return least


def test_each_stage_on_its_own_input(given, chain):
    toxic, (inputs, out) = given[1], chain
    before = lambda k: set(inputs[k])
    gone = {i for i, _ in before(0) - before(1)}
    assert gone == toxic
    gone = {i for i, _ in before(1) - before(2)}
    assert gone == {600, 601, 602, 603}

    classes = defaultdict(list)
    for (i, _), c in zip(inputs[2], near_classes([t for _, t in inputs[2]])):
        classes[c].append(i)
    stay = sorted((min((i for i in c if i is not None), default=-1) for c in classes.values()))
    assert sorted(-1 if i is None else i for i, _ in inputs[3]) == stay and len(stay) < len(inputs[2])

    clean = {(i, t) for i, t in before(3) if not brute(t, ITEMS)[1]}
    assert before(4) == clean and len(clean) < len(before(3)) and len(clean) > 100
    named = {i: t for i, t in clean if i is not None}
    rows = out.filter("doc_id IS NOT NULL").collect()
    whole = out.collect()
    if len(rows) == len(whole):
        assert check(rows, named) == 0
    else:
        assert {r.doc_id for r in rows} == set(named)
    counts = {r.sequence_id: r.n for r in out.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert all(n == 1024 or n & (n - 1) == 0 for n in counts.values())


def test_run_equals_its_stages(spark, given, chain):
    per_doc = lambda df: sorted((str(r.doc_id), r.n, r.doc_tokens, r.pieces) for r in df.groupBy("doc_id", "doc_tokens").agg(
        F.sum("length").alias("n"), F.count_distinct("start").alias("pieces")).collect())
    got, want = corpus_pipeline.run(spark, given[0]), chain[1]
    assert [x[:3] for x in per_doc(got)] == [x[:3] for x in per_doc(want)] and got.count() > 100


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
