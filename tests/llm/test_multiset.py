import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marketlens.llm import multiset


def texts():
    draw = random.Random(1)
    line = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    long = ["\n".join(line(30) for _ in range(12)) for _ in range(20)]
    return [None, "", "é", "ab", "x\ny", " \n\n", *long, long[3], "z " * 200_000, "a\n" * 50_000]


def test_edited_text_and_next(spark, docs):
    all_texts = texts()
    ids = [i * 7 - 20 for i in range(len(all_texts))]
    random.Random(2).shuffle(ids)
    order = sorted(zip(ids, all_texts))
    want = {}
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        h = len(t) // 2
        want[i] = (len(t), t[: len(t) - h] + n[:h], n)
    for parts in (1, 3, 8):
        rows = multiset.compare_with_edited(docs(*all_texts, ids=ids), parts=parts).collect()
        assert len(rows) == len(ids)
        for r in rows:
            n, edited, after = want[r.doc_id]
            assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
            if 1000 < n < 10_000 and len(after) < 10_000:  # one run repeated without end outweighs all others
                assert 0.3 < r.near_edited < 0.75 and r.near_next < 0.3 or r.near_next == 1
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(zip(ids, all_texts))[r.doc_id] or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_ids_missing_or_repeated(spark, docs):
    rows = multiset.compare_with_edited(docs("abcd", "efgh", "ijkl", None, ids=[None, 4, 4, None]), parts=2).collect()
    assert sorted(r.n_chars for r in rows) == [0, 4, 4, 4]
    assert hashlib.sha256(b"ab").hexdigest() in {r.edited_sha256 for r in rows}
    assert multiset.compare_with_edited(docs(), parts=2).count() == 0
    only = multiset.compare_with_edited(docs("abc def"), parts=2).collect()
    assert [r.near_next for r in only] == [1.0]


def test_paragraphs_add_up_in_any_order(spark):
    df = spark.createDataFrame([("one two three four\nfive six\nfive six", "five six\none two three four\nfive six", "five six", "one two three four\nfive six")], "a string, b string, c string, d string")
    for c in "abcd":
        df = multiset.fingerprints(df, c, f"f{c}")
    r = df.select("fa", "fb", multiset.inserted("fd", "fc").alias("more"), multiset.deleted("fa", "fc").alias("less"), "fd",
                  multiset.likeness("fa", "fb").alias("same"), multiset.likeness("fa", "fc").alias("part")).first()
    assert r.fa == r.fb == r.more and r.less == r.fd and r.same == 1.0 and 0 <= r.part < 1


@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_likeness_follows_the_shared_share(spark, share):
    lines = [f"a{i} b{i * i} c{i % 9} d{i * 3} e{i}" for i in range(800)]
    k = int(400 * share)
    df = spark.createDataFrame([("\n".join(lines[:400]), "\n".join(lines[:k] + lines[400 : 800 - k]))], "a string, b string")
    df = multiset.fingerprints(multiset.fingerprints(df, "a", "fa"), "b", "fb")
    assert abs(df.select(multiset.likeness("fa", "fb")).first()[0] - share) < 0.2
    assert df.select(F.col("fa") != F.col("fb")).first()[0]
