import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marketlens.llm import graph, simhash
from marketlens.llm import textbytes as tb


def brute_fp(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_classes(fps):
    """{fp: smallest fp reachable} by a plain search."""
    left, out = set(fps), {}
    while left:
        start = min(left)
        todo, seen = [start], {start}
        while todo:
            x = todo.pop()
            near = {y for y in left - seen if bin(x ^ y).count("1") <= 2}
            seen |= near
            todo += near
        for x in seen:
            out[x] = start
        left -= seen
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB zé \t\n.ü1", max_size=60) | st.none(), min_size=1, max_size=5))
def test_fingerprints_equal_brute_force(texts):
    import pyarrow as pa

    got = simhash.simhash_array(*tb.texts(pa.array(texts, pa.string())))
    assert [int(x) for x in got] == [brute_fp(t) for t in texts]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=80), min_size=1, max_size=30))
def test_xxh64_equals_library(parts):
    parts = parts * 4  # groups of four of a length take the array form
    data = np.frombuffer(b"".join(parts), np.uint8)
    length = np.array([len(p) for p in parts])
    start = np.cumsum(length) - length
    assert [int(x) for x in tb.xxh64(data, start, length)] == [xxhash.xxh64_intdigest(p, 42) for p in parts]


def _long(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("bucket_rows", [0, 3, 64])
def test_links_connect_exactly_what_two_bits_connect(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    draw = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(25):
        x = draw.getrandbits(64)
        for _ in range(draw.randrange(1, 12)):
            fps.add(x)
            for _ in range(draw.choice([1, 2, 2, 3])):
                x ^= 1 << draw.randrange(64)
    links = simhash.fingerprint_links(spark.createDataFrame([(_long(x),) for x in fps], "fp long")).collect()
    for r in links:
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    got, want = {}, {}
    for x, least in brute_classes(fps).items():
        want.setdefault(least, set()).add(x)
        got.setdefault(roots.get(_long(x), _long(x)), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chain_and_bad_links(spark):
    chain = [(i, i + 1) for i in range(300)] + [(5, 5), (None, 7), (1000, 1001)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and roots[1000] == roots[1001] != roots[0]
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_classes_of_documents(spark, docs):
    base = " ".join(f"w{i}" for i in range(400))
    table = docs(None, base, "", base, " \n", base + " w9", "other text here", "x" * 300_000, ids=[9, 4, 8, 2, 7, 5, None, 1])
    found = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(table).collect()}
    assert len(found) == 8
    assert found[9] == found[8] == found[7] == (0, 7)
    assert found[4][1] == found[2][1] == 2
    assert found[None][1] is None and found[1][1] == 1
    assert simhash.near_duplicates(docs()).count() == 0
    assert simhash.near_duplicates(table.union(table)).count() == 16
