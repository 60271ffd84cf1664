import random

import pytest

from marketlens.operators import graph as gr


def bfs(seeds, edges, hops):
    """Plain breadth-first search with the smallest cited number as via."""
    citing = {}
    for d, p in edges:
        citing.setdefault(p, set()).add(d)
    out = set()
    for term in {t for t, _ in seeds}:
        visited = {k for t, k in seeds if t == term}
        frontier = set(visited)
        for hop in range(1, hops + 1):
            step = {}
            for p in frontier:
                for d in citing.get(p, ()):
                    if d not in visited:
                        step[d] = min(step.get(d, p), p)
            out |= {(term, d, via, hop) for d, via in step.items()}
            visited |= set(step)
            frontier = set(step)
    return out


def run(spark, seeds, edges, hops=3):
    s = spark.createDataFrame(seeds, "term_id int, k_number string")
    e = spark.createDataFrame(edges, "device_k string, predicate_k string")
    return {tuple(r) for r in gr.propagate_citations(s, e, hops).select("term_id", "k_number", "via_k_number", "hop").collect()}


def test_chain_diamond_cycle_self_loop(spark):
    edges = [("b", "a"), ("c", "b"), ("d", "c"), ("e", "d"), ("x", "b"), ("x", "a2"), ("b", "a2"),
             ("a", "c"), ("s", "s"), ("b", "b"), ("q", "r")]
    seeds = [(1, "a"), (1, "a2"), (2, "s"), (3, "none")]
    assert run(spark, seeds, edges) == bfs(seeds, edges, 3)
    assert (1, "e") not in {(t, k) for t, k, _, _ in run(spark, seeds, edges)}


@pytest.mark.parametrize("split", [False, True])
def test_random_graphs(spark, monkeypatch, split):
    from marketlens.operators import skew

    if split:  # a large frontier, with every cited device counted as hot
        monkeypatch.setattr(gr, "fits_broadcast", lambda df: False)
        monkeypatch.setattr(skew.salted_join, "__defaults__", (3,))
    rnd = random.Random(3)
    nodes = [f"k{i:03d}" for i in range(80)]
    edges = list({(rnd.choice(nodes), rnd.choice(nodes[:20])) for _ in range(160)} | {(n, "k000") for n in nodes[:30]})
    seeds = list({(t, rnd.choice(nodes)) for t in range(5) for _ in range(2)} | {(9, "k000")})
    assert run(spark, seeds, edges) == bfs(seeds, edges, 3)


def test_salted_join_equals_join(spark):
    from marketlens.operators.skew import salted_join

    large = spark.createDataFrame([("hot" if i % 3 else f"c{i}", i) for i in range(300)], "k string, v int")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("c0", 3), ("c3", 4), ("zz", 5)], "k string, w int")
    got = sorted(tuple(r) for r in salted_join(large, other, ["k"], ["v"], hot_pairs=50).select("k", "v", "w").collect())
    assert got == sorted(tuple(r) for r in large.join(other, "k").select("k", "v", "w").collect())
    assert salted_join(large, other, ["k"], ["v"], hot_pairs=50).columns == ["k", "v", "w"]
