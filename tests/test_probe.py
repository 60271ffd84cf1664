import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators import matching as m
from marketlens.operators import probe as pr
from marketlens.plans import tiers as pl

FLAGS = {tx.EXPLICIT: tx.ANTI_WORDS, tx.IMPLIED: tx.ANTIBODY_WORDS}
VOCAB = ["anti", "antibody", "ab", "gad", "a", "b", "c", "ß", "dna", "x1"]


def drawn(seed, rows, clauses, fields):
    draw = random.Random(seed)
    said = lambda n: " " + " ".join(draw.choice(VOCAB) for _ in range(n)) + " "
    text = lambda: draw.choice([" ", said(draw.randrange(1, 9)), said(2) + "|" + said(3), None])
    records = [(f"K{i}" if i % 5 else None, draw.choice([None, [], [text() for _ in range(draw.randrange(1, fields + 1))]])) for i in range(rows)]
    asked = [(i // 3, 1 + i % 6, i, draw.choice(["any", "same"]), draw.choice([tx.NONE, tx.EXPLICIT, tx.IMPLIED]), [said(draw.randrange(1, 4)) for _ in range(draw.randrange(1, 4))]) for i in range(clauses)]
    return records, asked


def batch(records):
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in records], pa.string()), pa.array([t for _, t in records], pa.list_(pa.string()))], names=["k", "texts"])


def table(asked):
    names = ["term_id", "tier", "clause_no", "scope", "anti", "phrases"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
    return pa.table([pa.array([a[i] for a in asked], t) for i, t in enumerate(types)], names=names)


def plain(records, asked):
    for key, texts in records:
        texts = [t for t in texts or () if t is not None]
        words = {w for t in texts for w in t.split()}
        for term, tier, no, scope, anti, phrases in asked:
            met = any(all(p in t for p in phrases) for t in texts) if scope == "same" and len(set(phrases)) > 1 else all(any(p in t for t in texts) for p in phrases)
            if met and (anti == tx.NONE or words & set(FLAGS[anti])):
                yield key, term, tier, no


@pytest.mark.parametrize("seed, rows, fields", [(1, 700, 3), (2, 90, 1), (3, 70, 40), (4, 1, 3)])
def test_facts_and_masks_equal_brute_force(seed, rows, fields, monkeypatch):
    monkeypatch.setattr(pr, "OUT_ROWS", 50)
    records, asked = drawn(seed, rows, 80, fields)
    probe = pr.Probe(table(asked), FLAGS)
    want = sorted(plain(records, asked), key=str)
    got = [r for b in pr.facts([batch(records[:33]), batch(records[33:]).slice(0)], probe, ["k"]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(got, key=str) == want and (want or rows == 1)
    numbered = [(i, t) for i, (_, t) in enumerate(records)]
    tiers = {}
    for i, term, tier, _ in plain(numbered, asked):
        tiers[term, i] = tiers.get((term, i), 0) | 1 << tier - 1
    whole = batch(records).set_column(0, "k", pa.array(np.arange(rows)))
    assert {(t, k): x for b in pr.masks([whole], probe, ["k"]) for t, k, x in zip(*(c.to_pylist() for c in b.columns), strict=True)} == tiers


def test_clauses_that_find_nothing():
    asked = [(1, 1, 0, "any", tx.NONE, [" "]), (None, 1, 0, "any", tx.NONE, [" a "]), (2, 1, 0, "any", tx.NONE, [" a ", None]), (3, 1, 0, "any", tx.NONE, None)]
    rows = batch([("K", [" a b "])])
    for clauses in (asked, []):
        probe = pr.Probe(table(clauses), FLAGS)
        assert [*pr.facts([rows], probe, ["k"])] == [] and [*pr.masks([rows, rows.slice(0, 0)], probe, ["k"])] == []


def test_clauses_under_one_name_are_one(spark):
    """As the choice of anchors has it: of several clauses with the same term, tier and number one counts."""
    clauses = spark.createDataFrame([(1, 1, 0, "any", "none", [" a "]), (1, 1, 0, "any", "none", [" a "]), (1, 1, 0, "any", "none", [" gad "])],
                                    "term_id int, tier int, clause_no int, scope string, anti string, phrases array<string>")
    corpus = spark.createDataFrame([("K1", [" a gad "]), ("K2", [" a "])], "k_number string, texts array<string>")
    assert [r["k_number"] for r in m.satisfied_clauses(corpus, clauses, small=True).collect()] == ["K1"]


def test_a_record_hands_on_one_row_for_a_term(spark, terms, devices, monkeypatch):
    """F7 to F9, F13, F14: clauses are settled and united in the record; only records whose key is missing
    or comes again are grouped."""
    written, stored = {}, m.stored
    monkeypatch.setattr(m, "stored", lambda df, name="stored": written.setdefault(name, stored(df, name)))
    asked = terms.unionByName(terms.withColumn("term_id", F.col("term_id") + 100))
    twice = devices.unionByName(devices.filter("k_number = 'K900002'")).unionByName(devices.withColumn("k_number", F.lit(None).cast("string")))
    facts = m.satisfied_clauses(m.searchable(twice), pl.compile_terms(asked))
    want = {(r["term_id"], r["k_number"]): r["tiers"] for r in facts.groupBy("term_id", "k_number").agg(F.bit_or(m.tier_bit("tier")).alias("tiers")).collect()}
    masks = m.union_tiers(facts)
    rows = [tuple(r) for r in masks.select("term_id", "k_number", "tiers").collect()]
    assert {r[:2]: r[2] for r in rows} == want and len(rows) == len(want) > 10
    assert sorted(str(r[0]) for r in written["again"].collect()) == ["K900002", "None"]
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
