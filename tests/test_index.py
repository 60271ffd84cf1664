import os
import random

from pyspark.sql import functions as F

from marketlens.operators import commits as cm
from marketlens.operators import index as ix
from marketlens.operators import matching as m
from marketlens.plans import tiers as pl

SCHEMA = "k_number string, device_name string, statement_or_summary string, openfda_device_names array<string>"


def records(draw, n, first=0):
    word = lambda: draw.choice(["anti", "gad", "IgG", "of", "kit", "a", "b", "c", "antibody", "dna", "DS"])
    text = lambda: draw.choice([None, "", " ".join(word() for _ in range(draw.randrange(9))) + draw.choice(["", ".", "!"])])
    return [(f"K{first + i // 2 * 2}" if i % 7 else None, text(), text(), draw.choice([None, [], [text(), text()]])) for i in range(n)]


def lines(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_index_equals_scan_over_deltas(spark, tmp_path):
    draw, base = random.Random(2), str(tmp_path)
    first, second = records(draw, 60), records(draw, 30, first=40)
    state = ix.add(spark, base, spark.createDataFrame(first, SCHEMA).repartition(3))
    state = ix.add(spark, base, spark.createDataFrame(second, SCHEMA).repartition(2))
    replaced = {k for k, *_ in second} - {None}
    now = spark.createDataFrame([r for r in first if r[0] not in replaced] + second, SCHEMA)
    phrases = spark.createDataFrame(list(enumerate(
        ["of", "a b", "b a b", "a a", "kit of", "gad antibody", "DNA", "absent", "a absent", "", " - ", "a", "A-B", "c. a", "ds dna kit"])), "phrase_id int, phrase string")
    want = m.phrase_hits(phrases, m.searchable(now))
    assert lines(ix.phrase_hits(spark, state, phrases)) == lines(want) and want.count() > 40
    names = ["Anti-GAD IgG", "gad", "a b", "Anti-a", "DS DNA", "kit IgG", "of c", "-", "Anti-absent"]
    terms = spark.createDataFrame([(i, t, None if i % 2 else "gad of / a antibody", None) for i, t in enumerate(names)], "term_id int, term string, full string, search string")
    clauses = pl.compile_terms(terms)
    got, want = ix.satisfied_clauses(spark, state, clauses), m.satisfied_clauses(m.searchable(now), clauses)
    columns = ["k_number", "term_id", "tier", "clause_no"]
    assert lines(got.select(columns)) == lines(want.select(columns)) and want.count() > 40


def test_a_delta_leaves_what_is_there(spark, tmp_path):
    draw, base = random.Random(3), str(tmp_path)
    ix.add(spark, base, spark.createDataFrame(records(draw, 200), SCHEMA))
    files = lambda: {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}
    size = lambda paths: sum(os.path.getsize(p) for p in paths)
    before = files()
    state = ix.add(spark, base, spark.createDataFrame(records(draw, 4, first=1000), SCHEMA).coalesce(1))
    after = files()
    assert all(after[p] == t for p, t in before.items())
    assert size(set(after) - set(before)) < size(before)
    assert state.read(spark, "gone").count() == 0
    assert cm.state(spark, base, 1).read(spark, "records").count() == 200


def test_search_reads_postings_of_its_words_only(spark, tmp_path):
    state = ix.add(spark, str(tmp_path), spark.createDataFrame(records(random.Random(4), 100), SCHEMA))
    hits = ix.phrase_hits(spark, state, spark.createDataFrame([(1, "gad kit")], "phrase_id int, phrase string"))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan and " IN (" in plan
    assert "texts" not in plan
    assert ix.phrase_hits(spark, state, spark.createDataFrame([], "phrase_id int, phrase string")).count() == 0


def test_empty_records(spark, tmp_path):
    state = ix.add(spark, str(tmp_path), spark.createDataFrame([], SCHEMA))
    assert ix.phrase_hits(spark, state, spark.createDataFrame([(1, "gad")], "phrase_id int, phrase string")).agg(F.count("*")).first()[0] == 0


def test_words_of_a_text_are_grouped_without_being_shuffled(spark, devices, tmp_path, monkeypatch):
    """texts are dealt out by row; no word of them travels by itself."""
    from marketlens.operators.commits import Change

    plans, append = {}, Change.append
    monkeypatch.setattr(Change, "append", lambda self, store, df, by=None: plans.update({store: df._jdf.queryExecution().executedPlan().toString()}) or append(self, store, df, by))
    ix.add(spark, str(tmp_path / "index"), devices)
    assert "hashpartitioning(row" in plans["postings"] and "hashpartitioning(word" not in plans["postings"]


def test_few_clauses_are_settled_where_a_record_is(spark, tmp_path, monkeypatch):
    """what was found of a record comes together once; no clause is joined to it."""
    state = ix.add(spark, str(tmp_path), spark.createDataFrame(records(random.Random(5), 80), SCHEMA))
    terms = spark.createDataFrame([(1, "Anti-GAD IgG", "gad of / a antibody", None), (2, "a b", None, None)], "term_id int, term string, full string, search string")
    clauses = pl.compile_terms(terms)
    few = ix.satisfied_clauses(spark, state, clauses)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "term_id" not in plan.split("MapInArrow", 1)[1].split("\n", 1)[1]
    masks = lines(m.union_tiers(few).select("term_id", "k_number", "tiers"))
    assert masks == lines(few.groupBy("term_id", "k_number").agg(F.bit_or(m.tier_bit("tier")).alias("tiers")))
    monkeypatch.setattr(ix, "fits_broadcast", lambda df: False)
    many = ix.satisfied_clauses(spark, state, clauses)
    columns = ["k_number", "term_id", "tier", "clause_no"]
    assert lines(few.select(columns)) == lines(many.select(columns)) and len(masks) > 10
