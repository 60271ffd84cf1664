import random

import pytest

from marketlens.functions import text as tx
from marketlens.operators import matching as m
from marketlens.plans import tiers as pl


def found(df):
    return {(r["term_id"], r["k_number"], r["match_mode"]) for r in df.collect()}


def test_waterfall_on_known_cases(terms, devices):
    assert found(m.match_terms(terms, devices)) == {
        (2, "K900002", "broad"), (3, "K900002", "antigen-only"), (5, "K041628", "wordform"),
        (6, "K900001", "fused-anti"), (7, "K900002", "antigen-only"), (10, "K900003", "exact"),
    }


def test_expansion_tier(spark, devices):
    t = spark.createDataFrame(
        [(1, "ZZ1", "ablation probe", None), (2, "Anti-ZZ2", "x", "novel assay/GAD65"), (3, "ZZ3", "x", "antinuclear/anti"),
         (4, "Anti-ZZ4", None, "antinuclear"), (5, "ZZ5", None, None), (6, "ZZ6", None, "rheumatoid probe ablation factor RF missing")],
        "term_id int, term string, full string, search string")
    assert found(m.match_terms(t, devices)) == {
        (1, "K900003", "expansion"), (2, "K900002", "expansion"), (3, "K041628", "expansion"), (4, "K041628", "expansion")}


def test_label_is_lowest_contributing_tier(spark, devices):
    t = spark.createDataFrame([(1, "GAD65", "RF ablation", None)], "term_id int, term string, full string, search string")
    assert found(m.match_terms(t, devices)) == {(1, "K900002", "exact"), (1, "K900003", "exact")}


def brute(terms, devices, clauses):
    """Satisfied clauses by plain Python over the collected fixtures."""
    import re

    def norm(x):
        return " " + " ".join(t for t in re.split(r"[^a-z0-9]+", (x or "").lower()) if t) + " "

    out = set()
    for d in devices.collect():
        texts = [norm(d["device_name"]), norm(d["statement_or_summary"]), "|".join(norm(x) for x in d["openfda_device_names"] or [])]
        words = set(" ".join(texts).replace("|", " ").split())
        anti, strict = words & set(tx.ANTI_WORDS), words & set(tx.ANTIBODY_WORDS)
        for c in clauses.collect():
            if c["scope"] == "same":
                ok = any(all(p in t for p in c["phrases"]) for t in texts)
            else:
                ok = all(any(p in t for t in texts) for p in c["phrases"])
            ok = ok and {"explicit": bool(anti), "implied": bool(strict), "none": True}[c["anti"]]
            if ok:
                out.add((c["term_id"], c["tier"], c["clause_no"], d["k_number"]))
    return out


@pytest.mark.parametrize("small", [True, False])
def test_random_clauses_equal_brute_force(spark, small, monkeypatch):
    from marketlens.operators.skew import salted_join

    monkeypatch.setattr(salted_join, "__defaults__", (10,))  # most words count as hot
    rnd = random.Random(7)
    vocab = ["gad", "dna", "igg", "anti", "antibody", "ab", "cell", "x1", "beta", "kit"]

    def words(n):
        return rnd.choice([" ", "-", ", "]).join(rnd.choice(vocab) for _ in range(n))

    devices = spark.createDataFrame(
        [(f"K{i:06d}", words(rnd.randint(1, 6)), rnd.choice([None, words(30)]), rnd.choice([None, [words(2), words(1)]])) for i in range(120)],
        "k_number string, device_name string, statement_or_summary string, openfda_device_names array<string>")
    terms = spark.createDataFrame(
        [(i, rnd.choice(["", "Anti-", "anti "]) + words(rnd.randint(1, 3)) + rnd.choice(["", " IgG"]), words(2), "/".join(words(rnd.randint(1, 7)) for _ in range(2)))
         for i in range(60)], "term_id int, term string, full string, search string")
    clauses = pl.compile_terms(terms).cache()
    got = {(r["term_id"], r["tier"], r["clause_no"], r["k_number"])
           for r in m.satisfied_clauses(m.searchable(devices), clauses, small=small).collect()}
    assert got == brute(terms, devices, clauses)


def test_one_term_predicates_agree_with_phrase_hits(spark, devices):
    phrases = ["antibody", "RF ablation", "DS DNA", "gad islet", "-", "assay"]
    table = spark.createDataFrame(list(enumerate(phrases)), "phrase_id int, phrase string")
    hits = m.phrase_hits(table, m.searchable(devices))
    got = {(r["phrase_id"], r["k_number"]) for r in hits.collect()}
    expected = {
        (i, r["k_number"])
        for i, p in enumerate(phrases)
        for r in devices.filter(m.phrase_in_any_field(devices, m.SEARCH_FIELDS, p)).collect()
    }
    assert got == expected
    assert {r["field"] for r in hits.filter("phrase_id = 0").collect()} == {2}


def test_token_predicates(devices):
    def names(c):
        return {r["k_number"] for r in devices.filter(c).collect()}

    assert names(m.all_tokens_same_field(devices, m.SEARCH_FIELDS, ["islet", "gad"])) == {"K900002"}
    assert names(m.all_tokens_any_field(devices, m.SEARCH_FIELDS, ["rheumatoid", "probe"])) == {"K900003"}
    assert names(m.all_tokens_same_field(devices, m.SEARCH_FIELDS, ["rheumatoid", "probe"])) == set()


def test_corpus_counts_choose_the_rare_anchor(spark, devices):
    clauses = spark.createDataFrame(
        [(1, 1, 0, "any", "none", [" antibody ", " gad "])],
        "term_id int, tier int, clause_no int, scope string, anti string, phrases array<string>")
    counts = m.token_counts(m.searchable(devices))
    assert pl.with_anchor(clauses, counts).first()["anchor"] == "gad"
    assert pl.with_anchor(clauses).first()["anchor"] == "antibody"


def test_matching_plan_never_shuffles_text(terms, devices):
    masks = m.union_tiers(m.satisfied_clauses(m.searchable(devices), pl.compile_terms(terms)))
    plan = masks._jdf.queryExecution().executedPlan().toString()
    exchanges = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln]
    assert len(exchanges) >= 1 and all("k_number" in ln or "anchor" in ln for ln in exchanges)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("small", [True, False])
def test_null_and_repeated_keys(spark, small):
    """Every record answers for itself, whatever its key."""
    devices = spark.createDataFrame(
        [("K1", "gad kit"), ("K1", "gad assay"), (None, "the gad"), ("K2", "other"), ("K1", "gad kit")],
        "k_number string, device_name string").selectExpr("*", "cast(null as string) AS statement_or_summary", "cast(null as array<string>) AS openfda_device_names")
    corpus = m.searchable(devices)
    clauses = spark.createDataFrame(
        [(1, 1, 0, "any", "none", [" gad "]), (2, 1, 0, "any", "none", [" gad ", " kit "])],
        "term_id int, tier int, clause_no int, scope string, anti string, phrases array<string>")
    got = sorted((r["term_id"], r["k_number"] or "-") for r in m.satisfied_clauses(corpus, clauses, small=small).collect())
    assert got == [(1, "-"), (1, "K1"), (1, "K1"), (1, "K1"), (2, "K1"), (2, "K1")]
    phrases = spark.createDataFrame([(1, "gad")], "phrase_id int, phrase string")
    assert m.phrase_hits(phrases, corpus, small=small).count() == 4


def test_a_word_of_every_record_in_many_clauses(spark, monkeypatch):
    from marketlens.operators import skew

    monkeypatch.setattr(skew.salted_join, "__defaults__", (50,))
    devices = spark.range(60).selectExpr(
        "printf('K%06d', id) AS k_number", "concat('hot word', id % 7) AS device_name", "cast(null as string) AS statement_or_summary", "cast(null as array<string>) AS openfda_device_names")
    clauses = spark.range(40).selectExpr("cast(id as int) AS term_id", "1 AS tier", "0 AS clause_no", "'any' AS scope", "'none' AS anti", "array(' hot ', concat(' word', id % 10, ' ')) AS phrases")
    rows = {}
    for small in (True, False):
        hits = m.satisfied_clauses(m.searchable(devices), clauses, small=small)
        rows[small] = sorted((r["term_id"], r["k_number"]) for r in hits.collect())
    assert rows[True] == rows[False] and len(rows[True]) == sum(1 for t in range(40) for k in range(60) if t % 10 == k % 7)


@pytest.mark.parametrize("small", [True, False])
def test_conditions_beyond_what_is_settled_without_text(spark, small):
    """More phrases, runs, words and fields than the first test looks at."""
    corpus = spark.createDataFrame(
        [("K1", [" a b c d e f ", " g h ", " i | j ", " k l m n o "]), (None, [" a b ", " c d ", " e f ", " a b c d e f "]),
         ("K2", [" a b c d e ", " f ", " g ", " k "]), ("K2", [" b ", " ", " ", " a "])],
        "k_number string, texts array<string>")
    clauses = [
        (1, "any", [" a b ", " c d ", " e f "]), (2, "any", [" a b ", " c d ", " f e "]),
        (3, "same", [" a ", " b ", " c ", " d ", " e "]), (4, "same", [" a ", " b ", " c ", " d ", " f "]),
        (5, "same", [" k ", " o "]), (6, "same", [" i ", " j "]), (7, "same", [" a ", " k "]), (8, "any", [" k l m n o "]),
        (9, "any", [" b c d e f g "]), (10, "same", [" a b "]), (11, "any", [" a ", " g ", " k "]), (12, "any", [" b "])]
    clauses = spark.createDataFrame([(t, 1, 0, s, "none", p) for t, s, p in clauses], "term_id int, tier int, clause_no int, scope string, anti string, phrases array<string>")
    got = sorted((r["term_id"], r["k_number"] or "-") for r in m.satisfied_clauses(corpus, clauses, small=small).collect())
    assert got == sorted([(1, "K1"), (1, "-"), (3, "K1"), (3, "-"), (3, "K2"), (4, "K1"), (4, "-"), (5, "K1"), (6, "K1"), (8, "K1"),
                          (10, "K1"), (10, "-"), (10, "K2"), (11, "K1"), (11, "K2"), (12, "K1"), (12, "-"), (12, "K2"), (12, "K2")])


def test_only_numbers_travel_until_a_pair_is_likely(spark, terms, devices, monkeypatch):
    written, stored = {}, m.stored
    monkeypatch.setattr(m, "stored", lambda df, name="stored": written.setdefault(name, stored(df, name)))
    clauses = pl.compile_terms(terms)
    m.satisfied_clauses(m.searchable(devices), clauses, small=False).collect()
    assert written["pairs"].columns == ["_row", "_condition"]
    assert written["met"].columns == ["_row", "_condition", "k_number"]
    assert "users" not in written["conditions"].columns
