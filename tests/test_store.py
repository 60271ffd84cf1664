import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators import store as st
from marketlens.session import stored
from marketlens.sources import scans as sc


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_wins_and_ties(spark):
    df = spark.createDataFrame([("a", 2, "aaa later"), ("a", 1, "zzz first"), ("b", 1, "p"), ("b", 1, "q"), ("c", None, "z"), (None, 9, "nameless")], "k string, o int, v string")
    got = rows(st.latest_wins(df, ["k"], ["o"]))
    assert got[0] == ("a", 2, "aaa later") and got[1][:2] == ("b", 1) and got[2:] == [("c", None, "z")]
    assert got == rows(st.latest_wins(df.repartition(3), ["k"], ["o"]))
    with pytest.raises(ValueError):
        st.latest_wins(df, ["k"], [])


def test_latest_wins_sorts_no_text(spark):
    df = spark.createDataFrame([("a", 1, "long text")], "k string, o int, v string")
    plan = st.latest_wins(df, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert not any("Aggregate" in line and "v#" in line for line in plan.splitlines())


def test_latest_wins_writes_copies_lean_and_finds_winners_once(spark, monkeypatch):
    """no hash travels with the copies, and the winners are worked out once though measured and joined."""
    kept = []
    monkeypatch.setattr(st, "stored", lambda df, name="stored": kept.append((name, df.columns)) or stored(df, name))
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert rows(st.latest_wins(df, ["k"], ["o"])) == [("a", 2, "y"), ("b", 1, "z")]
    assert kept == [("copies", ["k", "o", "v", "_row"]), ("winners", ["_row"])]


def test_device_updates_keep_the_splits_of_a_large_table(spark, tmp_path):
    """line items are read in as many tasks as they have splits, and not shuffled to be read."""
    from workload import store_queries as sq

    n = 3 * spark.sparkContext.defaultParallelism
    li = spark.range(0, 1000, 1, n).select(
        F.col("id").alias("l_orderkey"), F.lit("O").alias("l_linestatus"), F.lit("N").alias("l_returnflag"), F.lit("1995-01-01").alias("l_shipdate"),
        F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.lit(1).alias("l_linenumber"))
    li.write.parquet(f"{tmp_path}/lineitem.parquet")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        updates = sq._device_updates(spark, str(tmp_path))
        assert updates.rdd.getNumPartitions() >= n and updates.count() == 1000
        assert "Exchange" not in updates._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_publish_after_reading_the_same_store(spark, tmp_path):
    path, new = str(tmp_path / "store"), spark.createDataFrame([("b", "2", 5), (None, "x", 9)], "k_number string, v string, at int")
    st.publish(spark.createDataFrame([("a", "1"), ("b", "1")], "k_number string, v string"), path)
    for _ in range(2):
        st.publish(st.upsert(st.published(spark, path), new, ["k_number"], ["at"]), path)
    assert rows(st.published(spark, path)) == [("a", "1"), ("b", "2")] and rows(st.published(spark, path, 1))[1] == ("b", "1")
    (tmp_path / "store" / "version=9").mkdir()
    assert rows(st.published(spark, path)) == [("a", "1"), ("b", "2")]


def test_upsert_is_idempotent_and_overwrites_all_columns(spark):
    old = spark.createDataFrame([("a", "1", "keep"), ("b", "1", "gone")], "k_number string, v string, w string")
    new = spark.createDataFrame([("b", None, "2"), ("c", "3", None)], "k_number string, w string, v string")
    once = st.upsert(old, new, ["k_number"], ["v"])
    assert rows(once) == rows(st.upsert(once, new, ["k_number"], ["v"]))
    assert sorted((r["k_number"], r["v"], r["w"]) for r in once.collect()) == sorted([("a", "1", "keep"), ("b", "2", None), ("c", None, "3")], key=str)


def test_replace_matches_clears_searched_keys(spark):
    schema = "k_number string, biomarker_key string, match_mode string, confidence string, via_k_number string"
    store = spark.createDataFrame([("K1", "psa", "exact", "confirmed", None), ("K2", "psa", "gudid", "inferred", None), ("K3", "rf", "exact", "confirmed", None)], schema)
    fresh = spark.createDataFrame([("K9", "psa", "broad", "confirmed", None), ("K9", "psa", "broad", "confirmed", None)], schema)
    keys = spark.createDataFrame([("psa",), ("empty",)], "biomarker_key string")
    got = {(r["k_number"], r["biomarker_key"], r["match_mode"]) for r in st.replace_matches(store, fresh, keys).collect()}
    assert got == {("K9", "psa", "broad"), ("K3", "rf", "exact")}
    gone = spark.createDataFrame([("rf",)], "biomarker_key string")
    assert st.replace_matches(store, store.limit(0), gone).count() == 2


def test_cached_and_new(spark, terms):
    keyed = sc.term_keys(terms)
    done = spark.createDataFrame([("gad65",), ("rf",)], "term_key string")
    cached, new = st.split_cached(keyed, done)
    assert {r["term"] for r in cached.collect()} == {"Anti-GAD65", "Anti-GAD65 IgG", "RF"}
    assert cached.count() + new.count() == terms.count()
    assert st.split_cached(keyed, done, refresh=True)[1].count() == terms.count()


def test_scope_last_panel_wins(spark):
    records = spark.createDataFrame(
        [("K1", "IM", "first"), ("K1", "MI", "last"), ("K2", "SU", "out"), (None, "IM", "no key"), ("K3", "CH", "one")],
        "k_number string, advisory_committee string, device_name string")
    assert rows(sc.scope_corpus(records)) == [("K1", "MI", "last"), ("K3", "CH", "one")]


def test_scan_envelope_with_both_name_forms(spark, tmp_path):
    (tmp_path / "page.json").write_text(
        '{"meta":{"results":{"total":3}},"results":['
        '{"k_number":"K1","device_name":"A","openfda":{"device_name":"plain"},"decision_date":"2004-09-01"},'
        '{"k_number":"K2","openfda":{"device_name":["Gad","Islet antibody"]},"decision_date":"bad-date"},'
        '{"k_number":"K3"}]}')
    records = sc.scan_clearances(spark, str(tmp_path))
    got = {r["k_number"]: (r["openfda_device_names"], r["decision_date"]) for r in sc.device_columns(records).collect()}
    assert got == {"K1": (["plain"], datetime.date(2004, 9, 1)), "K2": (["Gad", "Islet antibody"], None), "K3": (None, None)}
    packed = st.device_rows(records, "510k").filter("k_number = 'K2'").first()
    assert packed["openfda_device_name"] == "Gad; Islet antibody" and '"source":"510k"' in packed["raw_json"]


def test_scan_text_files(spark, tmp_path):
    (tmp_path / "K123456.txt").write_text("line one\nline two")
    row = sc.scan_document_text(spark, str(tmp_path), fmt="text").first()
    assert (row["k_number"], row["full_text"]) == ("K123456", "line one\nline two")


def test_term_list(spark):
    df = spark.createDataFrame([(1, "HbA1c\nTroponin, PSA\r\n\n , BNP ")], "id int, t string")
    got = [(r["ordinal"], r["term"]) for r in sc.parse_term_list(df, "t").orderBy("ordinal").collect()]
    assert got == [(0, "HbA1c"), (1, "Troponin"), (2, "PSA"), (3, "BNP")]


def test_pending_and_coverage(spark):
    devices = spark.createDataFrame([("K1", "IM"), ("K2", "IM"), ("K3", "CH"), ("K4", "SU")], "k_number string, advisory_committee string")
    docs = spark.createDataFrame([("K1", None, "m"), ("K2", "404", None)], "k_number string, fetch_error string, measurand_value string")
    assert rows(st.pending_documents(devices, docs, ["IM", "CH"])) == [("K3",)]
    assert rows(st.pending_documents(devices, docs, ["IM", "CH"], retry_errors=True)) == [("K2",), ("K3",)]
    assert rows(st.corpus_coverage(devices, docs)) == [("CH", 1, 0, 1, 0, 0), ("IM", 2, 2, 0, 1, 1), ("SU", 1, 0, 1, 0, 0)]


def test_mark_searched(spark):
    old = spark.createDataFrame([("a", "2020"), ("b", "2020")], "term_key string, searched_at string")
    keys = spark.createDataFrame([("b",), ("c",), ("c",)], "term_key string")
    assert rows(st.mark_searched(old, keys, F.lit("2024"))) == [("a", "2020"), ("b", "2024"), ("c", "2024")]


def test_relabel(spark):
    df = spark.createDataFrame([("expansion", "local-llm"), ("expansion", "umls"), ("exact", "umls")], "m string, s string")
    assert [r[0] for r in df.select(tx.relabel_mode(F.col("m"), F.col("s"))).collect()] == ["ai-suggested", "umls", "exact"]


def test_narrow_rows_win_as_wide_ones(spark):
    draw = random.Random(4)
    pick = lambda *x: draw.choice(x)
    rows = [(pick("a", "b", None, f"c{i % 9}"), pick(1, 2, None), pick("x", "", None, f"y{i % 5}")) for i in range(300)] * 2
    df = spark.createDataFrame(rows, "k string, t int, v string").repartition(5)
    for order in (["t"], [-F.col("t"), "v"], [F.lit(0)]):
        got, want = (st.latest_wins(df, ["k"], order, narrow=n) for n in (True, False))
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert st.latest_wins(df.limit(0), ["k"], ["t"], narrow=True).count() == 0
