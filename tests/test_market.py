from pyspark.sql import functions as F

from marketlens.operators import market as mk
from marketlens.operators import matching as m
from marketlens.sources.export import SHEETS, export_tables


def facts(terms, devices):
    found = m.match_terms(terms, devices).join(terms, "term_id")
    return mk.attach_devices(found.select("term", "k_number"), devices)


def test_market_table_keeps_zero_hit_terms(terms, devices):
    table = mk.summarise(terms.select("term"), facts(terms, devices))
    got = {r["term"]: (r["total_submissions"], r["cleared_count"], r["unique_applicants"], str(r["latest_approval"]), r["crowded"]) for r in table.collect()}
    assert len(got) == terms.count()
    assert got["PSA"] == (0, 0, 0, "None", False) and got["RF"] == (1, 0, 1, "None", False)
    assert got["dsDNA"] == (1, 1, 1, "2004-09-01", False)


def test_filters(devices):
    d = devices.withColumn("term", F.lit("RF test"))

    def names(df):
        return {r["k_number"] for r in df.collect()}

    assert names(mk.filter_date_window(d, "2004-09", "2011-03")) == {"K041628", "K900002"}
    assert names(mk.filter_date_window(d, None, "1999-01")) == {"K900001"}
    assert names(mk.filter_date_window(d, "2015-07")) == {"K900003"}
    assert names(mk.filter_show_only(d, ["acm"])) == {"K041628", "K900001"}
    assert len(names(mk.filter_show_only(d, ["rf"]))) == 5 and len(names(mk.filter_show_only(d, []))) == 5
    extra = d.unionByName(d.limit(1).withColumn("panel", F.lit(None).cast("string")).withColumn("k_number", F.lit("K0")))
    assert names(mk.filter_exclude_panels(extra, ["SU", "IM"])) == {"DEN140001", "K0"}


def test_rank_spans_partitions(spark):
    df = spark.range(1000).select(F.format_string("t%04d", "id").alias("term"), (F.col("id") * 7919 % 13).alias("cleared_count"))
    ranked = mk.rank_terms(df.repartition(9), mk.fewest_approvals()).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, 1001))
    order = [(r["cleared_count"], r["term"]) for r in ranked]
    assert order == sorted(order)


def test_rank_most_recent_nulls_last(spark):
    df = spark.createDataFrame([("a", None), ("b", "2001"), ("c", "2003")], "term string, latest_approval string")
    assert [r["term"] for r in mk.rank_terms(df, mk.most_recent()).orderBy("rank").collect()] == ["c", "b", "a"]


def test_cap_keeps_the_true_total(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("term"), F.format_string("K%06d", "id").alias("k_number"))
    capped = mk.cap_per_term(df, ["term"], ["k_number"], 300)
    got = {r["term"]: (r["n"], r["t"]) for r in capped.groupBy("term").agg(F.count("*").alias("n"), F.max("total").alias("t")).collect()}
    assert got == {"hot": (300, 900), "cold": (100, 100)}
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


def test_pages_and_top_k(spark):
    df = spark.range(120).select(F.col("id").alias("k"))
    assert [r["k"] for r in mk.page(df, ["k"], 100, 100).collect()] == list(range(100, 120))
    top = mk.top_k_with_total(df, ["k"], 50).collect()
    assert len(top) == 50 and {r["total"] for r in top} == {120}


def test_nested_result(spark, devices):
    matches = spark.createDataFrame(
        [("RF", "K900003", "wordform", "confirmed", None), ("RF", "K900002", "broad", "confirmed", None), ("RF", "DEN140001", "broad", "confirmed", None),
         ("RF", "K900001", "predicate", "inferred", "K900003"), ("RF", "K041628", "gudid", "inferred", None)],
        "term string, k_number string, match_mode string, confidence string, via_k_number string")
    wanted = spark.createDataFrame([("RF",), ("none",)], "term string")
    rows = mk.nested_result(wanted, matches, devices.select("k_number", "applicant"), chunk=2).collect()
    got = {(r["term"], r["kind"], r["chunk_no"]): r for r in rows}
    assert set(got) == {("RF", "records", 0), ("RF", "records", 1), ("RF", "inferred", 0), ("RF", "registry", 0), ("none", "records", 0)}
    assert [e["k_number"] for n in (0, 1) for e in got["RF", "records", n]["entries"]] == ["DEN140001", "K900002", "K900003"]
    assert {(r["total"], r["match_mode"]) for r in rows if r["kind"] == "records"} == {(3, "broad"), (0, "exact")}
    cited = got["RF", "inferred", 0]["entries"][0]
    assert (cited["applicant"], cited["via_k_number"], cited["reason"]) == ("Acme", "K900003", "predicate")
    assert got["RF", "registry", 0]["entries"][0]["k_number"] == "K041628" and got["none", "records", 0]["entries"] == []


def test_summary_has_one_row_per_term(spark):
    facts = spark.createDataFrame([("t", "K1", "wordform"), ("t", "K2", "exact"), ("u", "K1", "umls"), ("w", "K1", "strange")], "term string, k_number string, match_mode string").selectExpr(
        "*", "'a' AS applicant", "'Substantially Equivalent' AS decision_description", "date'2001-01-01' AS decision_date")
    terms = spark.createDataFrame([("t",), ("u",), ("v",), ("w",)], "term string")
    got = {r["term"]: (r["total_submissions"], r["match_mode"]) for r in mk.summarise(terms, facts).collect()}
    assert got == {"t": (2, "exact"), "u": (1, "umls"), "v": (0, "exact"), "w": (1, "other")}


def test_filters_apply_together(spark, terms, devices):
    found = m.match_terms(terms, devices).join(terms, "term_id").select("term", "k_number", "match_mode")
    details = mk.attach_devices(found, devices)
    filters = mk.Filters(panels=("IM",), to_month="2011-03", applicant="Acme", exclude_panels=("SU",))
    shown = filters.apply(details).collect()
    assert shown and {(r["panel"], r["applicant"]) for r in shown} == {("IM", "Acme")}
    one = mk.Filters(match_mode=shown[0]["match_mode"]).apply(details).collect()
    assert one and {r["match_mode"] for r in one} == {shown[0]["match_mode"]}
    tables = mk.report(terms.select("term"), details, details.limit(0).withColumn("confidence", F.lit("inferred")).withColumn("via_k_number", F.lit("")), filters, mk.FEWEST_APPROVALS, "2024-05-06")
    assert tables["summary"].agg(F.sum("total_submissions")).first()[0] == len(shown)
    assert {(r["setting"], r["value"]) for r in tables["search_info"].collect()} >= {("panels", "IM"), ("from_month", "All"), ("applicant", "Acme")}


def test_export(spark, terms, devices, tmp_path):
    f = facts(terms, devices)
    names = terms.select("term")
    tables = {
        "search_info": names, "summary": mk.rank_terms(mk.summarise(names, f), mk.fewest_approvals()),
        "biomarker_applicants": mk.biomarker_applicants(names, f), "details": mk.record_rows(f), "unconfirmed_matches": f.limit(0).select("term"),
    }
    assert list(tables) == SHEETS
    written = export_tables(tables, str(tmp_path / "x"), "csv", {"summary": "rank"})
    back = spark.read.option("header", True).csv(written["summary"])
    assert back.count() == terms.count() and "cleared_count" in back.columns
    export_tables(tables, str(tmp_path / "x"), "csv", {"summary": "rank"})
    assert spark.read.option("header", True).csv(written["biomarker_applicants"]).filter("term = 'RF'").first()["applicants"] == "Gamma"


def test_report_works_out_the_shown_facts_once(spark):
    """Three tables of a report read the same written facts, not the joins these came from."""
    terms = spark.createDataFrame([("a",), ("b",)], "term string")
    rows = [("a", f"K{i}", "exact", "d", "x", "Substantially Equivalent", None, None) for i in range(3)]
    details = spark.createDataFrame(rows, "term string, k_number string, match_mode string, device_name string, applicant string, decision_description string, decision_date date, panel string")
    unconfirmed = details.limit(0).withColumn("confidence", F.lit("inferred")).withColumn("via_k_number", F.lit(""))
    tables = mk.report(terms, details, unconfirmed, mk.Filters(exclude_panels=("LOW",)), mk.FEWEST_APPROVALS, "2024-05-06")
    files = set(tables["details"].inputFiles())
    assert files and files <= set(tables["biomarker_applicants"].inputFiles())
    assert {(r.term, r.total_submissions) for r in tables["summary"].collect()} == {("a", 3), ("b", 0)}
    assert sorted(r.k_number for r in tables["details"].collect()) == ["K0", "K1", "K2"]


def test_nested_facts_travel_without_device_columns(spark):
    """facts are dealt out by chunk while they are narrow; few devices come to them."""
    matches = spark.range(30).selectExpr("concat('t', id % 2) AS term", "printf('K%06d', id) AS k_number", "'exact' AS match_mode", "'confirmed' AS confidence", "cast(null as string) AS via_k_number")
    found = spark.range(40).selectExpr("printf('K%06d', id) AS k_number", "concat('of ', id) AS applicant")
    out = mk.nested_result(spark.createDataFrame([("t0",), ("t1",), ("t2",)], "term string"), matches, found, chunk=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    dealt = [ln for ln in plan.splitlines() if "Exchange hashpartitioning" in ln and "chunk_no" in ln]
    assert dealt and all("REPARTITION_BY_COL" in ln for ln in dealt)
    rows = out.collect()
    assert sorted((e["k_number"], e["applicant"]) for r in rows for e in r["entries"]) == [(f"K{i:06d}", f"of {i}") for i in range(30)]
    assert {len(r["entries"]) for r in rows if r["term"] != "t2"} == {3, 4} and [r["total"] for r in rows if r["term"] == "t2"] == [0]
