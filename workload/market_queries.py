"""Filters, totals, rankings, documents per term, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators import cells as ce
from marketlens.operators import documents as docs
from marketlens.operators import listing as ls
from marketlens.operators import market as mk
from marketlens.operators import matching as m
from marketlens.operators import pages as pg
from marketlens.session import scratch_dir, stored
from marketlens.sources.export import export_tables, listing_tables
from workload import views as v
from workload.registry import query
from workload.sql import CTE

_TERM_K = "SELECT term, k_number FROM v_details"


def _facts(df):
    return df.select("term", "k_number")


def _dates(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


@query("b6_filter_panel_in", "SELECT k_number FROM v_sub_devices WHERE panel IN ('URGENT', 'HIGH')", ("v_sub_devices",))
def b6(spark, sf):
    return mk.filter_panel_in(v.submission_devices(spark, sf), ["URGENT", "HIGH"]).select("k_number")


@query("b7_filter_date_window", f"{_TERM_K} WHERE decision_date BETWEEN DATE '1996-03-01' AND DATE '1998-02-28'", ("v_details",))
def b7(spark, sf):
    return _facts(mk.filter_date_window(v.submission_details(spark, sf), "1996-03", "1998-02"))


@query("b8_filter_applicant", f"{_TERM_K} WHERE applicant = 'Customer#000000007'", ("v_details",))
def b8(spark, sf):
    return _facts(mk.filter_applicant(v.submission_details(spark, sf), "Customer#000000007"))


@query("b9_filter_show_only", f"{_TERM_K} WHERE lower(term) LIKE '%ring%' OR lower(applicant) LIKE '%#000000012%'", ("v_details",))
def b9(spark, sf):
    return _facts(mk.filter_show_only(v.submission_details(spark, sf), ["RING", "#000000012"]))


@query("b10_filter_exclude_panels", f"{_TERM_K} WHERE panel IS NULL OR panel NOT IN ('LOW', 'MEDIUM')", ("v_details",))
def b10(spark, sf):
    return _facts(mk.filter_exclude_panels(v.submission_details(spark, sf), ["LOW", "MEDIUM"]))


@query("b11_filter_confirmed", "SELECT term, k_number FROM v_matches WHERE confidence = 'confirmed'", ("v_matches",))
def b11(spark, sf):
    return _facts(mk.filter_confirmed(v.submission_matches(spark, sf)))


@query("b11_filter_mode", "SELECT term, k_number, via_k_number FROM v_matches WHERE match_mode = 'predicate'", ("v_matches",))
def b11_mode(spark, sf):
    return mk.filter_mode(v.submission_matches(spark, sf), "predicate").select("term", "k_number", "via_k_number")


@query("b15_record_rows", """
  SELECT term, k_number, device_name, applicant, decision_description, CAST(decision_date AS VARCHAR) AS decision_date,
    'https://www.accessdata.fda.gov/scripts/cdrh/cfdocs/cfPMN/pmn.cfm?ID=' || k_number AS record_url FROM v_details""", ("v_details",))
def b15(spark, sf):
    return _dates(mk.record_rows(v.submission_details(spark, sf)), "decision_date")


@query("c1_attach_devices", """
  SELECT term, k_number, match_mode, confidence, via_k_number, applicant, panel FROM v_matches JOIN v_sub_devices USING (k_number)""",
       ("v_matches", "v_sub_devices"))
def c1(spark, sf):
    return mk.attach_devices(v.submission_matches(spark, sf), v.submission_devices(spark, sf)).select(
        "term", "k_number", "match_mode", "confidence", "via_k_number", "applicant", "panel")


def _summary(spark, sf):
    return mk.summarise(v.submission_terms(spark, sf), v.submission_details(spark, sf))


def _summary_column(name, column, sql=None):
    @query(name, f"SELECT term, {sql or column} AS {column} FROM v_summary", ("v_summary",))
    def run(spark, sf):
        c = F.col(column)
        return _summary(spark, sf).select("term", (c.cast("string") if column == "latest_approval" else c.cast("long")).alias(column))


_summary_column("d1_total_submissions", "total_submissions")
_summary_column("d2_cleared_count", "cleared_count")
_summary_column("d2_crowded", "crowded", "CAST(cleared_count >= 10 AS BIGINT)")
_summary_column("d3_unique_applicants", "unique_applicants")
_summary_column("d5_latest_approval", "latest_approval", "CAST(latest_approval AS VARCHAR)")


@query("d4_biomarker_applicants", """
  SELECT t.term, count(d.k_number) AS total_submissions, count(DISTINCT applicant) AS unique_applicants,
    coalesce(array_to_string(list_sort(list_distinct(list(applicant) FILTER (WHERE applicant IS NOT NULL))), '|'), '') AS applicants
  FROM v_sub_terms t LEFT JOIN v_details d USING (term) GROUP BY t.term""", ("v_sub_terms", "v_details"))
def d4(spark, sf):
    out = mk.biomarker_applicants(v.submission_terms(spark, sf), v.submission_details(spark, sf))
    return out.withColumn("applicants", F.array_join("applicants", "|"))


@query("d7_facets", """
  SELECT 'applicant' AS facet, applicant AS value, count(*) AS n FROM v_details WHERE applicant IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'panel', panel, count(*) FROM v_details WHERE panel IS NOT NULL GROUP BY 2""", ("v_details",))
def d7(spark, sf):
    return mk.facets(v.submission_details(spark, sf))


# One query per menu: the filters in FILTERS but the menu's own, and the count under all of them.
FILTERS = mk.Filters(from_month="1993-02", to_month="1997-10", panels=("URGENT", "HIGH", "LOW"), exclude_panels=("LOW",), show_only=("RING", "#00000000"))
_DATED = "decision_date BETWEEN DATE '1993-02-01' AND DATE '1997-10-31'"
_NAMED = "(lower(term) LIKE '%ring%' OR lower(applicant) LIKE '%#00000000%')"
_PANELLED = "(panel IN ('URGENT', 'HIGH', 'LOW') AND panel NOT IN ('LOW'))"
_MENUS = f"""
  SELECT 'applicant' AS facet, applicant AS value, count(*) AS n, count(*) AS shown FROM v_details
  WHERE applicant IS NOT NULL AND {_DATED} AND {_NAMED} AND {_PANELLED} GROUP BY 2
  UNION ALL SELECT 'panel', panel, count(*), count(*) FILTER (WHERE {_PANELLED}) FROM v_details
  WHERE panel IS NOT NULL AND {_DATED} AND {_NAMED} GROUP BY 2
  UNION ALL SELECT 'match_mode', match_mode, count(*), count(*) FROM v_details
  WHERE match_mode IS NOT NULL AND {_DATED} AND {_NAMED} AND {_PANELLED} GROUP BY 2"""


@query("d7_facets_under_filters", _MENUS, ("v_details",))
def d7_under_filters(spark, sf):
    return mk.facets_under_filters(v.submission_details(spark, sf), FILTERS)


@query("d7_facets_from_cells", _MENUS, ("v_details",))
def d7_from_cells(spark, sf):
    return ce.menus(stored(ce.cells(v.submission_details(spark, sf)), "cells"), FILTERS)


@query("d3_totals_from_cells", f"""
  SELECT t.term, count(d.k_number) AS total_submissions,
    count(*) FILTER (WHERE d.decision_description LIKE 'Substantially Equivalent%') AS cleared_count,
    count(DISTINCT d.applicant) AS unique_applicants,
    CAST(max(d.decision_date) FILTER (WHERE d.decision_description LIKE 'Substantially Equivalent%') AS VARCHAR) AS latest_approval,
    count(*) FILTER (WHERE d.decision_description LIKE 'Substantially Equivalent%') >= 10 AS crowded
  FROM v_sub_terms t LEFT JOIN (SELECT * FROM v_details WHERE {_DATED} AND {_NAMED} AND {_PANELLED}) d USING (term) GROUP BY t.term""",
       ("v_sub_terms", "v_details"))
def d3_from_cells(spark, sf):
    """Totals under filters from kept cells, the later half of the devices added as a change."""
    details = v.submission_details(spark, sf)
    early = F.xxhash64("k_number") % 2 == 0
    old, new = stored(ce.cells(details.filter(early)), "cells"), ce.cells(details.filter(~early))
    kept = stored(ce.merged(old, new), "cells")
    return _dates(ce.summarise(v.submission_terms(spark, sf), kept, FILTERS), "latest_approval")


@query("d3_applicants_estimated", """
  SELECT t.term, count(d.k_number) AS total_submissions, true AS within_error
  FROM v_sub_terms t LEFT JOIN v_details d USING (term) GROUP BY t.term""", ("v_sub_terms", "v_details"))
def d3_estimated(spark, sf):
    """Distinct applicants by sketch, each within four standard errors (and one) of the count."""
    terms, kept = v.submission_terms(spark, sf), stored(ce.cells(v.submission_details(spark, sf)), "cells")
    right = ce.summarise(terms, kept).select("term", F.col("unique_applicants").alias("right"))
    near = F.abs(F.col("unique_applicants") - F.col("right")) <= 1 + 4 * ce.SKETCH_ERROR * F.col("right")
    return ce.summarise(terms, ce.sketched(kept)).join(right, "term").select("term", "total_submissions", near.alias("within_error"))


@query("d8_unconfirmed_counts", """
  SELECT t.term, count(*) FILTER (WHERE match_mode = 'predicate') AS via_predicate,
    count(*) FILTER (WHERE match_mode = 'gudid') AS via_registry
  FROM v_sub_terms t LEFT JOIN v_matches USING (term) GROUP BY t.term""", ("v_sub_terms", "v_matches"))
def d8(spark, sf):
    return mk.unconfirmed_counts(v.submission_terms(spark, sf), v.submission_matches(spark, sf))


@query("d9_nested_result", f"""
  SELECT t.term, coalesce(kind, 'records') AS kind, coalesce(chunk_no, 0) AS chunk_no, coalesce(any_value(n), 0) AS total, 'exact' AS match_mode,
    coalesce(string_agg(k_number || ' ' || coalesce(via_k_number, '') || ' ' || CASE kind WHEN 'inferred' THEN 'predicate' ELSE '' END || ' ' || coalesce(applicant, ''), '|'
      ORDER BY k_number, via_k_number), '') AS entries
  FROM v_sub_terms t LEFT JOIN (
    SELECT *, (row_number() OVER (PARTITION BY term, kind ORDER BY k_number) - 1) // {mk.CHUNK_RECORDS} AS chunk_no, count(*) OVER (PARTITION BY term, kind) AS n FROM (
      SELECT m.*, d.applicant, CASE match_mode WHEN 'exact' THEN 'records' WHEN 'predicate' THEN 'inferred' ELSE 'registry' END AS kind
      FROM v_matches m JOIN v_sub_devices d USING (k_number))) USING (term) GROUP BY t.term, kind, chunk_no""",
       ("v_sub_terms", "v_matches", "v_sub_devices"))
def d9(spark, sf):
    """Every record of every term in some chunk."""
    out = mk.nested_result(v.submission_terms(spark, sf), v.submission_matches(spark, sf), v.submission_devices(spark, sf))
    none = F.lit("")
    line = F.transform("entries", lambda e: F.concat_ws(" ", e["k_number"], *[F.coalesce(e[c], none) for c in ("via_k_number", "reason", "applicant")]))
    return out.select("term", "kind", "chunk_no", "total", "match_mode", F.array_join(line, "|").alias("entries"))


@query("d1_summary_of_several_labels", """
  SELECT t.term, count(f.k_number) AS total_submissions, coalesce(['exact', 'broad', 'wordform', 'umls'][min(f.r)], 'exact') AS match_mode
  FROM v_sub_terms t LEFT JOIN (SELECT term, k_number, 1 + CAST(substr(k_number, 7, 1) AS INT) % 3 + CASE WHEN k_number LIKE '%5' THEN 1 ELSE 0 END AS r FROM v_details) f USING (term)
  GROUP BY t.term""", ("v_sub_terms", "v_details"))
def d1_labels(spark, sf):
    """Facts of one term under several labels: still one row, with the best of them."""
    last = F.substring("k_number", 7, 1).cast("int")
    place = last % 3 + F.when(last == 5, 1).otherwise(0)
    label = F.get(F.array(*[F.lit(x) for x in ("exact", "broad", "wordform", "umls")]), place)
    details = v.submission_details(spark, sf).withColumn("match_mode", label)
    return mk.summarise(v.submission_terms(spark, sf), details).select("term", "total_submissions", "match_mode")


@query("e3_rank_terms", """
  SELECT term, cleared_count, row_number() OVER (ORDER BY cleared_count, term) AS rank FROM v_summary""", ("v_summary",))
def e3(spark, sf):
    return mk.rank_terms(_summary(spark, sf), mk.fewest_approvals()).select("term", "cleared_count", "rank")


@query("e4_cap_per_term", """
  SELECT term, k_number, total FROM (SELECT term, k_number, count(*) OVER (PARTITION BY term) AS total,
    row_number() OVER (PARTITION BY term ORDER BY k_number) AS r FROM v_details) WHERE r <= 300""", ("v_details",))
def e4(spark, sf):
    return mk.cap_per_term(_facts(v.submission_details(spark, sf)), ["term"], ["k_number"], mk.MAX_RECORDS)


@query("f1_sort_fewest_approvals", """
  SELECT term, cleared_count, total_submissions FROM v_summary ORDER BY cleared_count, term""", ("v_summary",))
def f1(spark, sf):
    return mk.sort_fewest_approvals(_summary(spark, sf)).select("term", "cleared_count", "total_submissions")


@query("f2_sort_most_recent", """
  SELECT term, CAST(latest_approval AS VARCHAR) AS latest_approval,
    row_number() OVER (ORDER BY latest_approval DESC NULLS LAST, term) AS rank FROM v_summary""", ("v_summary",))
def f2(spark, sf):
    return _dates(mk.rank_terms(_summary(spark, sf), mk.most_recent()).select("term", "latest_approval", "rank"), "latest_approval")


@query("f3_top_k_with_total", """
  SELECT analyte, p_partkey, (SELECT count(*) FROM v_list_rows) AS total FROM v_list_rows ORDER BY analyte, p_partkey LIMIT 50""",
       ("v_list_rows",))
def f3(spark, sf):
    return mk.top_k_with_total(v.listing_rows(spark, sf).select("analyte", "p_partkey"), ["analyte", "p_partkey"], mk.MAX_LISTING_ROWS)


@query("f4_page", "SELECT k_number, device_name FROM v_sub_devices ORDER BY k_number LIMIT 100 OFFSET 200", ("v_sub_devices",))
def f4(spark, sf):
    return mk.page(v.submission_devices(spark, sf).select("k_number", "device_name"), ["k_number"], skip=200, limit=mk.PAGE_SIZE)


@query("f4_page_after_key", """
  SELECT row_number() OVER (ORDER BY applicant NULLS FIRST, k_number) AS rank, applicant, k_number, device_name
  FROM v_sub_devices WHERE k_number IS NOT NULL QUALIFY rank BETWEEN 601 AND 800""", ("v_sub_devices",))
def f4_after(spark, sf):
    """Page by key: the hundred rows after rank 700's key, and those before it by rank, from a kept layout."""
    path = scratch_dir(spark, "pages")
    listed = v.submission_devices(spark, sf).select("applicant", "k_number", "device_name").filter("k_number IS NOT NULL")
    pg.lay_out(listed, ["applicant", "k_number"], path, block=500)
    before = stored(pg.page_at(spark, path, 600), "page")
    last = before.orderBy(F.desc("rank")).first()
    after = (last["applicant"], last["k_number"]) if last else None
    return before.unionByName(pg.page_after(spark, path, after))


_SIDE_A = "(SELECT k_number, 'a' AS side, applicant FROM v_sub_devices WHERE panel = 'HIGH' OR panel = 'LOW')"
_SIDE_B = "(SELECT k_number, 'b' AS side, panel AS applicant FROM v_sub_devices WHERE panel = 'HIGH' OR panel IS NULL)"


def _sides(spark, sf):
    d = v.submission_devices(spark, sf)
    a = d.filter(F.col("panel").isin("HIGH", "LOW")).select("k_number", F.lit("a").alias("side"), "applicant")
    b = d.filter((F.col("panel") == "HIGH") | F.col("panel").isNull()).select("k_number", F.lit("b").alias("side"), F.col("panel").alias("applicant"))
    return a, b


@query("g1_merge_results", f"""
  SELECT * FROM {_SIDE_B} b UNION ALL SELECT * FROM {_SIDE_A} a WHERE k_number NOT IN (SELECT k_number FROM {_SIDE_B} x)""",
       ("v_sub_devices",))
def g1(spark, sf):
    a, b = _sides(spark, sf)
    return m.merge_results(a, b, ["k_number"], ["applicant"])


@query("g1_merged_total", f"""
  SELECT greatest((SELECT count(*) FROM {_SIDE_A} a), (SELECT count(*) FROM {_SIDE_B} b),
    (SELECT count(*) FROM (SELECT k_number FROM {_SIDE_A} a UNION SELECT k_number FROM {_SIDE_B} b))) AS total""", ("v_sub_devices",))
def g1_total(spark, sf):
    a, b = _sides(spark, sf)
    n = F.count("*").alias("n")
    merged = m.merge_results(a, b, ["k_number"], ["applicant"]).agg(n)
    total = m.merged_total(a.agg(n).scalar(), b.agg(n).scalar(), F.col("n"))
    return merged.select(total.alias("total"))


@query("g3_unconfirmed_matches", """
  SELECT term, k_number, via_k_number,
    CASE match_mode WHEN 'predicate' THEN 'inferred via predicate' ELSE 'found via device registry' END AS match_type
  FROM v_matches WHERE confidence = 'inferred'""", ("v_matches",))
def g3(spark, sf):
    return mk.unconfirmed_matches(v.submission_matches(spark, sf)).select("term", "k_number", "via_k_number", "match_type")


@query("g4_subtract_confirmed", """
  SELECT term, k_number, match_mode FROM v_matches u WHERE confidence = 'inferred' AND NOT EXISTS (
    SELECT 1 FROM v_matches c WHERE c.confidence = 'confirmed' AND c.term = u.term AND c.k_number = u.k_number)""", ("v_matches",))
def g4(spark, sf):
    facts = v.submission_matches(spark, sf)
    left = mk.subtract_confirmed(facts.filter(F.col("confidence") == "inferred"), mk.filter_confirmed(facts))
    return left.select("term", "k_number", "match_mode")


@query("c10_measurand_verdict", """
  SELECT d.p_partkey, d.k_number, CASE WHEN v.value IS NULL THEN NULL WHEN contains(' ' || v.value || ' ', ' ' || d.p_name || ' ')
    OR contains(' ' || v.value || ' ', ' ' || split_part(d.p_name, ' ', 2) || ' ') THEN 'Matches' ELSE 'No match' END AS verdict
  FROM (SELECT DISTINCT p_partkey, p_name, printf('K%06d', l_orderkey) AS k_number FROM v_lines) d LEFT JOIN v_measured v USING (k_number)""",
       ("v_lines", "v_measured"))
def c10(spark, sf):
    details = v.order_lines(spark, sf).select(
        "p_partkey", v.number("l_orderkey").alias("k_number"), F.concat(F.lit("Anti-"), F.col("p_name"), F.lit(" IgG")).alias("term"),
        F.col("p_name").alias("full"), F.concat(F.lit("xyz/"), F.substring_index("p_name", " ", -1)).alias("search"),
    )
    mined = docs.with_measurand(v.summary_text(spark, sf))
    return docs.measurand_verdict(details, mined).select("p_partkey", "k_number", "verdict")


CTE["v_shown"] = (["v_details"], """SELECT * FROM v_details WHERE decision_date BETWEEN DATE '1993-02-01' AND DATE '1997-10-31'
    AND (panel IS NULL OR panel <> 'LOW') AND (lower(term) LIKE '%ring%' OR lower(applicant) LIKE '%1%')""")
CTE["v_shown_totals"] = (["v_sub_terms", "v_shown"], """
    SELECT t.term, count(k_number) AS n, count(*) FILTER (WHERE decision_description LIKE 'Substantially Equivalent%') AS c,
      count(DISTINCT applicant) AS a, max(decision_date) FILTER (WHERE decision_description LIKE 'Substantially Equivalent%') AS latest,
      coalesce(array_to_string(list_sort(list_distinct(list(applicant) FILTER (WHERE applicant IS NOT NULL))), ';'), '') AS names
    FROM v_sub_terms t LEFT JOIN v_shown USING (term) GROUP BY 1""")
CTE["v_list_hits"] = (["v_list_rows"], """
    SELECT DISTINCT term, p_partkey FROM (SELECT DISTINCT p_name AS term, unnest(string_split(p_name, ' ')) AS word FROM part)
    JOIN (SELECT p_partkey, unnest(string_split(lower(analyte), ' ')) AS word FROM v_list_rows) USING (word)""")


@query("a14_export_tables", """
  SELECT 'search_info' AS sheet, unnest(['searched_at|2024-05-06 07:08', 'sort_order|Fewest approvals', 'panels|All', 'from_month|1993-02', 'to_month|1997-10', 'applicant|All', 'show_only|RING; 1', 'exclude_panels|LOW', 'match_mode|All']) AS line
  UNION ALL SELECT 'search_info', 'biomarker|' || term FROM v_sub_terms
  UNION ALL SELECT 'summary', concat_ws('|', row_number() OVER (ORDER BY c, term), term, n, c, a, coalesce(CAST(latest AS VARCHAR), '-'), CASE WHEN n > 0 THEN 'exact' ELSE 'exact' END) FROM v_shown_totals
  UNION ALL SELECT 'biomarker_applicants', concat_ws('|', term, n, a, names) FROM v_shown_totals
  UNION ALL SELECT 'details', concat_ws('|', term, k_number, device_name, coalesce(applicant, '-'), decision_description, CAST(decision_date AS VARCHAR),
    'https://www.accessdata.fda.gov/scripts/cdrh/cfdocs/cfPMN/pmn.cfm?ID=' || k_number) FROM v_shown
  UNION ALL SELECT 'unconfirmed_matches', concat_ws('|', term, k_number, coalesce(via_k_number, '-'), CASE match_mode WHEN 'predicate' THEN 'inferred via predicate' ELSE 'found via device registry' END)
    FROM v_matches JOIN v_sub_devices d USING (k_number) WHERE confidence = 'inferred' AND decision_date BETWEEN DATE '1993-02-01' AND DATE '1997-10-31'
    AND (panel IS NULL OR panel <> 'LOW') AND (lower(term) LIKE '%ring%' OR lower(applicant) LIKE '%1%')
  UNION ALL SELECT 'lab_test_summary', concat_ws('|', term, count(h.p_partkey)) FROM (SELECT DISTINCT p_name AS term FROM part) t LEFT JOIN v_list_hits h USING (term) GROUP BY term
  UNION ALL SELECT 'lab_test_details', concat_ws('|', term, p_partkey) FROM v_list_hits""", ("v_shown", "v_shown_totals", "v_matches", "v_sub_devices", "v_list_hits", "v_sub_terms"))
def a14(spark, sf):
    """All seven tables of one filtered search, written and read back line by line."""
    terms, details = v.submission_terms(spark, sf), v.submission_details(spark, sf)
    unconfirmed = mk.attach_devices(v.submission_matches(spark, sf).filter("confidence = 'inferred'"), v.submission_devices(spark, sf))
    filters = mk.Filters(from_month="1993-02", to_month="1997-10", show_only=("RING", "1"), exclude_panels=("LOW",))
    names = v.table(spark, sf, "part").select(F.concat(F.lit("Anti-"), F.col("p_name"), F.lit(" IgG")).alias("term")).distinct()
    hits = ls.search_listing(names, v.listing_rows(spark, sf).withColumn("facilityName", F.col("status")))
    tables = mk.report(terms, details, unconfirmed, filters, mk.FEWEST_APPROVALS, "2024-05-06 07:08") | listing_tables(names, hits)
    written = export_tables(tables, scratch_dir(spark, "export"), "parquet", {"summary": "rank"})
    plain = tx.antigen_of(F.col("term")).alias("term")
    shown = {
        "search_info": ["setting", "value"],
        "summary": ["rank", "term", "total_submissions", "cleared_count", "unique_applicants", "latest_approval", "match_mode"],
        "biomarker_applicants": ["term", "total_submissions", "unique_applicants", F.array_join("applicants", ";")],
        "details": ["term", "k_number", "device_name", "applicant", "decision_description", "decision_date", "record_url"],
        "unconfirmed_matches": ["term", "k_number", "via_k_number", "match_type"],
        "lab_test_summary": [plain, "tests"],
        "lab_test_details": [plain, "p_partkey"],
    }
    parts = []
    for sheet, path in written.items():
        texts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in shown[sheet]]
        parts.append(spark.read.parquet(path).select(F.lit(sheet).alias("sheet"), F.concat_ws("|", *texts).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("market_table", """
  SELECT t.term_id, t.term, count(m.k_number) AS total_submissions,
    count(*) FILTER (WHERE decision_description LIKE 'Substantially Equivalent%') AS cleared_count,
    count(DISTINCT applicant) AS unique_applicants,
    CAST(max(decision_date) FILTER (WHERE decision_description LIKE 'Substantially Equivalent%') AS VARCHAR) AS latest_approval,
    coalesce(any_value(m.label), 'exact') AS match_mode
  FROM v_terms t LEFT JOIN v_match m USING (term_id) LEFT JOIN v_devices d USING (k_number) GROUP BY 1, 2""",
       ("v_terms", "v_match", "v_devices"))
def market_table(spark, sf):
    """Terms to market table in one job: match, attach, total."""
    terms, devices = v.terms(spark, sf), v.devices(spark, sf)
    facts = m.match_terms(terms, devices, payload=["applicant", "decision_description", "decision_date"])
    summary = mk.summarise(terms.select("term_id", "term"), facts, by="term_id")
    return _dates(summary.select(
        "term_id", "term", "total_submissions", "cleared_count", "unique_applicants", "latest_approval", "match_mode",
    ), "latest_approval")
