"""Scans, stores, cached/new split, listings, incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators import commits as cm
from marketlens.operators import documents as docs
from marketlens.operators import listing as ls
from marketlens.operators import market as mk
from marketlens.operators import buckets as bk
from marketlens.operators import store as st
from marketlens.session import scratch_dir as scratch
from marketlens.sources import scans as sc
from marketlens.streaming import refresh as rf
from workload import views as v
from workload.registry import query
from workload.sql import k


# -- scans ------------------------------------------------------------------------------


@query("a1_scan_clearances", """
  SELECT k_number, device_name, array_to_string([source, kit], '; ') AS openfda_device_name, applicant, CAST(decision_date AS VARCHAR) AS decision_date
  FROM v_devices""", ("v_devices",))
def a1(spark, sf):
    """Records landed as JSON with a list-valued name, read back through the schema."""
    path = scratch(spark)
    v.devices(spark, sf).select(
        "k_number", "device_name", "statement_or_summary",
        F.struct(F.col("openfda_device_names").alias("device_name")).alias("openfda"),
        "applicant", "decision_description", F.col("decision_date").cast("string").alias("decision_date"),
        F.col("panel").alias("advisory_committee"),
    ).write.json(path)
    records = sc.scan_clearances(spark, path, envelope=False)
    return st.device_rows(records, "510k").select(
        "k_number", "device_name", "openfda_device_name", "applicant", "decision_date")


def _panels(spark, sf):
    """Clearance records with a copy in every panel that a line item names."""
    li, o = v.table(spark, sf, "lineitem"), v.table(spark, sf, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.when(F.col("l_linenumber") != 5, v.number("l_orderkey")).alias("k_number"),
        F.get(F.array(*[F.lit(p) for p in ("IM", "CH", "SU", "HE", "MI")]), (F.col("l_partkey") % 5).cast("int")).alias("advisory_committee"),
        F.col("o_orderstatus").alias("decision_description"),
    )


@query("a2_scope_corpus", f"""
  SELECT k_number, ['IM','CH','HE','MI','PA','TX'][max(r)] AS advisory_committee, any_value(o_orderstatus) AS decision_description FROM (
    SELECT {k('l_orderkey')} AS k_number, o_orderstatus, CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS r
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <> 5 AND l_partkey % 5 <> 2) GROUP BY 1""")
def a2(spark, sf):
    return sc.scope_corpus(_panels(spark, sf))


@query("a3_scan_registry", """
  SELECT device_description, brand_name, array_to_string(numbers, '|') AS numbers, count(*) AS n FROM v_registry GROUP BY ALL""", ("v_registry",))
def a3(spark, sf):
    from marketlens.functions.registry import submission_numbers

    path = scratch(spark)
    v.registry(spark, sf).drop("p_partkey").write.json(path)
    numbers = F.array_join(submission_numbers(F.col("premarket_submissions")), "|").alias("numbers")
    return sc.scan_registry(spark, path, envelope=False).groupBy("device_description", "brand_name", numbers).agg(F.count("*").alias("n"))


@query("a4_scan_document_text", f"""
  SELECT {k('l_orderkey')} AS k_number, CAST(l_orderkey % 11 = 3 AS INT) AS failed FROM (SELECT DISTINCT l_orderkey FROM lineitem)""")
def a4(spark, sf):
    path = scratch(spark)
    v.summary_text(spark, sf).drop("l_orderkey").write.parquet(path)
    return sc.scan_document_text(spark, path).select("k_number", F.col("full_text").isNull().cast("int").alias("failed"))


@query("a5_scan_listing_pages", "SELECT page_id, url, length(html) AS n FROM pages")
def a5(spark, sf):
    return sc.scan_listing_pages(spark, f"{sf}/pages.parquet").select("page_id", "url", F.length("html").cast("long").alias("n"))


@query("a6_scan_resolver_replies", """
  SELECT p_name || ' ' || p_partkey AS term_key, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_name END AS "full" FROM part WHERE p_size <> 50""")
def a6(spark, sf):
    from marketlens.functions.replies import parse_model_reply

    path = scratch(spark)
    v.model_replies(spark, sf).withColumn("engine", F.lit("model")).write.json(path)
    return sc.scan_resolver_replies(spark, path).filter(F.col("status") == 200).select(
        "term_key", parse_model_reply(F.col("body"))["full"].alias("full"))


@query("a7_parse_term_list", r"""
  SELECT doc_id, CAST(u.i - 1 AS INT) AS ordinal, u.t AS term FROM (
    SELECT doc_id, unnest(list_transform(ts, lambda x, i: {'i': i, 't': x})) AS u FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n,]'), lambda x: trim(x, ' ' || chr(9) || chr(160))), lambda x: x <> '') AS ts FROM documents))""")
def a7(spark, sf):
    return sc.parse_term_list(v.spread_table(spark, sf, "documents").select("doc_id", "text"), "text")


# -- stores -----------------------------------------------------------------------------


def _stored_devices(spark, sf):
    o = v.table(spark, sf, "orders")
    return o.select(v.number("o_orderkey").alias("k_number"), F.col("o_orderstatus").alias("decision_description"), F.col("o_orderpriority").alias("panel"))


def _device_updates(spark, sf):
    """A row per line item: several copies of a number, the last ship date wins."""
    li = v.spread_table(spark, sf, "lineitem")
    return li.select(
        v.number(F.col("l_orderkey") + 10).alias("k_number"), F.col("l_linestatus").alias("decision_description"),
        F.col("l_returnflag").alias("panel"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber").alias("at"))


_LAST = "(l_shipdate, l_partkey, l_suppkey, l_linenumber)"
_NEW_DEVICES = f"""(SELECT {k('l_orderkey + 10')} AS k_number, arg_max(l_linestatus, {_LAST}) AS decision_description,
  arg_max(l_returnflag, {_LAST}) AS panel FROM lineitem GROUP BY 1)"""


@query("e1_latest_wins", f"SELECT * FROM {_NEW_DEVICES}")
def e1(spark, sf):
    return st.latest_wins(_device_updates(spark, sf), ["k_number"], ["at"]).drop("at")


@query("a8_upsert_devices", f"""
  SELECT * FROM {_NEW_DEVICES} n UNION ALL SELECT {k('o_orderkey')}, o_orderstatus, o_orderpriority FROM orders
  WHERE {k('o_orderkey')} NOT IN (SELECT k_number FROM {_NEW_DEVICES} n)""")
def a8(spark, sf):
    """Published, upserted and published again, twice: the second run changes nothing."""
    path = scratch(spark, "devices")
    st.publish(_stored_devices(spark, sf), path)
    for _ in range(2):
        st.publish(st.upsert_devices(st.published(spark, path), _device_updates(spark, sf), ["at"]), path)
    return st.published(spark, path)


def _bucketed(spark, sf):
    """The devices in buckets; upserted, the buckets of two deltas put down again, half of the updates
    upserted once more, which changes nothing. The state and the folder."""
    base, updates = scratch(spark, "buckets"), _device_updates(spark, sf)
    bk.upsert(spark, base, "devices", _stored_devices(spark, sf), ["k_number"], ["k_number"])
    bk.upsert(spark, base, "devices", updates, ["k_number"], ["at"])
    bk.compact(spark, base, "devices", ["k_number"], deltas=1)
    return bk.upsert(spark, base, "devices", updates.filter(F.xxhash64("k_number") % 2 == 0), ["k_number"], ["at"])


@query("a8_bucketed_upsert", f"""
  SELECT * FROM {_NEW_DEVICES} n UNION ALL SELECT {k('o_orderkey')}, o_orderstatus, o_orderpriority FROM orders
  WHERE {k('o_orderkey')} NOT IN (SELECT k_number FROM {_NEW_DEVICES} n)""")
def a8_bucketed(spark, sf):
    """Devices upserted as deltas by key bucket, read with the last commit of each key."""
    return bk.read(spark, _bucketed(spark, sf), "devices", ["k_number"])


@query("c3_bucketed_missing", f"""
  SELECT DISTINCT {k('o_orderkey * 3')} AS k_number FROM orders WHERE {k('o_orderkey * 3')} NOT IN (
    SELECT k_number FROM {_NEW_DEVICES} n UNION ALL SELECT {k('o_orderkey')} FROM orders)""")
def c3_bucketed(spark, sf):
    """Numbers asked for that the bucketed devices do not have."""
    asked = v.table(spark, sf, "orders").select(v.number(F.col("o_orderkey") * 3).alias("k_number"))
    return bk.missing(spark, _bucketed(spark, sf), "devices", ["k_number"], asked)


@query("a9_upsert_document_text", f"""
  SELECT {k('o_orderkey')} AS k_number, CASE WHEN m.l_orderkey IS NULL THEN 'old' ELSE coalesce(m.value, 'none') END AS text,
    CASE WHEN m.l_orderkey % 11 = 3 THEN 'no decision document found (last status: 404)' END AS fetch_error
  FROM orders LEFT JOIN v_measured m ON o_orderkey = l_orderkey""", ("v_measured",))
def a9(spark, sf):
    existing = v.table(spark, sf, "orders").select(
        v.number("o_orderkey").alias("k_number"), F.lit("old").alias("text"), F.lit(None).cast("string").alias("fetch_error"))
    mined = docs.with_measurand(v.summary_text(spark, sf)).select(
        "k_number", F.coalesce("measurand_value", F.lit("none")).alias("text"), "fetch_error")
    return st.upsert_document_text(existing, mined, ["text", "fetch_error"])


_OLD_EDGES = f"(SELECT {k('l_orderkey')} AS device_k, {k('l_partkey')} AS predicate_k, max(l_returnflag) AS predicate_name FROM lineitem GROUP BY 1, 2)"
_NEW_EDGES = f"(SELECT {k('l_orderkey')} AS device_k, {k('l_suppkey')} AS predicate_k, max(l_linestatus) AS predicate_name FROM lineitem GROUP BY 1, 2)"


@query("a10_upsert_citations", f"""
  SELECT * FROM {_NEW_EDGES} n UNION ALL SELECT * FROM {_OLD_EDGES} o WHERE (device_k, predicate_k) NOT IN (
    SELECT device_k, predicate_k FROM {_NEW_EDGES} n)""")
def a10(spark, sf):
    li = v.table(spark, sf, "lineitem")

    def edges(cited, name):
        return li.groupBy(v.number("l_orderkey").alias("device_k"), v.number(cited).alias("predicate_k")).agg(F.max(name).alias("predicate_name"))

    fresh = li.select(v.number("l_orderkey").alias("device_k"), v.number("l_suppkey").alias("predicate_k"), F.col("l_linestatus").alias("predicate_name"))
    return st.upsert_citations(edges("l_partkey", "l_returnflag"), fresh, ["predicate_name"])


@query("a11_replace_matches", """
  SELECT k_number, biomarker_key, match_mode FROM (SELECT k_number, term AS biomarker_key, match_mode FROM v_matches)
  WHERE biomarker_key NOT LIKE '% ring' UNION ALL
  SELECT k_number, term, 'wordform' FROM v_matches WHERE term LIKE '% ring' AND match_mode = 'exact'""", ("v_matches",))
def a11(spark, sf):
    store = v.submission_matches(spark, sf).withColumnRenamed("term", "biomarker_key")
    ring = F.endswith("biomarker_key", F.lit(" ring"))
    fresh = store.filter(ring & (F.col("match_mode") == "exact")).withColumn("match_mode", F.lit("wordform"))
    keys = v.submission_terms(spark, sf).select(F.col("term").alias("biomarker_key")).filter(ring)
    return st.replace_matches(store, fresh, keys).select("k_number", "biomarker_key", "match_mode")


@query("a12_upsert_expansions", """
  SELECT coalesce(t.term_key, c.term_key) AS term_key, CASE WHEN t.term_key IS NOT NULL THEN t."full" ELSE c."full" END AS "full",
    CASE WHEN t.term_key IS NOT NULL THEN 'umls' ELSE c.source END AS source
  FROM v_cache c FULL JOIN (SELECT * FROM v_terminology WHERE "full" IS NOT NULL) t USING (term_key)""", ("v_cache", "v_terminology"))
def a12(spark, sf):
    from marketlens.operators.resolve import terminology_answers

    fresh = terminology_answers(v.terminology_replies(spark, sf)).select(
        "term_key", "full", F.lit(None).cast("string").alias("search"), F.lit("umls").alias("source"))
    return st.upsert_expansions(v.expansion_cache(spark, sf), fresh, ["full"]).select("term_key", "full", "source")


@query("a13_mark_searched", """
  SELECT p_name || ' ' || p_partkey AS term_key, CASE WHEN p_type = 'PROMO' THEN '2024-05-01' ELSE '2020-01-01' END AS searched_at FROM part""")
def a13(spark, sf):
    p = v.table(spark, sf, "part")
    old = p.select(v.reply_key().alias("term_key"), F.lit("2020-01-01").alias("searched_at"))
    keys = p.filter(F.col("p_type") == "PROMO").select(v.reply_key().alias("term_key"))
    return st.mark_searched(old, keys, F.lit("2024-05-01"))


@query("c2_pending_documents", f"""
  SELECT {k('o_orderkey')} AS k_number FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def c2(spark, sf):
    devices = _stored_devices(spark, sf).withColumnRenamed("panel", "advisory_committee")
    return st.pending_documents(devices, v.summary_text(spark, sf), ["1-URGENT", "5-LOW"])


@query("c2_pending_documents_retry", f"""
  SELECT {k('o_orderkey')} AS k_number FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 11 <> 3)""")
def c2_retry(spark, sf):
    devices = _stored_devices(spark, sf).withColumnRenamed("panel", "advisory_committee")
    return st.pending_documents(devices, v.summary_text(spark, sf), ["1-URGENT", "5-LOW"], retry_errors=True)


def _split(name, cached):
    @query(name, f"SELECT t AS term, p_partkey FROM v_forms WHERE {'' if cached else 'NOT'} EXISTS (SELECT 1 FROM v_done WHERE term_key = lower(trim(regexp_replace(regexp_replace(t, '(?i)\\s+Ig[AGME][1-4]?$', ''), '(?i)^anti[-\\s]+', ''))))",
           ("v_forms", "v_done"))
    def run(spark, sf):
        terms = sc.term_keys(v.term_forms(spark, sf).withColumnRenamed("t", "term"))
        searched = v.table(spark, sf, "part").filter(F.col("p_size") < 25).select(
            F.explode(F.array(F.substring_index("p_name", " ", 1), F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))).alias("term_key"))
        return st.split_cached(terms, searched)[0 if cached else 1].select("term", "p_partkey")


def _done_view() -> None:
    from workload.sql import CTE

    CTE["v_done"] = ([], "SELECT split_part(p_name, ' ', 1) AS term_key FROM part WHERE p_size < 25 UNION SELECT replace(p_name, ' ', '-') FROM part WHERE p_size < 25")


_done_view()
_split("c7_split_cached", True)
_split("c7_split_new", False)


@query("d10_corpus_coverage", """
  SELECT o_orderpriority AS advisory_committee, count(*) AS in_scope, count(m.k_number) AS fetched,
    count(*) FILTER (WHERE m.k_number IS NULL) AS to_fetch, count(*) FILTER (WHERE m.l_orderkey % 11 = 3) AS errors,
    count(m.value) AS with_measurand
  FROM orders LEFT JOIN v_measured m ON o_orderkey = l_orderkey GROUP BY 1""", ("v_measured",))
def d10(spark, sf):
    devices = _stored_devices(spark, sf).withColumnRenamed("panel", "advisory_committee")
    return st.corpus_coverage(devices, docs.with_measurand(v.summary_text(spark, sf)))


@query("d11_distinct_keys", f"SELECT DISTINCT {k('l_partkey')} AS predicate_k FROM lineitem")
def d11(spark, sf):
    return st.distinct_keys(v.edges(spark, sf), ["predicate_k"])


# -- listings ---------------------------------------------------------------------------


@query("h31_extract_listing_rows", """
  SELECT url, row_no, facilityName, analyte, status, detailLink, total FROM v_listing""", ("v_listing",))
def h31(spark, sf):
    return ls.extract_listing_rows(v.listing_pages(spark, sf)).select(
        "url", "row_no", "facilityName", "analyte", "status", "detailLink", "total")


@query("h31_page_items", """
  SELECT url, row_no, trim(regexp_replace(items[row_no + 1], '^<li><a href="[^"]*">|</a></li>$', '', 'g')) AS name,
    regexp_replace(regexp_extract(items[row_no + 1], 'href="([^"]*)"', 1), '^/', 'https://www.wadsworth.org/') AS link, len(items) AS total
  FROM (SELECT url, items, unnest(range(len(items))) AS row_no FROM (
    SELECT url, regexp_extract_all(html, '<li><a href="[^"]*">[^<]*</a></li>') AS items FROM pages))""")
def h31_items(spark, sf):
    """Every list item of every given page, read from its whole HTML."""
    rows = ls.extract_listing_rows(v.spread_table(spark, sf, "pages"), v.PAGE_ITEMS)
    return rows.select("url", "row_no", F.col("facilityName").alias("name"), F.col("detailLink").alias("link"), "total")


@query("b13_filter_status", "SELECT p_partkey FROM v_list_rows WHERE status = 'Conditionally Approved'", ("v_list_rows",))
def b13(spark, sf):
    return ls.filter_status(v.listing_rows(spark, sf), "conditionally_approved").select("p_partkey")


@query("c9_zero_clearance_crosscheck", """
  SELECT z.term, r.p_partkey, CAST(r.p_partkey IS NOT NULL AS INT) AS found
  FROM (SELECT term FROM v_summary WHERE cleared_count = 0) z LEFT JOIN v_list_rows r
    ON len(list_intersect(list_filter(regexp_split_to_array(lower(z.term), '[^a-z0-9]+'), lambda x: x <> ''),
                          list_filter(regexp_split_to_array(lower(r.analyte), '[^a-z0-9]+'), lambda x: x <> ''))) > 0""",
       ("v_summary", "v_list_rows"))
def c9(spark, sf):
    brands = v.submission_terms(spark, sf)
    summary = mk.summarise(brands, v.submission_details(spark, sf))
    rows = v.listing_rows(spark, sf)
    return ls.zero_clearance_crosscheck(summary, rows).select("term", "p_partkey", F.col("found").cast("int").alias("found"))


@query("c9_listing_search", """
  SELECT t.term, r.p_partkey FROM (SELECT DISTINCT p_name AS term FROM part) t JOIN v_list_rows r
    ON len(list_intersect(string_split(t.term, ' '), string_split(lower(r.analyte), ' '))) > 0""", ("v_list_rows",))
def c9_search(spark, sf):
    names = v.table(spark, sf, "part").select(F.concat(F.lit("Anti-"), F.col("p_name"), F.lit(" IgG")).alias("term")).distinct()
    found = ls.search_listing(names, v.listing_rows(spark, sf))
    return found.select(tx.antigen_of(F.col("term")).alias("term"), "p_partkey")


@query("c9_listing_report", """
  SELECT term, p_partkey, total FROM (SELECT t.term, r.p_partkey, count(*) OVER (PARTITION BY t.term) AS total,
      row_number() OVER (PARTITION BY t.term ORDER BY r.p_partkey) AS place
    FROM (SELECT DISTINCT p_name AS term FROM part) t JOIN v_list_rows r
      ON len(list_intersect(string_split(t.term, ' '), string_split(lower(r.analyte), ' '))) > 0) WHERE place <= 50""", ("v_list_rows",))
def c9_report(spark, sf):
    """Per term the first fifty listing rows and the number of all."""
    names = v.table(spark, sf, "part").select(F.concat(F.lit("Anti-"), F.col("p_name"), F.lit(" IgG")).alias("term")).distinct()
    found = ls.search_report(names, v.listing_rows(spark, sf).select("p_partkey", "analyte"), mk.MAX_LISTING_ROWS, ["p_partkey"])
    return found.select(tx.antigen_of(F.col("term")).alias("term"), "p_partkey", "total")


# -- incremental refresh ----------------------------------------------------------------


@query("i1_incremental_refresh", """
  SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def i1(spark, sf):
    """Events landed in four files, folded batch by batch: the latest per user stays."""
    base = scratch(spark)
    events = v.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    events.repartitionByRange(4, "ts").write.parquet(f"{base}/landed")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/landed")
    rf.refresh_store(stream, f"{base}/store", f"{base}/progress", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return rf.read_store(spark, f"{base}/store", ["user_id"], ["ts", "event_id"]).select("user_id", "ts", "event_type")


@query("i1_incremental_documents", "SELECT device_k, predicate_k, predicate_name FROM v_cites", ("v_cites",))
def i1_documents(spark, sf):
    """Documents landed in files, mined once each; the edges of all batches."""
    base = scratch(spark)
    v.summary_text(spark, sf).drop("l_orderkey").repartition(3).write.parquet(f"{base}/landed")
    stream = spark.readStream.schema(sc.DOCUMENT_SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{base}/landed")
    rf.refresh_corpus(rf.with_arrival(stream), f"{base}/text", f"{base}/edges", f"{base}/progress").awaitTermination()
    return rf.read_store(spark, f"{base}/edges", ["device_k", "predicate_k"])


@query("i1_after_compaction", """
  SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def i1_after_compaction(spark, sf):
    """Half of the events folded and compacted; a new stream, with a checkpoint of its own, goes
    on in the compacted store with the other half."""
    base, order = scratch(spark), ["ts", "event_id"]
    events = v.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    for half in (0, 1):
        events.filter(F.pmod("event_id", F.lit(2)) == half).write.parquet(f"{base}/landed{half}")
        stream = spark.readStream.schema(events.schema).parquet(f"{base}/landed{half}")
        rf.refresh_store(stream, f"{base}/store{half}", f"{base}/progress{half}", ["user_id"], order).awaitTermination()
        if not half:
            rf.compact(spark, f"{base}/store0", f"{base}/store1", ["user_id"], order)
    return rf.read_store(spark, f"{base}/store1", ["user_id"], order).select("user_id", "ts", "event_type")


@query("i1_corpus_refresh", """
  SELECT panel AS advisory_committee, count(*) AS in_scope, count(m.k_number) AS fetched, count(*) FILTER (WHERE m.k_number IS NULL) AS to_fetch,
    count(*) FILTER (WHERE m.l_orderkey % 11 = 3) AS errors, count(m.value) AS with_measurand, count(c.n) AS citing, CAST(coalesce(sum(c.n), 0) AS BIGINT) AS citations
  FROM (SELECT *, CASE o_orderpriority WHEN '1-URGENT' THEN 'IM' WHEN '2-HIGH' THEN 'CH' WHEN '5-LOW' THEN 'MI' END AS panel FROM orders)
    LEFT JOIN v_measured m ON o_orderkey = l_orderkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM v_cites GROUP BY 1) c ON o_orderkey = c.l_orderkey
  WHERE panel IS NOT NULL GROUP BY 1""", ("v_measured", "v_cites"))
def i1_corpus(spark, sf):
    """Half of the texts, then all: devices, documents, citations and coverage in two refreshes."""
    base = scratch(spark)
    panel = F.when(F.col("o_orderpriority") == "1-URGENT", "IM").when(F.col("o_orderpriority") == "2-HIGH", "CH").when(F.col("o_orderpriority") == "5-LOW", "MI").otherwise("SU")
    none = F.lit(None).cast("string")
    records = v.table(spark, sf, "orders").select(
        v.number("o_orderkey").alias("k_number"), F.col("o_orderpriority").alias("device_name"), none.alias("statement_or_summary"),
        F.struct(F.col("o_orderstatus").alias("device_name")).alias("openfda"), none.alias("applicant"), none.alias("decision_description"),
        F.col("o_orderdate").cast("string").alias("decision_date"), panel.alias("advisory_committee"), none.alias("advisory_committee_description"), none.alias("product_code"))
    texts = v.summary_text(spark, sf)
    rf.refresh_all(records, texts.filter(F.col("l_orderkey") % 2 == 0).drop("l_orderkey"), base, ["full_text"])
    coverage = rf.refresh_all(records, texts.drop("l_orderkey"), base, ["full_text"])
    last = cm.state(spark, base)
    edges = last.read(spark, "citations").groupBy(F.col("device_k").alias("k_number")).agg(F.count("*").alias("n"))
    cited = last.read(spark, "devices").join(edges, "k_number").groupBy("advisory_committee").agg(
        F.count("*").alias("citing"), F.sum("n").alias("citations"))
    return coverage.join(cited, "advisory_committee", "left").fillna(0, ["citing", "citations"])
