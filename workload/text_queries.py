"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.functions import documents as dc
from marketlens.functions import registry as rg
from marketlens.functions import replies as rp
from marketlens.functions import text as tx
from marketlens.operators import documents as docs
from marketlens.operators import listing as ls
from marketlens.plans import tiers as pl
from workload import views as v
from workload.registry import query
from workload.sql import WS, antigen, k, mode, strip_anti, strip_iso, tokens, words

# The letters and their names, written out here so that the SQL does not follow the code.
_GREEK_SQL = (
    "replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(t,"
    " 'α', 'alpha'), 'Α', 'Alpha'), 'β', 'beta'), 'Β', 'Beta'), 'γ', 'gamma'), 'Γ', 'Gamma'), 'δ', 'delta'), 'Δ', 'Delta'),"
    " 'κ', 'kappa'), 'Κ', 'Kappa'), 'λ', 'lambda'), 'Λ', 'Lambda'), 'μ', 'mu'), 'Μ', 'Mu')"
)


def _forms(name, expr, sql):
    """One query over all term forms: a column expression against its SQL."""

    @query(name, f"SELECT p_partkey, {sql} AS result FROM v_forms", ("v_forms",))
    def run(spark, sf):
        return v.term_forms(spark, sf).select("p_partkey", expr(F.col("t")).alias("result"))


def _int(test):
    return lambda t: test(t).cast("int")


def _joined(fn, sep="|"):
    return lambda t: F.array_join(fn(t), sep)


_forms("h1_greek_to_latin", tx.greek_to_latin, _GREEK_SQL)
_forms("h2_strip_anti_prefix", tx.strip_anti_prefix, strip_anti("t"))
_forms("h3_has_anti_prefix", _int(tx.has_anti_prefix), r"CAST(regexp_matches(trim(t), '(?i)^anti[-\s]') AS INT)")
_forms("h4_strip_isotype", tx.strip_isotype, strip_iso("t"))
_forms("h4_has_isotype", _int(tx.has_isotype), r"CAST(regexp_matches(t, '(?i)\s+Ig[AGME][1-4]?$') AS INT)")
_forms("h5_anti_requirement_mode", tx.anti_requirement_mode, mode("t"))
_forms("h6_split_tokens", _joined(tx.split_tokens), f"array_to_string({tokens('t')}, '|')")
_FUSED = f"regexp_replace({tokens(antigen('t'))}[1], '[^A-Za-z0-9]', '', 'g')"
_forms(
    "h7_fused_anti", tx.fused_anti,
    f"CASE WHEN ({mode('t')}) <> 'none' AND len({tokens(antigen('t'))}) = 1 AND {_FUSED} <> '' THEN 'Anti' || {_FUSED} END",
)
_VAR = r"""array_to_string(list_filter([
  regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'),
  CASE WHEN replace(t, '-', ' ') <> regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g') THEN replace(t, '-', ' ') END,
  CASE WHEN contains(t, ' ') THEN regexp_replace(t, '\s+', '-', 'g') END,
  CASE WHEN regexp_replace(t, '[\s-]+', '', 'g') NOT IN (regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'),
    replace(t, '-', ' '), CASE WHEN contains(t, ' ') THEN regexp_replace(t, '\s+', '-', 'g') ELSE t END)
    THEN regexp_replace(t, '[\s-]+', '', 'g') END], lambda z: z IS NOT NULL AND z <> t), '|')"""
_forms("h8_orthographic_variants", _joined(tx.orthographic_variants), _VAR)
_forms("h9_expansion_key", tx.expansion_key, f"lower({antigen('t')})")

_PHRASE = "p_name || ', antibody/(' || p_type || ') anti ' || p_brand"


@query("h10_split_expansion_tokens", rf"""
  SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array({_PHRASE}, '[\s/,()]+'),
    lambda z: z <> '' AND lower(z) NOT IN ('anti', 'antibody')), '|') AS result FROM part""")
def h10(spark, sf):
    phrase = F.concat(F.col("p_name"), F.lit(", antibody/("), F.col("p_type"), F.lit(") anti "), F.col("p_brand"))
    return v.table(spark, sf, "part").select(
        "p_partkey", F.array_join(tx.split_expansion_tokens(phrase), "|").alias("result"))


@query("h11_group_implies_anti", rf"""
  SELECT p_partkey, CAST(len({tokens('t')}) = 1 AND lower({tokens('t')}[1]) LIKE 'anti%' AS INT) AS result FROM v_forms""",
       ("v_forms",))
def h11(spark, sf):
    return v.term_forms(spark, sf).select(
        "p_partkey", tx.group_implies_anti(tx.split_tokens(F.col("t"))).cast("int").alias("result"))


def _clause_rows(df):
    return df.select("term_id", "tier", "scope", F.col("anti").alias("need"), F.array_join(F.array_sort("phrases"), "|").alias("phrases"))


_CLAUSE_SQL = """SELECT term_id, tier, scope, need, array_to_string(list_sort(list_distinct(ph)), '|') AS phrases
  FROM v_usable WHERE tier {}"""


@query("h12_compile_tiers", _CLAUSE_SQL.format("<= 5"), ("v_usable",))
def h12(spark, sf):
    return _clause_rows(pl.compile_tiers(v.terms(spark, sf)))


@query("h13_compile_expansion", _CLAUSE_SQL.format("= 6"), ("v_usable",))
def h13(spark, sf):
    return _clause_rows(pl.compile_expansions(v.terms(spark, sf)))


@query("h14_registry_token_groups", f"""
  SELECT DISTINCT term_id, lower(array_to_string(g, '|')) AS grp FROM (
    SELECT term_id, {tokens('unnest(string_split(coalesce(search, "full"), ' + "'/'" + '))')} AS g FROM v_reg_terms)
  WHERE len(g) > 0""", ("v_reg_terms",))
def h14(spark, sf):
    phrase = tx.expansion_phrase(F.col("full"), F.col("search"))
    return v.registry_terms(spark, sf).select(
        "term_id", F.explode(tx.registry_token_groups(phrase)).alias("g")
    ).select("term_id", F.lower(F.array_join("g", "|")).alias("grp"))


@query("h15_relabel_mode", """
  SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN lower(p_type) WHEN p_size < 20 THEN 'ai-suggested'
    WHEN p_size < 40 THEN 'umls' ELSE 'expansion' END AS mode FROM part""")
def h15(spark, sf):
    raw = F.when(F.col("p_type") == "PROMO", "expansion").otherwise(F.lower("p_type"))
    source = F.when(F.col("p_size") < 20, "local-llm").when(F.col("p_size") < 40, "umls").otherwise("none")
    return v.table(spark, sf, "part").select("p_partkey", tx.relabel_mode(raw, source).alias("mode"))


@query("h16_join_names", """
  SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_name || '; ' || p_type END AS names FROM part""")
def h16(spark, sf):
    listed = F.to_json(F.array("p_name", "p_type"))
    raw = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(listed)
    return v.table(spark, sf, "part").select("p_partkey", tx.join_names(raw).alias("names"))


@query("h17_pack_record", """
  SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_brand":"' || p_brand
    || '","source":"510k"}' AS packed FROM part""")
def h17(spark, sf):
    p = v.table(spark, sf, "part").withColumn("source", F.lit("510k"))
    return p.select("p_partkey", tx.pack_record("p_partkey", "p_name", "p_brand", "source").alias("packed"))


_DEVICE_K = f"CASE WHEN o_orderstatus = 'P' THEN {k('(o_orderkey * 97) % 1000000', 'DEN')} ELSE {k('(o_orderkey * 97) % 1000000')} END"
_FOLDER = """CASE WHEN CAST(regexp_extract(d, '[A-Z]+(\\d\\d)', 1) AS INT) >= 96 OR CAST(regexp_extract(d, '[A-Z]+(\\d\\d)', 1) AS INT) <= 1
  THEN '' ELSE CAST(CAST(regexp_extract(d, '[A-Z]+(\\d\\d)', 1) AS INT) AS VARCHAR) END"""


def _numbered(spark, sf):
    n = (F.col("o_orderkey") * 97) % 1000000
    d = F.when(F.col("o_orderstatus") == "P", v.number(n, "DEN")).otherwise(v.number(n))
    return v.table(spark, sf, "orders").select("o_orderkey", d.alias("d"))


@query("h18_document_year_folder", f"SELECT o_orderkey, {_FOLDER} AS folder FROM (SELECT o_orderkey, {_DEVICE_K} AS d FROM orders)")
def h18(spark, sf):
    return _numbered(spark, sf).select("o_orderkey", dc.document_year_folder(F.col("d")).alias("folder"))


@query("h19_candidate_document_urls", f"""
  SELECT o_orderkey, 'https://www.accessdata.fda.gov/cdrh_docs/reviews/' || d || '.pdf|https://www.accessdata.fda.gov/cdrh_docs/pdf'
    || {_FOLDER} || '/' || d || '.pdf' AS urls FROM (SELECT o_orderkey, {_DEVICE_K} AS d FROM orders)""")
def h19(spark, sf):
    return _numbered(spark, sf).select(
        "o_orderkey", F.array_join(dc.candidate_document_urls(F.col("d")), "|").alias("urls"))


@query("h20_pick_document", f"""
  SELECT {k('o_orderkey')} AS k_number,
    CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN 'r/' || {k('o_orderkey')}
      WHEN o_orderpriority NOT IN ('5-LOW', '2-HIGH') THEN 's/' || {k('o_orderkey')} END AS source_url,
    CASE WHEN (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT') OR o_orderpriority NOT IN ('5-LOW', '2-HIGH') THEN NULL
      ELSE 'no decision document found (last status: ' || CASE WHEN o_orderpriority = '5-LOW' THEN '404' ELSE '200' END || ')' END AS fetch_error
  FROM orders""")
def h20(spark, sf):
    return docs.pick_document(v.fetch_log(spark, sf))


@query("h21_flatten_ws", f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS flat FROM documents")
def h21(spark, sf):
    return v.spread_table(spark, sf, "documents").select("doc_id", tx.flatten_ws(F.col("text")).alias("flat"))


@query("h22_extract_measurand", "SELECT k_number, label, value FROM v_measured", ("v_measured",))
def h22(spark, sf):
    return v.summary_text(spark, sf).select("k_number", dc.extract_measurand(F.col("full_text")).alias("m")).select(
        "k_number", "m.label", "m.value")


_K = k("p_partkey % 1000000")


@query("h23_lines_until_next_section", f"""
  SELECT l_orderkey, CASE l_orderkey % 4 WHEN 0 THEN 'Predicate Name 510(k) Number|' ELSE '' END ||
    string_agg(CASE l_orderkey % 4 WHEN 0 THEN p_name || ' ' || {_K} WHEN 1 THEN p_name WHEN 2 THEN {_K} || ' - ' || p_name
      ELSE p_name || ' (' || {_K} || ')' END, '|' ORDER BY p_partkey) AS section
  FROM v_lines WHERE l_orderkey % 11 <> 3 GROUP BY 1""", ("v_lines",))
def h23(spark, sf):
    """The section of predicates in every document, whatever its template."""
    d = v.summary_text(spark, sf).withColumn("ls", dc.text_lines(F.col("full_text")))
    heads = ["A Predicate Device Names and 510(k) numbers", "1. Predicate device name(s):", "Predicate 510(k) Number(s):",
             "Predicate device name (Predicate 510(k) number):"]
    head = F.get(F.array(*[F.lit(h) for h in heads]), (F.col("l_orderkey") % 4).cast("int"))
    d = d.withColumn("at", F.array_position(F.transform("ls", lambda x: F.trim(x)), head).cast("int") - 1).filter("at >= 0")
    return d.select("l_orderkey", F.array_join(F.transform(dc.lines_until_next_section(F.col("ls"), F.col("at")), lambda x: F.trim(x)), "|").alias("section"))


def _citations(name, template, fn):
    """Edges one template finds over all documents: those written in it."""

    @query(name, f"SELECT device_k, predicate_k, predicate_name FROM v_cites WHERE l_orderkey % 4 = {template}", ("v_cites",))
    def run(spark, sf):
        lines = v.summary_text(spark, sf).select("k_number", dc.citation_lines(F.col("full_text")).alias("lines"))
        return docs.citation_edges(lines.select("k_number", fn(F.col("lines")).alias("citations")))


_citations("h24_citations_table", 0, dc.citations_table)
_citations("h25_citations_two_lists", 1, dc.citations_two_lists)
_citations("h26_citations_number_first", 2, dc.citations_number_first)
_citations("h27_citations_name_number", 3, dc.citations_name_number)


@query("e6_first_nonempty_template", "SELECT device_k, predicate_k, predicate_name FROM v_cites", ("v_cites",))
def e6(spark, sf):
    return docs.citation_edges(docs.with_citations(v.summary_text(spark, sf)))


@query("h28_contains_any_word", f"""
  SELECT page_id, CAST(len(list_intersect({words("array_to_string(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1), ' ')")},
    {words("array_to_string(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), ' ')")})) > 0 AS INT) AS in_links,
    CAST(len(list_intersect({words("split_part(url, '://', 2)")}, {words("html")})) > 0 AS INT) AS in_page FROM pages""")
def h28(spark, sf):
    """Words of the headings among those of all links, words of the address among the page's."""
    heads = F.array_join(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), 1), " ")
    links = F.array_join(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), " ")
    address = F.split_part("url", F.lit("://"), F.lit(2))
    return v.spread_table(spark, sf, "pages").select(
        "page_id", tx.contains_any_word(heads, links).cast("int").alias("in_links"),
        tx.contains_any_word(address, F.col("html")).cast("int").alias("in_page"))


@query("h29_parse_model_reply", """
  SELECT term_key, CASE WHEN p_partkey % 6 IN (0, 1) THEN p_name END AS "full",
    CASE WHEN p_partkey % 6 = 0 THEN p_name || '/' || p_type || '/' || p_brand END AS search
  FROM (SELECT *, p_name || ' ' || p_partkey AS term_key FROM part)""")
def h29(spark, sf):
    return v.model_replies(spark, sf).select("term_key", rp.parse_model_reply(F.col("body")).alias("a")).select(
        "term_key", "a.full", "a.search")


@query("h30_pick_terminology_hit", 'SELECT term_key, "full" FROM v_terminology WHERE "full" IS NOT NULL', ("v_terminology",))
def h30(spark, sf):
    from marketlens.operators.resolve import terminology_answers

    return terminology_answers(v.terminology_replies(spark, sf))


@query("h32_absolutise_url", """
  SELECT page_id, place, CASE WHEN href LIKE '/%' THEN 'https://www.wadsworth.org' || href ELSE href END AS link FROM (
    SELECT page_id, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS place FROM (
      SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) || [url] AS hrefs FROM pages))""")
def h32(spark, sf):
    """Every link of every page, and the page's own address."""
    links = F.concat(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1), F.array("url"))
    return v.table(spark, sf, "pages").select("page_id", F.posexplode(links).alias("place", "href")).select(
        "page_id", "place", ls.absolutise_url(F.col("href")).alias("link"))


@query("h33_parse_total", """
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey ELSE o_orderkey END AS total FROM orders""")
def h33(spark, sf):
    stated = F.concat(F.lit("Displaying 1 - 50 OF "), F.format_number("o_orderkey", 0), F.lit(" records"))
    header = F.when(F.col("o_orderstatus") == "P", "No header").otherwise(stated)
    return v.table(spark, sf, "orders").select("o_orderkey", ls.parse_total(header, F.col("o_custkey")).alias("total"))


@query("h34_parse_submission_numbers", "SELECT p_partkey, array_to_string(numbers, '|') AS numbers FROM v_registry", ("v_registry",))
def h34(spark, sf):
    return v.registry(spark, sf).select(
        "p_partkey", F.array_join(rg.submission_numbers(F.col("premarket_submissions")), "|").alias("numbers"))


@query("b14_valid_device_number", """
  SELECT o_orderkey, CAST(o_orderkey % 3 <> 2 AND length(CAST(o_orderkey * 50 AS VARCHAR)) <= 6 AS INT) AS valid FROM orders""")
def b14(spark, sf):
    n = F.col("o_orderkey") * 50
    number = F.when(F.col("o_orderkey") % 3 == 0, v.number(n)).when(F.col("o_orderkey") % 3 == 1, v.number(n, "DEN")).otherwise(v.number(n, "k"))
    return v.table(spark, sf, "orders").select("o_orderkey", tx.valid_device_number(number).cast("int").alias("valid"))
