"""The engine's inputs, derived from the tables at hand.

Every view covers its whole source tables. ``workload/sql.py`` states the same views in
SQL for the comparison queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions.listing_html import Selectors
from marketlens.sources.scans import spread

def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table whose rows are costly to work on, dealt out when it has few splits."""
    return spread(table(spark, sf, name))


def number(c: Column | str, prefix: str = "K") -> Column:
    """A device number of at least six digits."""
    return F.format_string(prefix + "%06d", F.col(c) if isinstance(c, str) else c)


def cap(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


# -- terms ------------------------------------------------------------------------------


def term_forms(spark, sf) -> DataFrame:
    """``p_partkey, t``: every part name written as one of twelve kinds of term."""
    p = table(spark, sf, "part")
    w1, w2 = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    forms = [
        F.concat(F.lit("Anti-"), cap(w2), F.lit(" IgG")),
        F.concat(w1, F.lit(" "), w2, F.lit(" IgG4")),
        F.concat(F.lit("anti "), w1),
        F.concat(F.lit("α-"), w1, F.lit("β"), w2, F.lit("Δκ")),
        F.concat(w1, cap(w2)),
        F.concat(w1, F.lit("-"), w2),
        F.concat(F.lit("ANTI-"), w1, F.lit("/"), w2),
        F.concat(w1, F.lit("   "), w2),
        F.concat(F.lit("μ"), w1, F.lit("µ")),
        F.lit("-"),
        F.concat(F.lit("anti"), w1),
        F.concat(w1, F.lit(" IgD")),
    ]
    return p.select("p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 12).cast("int")).alias("t"))


def terms(spark, sf) -> DataFrame:
    """``term_id, term, full, search``: eight kinds of term from every nine words of every
    benchmark text, up to its last word."""
    words = F.array_remove(F.split("text", r"[^\p{L}\p{N}]+"), "")
    b = table(spark, sf, "benchmark").select("item_id", words.alias("all"))
    last = F.greatest(F.ceil(F.size("all") / 9), F.lit(1)) - 1
    b = b.select("item_id", "all", F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("at"))
    b = b.select("item_id", "at", F.slice("all", F.col("at") * 9 + 1, 9).alias("w"))

    def w(i: int) -> Column:
        return F.coalesce(F.get("w", F.lit(i - 1)), F.lit("x"))

    forms = [
        F.concat_ws(" ", w(1), w(2), w(3)),
        F.concat_ws(" ", F.lit("anti"), w(2)),
        F.concat(F.lit("Anti-"), w(3)),
        F.concat(w(4), F.lit(" IgG")),
        F.concat(F.lower(F.substring(w(5), 1, 2)), cap(w(6))),
        F.concat(F.lit("src"), F.col("item_id").cast("string")),
        F.concat(w(1), F.lit("-"), w(2)),
        F.concat_ws(" ", w(3), w(2)),
    ]
    full = F.concat_ws(" ", w(7), w(8))
    search = F.concat(full, F.lit("/"), w(9), F.lit(", antibody/anti"), w(2), F.lit("/(anti)"))
    return b.select("item_id", "at", full.alias("full"), search.alias("search"), F.posexplode(F.array(*forms)).alias("f", "term")).select(
        ((F.col("item_id") * 1048576 + F.col("at")) * 8 + F.col("f")).alias("term_id"),
        "term",
        F.when(F.col("f") % 4 != 3, F.col("full")).alias("full"),
        F.when(F.col("f") % 4 < 2, F.col("search")).alias("search"),
    )


# -- devices ----------------------------------------------------------------------------


def devices(spark, sf) -> DataFrame:
    """Every document as a clearance record."""
    d, lab = spread_table(spark, sf, "documents"), table(spark, sf, "labels")
    first_line = F.substring_index("text", "\n", 1)
    return d.join(lab, "doc_id", "left").select(
        number("doc_id").alias("k_number"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(first_line, F.lit(" antibody"))).otherwise(first_line).alias("device_name"),
        F.col("text").alias("statement_or_summary"),
        F.array(F.col("source"), F.concat(F.col("lang"), F.lit(" kit"))).alias("openfda_device_names"),
        F.col("source").alias("applicant"),
        F.when(F.col("quality") == 1, "Substantially Equivalent").when(F.col("quality") == 0, "Not Substantially Equivalent").alias("decision_description"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 3650).cast("int")).alias("decision_date"),
        F.col("lang").alias("panel"),
    )


# -- submissions ------------------------------------------------------------------------


def submission_devices(spark, sf) -> DataFrame:
    """Every order as a clearance record."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    decision = (
        F.when(F.col("o_orderstatus") == "F", "Substantially Equivalent")
        .when(F.col("o_orderstatus") == "O", "Substantially Equivalent - With Limitations")
        .otherwise("Not Substantially Equivalent")
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        number("o_orderkey").alias("k_number"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("device_name"),
        F.col("c_name").alias("applicant"),
        decision.alias("decision_description"),
        F.col("o_orderdate").cast("date").alias("decision_date"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.substr("o_orderpriority", F.lit(3))).alias("panel"),
    )


def submission_matches(spark, sf) -> DataFrame:
    """``term, k_number, match_mode, confidence, via_k_number`` from every line item."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    mode = (
        F.when(F.col("l_returnflag") == "R", "predicate")
        .when(F.col("l_linenumber") >= 6, "gudid")
        .otherwise("exact")
    )
    facts = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_name").alias("term"), "l_orderkey", mode.alias("match_mode"), "l_suppkey"
    )
    one = facts.groupBy("term", "l_orderkey", "match_mode").agg(F.min("l_suppkey").alias("via")).select(
        "term", number("l_orderkey").alias("k_number"), "match_mode", number("via").alias("via")
    )
    return one.select(
        "term", "k_number", "match_mode",
        F.when(F.col("match_mode") == "exact", "confirmed").otherwise("inferred").alias("confidence"),
        F.when(F.col("match_mode") == "predicate", F.col("via")).alias("via_k_number"),
    )


def submission_terms(spark, sf) -> DataFrame:
    """All part names, and all brands as terms that nothing was submitted for."""
    p = table(spark, sf, "part")
    return p.select(F.explode(F.array("p_name", "p_brand")).alias("term")).distinct()


def submission_details(spark, sf) -> DataFrame:
    """Confirmed facts with their device columns."""
    from marketlens.operators import market as mk

    return mk.attach_devices(mk.filter_confirmed(submission_matches(spark, sf)), submission_devices(spark, sf))


# -- citations --------------------------------------------------------------------------


def edges(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    pairs = li.select("l_orderkey", "l_partkey").distinct()
    return pairs.select(number("l_orderkey").alias("device_k"), number("l_partkey").alias("predicate_k"))


def citation_seeds(spark, sf) -> DataFrame:
    """One confirmed device for every supplier, taken as a term."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("term_id"), number("s_suppkey").alias("k_number"))


# -- documents --------------------------------------------------------------------------

SECTION_LABELS = ["Measurand", "Analyte", "Type of Test or Tests Performed", "Intended Use", "Remarks"]


def order_lines(spark, sf) -> DataFrame:
    """Distinct cited parts of every order: ``l_orderkey, p_name, p_partkey``."""
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_partkey", "p_name").distinct()


def summary_text(spark, sf) -> DataFrame:
    """A decision summary for every order, in the template of its number."""
    rows = order_lines(spark, sf).groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct(F.col("p_partkey").alias("n"), F.col("p_name").alias("name")))).alias("r")
    )
    # A number has six digits in the documents, so part keys are taken modulo a million.
    k = lambda r: F.format_string("K%06d", r["n"] % 1_000_000)

    def lines(fn) -> Column:
        return F.array_join(F.transform("r", fn), "\n")

    table_ = F.concat(
        F.lit("A Predicate Device Names and 510(k) numbers\nPredicate Name 510(k) Number\n"),
        lines(lambda r: F.concat(r["name"], F.lit(" "), k(r))),
        F.lit("\nB Comparison\nLate K999999"),
    )
    two = F.concat(
        F.lit("1. Predicate device name(s):\n"), lines(lambda r: r["name"]),
        F.lit("\n2. Predicate 510(k) number(s):\n"), lines(k), F.lit("\n3. Comparison"),
    )
    first = F.concat(
        F.lit("Predicate 510(k) Number(s):\n"), lines(lambda r: F.concat(k(r), F.lit(" - "), r["name"])),
        F.lit("\nB Comparison"),
    )
    pair = F.concat(
        F.lit("Predicate device name (Predicate 510(k) number):\r\n"),
        lines(lambda r: F.concat(F.lit("  "), r["name"], F.lit(" ("), k(r), F.lit(") "))),
        F.lit("\nC Other"),
    )
    template = (F.col("l_orderkey") % 4).cast("int")
    label = F.get(F.array(*[F.lit(x) for x in SECTION_LABELS]), (F.col("l_orderkey") % 5).cast("int"))
    head = F.concat(
        F.lit("the measurand: prose\nK Number given\nB "), label, F.lit(":  "), F.col("r")[0]["name"],
        F.lit("\nassay\nC Device Description\n"),
    )
    failed = F.col("l_orderkey") % 11 == 3
    body = F.when(template == 0, table_).when(template == 1, two).when(template == 2, first).otherwise(pair)
    text = F.concat(head, body)
    return rows.select(
        "l_orderkey",
        number("l_orderkey").alias("k_number"),
        F.when(~failed, text).alias("full_text"),
        F.when(failed, F.lit("no decision document found (last status: 404)")).alias("fetch_error"),
    )


def fetch_log(spark, sf) -> DataFrame:
    """Two document requests for every order, with outcomes by its columns."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    k = number("o_orderkey")
    tries = F.array(
        F.struct(
            F.lit(1).alias("ordinal"), F.concat(F.lit("r/"), k).alias("url"),
            F.when(F.col("o_orderstatus") == "F", 200).otherwise(404).alias("status"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "text/html").otherwise("application/PDF").alias("content_type"),
        ),
        F.struct(
            F.lit(2).alias("ordinal"), F.concat(F.lit("s/"), k).alias("url"),
            F.when(F.col("o_orderpriority") == "5-LOW", 404).otherwise(200).alias("status"),
            F.when(F.col("o_orderpriority") == "2-HIGH", "text/html").otherwise("application/pdf").alias("content_type"),
        ),
    )
    return o.select(k.alias("k_number"), F.inline(tries))


# -- registry ---------------------------------------------------------------------------


def registry(spark, sf) -> DataFrame:
    """Every part as a registry record."""
    p = table(spark, sf, "part")
    kind = F.col("p_size") % 5
    code_type = "array<struct<name:string,openfda:struct<device_name:string>>>"
    codes = F.array(F.struct(
        F.when(kind == 0, "Real Time System").when(kind == 1, "Systemic assay").otherwise("Assay").alias("name"),
        F.struct(F.when(kind == 0, "Thermal Cycler").when(kind == 1, F.concat("p_name", F.lit(" Antibody"))).alias("device_name")).alias("openfda"),
    )).cast(code_type)
    return p.select(
        "p_partkey",
        F.concat_ws(" ", "p_name", "p_type").alias("device_description"),
        F.col("p_brand").alias("brand_name"),
        F.when(kind != 2, codes).alias("product_codes"),
        F.array(F.struct(F.col("p_type").alias("name"), F.when(kind == 3, "optical reader").alias("definition"))).alias("gmdn_terms"),
        F.when(
            kind != 4,
            F.array(
                F.struct(F.lower(number("p_partkey")).alias("submission_number")),
                F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("submission_number")),
                F.struct(F.when(F.col("p_size") % 7 == 0, number("p_size", "DEN")).alias("submission_number")),
            ),
        ).alias("premarket_submissions"),
    )


def registry_terms(spark, sf) -> DataFrame:
    """``term_id, term, full, search`` for every part name; some have no expansion."""
    p = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("term_id"))
    w1, w2 = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    search = (
        F.when(w1.isin("old", "hot"), F.lit(None))
        .when(w1 == "new", F.concat("p_name", F.lit("/"), F.upper("p_name"), F.lit("/PROMO "), w2))
        .otherwise(F.concat(w2, F.lit(" ECONOMY/"), w1, F.lit(" Brand#7/ /"), w2, F.lit(" ECONOMY")))
    )
    return p.select("term_id", F.col("p_name").alias("term"), F.when(w1 != "hot", F.col("p_name")).alias("full"), search.alias("search"))


# -- resolver replies -------------------------------------------------------------------


def reply_key() -> Column:
    return F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string"))


def model_replies(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    bodies = [
        F.concat("p_name", F.lit("\n"), F.col("p_type"), F.lit(", "), F.col("p_brand"), F.lit(",")),
        F.concat(F.lit("<think>hm\nhm</think>\n"), "p_name"),
        F.lit("UNKNOWN"),
        F.concat(F.lit("unknown term "), "p_name"),
        F.concat(F.repeat("p_type", 50), F.lit("\nx")),
        F.lit(" \n "),
    ]
    return p.select(
        reply_key().alias("term_key"), F.lit(1).alias("ordinal"),
        F.when(F.col("p_size") == 50, 500).otherwise(200).alias("status"),
        F.get(F.array(*bodies), (F.col("p_partkey") % 6).cast("int")).alias("body"),
    )


def terminology_replies(spark, sf) -> DataFrame:
    p = table(spark, sf, "part")
    none = F.lit('{"result":{"results":[{"ui":"NONE","name":"x"}]}}')
    hit = F.concat(F.lit('{"result":{"results":[{"ui":"NONE","name":"x"},{"ui":"C'), F.col("p_partkey").cast("string"), F.lit('","name":"'), F.col("p_name"), F.lit('"},{"ui":"C0","name":"later"}]}}'))
    words = F.concat(F.lit('{"result":{"results":[{"ui":"W1","name":"'), F.col("p_brand"), F.lit('"}]}}'))
    tries = F.array(
        F.struct(F.lit("words").alias("search_type"), F.when(F.col("p_size") > 45, 429).otherwise(200).alias("status"), words.alias("body")),
        F.struct(F.lit("exact").alias("search_type"), F.lit(200).alias("status"), F.when(F.col("p_size") % 3 == 0, hit).otherwise(none).alias("body")),
    )
    return p.select(reply_key().alias("term_key"), F.inline(tries))


def expansion_cache(spark, sf) -> DataFrame:
    """Answers that were kept from earlier: those of the small parts."""
    p = table(spark, sf, "part").filter(F.col("p_size") <= 12)
    negative = F.col("p_size") <= 4
    return p.select(
        reply_key().alias("term_key"),
        F.when(~negative, F.col("p_type")).alias("full"),
        F.when(~negative & (F.col("p_size") <= 8), F.concat_ws("/", "p_type", "p_brand")).alias("search"),
        F.when(negative, "none").otherwise("umls").alias("source"),
    )


# -- listing pages ----------------------------------------------------------------------


def listing_pages(spark, sf) -> DataFrame:
    """Every web page's title and heading laid out as a two-row listing page."""
    pg = spread_table(spark, sf, "pages")
    host = F.regexp_extract("url", "//([^/]+)/", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    head = F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)
    link = F.regexp_extract("html", '<li><a href="(/[^"]*)"', 1)

    def field(css: str, c: Column) -> list[Column]:
        return [F.lit(f'<div class="field {css}"><span class="field__label">L</span><div class="field__item">\n '), c, F.lit(" </div></div>")]

    def row(name: Column, analyte: Column, status: str, href: Column) -> list[Column]:
        return [
            F.lit('<div class="views-row odd"><h2 class="clep-approved-ltd__name">'), name, F.lit("</h2>"),
            *field("field--name-field-analyte-name", analyte),
            *field("field--name-field-ltd-status", F.lit(f"<b>{status}</b><br>")),
            F.lit('<p class="print"><a class="x" href="'), href, F.lit('">Print</a></p></div>'),
        ]

    html = F.concat(
        F.lit('<html><body><div class="view__header"><h3>Displaying 1 - 2 of 1,'),
        F.format_string("%03d", F.col("page_id") % 1000), F.lit(" Records</h3></div>"),
        *row(host, title, "Approved", link),
        *row(F.lit("Lab\t  Two"), head, "Conditionally  Approved", F.concat(F.lit("http://x"), link)),
        F.lit('<div class="footer">end</div></body></html>'),
    )
    return pg.select("page_id", F.col("url"), html.alias("html"))


# A given page read as a listing: its list items are the rows, its links the names.
PAGE_ITEMS = Selectors(row="li", fields={"facilityName": ("a",)}, link=("a",), header=("h1",))


def listing_rows(spark, sf) -> DataFrame:
    """Every part as an already extracted listing row."""
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        F.concat_ws(" ", "p_type", "p_name").alias("analyte"),
        F.when(F.col("p_size") % 2 == 0, "Approved").otherwise("Conditionally Approved").alias("status"),
    )


# -- whole searches ---------------------------------------------------------------------


def part_devices(spark, sf) -> DataFrame:
    """Every part as a clearance record, under the number its registry record names."""
    p = table(spark, sf, "part")
    return p.select(
        number("p_partkey").alias("k_number"), F.col("p_name").alias("device_name"),
        F.col("p_type").alias("statement_or_summary"), F.array("p_brand").alias("openfda_device_names"),
    )


def order_edges(spark, sf) -> DataFrame:
    """Every order cites the device with its customer's number."""
    o = table(spark, sf, "orders")
    return o.select(number("o_orderkey").alias("device_k"), number("o_custkey").alias("predicate_k"))


def search_terms(spark, sf) -> DataFrame:
    """Part names with their expansions, and the resolver that gave them."""
    t = registry_terms(spark, sf)
    return t.withColumn("source", F.when(F.col("full").isNull(), "none").otherwise("umls"))
