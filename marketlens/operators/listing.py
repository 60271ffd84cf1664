"""Laboratory-test listings: extraction, search and the zero-clearance cross-check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.functions.listing_html import Selectors, read_pages
from marketlens.operators.market import cap_per_term, first_per_group
from marketlens.operators.skew import salted_join
from marketlens.session import fits_broadcast, stored

LISTING_SITE = "https://www.wadsworth.org"


def absolutise_url(href: Column, base: str | Column = LISTING_SITE) -> Column:
    base = F.lit(base) if isinstance(base, str) else base
    return F.when(F.startswith(href, F.lit("/")), F.concat(base, href)).otherwise(href)


def parse_total(header: Column, fallback: Column) -> Column:
    """The total a page header states (``of 1,234 Records``), else the fallback."""
    digits = F.replace(F.regexp_extract(header, r"(?i)of\s+([\d,]+)\s+Records?", 1), F.lit(","))
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), fallback.cast("bigint"))


def extract_listing_rows(pages: DataFrame, selectors: Selectors = Selectors()) -> DataFrame:
    """One cleaned row per listing entry of ``pages(url, html)``, by default of a listing as the
    site lays it out.

    Pages without the row marker never leave the JVM. Elements nest, so the rest goes
    through an HTML reader in Arrow batches, page by page.
    """
    schema = "url string, header string, row_no int, rows_on_page int, " + ", ".join(
        f"{f} string" for f in selectors.columns
    )
    listed = pages.select("url", "html").filter(F.contains("html", F.lit(selectors.row)))
    rows = listed.mapInPandas(lambda batches: read_pages(batches, selectors), schema)
    cleaned = [tx.flatten_ws(F.col(f)).alias(f) for f in selectors.fields]
    link = absolutise_url(tx.flatten_ws(F.col("detailLink"))).alias("detailLink")
    return rows.select(
        "url", "row_no", *cleaned, link, parse_total(F.col("header"), F.col("rows_on_page")).alias("total")
    )


def filter_status(rows: DataFrame, status: str = "All") -> DataFrame:
    """``approved`` or ``conditionally_approved`` against the listing's status text."""
    if status == "All":
        return rows
    return rows.filter(F.replace(F.lower("status"), F.lit(" "), F.lit("_")) == status)


def _wanted(terms: DataFrame) -> DataFrame:
    """``term, _wanted, word``: a written row for each word a term is searched by."""
    plain = tx.antigen_of(tx.greek_to_latin(tx.strip_ws(F.col("term"))))
    wanted = terms.select("term", F.array_distinct(tx.words_of(tx.padded(plain))).alias("_wanted"))
    return stored(wanted.select("*", F.explode_outer("_wanted").alias("word")).filter("word IS NOT NULL"), "wanted")


def search_listing(terms: DataFrame, rows: DataFrame, analyte: str = "analyte") -> DataFrame:
    """Listing rows whose analyte has any word of a term: ``term`` and the row's columns.

    Terms are searched without anti prefix and isotype, whose words are everywhere.
    """
    wanted = _wanted(terms)
    listed = rows.withColumn("_words", F.array_distinct(tx.words_of(tx.padded(F.col(analyte)))))
    # A row holding several words of a term counts once: through the first of them.
    # The outer form keeps the optimiser from adding a size test that tokenises a second time.
    words = listed.select("*", F.explode_outer("_words").alias("word"))
    if fits_broadcast(wanted):
        pairs = words.join(F.broadcast(wanted), "word")
    else:
        pairs = salted_join(words, wanted, ["word"], salt_by=["_words"])
    return (
        pairs.filter(F.get(F.array_intersect("_words", "_wanted"), F.lit(0)) == F.col("word"))
        .select("term", *rows.columns)
    )


def listing_report(hits: DataFrame, k: int, order: list[str]) -> DataFrame:
    """Per term the first ``k`` of its listing rows and the number of all of them."""
    return cap_per_term(hits, ["term"], order, k)


def search_report(terms: DataFrame, rows: DataFrame, k: int, order: list[str], analyte: str = "analyte") -> DataFrame:
    """As :func:`listing_report` of :func:`search_listing`, without forming term x row pairs: ``term``,
    the row's columns, ``total``. Equal rows by ``order`` are settled by their place in the table.

    The first ``k`` rows of a term are among the first ``k`` of each of its words, so a list is kept
    per word, filled to ``k`` in every task before anything is shuffled, and a term merges the
    lists of its words: what is joined is bounded by the words of the terms times ``k``, however
    many rows a word stands in. The total needs all rows, but only as counts: rows with the same
    words are one, and terms add the counts of the word sets they meet, each through the first
    word in common.
    """
    terms = terms.distinct()
    wanted = _wanted(terms)
    words = F.array_distinct(tx.words_of(tx.padded(F.col(analyte))))
    listed = stored(rows.withColumn("_words", words).withColumn("_row", F.monotonically_increasing_id()), "listed")
    small = fits_broadcast(wanted)

    sets = listed.groupBy("_words").agg(F.count("*").alias("_n")).select("*", F.explode_outer("_words").alias("word"))
    met = sets.join(F.broadcast(wanted), "word") if small else salted_join(sets, wanted, ["word"], salt_by=["_words"])
    once = met.filter(F.get(F.array_intersect("_words", "_wanted"), F.lit(0)) == F.col("word"))
    totals = once.groupBy("term").agg(F.sum("_n").alias("total"))

    asked = wanted.select("word").distinct()
    postings = listed.select(*rows.columns, "_row", F.explode_outer("_words").alias("word"))
    postings = postings.join(F.broadcast(asked) if small else asked, "word", "left_semi")
    lists = stored(first_per_group(postings, ["word"], [*order, "_row"], k), "lists")
    pairs = lists.join(F.broadcast(wanted), "word") if small else salted_join(lists, wanted, ["word"], salt_by=["_row"])
    merged = pairs.dropDuplicates(["term", "_row"])
    first = first_per_group(merged, ["term"], [*order, "_row"], k)
    return first.join(totals, "term").select("term", *rows.columns, "total")


def zero_clearance_crosscheck(summary: DataFrame, rows: DataFrame, analyte: str = "analyte") -> DataFrame:
    """Terms nothing was cleared for, with their listed laboratory tests.

    A term without any keeps one row with ``found`` false.
    """
    zero = summary.filter(F.col("cleared_count") == 0).select("term")
    hits = search_listing(zero, rows, analyte).withColumn("found", F.lit(True))
    return zero.join(hits, "term", "left").withColumn("found", F.coalesce("found", F.lit(False)))
