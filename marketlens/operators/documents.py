"""Document jobs: fetch decisions, mining into text rows and citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.functions import documents as dc
from marketlens.functions import text as tx


def pick_document(fetch_log: DataFrame) -> DataFrame:
    """Per device the first candidate that is really a document, else an error text.

    ``fetch_log(k_number, ordinal, url, status, content_type)``.
    """
    good = (F.col("status") == 200) & F.contains(F.lower("content_type"), F.lit("pdf"))
    picked = fetch_log.groupBy("k_number").agg(
        F.min(F.when(good, F.struct("ordinal", "url"))).alias("first"),
        F.max(F.struct("ordinal", "status")).alias("last"),
    )
    # Fixed value: the words of the error, which stores and reports show.
    error = F.concat(
        F.lit("no decision document found (last status: "),
        F.coalesce(F.col("last.status").cast("string"), F.lit("None")),
        F.lit(")"),
    )
    return picked.select(
        "k_number",
        F.col("first.url").alias("source_url"),
        F.when(F.col("first").isNull(), error).alias("fetch_error"),
    )


def with_measurand(documents: DataFrame) -> DataFrame:
    """Add ``measurand_label`` and ``measurand_value`` to document rows."""
    found = documents.select("*", dc.extract_measurand(F.col("full_text")).alias("_m"))
    return found.select(
        *documents.columns,
        F.col("_m.label").alias("measurand_label"),
        F.col("_m.value").alias("measurand_value"),
    )


def with_citations(documents: DataFrame) -> DataFrame:
    """Add ``citations`` to document rows; the lines are split once for all templates."""
    split = documents.select("*", dc.citation_lines(F.col("full_text")).alias("_lines"))
    return split.select(*documents.columns, dc.extract_citations(F.col("_lines")).alias("citations"))


def mine_documents(documents: DataFrame) -> DataFrame:
    """Measurand and citations of every document row."""
    return with_citations(with_measurand(documents))


def citation_edges(mined: DataFrame) -> DataFrame:
    """Edge rows ``device_k, predicate_k, predicate_name``; the last name of a pair stays."""
    # Repeats can only come from one document, so they are resolved inside its row.
    last = F.filter(
        "citations",
        lambda c, i: ~F.exists(
            F.slice("citations", i + 2, F.size("citations")),
            lambda later: later["k_number"] == c["k_number"],
        ),
    )
    return mined.select(
        F.col("k_number").alias("device_k"), F.explode(last).alias("c")
    ).select("device_k", F.col("c.k_number").alias("predicate_k"), F.col("c.name").alias("predicate_name"))


def measurand_verdict(details: DataFrame, documents: DataFrame) -> DataFrame:
    """Add ``verdict``: does the device's own stated measurand name the term?

    ``details(term_id, term, k_number[, full, search])``. True when the antigen or a whole
    synonym group of the expansion is found in the measurand; NULL without one.
    """
    stated = documents.select(
        "k_number", "measurand_value", tx.padded(F.col("measurand_value")).alias("_stated")
    )
    wanted = tx.padded(tx.antigen_of(tx.greek_to_latin(F.col("term"))))
    asked = details.withColumn("_wanted", wanted)
    named = tx.contains_phrase(F.col("_stated"), F.col("_wanted"))
    if {"full", "search"} <= set(details.columns):
        groups = tx.expansion_groups(tx.expansion_phrase(F.col("full"), F.col("search")))
        asked = asked.withColumn("_groups", F.transform(groups, lambda g: F.transform(g, tx.padded)))
        by_group = F.exists(
            "_groups", lambda g: F.forall(g, lambda w: tx.contains_phrase(F.col("_stated"), w))
        )
        named = named | F.coalesce(by_group, F.lit(False))
    verdict = F.when(
        F.col("measurand_value").isNotNull(),
        F.when(named, F.lit("Matches")).otherwise(F.lit("No match")),
    )
    return (
        asked.join(stated, "k_number", "left").withColumn("verdict", verdict)
        .drop("_stated", "_wanted", "_groups")
    )
