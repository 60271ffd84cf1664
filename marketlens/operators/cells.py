"""Totals that filters recompute from kept cells, not from facts.

A cell is what all facts of one term, panel, month, match mode and applicant come to; every filter of
a results page tests one of these, months included, as date filters are whole months. Cells of new
facts merge with the kept ones by adding up. Without the applicant, cells are fewer, and hold a
distinct-count sketch in its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators import market as mk

_OPEN = ["term", "panel", "decision_date", "match_mode"]
# Of the sketch: 2^12 places, a relative standard error of about 1.6 %.
SKETCH_BITS = 12
SKETCH_ERROR = 1.04 / (1 << (SKETCH_BITS // 2))


def cells(details: DataFrame) -> DataFrame:
    """``term, panel, decision_date, match_mode, applicant, n, cleared, latest``.

    ``details`` hold a device once per term, ``decision_date`` as a date; in a cell it is the first
    day of its month, which passes a date filter as each day of the month does. ``latest`` is the
    last date of a cleared device. Nulls are values of their own.
    """
    cleared = mk.is_cleared(F.col("decision_description"))
    return (
        details.withColumn("_day", F.col("decision_date"))
        .withColumn("decision_date", F.trunc("decision_date", "month"))
        .groupBy(*_OPEN, "applicant")
        .agg(
            F.count("k_number").alias("n"),
            F.count_if(cleared).alias("cleared"),
            F.max(F.when(cleared, F.col("_day"))).alias("latest"),
        )
    )


def sketched(kept: DataFrame) -> DataFrame:
    """Cells without the applicant: ``term, panel, decision_date, match_mode, n, cleared, latest,
    applicants``, the last a sketch of the distinct applicants."""
    return kept.groupBy(*_OPEN).agg(
        F.sum("n").alias("n"),
        F.sum("cleared").alias("cleared"),
        F.max("latest").alias("latest"),
        F.hll_sketch_agg("applicant", F.lit(SKETCH_BITS)).alias("applicants"),
    )


def merged(kept: DataFrame, more: DataFrame) -> DataFrame:
    """Cells of either kind with those of further facts; a device must be among one side's only."""
    by = [*_OPEN, "applicant"] if "applicant" in kept.columns else _OPEN
    sketch = [] if "applicant" in kept.columns else [F.hll_union_agg("applicants").alias("applicants")]
    return kept.unionByName(more).groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("cleared").alias("cleared"), F.max("latest").alias("latest"), *sketch
    )


def summarise(terms: DataFrame, kept: DataFrame, filters: mk.Filters = mk.Filters()) -> DataFrame:
    """As :func:`market.summarise` over the facts that pass the filters, without the label.

    With cells by applicant all numbers are exact, since a term's distinct applicants are counted over
    its cells. With sketched cells ``unique_applicants`` is an estimate with a relative standard
    error of :data:`SKETCH_ERROR`, the others are exact; filters on applicants need the former.
    """
    exact = "applicant" in kept.columns
    if not exact and (filters.applicant is not None or filters.show_only):
        raise ValueError("sketched cells do not know single applicants; filter cells by applicant instead")
    if exact:
        applicants = F.count_distinct("applicant")
    else:
        applicants = F.hll_sketch_estimate(F.hll_union_agg("applicants"))
    totals = filters.apply(kept).groupBy("term").agg(
        F.sum("n").alias("total_submissions"),
        F.sum("cleared").alias("cleared_count"),
        applicants.alias("unique_applicants"),
        F.max("latest").alias("latest_approval"),
    )
    zero = F.lit(0).cast("long")
    counts = ["total_submissions", "cleared_count", "unique_applicants"]
    return (
        terms.join(totals, "term", "left")
        .select(*terms.columns, *[F.coalesce(c, zero).alias(c) for c in counts], "latest_approval")
        .withColumn("crowded", F.col("cleared_count") >= mk.CROWDED_FROM)
    )


def menus(kept: DataFrame, filters: mk.Filters) -> DataFrame:
    """As :func:`market.facets_under_filters`, from cells by applicant."""
    return mk.facets_under_filters(kept, filters, F.col("n"))
