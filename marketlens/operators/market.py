"""The market table: filters, totals, rankings, documents per term."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.plans.tiers import TIERS
from marketlens.session import fits_broadcast, stored

# The clearing decision, the crowded-market bound, the listing caps.
CLEARED_DECISION = "Substantially Equivalent"
CROWDED_FROM = 10
MAX_RECORDS = 300
MAX_LISTING_ROWS = 50
PAGE_SIZE = 100
# The review panels in scope.
PANELS_IN_SCOPE = ["IM", "CH", "HE", "MI", "PA", "TX"]

# Records to a row of a nested result; all records are in some row.
CHUNK_RECORDS = 1000

# Labels of matches, best first.
LABELS = [*TIERS, "ai-suggested", "umls", "gudid", "predicate", "other"]

# Fixed value: where a record's page is.
DETAIL_URL = "https://www.accessdata.fda.gov/scripts/cdrh/cfdocs/cfPMN/pmn.cfm?ID="


def is_cleared(decision: Column) -> Column:
    return F.coalesce(F.startswith(decision, F.lit(CLEARED_DECISION)), F.lit(False))


# -- filters ----------------------------------------------------------------------------


def _in_panels(panels: list[str], column: str = "panel") -> Column:
    return F.col(column).isin(*panels)


def _in_window(from_month: str | None, to_month: str | None, column: str = "decision_date") -> list[Column]:
    first = [F.col(column) >= F.to_date(F.lit(from_month + "-01"))] if from_month else []
    return first + ([F.col(column) <= F.last_day(F.to_date(F.lit(to_month + "-01")))] if to_month else [])


def _names_one(names: list[str]) -> Column:
    tests = [
        F.contains(F.lower(c), F.lower(F.lit(n))) for n in names for c in ("term", "applicant")
    ]
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def _not_in_panels(panels: list[str]) -> Column:
    return F.col("panel").isNull() | ~F.col("panel").isin(*panels)


def filter_panel_in(df: DataFrame, panels: list[str], column: str = "panel") -> DataFrame:
    return df.filter(_in_panels(panels, column))


def filter_date_window(df: DataFrame, from_month: str | None = None, to_month: str | None = None,
                       column: str = "decision_date") -> DataFrame:
    """Keep dates from the first day of ``from_month`` to the last of ``to_month`` (``yyyy-MM``)."""
    for test in _in_window(from_month, to_month, column):
        df = df.filter(test)
    return df


def filter_applicant(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("applicant") == name)


def filter_show_only(df: DataFrame, names: list[str]) -> DataFrame:
    """Keep rows whose term or applicant contains one of the names, in any case."""
    return df.filter(_names_one(names)) if names else df


def filter_exclude_panels(df: DataFrame, panels: list[str]) -> DataFrame:
    """Drop ruled-out panels; records without a panel stay."""
    return df.filter(_not_in_panels(panels)) if panels else df


def filter_confirmed(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("confidence") == "confirmed")


def filter_mode(matches: DataFrame, mode: str) -> DataFrame:
    return matches.filter(F.col("match_mode") == mode)


# -- facts ------------------------------------------------------------------------------


def attach_devices(matches: DataFrame, devices: DataFrame) -> DataFrame:
    """Match facts with their device columns; one join serves all match classes."""
    return matches.join(devices, "k_number")


def record_rows(details: DataFrame) -> DataFrame:
    """The detail listing: name, applicant, decision, date and the record's address."""
    return details.select(
        "term", "k_number", "device_name", "applicant", "decision_description", "decision_date",
        F.concat(F.lit(DETAIL_URL), F.col("k_number")).alias("record_url"),
    )


def unconfirmed_matches(matches: DataFrame) -> DataFrame:
    """Citation- and registry-inferred facts, each with its match type."""
    label = (
        F.when(F.col("match_mode") == "predicate", "inferred via predicate")
        .when(F.col("match_mode") == "gudid", "found via device registry")
    )
    return (
        matches.filter(F.col("confidence") == "inferred")
        .withColumn("match_type", label)
        .filter(F.col("match_type").isNotNull())
    )


def subtract_confirmed(unconfirmed: DataFrame, confirmed: DataFrame, by: str = "term") -> DataFrame:
    return unconfirmed.join(confirmed.select(by, "k_number"), [by, "k_number"], "left_anti")


# -- totals per term --------------------------------------------------------------------


def _best_label(mode: str) -> tuple[Column, Column]:
    """Rank of a label as an integer, for a minimum on hash tables, and the label of a rank.

    Labels the engine does not know count last, as ``other``."""
    labels = F.array(*[F.lit(x) for x in LABELS])
    place = F.array_position(labels, F.col(mode)).cast("int")
    rank = F.when(F.col(mode).isNotNull(), F.when(place > 0, place).otherwise(len(LABELS)))
    return F.min(rank), F.get(labels, F.col("_label") - 1)


def summarise(terms: DataFrame, facts: DataFrame, by: str = "term") -> DataFrame:
    """One row per term: submissions, cleared, crowded, applicants, latest approval.

    ``facts`` hold a device once per term. Where they carry a ``match_mode``, the row has the
    best of the term's labels (``exact`` if it has no facts), however many labels there are.
    """
    cleared = is_cleared(F.col("decision_description"))
    labelled = "match_mode" in facts.columns
    rank, label = _best_label("match_mode") if labelled else (None, None)
    totals = facts.groupBy(by).agg(
        F.count("k_number").alias("total_submissions"),
        F.count_if(cleared).alias("cleared_count"),
        F.count_distinct("applicant").alias("unique_applicants"),
        F.max(F.when(cleared, F.col("decision_date"))).alias("latest_approval"),
        *([rank.alias("_label")] if labelled else []),
    )
    zero = F.lit(0).cast("long")
    counts = ["total_submissions", "cleared_count", "unique_applicants"]
    return (
        terms.join(totals, by, "left")
        .select(
            *terms.columns,
            *[F.coalesce(c, zero).alias(c) for c in counts],
            "latest_approval",
            *([F.coalesce(label, F.lit("exact")).alias("match_mode")] if labelled else []),
        )
        .withColumn("crowded", F.col("cleared_count") >= CROWDED_FROM)
    )


def applicants_per_term(facts: DataFrame) -> DataFrame:
    """Long form: ``term, applicant, submissions``."""
    return (
        facts.filter(F.col("applicant").isNotNull())
        .groupBy("term", "applicant")
        .agg(F.count("k_number").alias("submissions"))
    )


def biomarker_applicants(terms: DataFrame, facts: DataFrame) -> DataFrame:
    """Per term: submissions, number of applicants and their list.

    Records are reduced to one row per (term, applicant) before a list is formed, so a
    list is as long as the term has companies, however many records they filed.
    """
    totals = facts.groupBy("term").agg(F.count("k_number").alias("total_submissions"))
    lists = (
        applicants_per_term(facts)
        .groupBy("term")
        .agg(
            F.count("applicant").alias("unique_applicants"),
            F.sort_array(F.collect_list("applicant")).alias("applicants"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        terms.join(totals, "term", "left").join(lists, "term", "left").select(
            *terms.columns,
            F.coalesce("total_submissions", zero).alias("total_submissions"),
            F.coalesce("unique_applicants", zero).alias("unique_applicants"),
            F.coalesce("applicants", F.array().cast("array<string>")).alias("applicants"),
        )
    )


def unconfirmed_counts(terms: DataFrame, matches: DataFrame) -> DataFrame:
    """Per term, citation- and registry-inferred devices; they stay outside the totals."""
    counts = (
        matches.filter(F.col("confidence") == "inferred")
        .groupBy("term")
        .agg(
            F.count_if(F.col("match_mode") == "predicate").alias("via_predicate"),
            F.count_if(F.col("match_mode") == "gudid").alias("via_registry"),
        )
    )
    zero = F.lit(0).cast("long")
    return terms.join(counts, "term", "left").select(
        *terms.columns,
        F.coalesce("via_predicate", zero).alias("via_predicate"),
        F.coalesce("via_registry", zero).alias("via_registry"),
    )


def facets(details: DataFrame) -> DataFrame:
    """Values for the filter menus: ``facet, value, n``."""
    pairs = F.array(
        F.struct(F.lit("applicant").alias("facet"), F.col("applicant").alias("value")),
        F.struct(F.lit("panel").alias("facet"), F.col("panel").alias("value")),
    )
    return (
        details.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.count("*").alias("n"))
    )


# -- order, rank, caps, pages -----------------------------------------------------------


def fewest_approvals() -> list[Column]:
    return [F.col("cleared_count").asc(), F.col("term").asc()]


def most_recent() -> list[Column]:
    return [F.col("latest_approval").desc_nulls_last(), F.col("term").asc()]


def sort_fewest_approvals(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*fewest_approvals())


def sort_most_recent(summary: DataFrame) -> DataFrame:
    return summary.orderBy(*most_recent())


def rank_rows(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """Add ``rank``, from 1, in the given order without bringing all rows into one task.

    The range-partitioned sort is written once; a row's rank is the number of rows in earlier
    partitions plus its place in its own.
    """
    ordered = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    # One row per partition of the sort, never per row of the table.
    before = sizes.select(
        "_p",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_before"),
    )
    return (
        ordered.withColumn("_p", part)
        .join(F.broadcast(before), "_p")
        .withColumn("rank", F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_at", "_p", "_before")
    )


def rank_terms(summary: DataFrame, order: list[Column]) -> DataFrame:
    """The summary with each term's ``rank`` in the given order."""
    return rank_rows(summary, order)


def first_per_group(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in the given order.

    Each limit is on a rank alone, which Spark also applies per task before the shuffle. A first
    round keeps the best ``n`` of every 64th of the tasks, so that the one task that settles a
    hot group gets few rows however many tasks fed it.
    """

    def best(rows: DataFrame, within: list[str]) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
        return rows.withColumn("_r", rank).filter(F.col("_r") <= n).drop("_r")

    pieces = df.withColumn("_piece", F.pmod(F.spark_partition_id(), F.lit(64)))
    return best(best(pieces, [*by, "_piece"]).drop("_piece"), by)


def cap_per_term(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most ``n`` listed records per group, with the true ``total`` beside them.

    The facts, which should be narrow, are written once and read for the list and the total, which
    covers all records.
    """
    df = stored(df, "facts")
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    return first_per_group(df, by, order, n).join(totals, by)


def top_k_with_total(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows, each with the number of all rows."""
    total = df.agg(F.count("*").alias("total")).scalar()
    return df.orderBy(*order).limit(k).withColumn("total", total)


def page(df: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + limit`` of the order, found by rank: no task holds the rows
    before them."""
    ranked = rank_rows(df, order)
    return ranked.filter((F.col("rank") > skip) & (F.col("rank") <= skip + limit)).orderBy("rank").drop("rank")


# -- one document per term --------------------------------------------------------------


def nested_result(terms: DataFrame, matches: DataFrame, devices: DataFrame, chunk: int = CHUNK_RECORDS) -> DataFrame:
    """All records, inferred matches and registry matches of every term, in chunks.

    ``matches(term, k_number, match_mode, confidence, via_k_number)`` give ``terms' columns,
    kind, chunk_no, total, match_mode, entries``: the entries of a term and kind by number,
    ``chunk`` to a row and all of them in some row, beside their ``total``. ``match_mode`` is the
    best label of the term's confirmed records, ``exact`` if it has none. An entry holds
    ``k_number, via_k_number, reason`` and the device's columns. A term without matches has one
    row of kind ``records`` without entries. Chunks go by rank, so that no task holds a term. Facts are
    dealt out by chunk while they are narrow, and devices that were measured to be few come to them.
    """
    kind = (
        F.when(F.col("confidence") == "confirmed", "records")
        .when(F.col("match_mode") == "predicate", "inferred")
        .when(F.col("match_mode") == "gudid", "registry")
    )
    few = fits_broadcast(devices)
    numbers = F.broadcast(devices.select("k_number")) if few else devices.select("k_number")
    known = matches.withColumn("kind", kind).filter(F.col("kind").isNotNull()).join(numbers, "k_number", "left_semi")
    facts = rank_rows(known.select("term", "kind", "k_number", "via_k_number", "match_mode"), ["term", "kind", "k_number"])
    rank, label = _best_label("match_mode")
    groups = facts.groupBy("term", "kind").agg(F.min("rank").alias("_first"), F.count("*").alias("total"))
    best = facts.filter("kind = 'records'").groupBy("term").agg(rank.alias("_label")).select("term", label.alias("_best"))
    placed = facts.join(groups, ["term", "kind"]).withColumn("chunk_no", F.floor((F.col("rank") - F.col("_first")) / chunk))
    device_cols = [c for c in devices.columns if c != "k_number"]
    entry = F.struct("k_number", "via_k_number", F.when(F.col("kind") == "inferred", "predicate").alias("reason"), *device_cols)
    dealt = placed.select("term", "kind", "chunk_no", "total", "k_number", "via_k_number")
    if few:
        dealt, devices = dealt.repartition("term", "kind", "chunk_no").sortWithinPartitions("term", "kind", "chunk_no"), F.broadcast(devices)
    chunks = attach_devices(dealt, devices).groupBy("term", "kind", "chunk_no").agg(
        F.first("total").alias("total"), F.sort_array(F.collect_list(entry)).alias("entries")
    )
    found = terms.join(chunks, "term").join(best, "term", "left")
    bare = terms.join(groups.select("term").distinct(), "term", "left_anti")
    zero = F.lit(0).cast("long")
    empty = F.array().cast(chunks.schema["entries"].dataType)
    return found.select(
        *terms.columns, "kind", "chunk_no", "total", F.coalesce("_best", F.lit("exact")).alias("match_mode"), "entries"
    ).unionByName(bare.select(
        *terms.columns, F.lit("records").alias("kind"), zero.alias("chunk_no"), zero.alias("total"),
        F.lit("exact").alias("match_mode"), empty.alias("entries"),
    ))


# -- all filters together ---------------------------------------------------------------


@dataclass(frozen=True)
class Filters:
    """The filters of a results page. Unset ones let everything pass."""

    panels: tuple[str, ...] = ()
    from_month: str | None = None
    to_month: str | None = None
    applicant: str | None = None
    show_only: tuple[str, ...] = ()
    exclude_panels: tuple[str, ...] = ()
    match_mode: str | None = None

    def passes(self) -> dict[str, Column]:
        """Per filter that is set, the test that a row shown must meet (null: it does not)."""
        tests: dict[str, Column] = {}
        if self.panels:
            tests["panels"] = _in_panels(list(self.panels))
        window = _in_window(self.from_month, self.to_month)
        if window:
            tests["dates"] = reduce(lambda a, b: a & b, window)
        if self.applicant is not None:
            tests["applicant"] = F.col("applicant") == self.applicant
        if self.show_only:
            tests["show_only"] = _names_one(list(self.show_only))
        if self.exclude_panels:
            tests["exclude_panels"] = _not_in_panels(list(self.exclude_panels))
        if self.match_mode is not None:
            tests["match_mode"] = F.col("match_mode") == self.match_mode
        return tests

    def apply(self, details: DataFrame) -> DataFrame:
        """Detail rows that pass all filters; summary and totals are worked out from these."""
        for test in self.passes().values():
            details = details.filter(test)
        return details

    def settings(self, spark: SparkSession) -> DataFrame:
        """One row ``(setting, value)`` per filter; what is unset is "All"."""
        rows = [(f.name, getattr(self, f.name)) for f in fields(self)]
        return spark.createDataFrame(
            [(n, "; ".join(x) if isinstance(x, tuple) and x else x if isinstance(x, str) else "All") for n, x in rows],
            "setting string, value string",
        )


# Menus of a results page: the column whose values a menu lists, and the filters set through it.
MENUS = {
    "applicant": ("applicant", {"applicant"}),
    "panel": ("panel", {"panels", "exclude_panels"}),
    "match_mode": ("match_mode", {"match_mode"}),
}


def facets_under_filters(details: DataFrame, filters: Filters, weight: Column | None = None) -> DataFrame:
    """Values for the filter menus while filters are set: ``facet, value, n, shown``.

    A menu counts the rows that pass all *other* filters, so that what its own filter hides can
    still be chosen; ``shown`` counts those that pass its own as well. Every row gets a mask of the
    filters it fails, and one pass with one map-side combined aggregate fills all menus. Values that
    the other filters hide entirely, and nulls, are not listed. ``weight`` is the number of facts a
    row stands for, one by default.
    """
    tests = filters.passes()
    bits = {name: 1 << i for i, name in enumerate(tests)}
    failed = reduce(
        lambda a, b: a + b,
        [F.when(F.coalesce(test, F.lit(False)), 0).otherwise(bits[name]) for name, test in tests.items()],
        F.lit(0),
    )
    rows = details.select(
        *[c for c, _ in MENUS.values()], (F.lit(1) if weight is None else weight).cast("long").alias("_n"), failed.alias("_failed")
    )
    listed = []
    for facet, (column, own) in MENUS.items():
        others = sum(bit for name, bit in bits.items() if name not in own)
        open_ = F.col("_failed").bitwiseAND(F.lit(others)) == 0
        listed.append(F.struct(F.lit(facet).alias("facet"), F.when(open_, F.col(column)).alias("value")))
    return (
        rows.select(F.inline(F.array(*listed)), "_n", "_failed")
        .filter(F.col("value").isNotNull())
        .groupBy("facet", "value")
        .agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_failed") == 0, F.col("_n")).otherwise(0)).alias("shown"))
    )


# Sort orders by the names they have on screen.
FEWEST_APPROVALS, MOST_RECENT = "Fewest approvals", "Most recent approval"


def sort_orders() -> dict[str, list[Column]]:
    return {FEWEST_APPROVALS: fewest_approvals(), MOST_RECENT: most_recent()}


def search_info(terms: DataFrame, filters: Filters, order: str, at: str) -> DataFrame:
    """``(setting, value)``, how an export came about: when, the sort order, the state of every filter,
    and a row for each biomarker that was searched."""
    when = terms.sparkSession.createDataFrame([("searched_at", at), ("sort_order", order)], "setting string, value string")
    asked = terms.select(F.lit("biomarker").alias("setting"), F.col("term").alias("value"))
    return when.unionByName(filters.settings(terms.sparkSession)).unionByName(asked)


def report(terms: DataFrame, details: DataFrame, unconfirmed: DataFrame, filters: Filters, order: str, at: str) -> dict[str, DataFrame]:
    """The tables of an export, all under the same filters and in the order named (one of
    :func:`sort_orders`); ``at`` is the time of the search as it is to be shown.

    ``details`` are confirmed facts with device columns, ``unconfirmed`` inferred ones.
    """
    shown = stored(filters.apply(details), "shown")  # three tables are worked out from it
    # The match mode filter is about confirmed matches; inferred ones have modes of their own.
    inferred = replace(filters, match_mode=None).apply(unconfirmed)
    return {
        "search_info": search_info(terms, filters, order, at),
        "summary": rank_terms(summarise(terms, shown), sort_orders()[order]),
        "biomarker_applicants": biomarker_applicants(terms, shown),
        "details": record_rows(shown),
        "unconfirmed_matches": unconfirmed_matches(inferred),
    }
