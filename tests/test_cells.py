import datetime
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import cells, market as mk

FILTERS = [
    mk.Filters(),
    mk.Filters(panels=("IM", "CH"), from_month="2003-02", to_month="2009-11"),
    mk.Filters(applicant="company 3", exclude_panels=("IM",)),
    mk.Filters(show_only=("t1", "COMPANY 7"), match_mode="exact", to_month="2008-12"),
    mk.Filters(panels=("nowhere",)),
]


@pytest.fixture(scope="module")
def details(spark):
    draw = random.Random(3)
    rows = []
    for i in range(3000):
        term = "t0" if i % 3 == 0 else f"t{draw.randrange(12)}"
        day = None if i % 41 == 0 else datetime.date(2000, 1, 1) + datetime.timedelta(days=draw.randrange(4000))
        rows.append((
            term, f"K{i:06d}", None if i % 29 == 0 else f"company {draw.randrange(40)}",
            draw.choice(["Substantially Equivalent", "Substantially Equivalent - Kit", "Denied", None]), day,
            draw.choice(["IM", "CH", "SU", None]), draw.choice(["exact", "broad", "wordform", None]),
        ))
    schema = "term string, k_number string, applicant string, decision_description string, decision_date date, panel string, match_mode string"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([(f"t{i}",) for i in range(14)], "term string")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("filters", FILTERS)
def test_totals_from_cells_equal_totals_from_facts(details, terms, filters):
    plain = mk.summarise(terms, filters.apply(details).drop("match_mode"))
    assert rows(cells.summarise(terms, cells.cells(details), filters).select(plain.columns)) == rows(plain)


def test_cells_merge(details, terms):
    old, new = details.filter("k_number < 'K001000'"), details.filter("k_number >= 'K001000'")
    whole = cells.cells(details)
    assert rows(cells.merged(cells.cells(old), cells.cells(new)).select(whole.columns)) == rows(whole)
    one = cells.summarise(terms, cells.sketched(whole))
    two = cells.summarise(terms, cells.merged(cells.sketched(cells.cells(old)), cells.sketched(cells.cells(new))))
    assert rows(one) == rows(two.select(one.columns))


def test_sketches_estimate_within_their_error(spark, terms):
    many = spark.range(60_000).select(
        F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("term"), F.concat(F.lit("K"), "id").alias("k_number"),
        F.concat(F.lit("c"), (F.col("id") % 30_011).cast("string")).alias("applicant"),
        F.lit("Denied").alias("decision_description"), F.expr("date_add(DATE '2001-01-01', int(id % 900))").alias("decision_date"),
        F.lit("IM").alias("panel"), F.lit("exact").alias("match_mode"),
    )
    kept = cells.cells(many)
    right = {r.term: r for r in cells.summarise(terms, kept).collect()}
    for r in cells.summarise(terms, cells.sketched(kept)).collect():
        assert r.total_submissions == right[r.term].total_submissions
        assert abs(r.unique_applicants - right[r.term].unique_applicants) <= 4 * cells.SKETCH_ERROR * right[r.term].unique_applicants
    with pytest.raises(ValueError):
        cells.summarise(terms, cells.sketched(kept), mk.Filters(applicant="c1"))


def one_menu(details, filters, facet):
    """The plain way: a query for each menu, without the menu's own filters."""
    column, own = mk.MENUS[facet]
    found = details
    for name, test in filters.passes().items():
        if name not in own:
            found = found.filter(test)
    n = {r[0]: r[1] for r in found.groupBy(column).count().collect() if r[0] is not None}
    shown = {r[0]: r[1] for r in filters.apply(details).groupBy(column).count().collect()}
    return {(facet, v, k, shown.get(v, 0)) for v, k in n.items()}


@pytest.mark.parametrize("filters", FILTERS)
def test_menus_equal_one_query_each(details, filters):
    want = set().union(*[one_menu(details, filters, facet) for facet in mk.MENUS])
    assert {tuple(r) for r in mk.facets_under_filters(details, filters).collect()} == want
    assert {tuple(r) for r in cells.menus(cells.cells(details), filters).collect()} == want


def test_menus_take_one_pass(details):
    plan = mk.facets_under_filters(details, FILTERS[1])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("InMemoryTableScan") == 1


def test_empty(details, terms):
    none = details.limit(0)
    assert cells.menus(cells.cells(none), FILTERS[1]).count() == 0
    assert {r.total_submissions for r in cells.summarise(terms, cells.cells(none), FILTERS[1]).collect()} == {0}
