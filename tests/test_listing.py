from pyspark.sql import functions as F

from marketlens.functions.listing_html import read_listing
from marketlens.operators import listing as ls

PAGE = """<html><div class="view__header"><h3>Displaying 1 - 2 of <b>1,234</b> Records</h3></div>
<div class="field--name-field-analyte-name"><div class="field__item">outside</div></div>
<div class="x views-row y"><h2 class="clep-approved-ltd__name">Quest &amp; <i>Sons</i><br></h2>
 <div class="field--name-field-analyte-name"><span>Analyte</span><div class="field__item">CENP-B
   IgG</div><div class="field__item"> two</div></div>
 <div class="field--name-field-ltd-status"><div class="field__item">Conditionally Approved</div></div>
 <a href="/no">x</a><span class="print"><a class="b" href="/node/1?a=1&amp;b=2">Print</a></span></div>
<div class="views-row"><h2 class="clep-approved-ltd__name">B</h2><span class="print"><a href='http://x/y'>P</a></span></div>
</html>"""


def test_reader():
    header, rows = read_listing(PAGE)
    assert header == "Displaying 1 - 2 of 1,234 Records"
    assert [r["facilityName"] for r in rows] == ["Quest &amp; Sons", "B"]
    assert rows[0]["detailLink"] == "/node/1?a=1&amp;b=2" and rows[0]["method"] == ""
    assert read_listing(None) == ("", [])


def test_extract(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u2", "<p>nothing</p>"), ("u3", None), ("u4", "<div class='views-row'></div>")], "url string, html string")
    got = {(r["url"], r["row_no"]): r for r in ls.extract_listing_rows(pages).collect()}
    assert set(got) == {("u1", 0), ("u1", 1), ("u4", 0)}
    first = got["u1", 0]
    assert (first["analyte"], first["status"], first["total"]) == ("CENP-B IgG two", "Conditionally Approved", 1234)
    assert first["detailLink"] == "https://www.wadsworth.org/node/1?a=1&amp;b=2"
    assert got["u1", 1]["detailLink"] == "http://x/y" and got["u4", 0]["total"] == 1


def test_search_counts_a_row_once(spark):
    rows = spark.createDataFrame([(1, "CENP-B antibody"), (2, "other"), (3, None)], "id int, analyte string")
    terms = spark.createDataFrame([("Anti-CENP-B IgG",), ("zzz",)], "term string")
    assert [(r["term"], r["id"]) for r in ls.search_listing(terms, rows).collect()] == [("Anti-CENP-B IgG", 1)]


def test_crosscheck(spark):
    summary = spark.createDataFrame([("CENP-B", 0), ("zzz", 0), ("other", 3)], "term string, cleared_count int")
    rows = spark.createDataFrame([(1, "CENP-B antibody"), (2, "other")], "id int, analyte string")
    got = {(r["term"], r["id"], r["found"]) for r in ls.zero_clearance_crosscheck(summary, rows).collect()}
    assert got == {("CENP-B", 1, True), ("zzz", None, False)}


def test_status(spark):
    rows = spark.createDataFrame([("Approved",), ("Conditionally Approved",)], "status string")
    assert ls.filter_status(rows).count() == 2
    assert [r[0] for r in ls.filter_status(rows, "approved").collect()] == ["Approved"]
    assert [r[0] for r in ls.filter_status(rows, "conditionally_approved").collect()] == ["Conditionally Approved"]


def test_totals(spark):
    df = spark.createDataFrame([("1 - 50 of 1,234 Records",), ("of 1 record",), ("none",)], "h string")
    assert [r[0] for r in df.select(ls.parse_total(F.col("h"), F.lit(7))).collect()] == [1234, 1, 7]


def test_report_from_word_lists_equals_all_pairs(spark):
    vocabulary = ["hot", *[f"w{i}" for i in range(30)]]
    rows = spark.range(4000).select(
        F.col("id"), (F.col("id") % 7).alias("x"),
        F.concat_ws(" ", F.when(F.col("id") % 3 > 0, "Hot"), *[F.element_at(F.array(*[F.lit(w) for w in vocabulary]), (F.abs(F.xxhash64("id", F.lit(i))) % 31 + 1).cast("int")) for i in range(2)]).alias("analyte"),
    ).unionByName(spark.createDataFrame([(9001, 1, None), (9002, 1, ""), (9003, 0, "w1 w1")], "id long, x long, analyte string"))
    terms = spark.createDataFrame([("hot",), ("w1 hot w2",), ("Anti-w3 IgG",), ("w4-w5",), ("nowhere",), ("w1 hot w2",), ("",)], "term string")
    hits = ls.search_listing(terms.distinct(), rows)
    want = ls.listing_report(hits, 20, ["x", "id"]).select("term", "id", "total")
    got = ls.search_report(terms, rows.repartition(9), 20, ["x", "id"])
    assert got.columns == ["term", "id", "x", "analyte", "total"]
    assert sorted(map(tuple, got.select("term", "id", "total").collect())) == sorted(map(tuple, want.collect()))
    assert {r["term"] for r in got.collect()} == {"hot", "w1 hot w2", "Anti-w3 IgG", "w4-w5"}


def test_report_joins_no_more_than_lists(spark):
    """Every row holds the word of every term: what is joined stays words x k a term."""
    rows = spark.range(20_000).select("id", F.concat(F.lit("common word"), F.col("id") % 5).alias("analyte"))
    terms = spark.range(50).select(F.concat(F.lit("common extra"), "id").alias("term"))
    got = ls.search_report(terms, rows, 10, ["id"])
    assert {(r["term"], r["total"], r["n"]) for r in got.groupBy("term", "total").agg(F.count("*").alias("n")).collect()} == {(f"common extra{i}", 20_000, 10) for i in range(50)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString() or "window" in plan.lower()


def test_report_of_empty_tables(spark):
    rows = spark.createDataFrame([], "id int, analyte string")
    terms = spark.createDataFrame([("CENP-B",)], "term string")
    assert ls.search_report(terms, rows, 5, ["id"]).count() == 0
    assert ls.search_report(terms.limit(0), spark.createDataFrame([(1, "CENP")], rows.schema), 5, ["id"]).count() == 0
