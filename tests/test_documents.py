from pyspark.sql import functions as F

from marketlens.functions import documents as dc
from marketlens.operators import documents as docs

TEMPLATES = {
    "A": ("A Predicate Device Names and 510(k) numbers\nPredicate Name 510(k) Number\nFoo Assay K111111\nBar Assay DEN140001\nB Comparison\nLate K999999",
          [("Foo Assay", "K111111"), ("Bar Assay", "DEN140001")]),
    "B": ("1. Predicate device name(s):\nFoo\nBar\n2. Predicate 510(k) number(s):\nK111111\nK222222\n3. Comparison",
          [("Foo", "K111111"), ("Bar", "K222222")]),
    "B short": ("1. Predicate device name(s):\nFoo\nBar\n2. Predicate 510k number:\nK111111\n3. C", [("Foo", "K111111")]),
    "C": ("Predicate 510(k) Number(s):\r\nK111111 - Foo\r\nB Comparison\r\nK222222 - No", [("Foo", "K111111")]),
    "D": ("Predicate device name (Predicate 510(k) number):\x0bFoo (K111111)\x1cC Other", [("Foo", "K111111")]),
    "rows far below the header": ("Predicate Device Name and 510\nnoise\nmore\n Foo  K111111 \n\nBar K222222\nend\nLate K333333",
                                  [("Foo", "K111111"), ("Bar", "K222222")]),
    "first line kept": ("Predicate 510(k) Number:\nA Bcd\nK111111 - Foo", [("Foo", "K111111")]),
    "none": ("No table here", []),
    "header only": ("Predicate Device Names and 510(k) numbers", []),
}


def test_templates(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in TEMPLATES.items()], "k string, t string")
    rows = df.withColumn("ls", dc.citation_lines(F.col("t"))).select("k", dc.extract_citations(F.col("ls")).alias("c")).collect()
    got = {r["k"]: [(c["name"], c["k_number"]) for c in r["c"]] for r in rows}
    assert got == {k: e for k, (_, e) in TEMPLATES.items()}


def test_line_breaks(spark):
    text = "a\nb\r\nc\rd\x0be\x0cf\x1cg\x1dh\x1ei\x85j k l \n  \n"
    row = spark.createDataFrame([(text,)], "t string").select(dc.text_lines(F.col("t")).alias("l")).first()
    assert row["l"] == [ln.strip() for ln in text.splitlines() if ln.strip()]


def test_measurand(spark):
    cases = {
        "x B Measurand: Anti-GAD65 antibodies in human serum C Type of Test: Quant": ("Measurand", "Anti-GAD65 antibodies in human serum"),
        "C. Measurand:\n Troponin I": ("Measurand", "Troponin I"),
        "the measurand: x": None,
        "B Measurand: " + "y" * 500: None,
        "D Analyte: HbA1c E Other thing": ("Analyte", "HbA1c"),
        "C Manufacturer D Type of Test or Tests Performed: WBC, RBC": ("Type of Test or Tests Performed", "WBC, RBC"),
        "A Analytes: a B Measurands: b": ("Measurand", "b"),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    rows = df.select("i", dc.extract_measurand(F.col("t")).alias("m")).orderBy("i").collect()
    assert [tuple(r["m"]) if r["m"] else None for r in rows] == list(cases.values())


def test_addresses(spark):
    df = spark.createDataFrame([("K961234",), ("K011234",), ("K051061",), ("DEN140001",), ("K251234",), ("X",)], "k string")
    rows = df.select(dc.document_year_folder(F.col("k")).alias("f"), dc.candidate_document_urls(F.col("k")).alias("u")).collect()
    assert [r["f"] for r in rows][:5] == ["", "", "5", "14", "25"]
    assert rows[2]["u"][1].endswith("/cdrh_docs/pdf5/K051061.pdf") and rows[5]["u"] is None


def test_pick_document(spark):
    log = spark.createDataFrame(
        [("a", 1, "u1", 404, None), ("a", 2, "u2", 200, "application/PDF"), ("b", 1, "u1", 200, "text/html"),
         ("b", 2, "u2", 404, None), ("c", 1, "u1", 200, "x/pdf"), ("c", 2, "u2", 200, "x/pdf")],
        "k_number string, ordinal int, url string, status int, content_type string")
    got = {r["k_number"]: (r["source_url"], r["fetch_error"]) for r in docs.pick_document(log).collect()}
    assert got == {"a": ("u2", None), "b": (None, "no decision document found (last status: 404)"), "c": ("u1", None)}


def test_repeated_edge_keeps_last_name(spark):
    text = "Predicate Device Names and 510(k)\nOld K111111\nNew K111111\nOther K222222"
    mined = docs.mine_documents(spark.createDataFrame([("K1", text)], "k_number string, full_text string"))
    got = sorted(tuple(r) for r in docs.citation_edges(mined).collect())
    assert got == [("K1", "K111111", "New"), ("K1", "K222222", "Other")]


def test_verdict(spark):
    details = spark.createDataFrame(
        [(1, "Anti-GAD65", "K1", None, None), (2, "PSA", "K1", "x", "zzz/human antibodies"), (3, "PSA", "K1", None, None), (4, "PSA", "K2", None, None)],
        "term_id int, term string, k_number string, full string, search string")
    d = spark.createDataFrame([("K1", "GAD65 antibodies in human serum")], "k_number string, measurand_value string")
    got = {r["term_id"]: r["verdict"] for r in docs.measurand_verdict(details, d).collect()}
    assert got == {1: "Matches", 2: "Matches", 3: "No match", 4: None}
