import pytest
from pyspark.sql import functions as F

from marketlens.functions import text as tx


def values(spark, items, expr):
    df = spark.createDataFrame(list(enumerate(items)), "i int, t string")
    rows = df.select("i", expr(F.col("t")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_greek_letters_but_not_the_micro_sign(spark):
    assert values(spark, ["β2-GP1", "Αβγδκλμ", "µg"], tx.greek_to_latin) == [
        "beta2-GP1", "Alphabetagammadeltakappalambdamu", "µg"]


@pytest.mark.parametrize("term,mode,antigen,fused", [
    ("Anti-GAD65 IgG", "explicit", "GAD65", "AntiGAD65"),
    ("GAD IgG4", "implied", "GAD", "AntiGAD"),
    ("Anti-Cardiolipin", "explicit", "Cardiolipin", "AntiCardiolipin"),
    ("PSA", "none", "PSA", None),
    ("X IgD", "none", "X IgD", None),
    ("anti A/B", "explicit", "A/B", None),
    ("antinuclear", "none", "antinuclear", None),
    ("anti -", "explicit", "", None),
])
def test_modes_antigens_fused(spark, term, mode, antigen, fused):
    assert values(spark, [term], tx.anti_requirement_mode) == [mode]
    assert values(spark, [term], tx.antigen_of) == [antigen]
    assert values(spark, [term], tx.fused_anti) == [fused]


def test_variants(spark):
    assert values(spark, ["dsDNA", "CENP-B", "a b", "RF", "HbA1c", "x  y-z"], tx.orthographic_variants) == [
        ["ds DNA"], ["CENP B", "CENPB"], ["a-b", "ab"], [], ["Hb A1c"], ["x  y z", "x-y-z", "xyz"]]


def test_expansion_key_keeps_greek(spark):
    assert values(spark, ["Anti-X IgG", "X", "β2", " Anti-X "], tx.expansion_key) == ["x", "x", "β2", "anti-x"]


def test_groups(spark):
    got = values(spark, ["Full name/anti (x), y/ /antibody/antiDNA"], tx.expansion_groups)
    assert got == [[["Full", "name"], ["x", "y"], ["antiDNA"]]]
    got = values(spark, ["a b/A  B/(c)/anti/"], tx.registry_token_groups)
    assert got == [[["a", "b"], ["(c)"], ["anti"]]]


def test_normal_form(spark):
    assert values(spark, ["CENP-B, Ünïts", "--", ""], tx.padded) == [" cenp b ünïts ", " ", " "]
    df = spark.createDataFrame([(["Gad", "Islet antibody"],)], "v array<string>")
    text = df.select(tx.padded_values(F.col("v")).alias("t"))
    row = text.select(
        tx.contains_phrase(F.col("t"), F.lit(" islet antibody ")).alias("a"),
        tx.contains_phrase(F.col("t"), F.lit(" gad islet ")).alias("b"),
        tx.contains_phrase(F.col("t"), F.lit(" ")).alias("c"),
        tx.contains_phrase(F.lit(None).cast("string"), F.lit(" a ")).alias("d"),
    ).first()
    assert tuple(row) == (True, False, False, False)


def test_names_dates_numbers(spark):
    assert values(spark, ['["a","b"]', "plain", "[not json", None], tx.join_names) == ["a; b", "plain", "[not json", ""]
    assert [str(x) for x in values(spark, ["2004-09-01", "bad-date", None], tx.parse_date)] == ["2004-09-01", "None", "None"]
    assert values(spark, ["K123456", "DEN123456", "k123456", "K1234567", None], tx.valid_device_number) == [
        True, True, False, False, False]


def test_any_word(spark):
    df = spark.createDataFrame([("CENP-B antibody", "cenp x"), ("a", "b"), (None, "b")], "a string, b string")
    assert [r[0] for r in df.select(tx.contains_any_word(F.col("a"), F.col("b"))).collect()] == [True, False, False]
