import glob

import pytest
from pyspark.sql import functions as F

from marketlens.operators import pages


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    """1,050 rows in blocks of 100; two key columns, the first with ties and nulls."""
    path = str(tmp_path_factory.mktemp("pages") / "listing")
    df = spark.range(1050).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 13).alias("a"), F.format_string("k%05d", "id").alias("k"), (F.col("id") * 2).alias("x"))
    pages.lay_out(df.repartition(7), ["a", "k"], path, block=100)
    rows = sorted(((r.a, r.k) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    return path, rows


def got(df):
    return [(r.a, r.k) for r in df.collect()]


@pytest.mark.parametrize("skip,limit", [(0, 100), (95, 10), (250, 333), (1000, 100), (1050, 5), (9000, 5), (40, 0)])
def test_pages_by_rank(spark, listing, skip, limit):
    path, rows = listing
    found = pages.page_at(spark, path, skip, limit)
    assert found.columns == ["a", "k", "x", "rank"] and got(found) == rows[skip : skip + limit]


@pytest.mark.parametrize("limit", [7, 100, 260])
def test_following_the_cursor_gives_every_row_once(spark, listing, limit):
    path, rows = listing
    seen, after = [], None
    for _ in range(6):
        found = got(pages.page_after(spark, path, after, limit))
        seen += found
        after = found[-1] if found else after
    assert seen == rows[: 6 * limit]


def test_cursor_that_is_no_key(spark, listing):
    path, rows = listing
    after = (5, "k00300x")
    assert got(pages.page_after(spark, path, after, 50)) == [r for r in rows if r[0] is not None and r > after][:50]
    assert got(pages.page_after(spark, path, (99, ""), 50)) == []
    assert got(pages.page_after(spark, path, (None, ""), 3)) == rows[:3]
    with pytest.raises(ValueError):
        pages.page_after(spark, path, (1,), 5)


def test_a_late_page_reads_its_own_files_only(spark, tmp_path):
    path = str(tmp_path / "listing")
    pages.lay_out(spark.range(1000).select(F.col("id").alias("k")).repartition(5), ["k"], path, block=100)
    for file in glob.glob(f"{path}/rows/block=*/*.parquet"):
        if "block=8" not in file and "block=9" not in file:
            with open(file, "wb") as out:
                out.write(b"not to be read")
    schema = "k long, rank long, block long"
    rows = spark.read.schema(schema)
    assert [r.k for r in pages.page_at(spark, path, 820, 30).collect()] == list(range(820, 850))
    assert [r.k for r in pages.page_after(spark, path, (849,), 30).collect()] == list(range(850, 880))
    with pytest.raises(Exception):
        rows.parquet(f"{path}/rows").filter("block = 7").collect()


def test_empty_listing(spark, tmp_path):
    path = str(tmp_path / "none")
    pages.lay_out(spark.range(0).select(F.col("id").alias("k")), ["k"], path)
    assert pages.page_at(spark, path, 0).count() == 0 and pages.page_after(spark, path, (3,)).count() == 0
