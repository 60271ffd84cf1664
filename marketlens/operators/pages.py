"""Pages of a long listing: sorted once into blocks of ranks, then read block by block."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketlens.operators.market import PAGE_SIZE, rank_rows

BLOCK_ROWS = 1_000_000


def lay_out(df: DataFrame, order: list[str], path: str, block: int = BLOCK_ROWS) -> None:
    """Write the rows sorted by the ascending columns ``order`` to a new folder, with their ``rank``.

    A folder holds the rows of ``block`` ranks, so a reader opens the folders of its page alone.
    Beside them lies the first key of every block, one row for ``block`` rows of the listing.
    Rows with the same key have ranks of their own; a cursor by key needs unique keys.
    """
    ranked = rank_rows(df, order).withColumn("block", F.floor((F.col("rank") - 1) / block))
    # Parts of the sort are runs of ranks, so each writes to few folders and nothing is shuffled again.
    ranked.write.partitionBy("block").parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(ranked.schema).parquet(f"{path}/rows")
    rows.groupBy("block").agg(F.min_by(F.struct(*order), "rank").alias("first")).write.parquet(f"{path}/blocks")
    # Said once, so that readers need not open files of other pages to know the columns.
    about = [(block, order, ranked.schema.json())]
    df.sparkSession.createDataFrame(about, "size long, by array<string>, columns string").write.parquet(f"{path}/about")


def _rows(spark: SparkSession, path: str, about: Row) -> DataFrame:
    schema = StructType.fromJson(json.loads(about["columns"]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _between(low: int, high: int) -> Column:
    return (F.col("block") >= low) & (F.col("block") <= high)


def page_at(spark: SparkSession, path: str, skip: int, limit: int = PAGE_SIZE) -> DataFrame:
    """Rows ``skip + 1`` to ``skip + limit``, with their ``rank``; past the end there are none."""
    about = spark.read.parquet(f"{path}/about").first()
    last = max(skip, skip + limit - 1) // about["size"]
    found = _rows(spark, path, about).filter(_between(skip // about["size"], last))
    return found.filter((F.col("rank") > skip) & (F.col("rank") <= skip + limit)).orderBy("rank").drop("block")


def page_after(spark: SparkSession, path: str, after: tuple | None, limit: int = PAGE_SIZE) -> DataFrame:
    """The ``limit`` rows that follow the key ``after`` (None: the first ones), with their ``rank``.

    The key need not be in the listing. The block where it would stand is found from the blocks' first
    keys, and no block before it is read, nor one after the page can end. In keys, as in the sort,
    null comes first.
    """
    about = spark.read.parquet(f"{path}/about").first()
    if after is None:
        return page_at(spark, path, 0, limit)
    order = about["by"]
    if len(after) != len(order):
        raise ValueError(f"a cursor has the values of {order}")
    rows = _rows(spark, path, about)
    cursor = F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for x, c in zip(after, order)])
    blocks = spark.read.parquet(f"{path}/blocks").filter(F.col("first") <= cursor)
    low = blocks.agg(F.max("block").alias("b")).first()["b"] or 0
    found = rows.filter(_between(low, low + -(-limit // about["size"])))
    return found.filter(F.struct(*order) > cursor).orderBy("rank").limit(limit).drop("block")
