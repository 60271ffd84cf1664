"""Export of a search: several tables written together under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHEETS = ["search_info", "summary", "biomarker_applicants", "details", "unconfirmed_matches"]
LISTING_SHEETS = ["lab_test_summary", "lab_test_details"]


def listing_tables(terms: DataFrame, hits: DataFrame) -> dict[str, DataFrame]:
    """The two tables of a listing search: tests and laboratories per term, and all rows.

    ``hits(term, facilityName, ...)``; a term without any keeps a row of zeros."""
    counts = hits.groupBy("term").agg(F.count("*").alias("tests"), F.count_distinct("facilityName").alias("facilities"))
    zero = F.lit(0).cast("long")
    summary = terms.select("term").join(counts, "term", "left").select(
        "term", F.coalesce("tests", zero).alias("tests"), F.coalesce("facilities", zero).alias("facilities"))
    return dict(zip(LISTING_SHEETS, (summary, hits)))


def _flat(df: DataFrame, fmt: str) -> DataFrame:
    """CSV has no arrays: lists of names become one text."""
    if fmt != "csv":
        return df
    return df.select(
        *[F.array_join(f.name, "; ").alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
          for f in df.schema.fields]
    )


def export_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet",
                  ranked_by: dict[str, str] | None = None) -> dict[str, str]:
    """Write each table to ``path/<name>`` and return the folders.

    Tables named in ``ranked_by`` are range-partitioned and sorted by that column, so file
    order is the order on screen; all others keep their partitions.
    """
    written = {}
    for name, df in tables.items():
        out = _flat(df, fmt)
        rank = (ranked_by or {}).get(name)
        if rank:
            out = out.repartitionByRange(F.col(rank)).sortWithinPartitions(rank)
        target = f"{path.rstrip('/')}/{name}"
        writer = out.write.mode("overwrite")
        (writer.option("header", True).csv(target) if fmt == "csv" else writer.format(fmt).save(target))
        written[name] = target
    return written
