"""Scans with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.operators.market import PANELS_IN_SCOPE
from marketlens.operators.store import latest_wins

CLEARANCE_SCHEMA = """
    k_number string, device_name string, statement_or_summary string,
    openfda struct<device_name: string>,
    applicant string, decision_description string, decision_date string,
    advisory_committee string, advisory_committee_description string, product_code string
"""
REGISTRY_SCHEMA = """
    device_description string, brand_name string,
    product_codes array<struct<name: string, openfda: struct<device_name: string>>>,
    gmdn_terms array<struct<name: string, definition: string>>,
    premarket_submissions array<struct<submission_number: string>>
"""
DOCUMENT_SCHEMA = "k_number string, full_text string, fetch_error string"
PAGE_SCHEMA = "page_id bigint, url string, html string"
REPLY_SCHEMA = "term_key string, engine string, ordinal int, search_type string, status int, body string"


def _fields(schema: str) -> str:
    return " ".join(schema.split())


def _scan(spark: SparkSession, path, schema: str, fmt: str, envelope: bool) -> DataFrame:
    reader = spark.read
    if not envelope:
        return reader.schema(_fields(schema)).format(fmt).load(path)
    item = spark.createDataFrame([], _fields(schema)).schema.simpleString()
    wrapped = reader.schema(f"results array<{item}>").option("multiLine", True).json(path)
    return wrapped.select(F.inline("results"))


def spread(scan: DataFrame) -> DataFrame:
    """Spread a scan that has fewer splits than the cluster has cores.

    A large table comes in many splits and is returned as it is. Only a scan too small to
    occupy the cluster is dealt out, so that costly row-local work runs on all cores.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def scan_clearances(spark: SparkSession, path, fmt: str = "json", envelope: bool = True) -> DataFrame:
    """Clearance records from saved result pages, JSON lines or parquet.

    ``openfda.device_name`` may be a string or a list; the list arrives as JSON text and
    is opened by :func:`device_columns`.
    """
    return _scan(spark, path, CLEARANCE_SCHEMA, fmt, envelope)


def scan_registry(spark: SparkSession, path, fmt: str = "json", envelope: bool = True) -> DataFrame:
    return _scan(spark, path, REGISTRY_SCHEMA, fmt, envelope)


def scan_document_text(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    """Decision-summary text, one row per device.

    ``fmt="text"`` reads one file per device, named after its number.
    """
    if fmt != "text":
        return spark.read.schema(DOCUMENT_SCHEMA).format(fmt).load(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^((?:K|DEN)\d{6})", 1)
    return spark.read.text(path, wholetext=True).select(
        number.alias("k_number"), F.col("value").alias("full_text"), F.lit(None).cast("string").alias("fetch_error")
    )


def scan_listing_pages(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).format(fmt).load(path)


def scan_resolver_replies(spark: SparkSession, path, fmt: str = "json") -> DataFrame:
    return spark.read.schema(REPLY_SCHEMA).format(fmt).load(path)


def device_columns(records: DataFrame) -> DataFrame:
    """Clearance records in the columns the matcher and the market table use."""
    return records.select(
        "k_number",
        "device_name",
        "statement_or_summary",
        tx.name_values(F.col("openfda.device_name")).alias("openfda_device_names"),
        "applicant",
        "decision_description",
        tx.parse_date(F.col("decision_date")).alias("decision_date"),
        F.col("advisory_committee").alias("panel"),
        "product_code",
    )


def scope_corpus(clearances: DataFrame, panels: list[str] = PANELS_IN_SCOPE,
                 column: str = "advisory_committee") -> DataFrame:
    """Records of the given panels, one per number; the copy of the last panel wins."""
    kept = clearances.filter(F.col(column).isin(*panels) & F.col("k_number").isNotNull())
    rank = F.array_position(F.array(*[F.lit(p) for p in panels]), F.col(column))
    return latest_wins(kept, ["k_number"], [rank])


def parse_term_list(df: DataFrame, column: str) -> DataFrame:
    """Free text into terms: split at line breaks and commas, trimmed, blanks dropped.

    The other columns stay; ``ordinal`` is the place in the text, counted over the terms.
    """
    parts = F.array_remove(F.transform(F.split(F.col(column), r"[\r\n,]"), tx.strip_ws), "")
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(parts).alias("ordinal", "term"))


def term_keys(terms: DataFrame, term: Column | None = None) -> DataFrame:
    return terms.withColumn("term_key", tx.expansion_key(F.col("term") if term is None else term))
