"""Keyed tables: latest copy wins, upserts, replacement, served/new split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.functions import text as tx
from marketlens.session import broadcast_if_small, folders, stored


def latest_wins(df: DataFrame, keys: list[str], order: list[str | Column], narrow: bool = False) -> DataFrame:
    """One row per key: the greatest by ``order``, which says what "latest" means.

    Rows with a null in their key name nothing and are dropped; for all stores this is the place
    where that is decided. Equal rows by ``order`` are settled by a hash of the row, so that runs
    agree. The winner is found on keys, order and a row number alone, in a partial aggregate: a
    key that holds a third of all rows never meets in one task, and texts are neither sorted nor
    aggregated but read once more for the rows that won. ``narrow`` says that rows are a few short
    values: these go through the partial aggregate whole, and nothing is written. Both ways give
    the same rows.
    """
    if not order:
        raise ValueError("say by which columns a copy is later than another")
    named = df.dropna(subset=keys)
    if narrow:
        by = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
        last = F.max_by(F.struct(*df.columns), F.struct(*by, F.xxhash64(*df.columns))).alias("_last")
        return named.groupBy(*keys).agg(last).select("_last.*")
    placed = stored(named.withColumn("_row", F.monotonically_increasing_id()), "copies")
    ranked = [(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]
    last = F.max(F.struct(*ranked, F.xxhash64(*df.columns).alias("_h"), "_row")).alias("_last")
    best = stored(placed.groupBy(*keys).agg(last).select("_last._row"), "winners")  # measured and joined, so worked out once
    return placed.join(broadcast_if_small(best), "_row", "left_semi").select(*df.columns)


def distinct_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def upsert(existing: DataFrame, updates: DataFrame, keys: list[str],
           order: list[str | Column], narrow: bool = False) -> DataFrame:
    """Insert or replace by key; every column of a replaced row is overwritten.

    ``order`` settles copies of a key among the updates; its columns may be ones that the store
    does not have.

    ``existing`` is already unique by key, so it is only anti-joined, never regrouped:
    when the updates are measured to be small, the stored table is not shuffled at all.
    The reduced updates are used for the measure, the join and the result, and are
    therefore worked out once. ``narrow`` as for :func:`latest_wins`.
    """
    new = stored(latest_wins(updates, keys, order, narrow).select(*existing.columns), "updates")
    kept = existing.join(broadcast_if_small(new.select(*keys)), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(new)


def device_rows(records: DataFrame, source: str) -> DataFrame:
    """Clearance records in the columns of the device store, tagged with their source."""
    tagged = records.withColumn("source", F.lit(source))
    return tagged.select(
        "k_number",
        "source",
        "device_name",
        tx.join_names(F.col("openfda.device_name")).alias("openfda_device_name"),
        "applicant",
        "decision_description",
        "decision_date",
        "advisory_committee",
        "advisory_committee_description",
        "product_code",
        tx.pack_record(*tagged.columns).alias("raw_json"),
    )


def upsert_devices(existing: DataFrame, updates: DataFrame, order: list[str | Column]) -> DataFrame:
    return upsert(existing, updates, ["k_number"], order)


def upsert_document_text(existing: DataFrame, updates: DataFrame, order: list[str | Column]) -> DataFrame:
    """Failed documents are rows too, with ``fetch_error`` set."""
    return upsert(existing, updates, ["k_number"], order)


def upsert_citations(existing: DataFrame, updates: DataFrame, order: list[str | Column]) -> DataFrame:
    """Edges that a document no longer names stay in place."""
    return upsert(existing, updates, ["device_k", "predicate_k"], order, narrow=True)


def upsert_expansions(cache: DataFrame, updates: DataFrame, order: list[str | Column]) -> DataFrame:
    """Negative answers (``source = 'none'``) are kept like any other."""
    return upsert(cache, updates, ["term_key"], order, narrow=True)


def mark_searched(searched: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    marks = keys.select("term_key").distinct().withColumn("searched_at", at)
    return upsert(searched, marks, ["term_key"], ["searched_at"], narrow=True)


def replace_matches(store: DataFrame, matches: DataFrame, searched_keys: DataFrame) -> DataFrame:
    """Drop every stored match of the searched keys and put the new ones in.

    ``searched_keys(biomarker_key)`` also lists keys whose new result is empty.
    """
    gone = broadcast_if_small(stored(searched_keys.select("biomarker_key").distinct(), "searched"))
    kept = store.join(gone, "biomarker_key", "left_anti").select(*store.columns)
    fresh = latest_wins(
        matches.select(*store.columns), ["k_number", "biomarker_key", "match_mode"], ["confidence", "via_k_number"], narrow=True
    )
    return kept.unionByName(fresh.select(*store.columns))


def split_cached(terms: DataFrame, searched: DataFrame, refresh: bool = False):
    """``(cached, new)``: terms to serve from the store and terms to search now."""
    if refresh:
        return terms.filter(F.lit(False)), terms
    done = searched.select("term_key").distinct()
    return terms.join(done, "term_key", "left_semi"), terms.join(done, "term_key", "left_anti")


def pending_documents(devices: DataFrame, documents: DataFrame, panels: list[str],
                      retry_errors: bool = False) -> DataFrame:
    """In-scope devices without a document row; failed ones count as done by default."""
    done = documents.filter(F.col("fetch_error").isNull()) if retry_errors else documents
    wanted = devices.filter(F.col("advisory_committee").isin(*panels))
    if "source" in devices.columns:
        wanted = wanted.filter(F.col("source") == "510k")
    return wanted.select("k_number").join(done.select("k_number"), "k_number", "left_anti")


def corpus_coverage(devices: DataFrame, documents: DataFrame) -> DataFrame:
    """Per panel: devices in scope, documents done, still to do, failed, with a measurand."""
    d = documents.select(
        "k_number",
        F.col("fetch_error").isNotNull().alias("failed"),
        F.col("measurand_value").isNotNull().alias("measured"),
        F.lit(True).alias("done"),
    )
    return (
        devices.select("k_number", "advisory_committee")
        .join(d, "k_number", "left")
        .groupBy("advisory_committee")
        .agg(
            F.count("*").alias("in_scope"),
            F.count_if(F.col("done")).alias("fetched"),
            F.count_if(F.col("done").isNull()).alias("to_fetch"),
            F.count_if(F.col("failed")).alias("errors"),
            F.count_if(F.col("measured")).alias("with_measurand"),
        )
    )


# -- published versions -----------------------------------------------------------------

_VERSION = "version="


def publish(df: DataFrame, store: str) -> int:
    """Write the next version of a store and return its number.

    Versions are folders of their own, so a frame that was worked out from the store, an upsert
    for instance, can be published to it. A version counts once Spark has marked it complete; a
    failed write leaves an unmarked folder, which readers pass over and no one writes to again.
    """
    number = max((int(f[len(_VERSION):]) for f in folders(df.sparkSession, store) if f.startswith(_VERSION)), default=0) + 1
    df.write.parquet(f"{store}/{_VERSION}{number}")
    return number


def complete_versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the versions of a store that were written to their end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    numbers = sorted(int(f[len(_VERSION):]) for f in folders(spark, store) if f.startswith(_VERSION))
    marks = [(n, path(f"{store}/{_VERSION}{n}/_SUCCESS")) for n in numbers]
    return [n for n, mark in marks if mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)]


def published(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """A version of a store, by default the last complete one."""
    numbers = complete_versions(spark, store)
    if not numbers or version is not None and version not in numbers:
        raise FileNotFoundError(f"no complete version in {store}")
    return spark.read.parquet(f"{store}/{_VERSION}{numbers[-1] if version is None else version}")
