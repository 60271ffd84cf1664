"""A corpus made ready for training: five stages, each over all that the one before kept.

1. ``toxicity``: documents that the toxicity model scores at 0.3 or more go.
2. ``language``: documents without a letter, or odd for every learned language, go.
3. ``near_dedup``: of each class of near-copies, linked by SimHash as in op2 or at a Jaccard similarity
   of 0.8 or more of their five-word shingles, the document of smallest id stays.
4. ``decontamination``: documents that hold a window of a benchmark item go.
5. ``packing``: the rest is packed into sequences.

All but the last return the columns of ``documents``. A stage's result is written as Parquet to
the shared folder and reread as the next one's input.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import langid, minhash, packing, toxicity, winnowing
from marketlens.llm.queries import table, tokenizer
from marketlens.session import broadcast_if_small, ship_package, stored

TOXIC_FROM = 0.3
READ = ("doc_id", "text", "lang")


def filtering(stage):
    """A stage that sees columns it does not read under neutral names, so that none clashes with
    its own, and returns the given columns in their order."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        aside = [c if c in READ else f"__{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*aside), sf_dir).select(aside).toDF(*docs.columns)

    return run_stage


@filtering
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below ``TOXIC_FROM``; a null or empty text has score 0."""
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.scored(docs, toxicity.train(rows), out="__score")
    return scored.filter(F.col("__score") < TOXIC_FROM)


@filtering
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: with a letter, and not odd beyond the model's
    limit. If no document has a language, none was learned and all that have a letter stay."""
    models = langid.train(docs)
    if not models.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = langid.identified(docs, models)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_odd") <= langid.MOST_ODD)
    return found.filter(known)


@filtering
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class the rows of its smallest id, one of them if the id is repeated. Rows
    without an id have no name to stay under: one stays if its class has no other."""
    classes = stored(minhash.near_copies(docs, fingerprints=True), "classes")
    leave = stored(classes.filter("component_id <> doc_id").select("doc_id").distinct(), "leave")
    kept = docs.filter("doc_id IS NOT NULL").join(broadcast_if_small(leave), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    if not repeated.isEmpty():
        twice = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(repeated, "doc_id", "left_anti").union(twice).select(docs.columns)
    nameless = docs.filter("doc_id IS NULL")
    if not nameless.isEmpty():
        lone = classes.filter("component_id IS NULL").select(F.col("fp").alias("__fp")).distinct()
        own = minhash.named(nameless, keep_text=True).withColumnRenamed("fp", "__fp")
        kept = kept.union(own.join(lone, "__fp", "left_semi").dropDuplicates(["__fp"]).select(docs.columns))
    return kept


@filtering
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a word inside a window of a benchmark item."""
    found = winnowing.contamination(docs, table(spark, sf_dir, "benchmark"), keep_text=True)
    return found.filter("n_hit = 0")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    ship_package(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
