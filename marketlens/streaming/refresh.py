"""Incremental refresh: new files are mined once and folded into the stores.

Stores are append-only parquet folders, ``generation=g/run=r/batch=b``. A run is a stream with
its checkpoint; its generation is one above all that the store held when the run first wrote. A
retried batch overwrites its own folder and no other; a new checkpoint, also one made after the
old was lost, is a new run and so a later generation, as is a compaction. Readers take the
latest copy of a key. One run writes to a store at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marketlens.operators import standing as sd
from marketlens.operators import store as st
from marketlens.operators.commits import Change
from marketlens.operators.documents import citation_edges, mine_documents
from marketlens.operators.market import PANELS_IN_SCOPE
from marketlens.operators.store import latest_wins
from marketlens.session import broadcast_if_small, folders, stored
from marketlens.sources.scans import scope_corpus

GENERATION, RUN, BATCH = "generation", "run", "batch"
PLACE = [GENERATION, RUN, BATCH]
COMPACTION = "compaction"
ARRIVED = "arrived"


def with_arrival(stream: DataFrame) -> DataFrame:
    """A stream of files with the time its file arrived, which says which copy is the last."""
    return stream.withColumn(ARRIVED, F.col("_metadata.file_modification_time"))


def _generations(spark: SparkSession, store: str) -> dict[int, list[str]]:
    """Generations of a store and the runs that wrote them."""
    found = {}
    for name in folders(spark, store):
        if name.startswith(f"{GENERATION}="):
            runs = folders(spark, f"{store}/{name}")
            found[int(name.split("=")[1])] = [r.split("=", 1)[1] for r in runs if r.startswith(f"{RUN}=")]
    return found


def _copies(spark: SparkSession, store: str) -> DataFrame | None:
    """All copies in a store, or None before its first batch."""
    return spark.read.parquet(store) if _generations(spark, store) else None


def batch_folder(spark: SparkSession, store: str, run: str, batch_id: int) -> str:
    """The folder of a batch: the run's generation, or a new one if the run has none yet."""
    known = _generations(spark, store)
    generation = next((g for g, runs in known.items() if run in runs), max(known, default=0) + 1)
    return f"{store}/{GENERATION}={generation}/{RUN}={run}/{BATCH}={batch_id}"


def write_batch(df: DataFrame, store: str, run: str, batch_id: int) -> str:
    path = batch_folder(df.sparkSession, store, run, batch_id)
    df.write.mode("overwrite").parquet(path)
    return path


def read_store(spark: SparkSession, store: str, keys: list[str], order: list[str | Column] | None = None) -> DataFrame:
    """Current state of a store: the latest copy per key, by ``order`` if given and then by
    generation and batch."""
    copies = spark.read.parquet(store)
    return latest_wins(copies, keys, [*(order or []), GENERATION, BATCH]).drop(*PLACE)


def compact(spark: SparkSession, store: str, target: str, keys: list[str],
            order: list[str | Column] | None = None) -> None:
    """Fold a store into one copy per key in a new folder; streams may go on into that folder."""
    if folders(spark, target):
        raise FileExistsError(f"{target} holds a store already")
    write_batch(read_store(spark, store, keys, order), target, COMPACTION, 0)


def _run_of(batch: DataFrame) -> str:
    """The stream that hands out this batch; its id lives in the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def refresh_store(stream: DataFrame, store: str, checkpoint: str, keys: list[str],
                  order: list[str | Column]) -> StreamingQuery:
    """Upsert a stream of rows into a store, until the input is used up."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        write_batch(latest_wins(batch, keys, order), store, _run_of(batch), batch_id)

    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_corpus(documents: DataFrame, text_store: str, citation_store: str, checkpoint: str,
                   order: list[str | Column] = (ARRIVED,)) -> StreamingQuery:
    """Mine newly arrived documents and skip those already in the text store.

    ``documents(k_number, full_text, fetch_error)`` is a stream of landed texts, by default one
    :func:`with_arrival`; of copies in one batch the latest by ``order`` is mined.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        spark, run = batch.sparkSession, _run_of(batch)
        new = latest_wins(batch, ["k_number"], list(order))
        copies = _copies(spark, text_store)
        if copies is not None:
            own = (F.col(RUN) == run) & (F.col(BATCH) == batch_id)
            done = copies.filter(~own).select("k_number")
            # The batch is the small side: reduce the store to its numbers first.
            done = done.join(broadcast_if_small(new.select("k_number")), "k_number", "left_semi")
            new = new.join(done, "k_number", "left_anti")
        path = write_batch(mine_documents(new.drop(ARRIVED)), text_store, run, batch_id)
        # Edges come from the stored result, so documents are parsed once.
        write_batch(citation_edges(spark.read.parquet(path)), citation_store, run, batch_id)

    return (
        documents.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def follow(records: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Let a stream of records meet the standing searches in ``base``, until the input is used up.
    A batch goes by its stream's name and number, so that a retried one is not folded again."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        sd.fold(batch.sparkSession, base, batch, f"{_run_of(batch)}/{batch_id}")

    return (
        records.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def fold_version(store: str, updates: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Upsert into a published store, or begin it, and return the new version. A store whose first
    write failed has no complete version and is begun."""
    spark = updates.sparkSession
    if st.complete_versions(spark, store):
        st.publish(st.upsert(st.published(spark, store), updates, keys, order), store)
    else:
        st.publish(latest_wins(updates, keys, order), store)
    return st.published(spark, store)


def _folded(change: Change, store: str, updates: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    held = change.read(store)
    return change.put(store, latest_wins(updates, keys, order) if held is None else st.upsert(held, updates, keys, order))


def refresh_all(records: DataFrame, landed: DataFrame, base: str, order: list[str | Column],
                panels: list[str] = PANELS_IN_SCOPE, retry_errors: bool = False) -> DataFrame:
    """The whole refresh as one job: devices in scope, documents still to do, what is mined from
    them, and how far the corpus is covered.

    ``records`` are clearance records, ``landed(k_number, full_text, fetch_error, ...)`` the texts
    at hand, of which the latest by ``order`` counts. The stores ``devices``, ``documents`` and
    ``citations`` in ``base`` go on in one commit, so a document is never marked done without its
    citations. Documents mined before are not read again; failed ones only if asked for.
    """
    spark = records.sparkSession
    change = Change(spark, base)
    devices = _folded(change, "devices", st.device_rows(scope_corpus(records, panels), "510k"), ["k_number"], ["source"])
    known = change.read("documents")
    if known is None:
        known = landed.select("k_number", "fetch_error").limit(0)
    todo = st.pending_documents(devices, known, panels, retry_errors)
    new = latest_wins(landed.join(broadcast_if_small(stored(todo, "todo")), "k_number", "left_semi"), ["k_number"], order)
    mined = stored(mine_documents(new), "mined")
    documents = _folded(change, "documents", mined, ["k_number"], ["k_number"])
    _folded(change, "citations", citation_edges(mined), ["device_k", "predicate_k"], ["predicate_name"])
    change.commit()
    return st.corpus_coverage(devices, documents)
