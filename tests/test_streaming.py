import pytest

from marketlens.sources import scans as sc
from marketlens.streaming import refresh as rf

TEXT = "B Measurand: {0} C Other Thing\nPredicate 510(k) Number(s):\nK{1:06d} - Pred"


def land(spark, path, rows):
    spark.createDataFrame(rows, sc.DOCUMENT_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_documents_are_mined_once(spark, tmp_path):
    base = str(tmp_path)
    args = (f"{base}/text", f"{base}/edges", f"{base}/progress")

    def run():
        stream = rf.with_arrival(spark.readStream.schema(sc.DOCUMENT_SCHEMA).parquet(f"{base}/landed"))
        rf.refresh_corpus(stream, *args).awaitTermination()
        return rf.read_store(spark, args[0], ["k_number"]), rf.read_store(spark, args[1], ["device_k", "predicate_k"])

    land(spark, f"{base}/landed", [("K000001", TEXT.format("psa", 9), None), ("K000002", None, "404")])
    text, edges = run()
    assert {r["k_number"]: r["measurand_value"] for r in text.collect()} == {"K000001": "psa", "K000002": None}
    land(spark, f"{base}/landed", [("K000001", TEXT.format("changed", 8), None), ("K000003", TEXT.format("rf", 7), None)])
    text, edges = run()
    assert {r["k_number"]: r["measurand_value"] for r in text.collect()} == {"K000001": "psa", "K000002": None, "K000003": "rf"}
    assert {(r["device_k"], r["predicate_k"]) for r in edges.collect()} == {("K000001", "K000009"), ("K000003", "K000007")}


def test_batches_are_idempotent_and_compact(spark, tmp_path):
    store = str(tmp_path / "s")
    first = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int")
    second = spark.createDataFrame([("a", 2)], "k string, v int")
    for _ in range(2):
        rf.write_batch(first, store, "r1", 0)
        rf.write_batch(second, store, "r1", 1)
    want = [("a", 2), ("b", 5)]
    assert sorted(tuple(r) for r in rf.read_store(spark, store, ["k"]).collect()) == want
    rf.compact(spark, store, str(tmp_path / "c"), ["k"])
    assert sorted(tuple(r) for r in rf.read_store(spark, str(tmp_path / "c"), ["k"]).collect()) == want


def fold(spark, base, rows, store, checkpoint):
    spark.createDataFrame(rows, "k string, at int").coalesce(1).write.mode("append").parquet(f"{base}/in-{checkpoint}")
    stream = spark.readStream.schema("k string, at int").parquet(f"{base}/in-{checkpoint}")
    rf.refresh_store(stream, store, f"{base}/{checkpoint}", ["k"], ["at"]).awaitTermination()
    return sorted(tuple(r) for r in rf.read_store(spark, store, ["k"], ["at"]).collect())


def test_new_checkpoint_after_compaction_or_loss_keeps_all(spark, tmp_path):
    base, old, new = str(tmp_path), str(tmp_path / "old"), str(tmp_path / "new")
    assert fold(spark, base, [("a", 1), ("b", 1)], old, "one") == [("a", 1), ("b", 1)]
    rf.compact(spark, old, new, ["k"], ["at"])
    assert fold(spark, base, [("c", 1)], new, "two") == [("a", 1), ("b", 1), ("c", 1)]
    assert fold(spark, base, [("b", 2)], new, "two") == [("a", 1), ("b", 2), ("c", 1)]
    assert fold(spark, base, [("d", 1), ("b", 1)], new, "lost") == [("a", 1), ("b", 2), ("c", 1), ("d", 1)]
    with pytest.raises(FileExistsError):
        rf.compact(spark, old, new, ["k"], ["at"])


def test_retried_batch_replaces_itself_alone(spark, tmp_path):
    store, frame = str(tmp_path / "s"), lambda *rows: spark.createDataFrame(rows, "k string, at int")
    rf.write_batch(frame(("a", 1)), store, "r1", 0)
    rf.write_batch(frame(("x", 1)), store, "r2", 0)
    rf.write_batch(frame(("a", 7)), store, "r1", 0)
    assert sorted(tuple(r) for r in rf.read_store(spark, store, ["k"]).collect()) == [("a", 7), ("x", 1)]


def test_a_broken_store_is_not_an_empty_one(spark, tmp_path):
    folder = tmp_path / "s" / "generation=1" / "run=r" / "batch=0"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        rf._copies(spark, str(tmp_path / "s")).count()
    assert rf._copies(spark, str(tmp_path / "none")) is None
