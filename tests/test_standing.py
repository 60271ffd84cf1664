import random

import pytest

from marketlens.operators import commits as cm
from marketlens.operators import matching as m
from marketlens.operators import standing as sd
from marketlens.streaming import refresh as rf
from tests.test_index import SCHEMA, lines, records

TERMS = "term_id int, term string, full string, search string"
NAMES = ["Anti-GAD IgG", "gad", "a b", "Anti-a", "DS DNA", "kit IgG", "of c", "-", "Anti-absent"]
KEEP = ["term_id", "k_number", "match_mode", "tiers"]


def terms(spark, ids):
    return spark.createDataFrame([(i, NAMES[i], None if i % 2 else "gad of / a antibody", None) for i in ids], TERMS)


def full(spark, ids, rows):
    return lines(m.match_terms(terms(spark, ids), spark.createDataFrame(rows, SCHEMA)).select(KEEP))


def now(spark, base):
    return lines(sd.matches(spark, cm.state(spark, base)).select(KEEP))


def test_batches_equal_one_search(spark, tmp_path):
    draw, base, held = random.Random(6), str(tmp_path), []
    sd.watch(spark, base, terms(spark, range(5)))
    for step in range(3):  # later batches replace some records of earlier ones
        batch = records(draw, 25, first=20 * step)
        sd.fold(spark, base, spark.createDataFrame(batch, SCHEMA).repartition(2))
        again = {k for k, *_ in batch} - {None}
        held = [r for r in held if r[0] not in again] + batch
        if step == 1:
            sd.watch(spark, base, terms(spark, range(5, len(NAMES))))
            assert now(spark, base) == full(spark, range(len(NAMES)), held)
    sd.watch(spark, base, spark.createDataFrame([(1, "kit", None, None)], TERMS))  # asked otherwise now
    sd.forget(spark, base, spark.createDataFrame([(0,), (99,)], "term_id int"))
    asked = terms(spark, [i for i in range(len(NAMES)) if i > 1]).unionByName(spark.createDataFrame([(1, "kit", None, None)], TERMS))
    want = lines(m.match_terms(asked, spark.createDataFrame(held, SCHEMA)).select(KEEP))
    assert now(spark, base) == want and len(want) > 40
    sd.compact(spark, base)
    sd.fold(spark, base, spark.createDataFrame([("K0", "gad", None, None)], SCHEMA))
    held = [r for r in held if r[0] != "K0"] + [("K0", "gad", None, None)]
    assert now(spark, base) == lines(m.match_terms(asked, spark.createDataFrame(held, SCHEMA)).select(KEEP))


def test_a_nearer_tier_takes_over_and_gives_back(spark, tmp_path):
    base = str(tmp_path)
    sd.watch(spark, base, spark.createDataFrame([(1, "Anti-GAD", None, None), (2, "kit", None, None)], TERMS))
    loose = sd.fold(spark, base, spark.createDataFrame([("K1", "gad antibody", None, None), ("K9", "kit", None, None)], SCHEMA))
    assert [r[2] for r in sd.matches(spark, loose).filter("term_id = 1").select(KEEP).collect()] == ["broad"]
    exact = sd.fold(spark, base, spark.createDataFrame([("K2", "anti gad", None, None)], SCHEMA))
    found = sd.matches(spark, exact).filter("term_id = 1")
    assert {r["match_mode"] for r in found.collect()} == {"exact"} and "K2" in {r["k_number"] for r in found.collect()}
    news = {tuple(r) for r in sd.changed(spark, base, loose.number).collect()}
    assert (1, "K2", None, "exact") in news and all(r[0] == 1 for r in news)
    back = sd.fold(spark, base, spark.createDataFrame([("K2", "nothing", None, None)], SCHEMA))
    assert [tuple(r)[:3] for r in sd.matches(spark, back).filter("term_id = 1").select(KEEP).collect()] == [(1, "K1", "broad")]
    gone = {tuple(r) for r in sd.changed(spark, base, exact.number).collect()}
    assert (1, "K2", "exact", None) in gone
    assert sd.changed(spark, base, loose.number).count() == 0  # as it was then


def test_changes_carry_one_state_into_another(spark, tmp_path):
    draw, base = random.Random(8), str(tmp_path)
    sd.watch(spark, base, terms(spark, range(6)))
    numbers = [cm.state(spark, base).number]
    for step in range(2):
        sd.fold(spark, base, spark.createDataFrame(records(draw, 20, first=10 * step), SCHEMA))
        numbers.append(cm.state(spark, base).number)
    sd.watch(spark, base, terms(spark, [6, 7, 8]))
    sd.forget(spark, base, spark.createDataFrame([(2,)], "term_id int"))
    last = {(r[0], r[1]): r[2] for r in sd.matches(spark, cm.state(spark, base)).collect()}
    for number in numbers:
        news = sd.changed(spark, base, number).collect()
        at = {} if number == numbers[0] else {(r[0], r[1]): r[2] for r in sd.matches(spark, cm.state(spark, base, number)).collect()}
        for r in news:
            key = (r["term_id"], r["k_number"])
            assert at.get(key) == r["was"]
            at.pop(key, None)
            if r["now"] is not None:
                at[key] = r["now"]
        assert at == last


def test_streamed_batches_once_each(spark, tmp_path):
    base, rows = str(tmp_path / "base"), records(random.Random(9), 40)
    spark.createDataFrame(rows, SCHEMA).repartition(3, "k_number").write.parquet(f"{tmp_path}/landed")
    sd.watch(spark, base, terms(spark, range(len(NAMES))))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/landed")
    rf.follow(stream(), base, f"{tmp_path}/progress").awaitTermination()
    assert now(spark, base) == full(spark, range(len(NAMES)), rows)
    state = cm.state(spark, base)
    name = state.read(spark, "batches").first()["batch"]
    again = sd.fold(spark, base, spark.createDataFrame(rows[:3], SCHEMA), name)  # a retry after its commit
    assert again.number == state.number
    rf.follow(stream(), base, f"{tmp_path}/progress").awaitTermination()
    assert cm.state(spark, base).number == state.number


def test_killed_before_its_commit(spark, tmp_path, monkeypatch):
    base, rows = str(tmp_path), records(random.Random(10), 20)
    sd.watch(spark, base, terms(spark, range(4)))
    with monkeypatch.context() as patch:
        patch.setattr(cm.Change, "commit", lambda self: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            sd.fold(spark, base, spark.createDataFrame(rows, SCHEMA), "b")
    with pytest.raises(LookupError):
        sd.matches(spark, cm.state(spark, base))
    sd.fold(spark, base, spark.createDataFrame(rows, SCHEMA), "b")
    assert now(spark, base) == full(spark, range(4), rows)


def test_empty_batches_and_terms(spark, tmp_path):
    base = str(tmp_path)
    sd.fold(spark, base, spark.createDataFrame([], SCHEMA))
    sd.watch(spark, base, spark.createDataFrame([(1, "-", None, None), (None, "gad", None, None)], TERMS))
    sd.fold(spark, base, spark.createDataFrame([(None, "gad", None, None), ("K1", None, None, None)], SCHEMA))
    assert sd.matches(spark, cm.state(spark, base)).count() == 0
    sd.watch(spark, base, spark.createDataFrame([(2, "gad", None, None)], TERMS))
    assert [tuple(r)[:2] for r in sd.matches(spark, cm.state(spark, base)).select(KEEP).collect()] == [(2, None)]


def test_a_batch_of_one_file_is_searched_on_all_cores(spark, tmp_path, devices, terms, monkeypatch):

    base, split, satisfied = str(tmp_path / "s"), [], m.satisfied_clauses

    def seen(corpus, *args, **kwargs):
        split.append(corpus.rdd.getNumPartitions())
        return satisfied(corpus, *args, **kwargs)

    monkeypatch.setattr(m, "satisfied_clauses", seen)
    sd.watch(spark, base, terms)
    sd.fold(spark, base, devices.coalesce(1))
    assert split == [spark.sparkContext.defaultParallelism]


def test_kept_masks_are_not_grouped_again(spark, tmp_path, devices, terms):
    """a key lives in one commit, so only masks of records without a key are united anew, and the
    few voided keys come to the masks."""
    base = str(tmp_path / "s")
    sd.watch(spark, base, terms)
    sd.fold(spark, base, devices.limit(3))
    at = sd.fold(spark, base, devices.limit(1).unionByName(devices.selectExpr("null AS k_number", *[f"{c}" for c in devices.columns if c != "k_number"])))
    found = sd.masks(spark, at)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(term_id") == 1 and "SortMergeJoin" not in plan and "isnull(k_number" in plan
    rows = found.collect()
    assert len({(r["term_id"], r["k_number"]) for r in rows}) == len(rows) > 0
