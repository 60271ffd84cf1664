import pytest
from pyspark.sql import functions as F

from marketlens.operators import commits as cm
from marketlens.operators import lookup as lk
from marketlens.sources import scans as sc
from marketlens.streaming import refresh as rf
from tests.test_lookup import REGISTRY
from tests.test_streaming import TEXT


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stores_move_on_together(spark, tmp_path):
    base, frame = str(tmp_path), lambda *x: spark.createDataFrame([(i,) for i in x], "k int")
    assert cm.state(spark, base).number == 0 and cm.state(spark, base).read(spark, "a") is None
    first = cm.Change(spark, base)
    first.put("a", frame(1))
    first.append("b", frame(10))
    assert cm.state(spark, base).number == 0
    first.commit()
    second = cm.Change(spark, base)
    second.put("a", second.read("a").union(frame(2)))  # worked out from the store itself
    second.append("b", frame(11))
    rival = cm.Change(spark, base)
    rival.put("a", frame(99))
    assert second.commit().number == 2
    with pytest.raises(cm.Conflict):
        rival.commit()
    last = cm.state(spark, base)
    assert (rows(last.read(spark, "a")), rows(last.read(spark, "b"))) == ([(1,), (2,)], [(10,), (11,)])
    assert rows(cm.state(spark, base, 1).read(spark, "a")) == [(1,)]
    gone = cm.clean(spark, base, keep=1)
    assert len(gone) == 2 and rows(cm.state(spark, base).read(spark, "b")) == [(10,), (11,)]
    with pytest.raises(FileNotFoundError):
        cm.state(spark, base, 1)


class Killed(Exception):
    pass


def _kill_at(monkeypatch, step):
    """The job dies after its ``step``-th folder is written, or at the last before its manifest is."""
    done, written, placed = [], cm.Change._written, cm._put_in_place

    def dying(self, store, df, *by):
        folder = written(self, store, df, *by)
        done.append(store)
        if len(done) == step:
            raise Killed
        return folder

    def never(*args):
        raise Killed

    monkeypatch.setattr(cm.Change, "_written", dying)
    if step == 0:
        monkeypatch.setattr(cm, "_put_in_place", never)
    return lambda: (monkeypatch.setattr(cm.Change, "_written", written), monkeypatch.setattr(cm, "_put_in_place", placed))


def _records(spark, ids):
    made = [(f"K{i:06d}", f"device {i}", "s", None, "Acme", "Substantially Equivalent", "2001-01-02", "CH", "Chemistry", "X") for i in ids]
    df = spark.createDataFrame(made, "k_number string, device_name string, statement_or_summary string, openfda struct<device_name:string>, "
                               "applicant string, decision_description string, decision_date string, advisory_committee string, advisory_committee_description string, product_code string")
    return df


def _contents(spark, base):
    last = cm.state(spark, base)
    return {s: rows(last.read(spark, s).drop("raw_json")) for s in ("devices", "documents", "citations")}


@pytest.mark.parametrize("step", [1, 2, 3, 0])
def test_refresh_killed_anywhere_and_run_again(spark, tmp_path, monkeypatch, step):
    landed = spark.createDataFrame([("K000001", TEXT.format("psa", 9), None), ("K000002", TEXT.format("rf", 7), None)], sc.DOCUMENT_SCHEMA)
    later = landed.union(spark.createDataFrame([("K000003", TEXT.format("tsh", 5), None)], sc.DOCUMENT_SCHEMA))
    bases = [str(tmp_path / x) for x in ("calm", "killed")]
    rf.refresh_all(_records(spark, [1, 2]), landed, bases[1], ["k_number"], panels=["CH"])
    before = _contents(spark, bases[1])
    assert [e[:2] for e in before["citations"]] == [("K000001", "K000009"), ("K000002", "K000007")]
    again = _kill_at(monkeypatch, step)
    with pytest.raises(Killed):
        rf.refresh_all(_records(spark, [1, 2, 3]), later, bases[1], ["k_number"], panels=["CH"])
    again()
    assert _contents(spark, bases[1]) == before
    for base in bases:
        rf.refresh_all(_records(spark, [1, 2, 3]), later, base, ["k_number"], panels=["CH"])
    assert _contents(spark, bases[0]) == _contents(spark, bases[1]) != before
    cm.clean(spark, bases[1], keep=1)
    assert _contents(spark, bases[0]) == _contents(spark, bases[1])


def test_first_write_of_a_store_that_failed(spark, tmp_path):
    (tmp_path / "s" / "version=1").mkdir(parents=True)
    frame = spark.createDataFrame([("a", 1)], "k string, v int")
    assert rows(rf.fold_version(str(tmp_path / "s"), frame, ["k"], ["v"])) == [("a", 1)]


@pytest.fixture
def searched(spark, devices, tmp_path):
    registry = spark.createDataFrame([], REGISTRY)
    edges = spark.createDataFrame([("DEN140001", "K900003")], "device_k string, predicate_k string")
    shown = ["k_number", "device_name", "applicant", "decision_date"]
    none = {"model": spark.createDataFrame([], "term_key string, ordinal int, status int, body string"),
            "terminology": spark.createDataFrame([], "term_key string, search_type string, status int, body string")}

    def ask(names, day, refresh=False, model=None):
        asked = spark.createDataFrame(list(enumerate(names)), "term_id int, term string")
        base = str(tmp_path / "base")
        made, found = lk.answer_published(asked, base, shown, devices.drop("panel"), registry, edges, model if model is not None else none["model"],
                                          none["terminology"], F.lit(day), refresh)
        answers = sorted((r.term, r.kind, sorted(e.k_number for e in r.entries)) for r in found.collect())
        marks = {r.term_key: r.searched_at for r in cm.state(spark, base).read(spark, "searched").collect()}
        return made.number, answers, marks

    return ask


def test_searches_are_kept_and_refreshed(spark, searched, monkeypatch):
    number, first, marks = searched(["GAD65", "nothing"], "d1")
    assert number == 1 and marks == {"gad65": "d1", "nothing": "d1"} and first == [(0, "records", ["K900002"]), (1, "records", [])]
    assert searched(["nothing", "GAD65"], "d2")[0] == 1  # answered from the stores, nothing to commit
    reply = spark.createDataFrame([("nothing", 1, 200, "probe ablation")], "term_key string, ordinal int, status int, body string")
    assert searched(["nothing"], "d3", model=reply)[1] == [(0, "records", [])]  # the negative answer is kept
    again = _kill_at(monkeypatch, 3)
    with pytest.raises(Killed):
        searched(["nothing", "PSA"], "d4", refresh=True, model=reply)
    again()
    assert searched(["nothing"], "d5")[1:] == ([(0, "records", [])], {"gad65": "d1", "nothing": "d1"})
    number, answers, marks = searched(["nothing", "PSA"], "d6", refresh=True, model=reply)
    assert number == 2 and marks == {"gad65": "d1", "nothing": "d6", "psa": "d6"}
    assert answers == [(0, "inferred", ["DEN140001"]), (0, "records", ["K900003"]), (1, "records", [])]
    assert searched(["nothing"], "d7")[1] == [(0, "inferred", ["DEN140001"]), (0, "records", ["K900003"])]
