import glob
import os
import random

import pytest

from marketlens.operators import buckets as bk
from marketlens.operators.commits import Conflict, Change, clean, state

SCHEMA = "k string, part long, text string"


def put(spark, base, rows):
    return bk.upsert(spark, base, "docs", spark.createDataFrame(rows, SCHEMA), ["k", "part"], ["text"])


def held(spark, at):
    return {(r.k, r.part): r.text for r in bk.read(spark, at, "docs", ["k", "part"]).collect()}


def size(base):
    return sum(os.path.getsize(f) for f in glob.glob(f"{base}/docs/**/*.parquet", recursive=True))


def of(spark, k, part=0):
    return spark.createDataFrame([(k, part)], "k string, part long").select(bk._bucket(["k", "part"])).first()[0]


def test_upserts_equal_a_dictionary(spark, tmp_path):
    base, draw, want, before = str(tmp_path / "base"), random.Random(4), {}, {}
    assert bk.read(spark, state(spark, base), "docs", ["k", "part"]) is None
    for step in range(6):
        rows = [(f"k{draw.randrange(60)}", draw.randrange(2), f"{step} {draw.randrange(9)}") for _ in range(40)] + [(None, 1, "lost"), ("lost", None, "x")]
        at = put(spark, base, rows)
        for k, part, text in rows:
            if k is not None and part is not None:
                now = want.get((k, part), "")
                want[k, part] = max(now, text) if now.startswith(f"{step} ") else text
        if step == 3:
            full = bk.compact(spark, base, "docs", ["k", "part"], deltas=2)
            deltas = bk.deltas_of(spark, state(spark, base), "docs")
            assert full and all(len(deltas[b]) == 1 for b in full) and len(full) < len(deltas)
            before = dict(want), state(spark, base)
        assert held(spark, state(spark, base)) == want
    assert held(spark, before[1]) == before[0]  # earlier states stay as they were
    bk.compact(spark, base, "docs", ["k", "part"], deltas=0)
    clean(spark, base, keep=1)
    assert held(spark, state(spark, base)) == want and len(glob.glob(f"{base}/docs/*")) == 1
    assert at.number == 7


def test_bytes_written_follow_the_updates(spark, tmp_path):
    base = str(tmp_path / "base")
    draw = random.Random(1)
    put(spark, base, [(f"k{i}", 0, "".join(draw.choice("abcdefghij") for _ in range(500))) for i in range(4000)])
    whole = size(base)
    put(spark, base, [("k7", 0, "new"), ("k8", 0, "new")])
    assert size(base) - whole < whole / 100
    new = glob.glob(f"{base}/docs/2-*/bucket=*")
    assert {int(f.split("=")[1]) for f in new} == {of(spark, "k7"), of(spark, "k8")}
    seen = size(base)
    assert set(bk.compact(spark, base, "docs", ["k", "part"], deltas=1)) == {of(spark, "k7"), of(spark, "k8")}
    assert size(base) - seen < whole * 3 / bk.BUCKETS
    assert held(spark, state(spark, base))["k7", 0] == "new" and len(held(spark, state(spark, base))) == 4000


def test_lookup_opens_its_buckets_only(spark, tmp_path):
    base = str(tmp_path / "base")
    put(spark, base, [(f"k{i}", 0, "old") for i in range(500)])
    at = put(spark, base, [("k3", 0, "new")])
    for file in glob.glob(f"{base}/docs/*/bucket=*/*.parquet"):
        if f"bucket={of(spark, 'k3')}/" not in file:
            with open(file, "wb") as out:
                out.write(b"not to be read")
    asked = spark.createDataFrame([("k3", 0), (None, 0)], "k string, part long")
    assert [tuple(r) for r in bk.lookup(spark, at, "docs", ["k", "part"], asked).collect()] == [("k3", 0, "new")]
    with pytest.raises(Exception):
        held(spark, at)


def test_missing_keys(spark, tmp_path):
    base = str(tmp_path / "base")
    asked = spark.createDataFrame([("a", 0), ("b", 0), ("b", 0)], "k string, part long")
    assert {r.k for r in bk.missing(spark, state(spark, base), "docs", ["k", "part"], asked).collect()} == {"a", "b"}
    at = put(spark, base, [("a", 0, "x")])
    assert [r.k for r in bk.missing(spark, at, "docs", ["k", "part"], asked).collect()] == ["b"]


def test_two_changes_at_once_and_nothing_to_do(spark, tmp_path):
    base = str(tmp_path / "base")
    put(spark, base, [("a", 0, "x")])
    late = Change(spark, base)
    put(spark, base, [("a", 0, "y")])
    late.append("docs", late.read("docs"), by=bk.BUCKET)
    with pytest.raises(Conflict):
        late.commit()
    at = put(spark, base, [])
    assert held(spark, at) == {("a", 0): "y"} and bk.compact(spark, base, "docs", ["k", "part"]) == []
