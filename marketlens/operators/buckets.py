"""Keyed stores in fixed buckets: a change writes and rewrites only the buckets its keys fall into.

A bucket is a hash of the key and a folder of its own in every delta. An upsert adds a delta in one
commit (:mod:`commits`), whatever the store holds; a read lets a key's last commit win and opens the
buckets it needs; :func:`compact` puts down again only the buckets that lie in many deltas, from when
on their older folders are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators.commits import Change, State
from marketlens.operators.store import latest_wins
from marketlens.session import broadcast_if_small, folders, stored

BUCKETS = 64
DELTAS = 8  # deltas of a bucket beyond which :func:`compact` puts it down again
AT, BUCKET = "commit", "bucket"


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _floors(store: str) -> str:
    return f"{store}-floors"


def _dealt(rows: DataFrame, keys: list[str], files: int) -> DataFrame:
    """A bucket's rows in ``files`` tasks and so in as many files, however many tasks made them."""
    return rows.repartition(BUCKET, F.pmod(F.xxhash64(F.lit(files), *keys), F.lit(files)))


def upsert(spark: SparkSession, base: str, store: str, updates: DataFrame, keys: list[str], order: list[str | Column], files: int = 1) -> State:
    """Insert or replace by key, in one commit; nothing that the store holds is read or moved.

    Copies of a key among the updates are settled by ``order``, and rows with a null in their key are
    dropped, as by :func:`store.latest_wins`. The first updates give the store its columns; later ones
    may have more, for ``order``. ``files`` is the number of files of a bucket's delta; let it grow
    with the size of a change.
    """
    change = Change(spark, base)
    known = change.before.schemas.get(store)
    columns = [f["name"] for f in known["fields"] if f["name"] not in (AT, BUCKET)] if known else updates.columns
    new = latest_wins(updates, keys, order).select(*columns).withColumn(AT, F.lit(change.before.number + 1).cast("long"))
    change.append(store, _dealt(new.withColumn(BUCKET, _bucket(keys)), keys, files), by=BUCKET)
    return change.commit()


def deltas_of(spark: SparkSession, at: State, store: str) -> dict[int, list[int]]:
    """The commits whose delta has a folder of a bucket that counts, for each bucket. Folders are
    listed, not opened."""
    floors = at.read(spark, _floors(store))
    least = {} if floors is None else {r[BUCKET]: r["f"] for r in floors.groupBy(BUCKET).agg(F.max(AT).alias("f")).collect()}
    found: dict[int, list[int]] = {}
    for commit, path, _ in at.parts(spark, store):
        for name in folders(spark, path):
            bucket = int(name.split("=")[1])
            if commit >= least.get(bucket, 0):
                found.setdefault(bucket, []).append(commit)
    return found


def _rows(spark: SparkSession, at: State, store: str, of: Callable[[int], list[int]]) -> DataFrame | None:
    """Rows of each delta's buckets as ``of`` its commit says; others are pruned by their folder."""
    parts = [df.filter(F.col(BUCKET).isin(of(commit))) for commit, _, df in at.parts(spark, store) if of(commit)]
    return reduce(DataFrame.unionByName, parts) if parts else None


def _live(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's last commit. A commit has a key once, so keys and numbers suffice to
    find them, and wide columns are not aggregated."""
    last = rows.groupBy(*keys).agg(F.max(AT).alias(AT))
    return rows.join(last, [*keys, AT], "left_semi").select(rows.columns)


def _read(spark: SparkSession, at: State, store: str, keys: list[str], only: Iterable[int] | None) -> DataFrame | None:
    known = deltas_of(spark, at, store)
    known = known if only is None else {b: known[b] for b in only if b in known}
    alone = _rows(spark, at, store, lambda c: sorted(b for b, cs in known.items() if cs == [c]))
    layered = _rows(spark, at, store, lambda c: sorted(b for b, cs in known.items() if len(cs) > 1 and c in cs))
    parts = [p for p in (alone, None if layered is None else _live(layered, keys)) if p is not None]
    if not parts:
        rows = at.read(spark, store)
        return None if rows is None else rows.limit(0)
    return reduce(DataFrame.unionByName, parts)


def read(spark: SparkSession, at: State, store: str, keys: list[str], only: Iterable[int] | None = None) -> DataFrame | None:
    """A store's rows, one a key, or None if nothing was put into it. ``only`` names the buckets to
    read; a bucket of a single delta has each key once and is taken as it is."""
    rows = _read(spark, at, store, keys, only)
    return None if rows is None else rows.drop(AT, BUCKET)


def lookup(spark: SparkSession, at: State, store: str, keys: list[str], asked: DataFrame) -> DataFrame | None:
    """The store's rows whose key is asked for; only the buckets of asked keys are read."""
    asked = stored(asked.select(*keys).dropna().distinct().withColumn(BUCKET, _bucket(keys)), "asked")
    buckets = [r[BUCKET] for r in asked.select(BUCKET).distinct().collect()]  # at most BUCKETS numbers
    rows = read(spark, at, store, keys, buckets)
    return None if rows is None else rows.join(broadcast_if_small(asked.drop(BUCKET)), keys, "left_semi").select(rows.columns)


def missing(spark: SparkSession, at: State, store: str, keys: list[str], asked: DataFrame) -> DataFrame:
    """The asked keys that the store does not have, each once."""
    asked = asked.select(*keys).dropna().distinct()
    there = lookup(spark, at, store, keys, asked)
    return asked if there is None else asked.join(broadcast_if_small(stored(there.select(*keys), "there")), keys, "left_anti")


def compact(spark: SparkSession, base: str, store: str, keys: list[str], deltas: int = DELTAS, files: int = 1) -> list[int]:
    """Put down again, in one commit, the buckets of more than ``deltas`` deltas, and return them.

    Folders that no bucket needs any more stay named until all buckets are put down at once, as with
    ``deltas=0``; from then on :func:`commits.clean` may delete them."""
    change = Change(spark, base)
    known = deltas_of(spark, change.before, store)
    full = sorted(b for b, commits in known.items() if len(commits) > deltas)
    if not full:
        return []
    number = F.lit(change.before.number + 1).cast("long")
    rows = _dealt(_read(spark, change.before, store, keys, full).withColumn(AT, number), keys, files)
    if len(full) == len(known):
        change.put(store, rows, by=BUCKET)
    else:
        change.append(store, rows, by=BUCKET)
    change.append(_floors(store), spark.createDataFrame([(b,) for b in full], f"{BUCKET} int").withColumn(AT, number).coalesce(1))
    change.commit()
    return full
