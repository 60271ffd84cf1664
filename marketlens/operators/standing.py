"""Searches that stay: clauses are a table that is kept, and every batch of new records probes it.

What a record satisfies is one tier mask per term, kept as it was found. A term's label and the tiers
that count for it are worked out from all its masks when they are read, so that a tier newly found
takes the place of a looser one, and a record that comes again with other texts takes its old masks
away, which may bring a looser tier back. Folding records in any number of batches gives what one
full search over their last copies gives.

Stores of a base folder, which change in one commit: ``terms``, ``clauses``, ``records`` (normalised
texts), ``masks``, ``replaced`` and ``batches``. A batch costs one probe of its own records; texts
kept before are read only when a term is added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.operators import matching as m
from marketlens.operators.commits import Change, State, state
from marketlens.operators.deltas import AT, among, compacted, live
from marketlens.plans import tiers as pl
from marketlens.session import broadcast_if_small, discard, fits_broadcast, stored
from marketlens.sources.scans import spread

KEY = "k_number"
SINCE = "since"


def _masks(corpus: DataFrame, clauses: DataFrame) -> DataFrame:
    """``term_id, since, k_number, commit, tiers`` of records ``k_number, commit, texts``."""
    hits = m.satisfied_clauses(spread(corpus), clauses.drop(SINCE), payload=[AT])
    since = clauses.select("term_id", SINCE).distinct()
    return m.union_tiers(hits, payload=[AT]).join(broadcast_if_small(since), "term_id").select("term_id", SINCE, KEY, AT, "tiers")


def _watched(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of terms that are watched, in the form last given."""
    return rows.join(broadcast_if_small(terms.select("term_id", SINCE)), ["term_id", SINCE], "left_semi").select(rows.columns)


def watch(spark: SparkSession, base: str, terms: DataFrame) -> State:
    """Add terms, in the columns of :func:`tiers.compile_terms`, and search what is kept for them.

    A term watched before under the same ``term_id`` is replaced: its clauses and masks no longer
    count. Terms without an id are dropped; a term without a clause is watched and finds nothing."""
    change = Change(spark, base)
    now = F.lit(change.before.number + 1).alias(SINCE)
    asked = stored(terms.filter("term_id IS NOT NULL"), "asked")
    ids = asked.select("term_id").distinct().select("term_id", now)
    before = change.read("terms")
    change.put("terms", ids if before is None else before.join(broadcast_if_small(ids.select("term_id")), "term_id", "left_anti").unionByName(ids))
    clauses = stored(m.anchor_clauses(pl.compile_terms(asked)).select("*", now), "watched")
    change.append("clauses", clauses)
    records = change.read("records")
    if records is not None:
        change.append("masks", _masks(live(records, change.read("replaced"), [KEY]), clauses))
    after = change.commit()
    discard(asked, clauses)
    return after


def forget(spark: SparkSession, base: str, ids: DataFrame) -> State:
    """Watch the terms ``ids(term_id)`` no longer."""
    change = Change(spark, base)
    before = change.read("terms")
    if before is None:
        return change.before
    change.put("terms", before.join(broadcast_if_small(ids.select("term_id").distinct()), "term_id", "left_anti"))
    return change.commit()


def fold(spark: SparkSession, base: str, records: DataFrame, batch: str | None = None,
         fields: list[str] = m.SEARCH_FIELDS) -> State:
    """Add a batch of records; those that came in earlier batches under the same key are replaced.

    Several records of one key in a batch all count, and records without a key answer for themselves
    and are never replaced, as in a search. A batch with a name is folded once: if it was committed
    before, a retry changes nothing."""
    change = Change(spark, base)
    done = change.read("batches")
    if batch is not None and done is not None and not done.filter(F.col("batch") == batch).isEmpty():
        return change.before
    at = F.lit(change.before.number + 1).alias(AT)
    new = stored(m.searchable(records, KEY, fields).select(KEY, at, "texts"), "batch")
    kept = change.read("records")
    if kept is not None:
        again = among(kept.select(KEY), new, [KEY]).distinct().select(KEY, at)
        change.append("replaced", again)
    change.append("records", new)
    clauses, terms = change.read("clauses"), change.read("terms")
    if clauses is not None:
        change.append("masks", _masks(new, _watched(clauses, terms)))
    if batch is not None:
        change.append("batches", spark.range(1).select(F.lit(batch).alias("batch")))
    after = change.commit()
    discard(new)
    return after


def masks(spark: SparkSession, at: State) -> DataFrame | None:
    """``term_id, k_number, tiers`` as of a commit; None before the first record met a term."""
    rows, terms = at.read(spark, "masks"), at.read(spark, "terms")
    if rows is None or terms is None:
        return None
    now = live(_watched(rows, terms), at.read(spark, "replaced"), [KEY], measured=True)
    # A key lives in one commit alone, whose masks are united already; records without a key in many.
    nameless = now.filter(F.col(KEY).isNull()).groupBy("term_id", KEY).agg(F.bit_or("tiers").alias("tiers"))
    return now.filter(F.col(KEY).isNotNull()).select("term_id", KEY, "tiers").unionByName(nameless)


def _waterfall(rows: DataFrame, terms: DataFrame | None) -> DataFrame:
    """What a term found is one row of a few numbers, as a watched term is."""
    return m.tier_waterfall(rows, small_terms=terms is not None and fits_broadcast(terms))


def matches(spark: SparkSession, at: State) -> DataFrame:
    """``term_id, k_number, match_mode, tiers`` of all watched terms as of a commit, as
    :func:`matching.match_terms` gives them over the records' last copies."""
    rows = masks(spark, at)
    if rows is None:
        raise LookupError("no term is watched over any record yet")
    return _waterfall(rows, at.read(spark, "terms"))


def changed(spark: SparkSession, base: str, before: int, after: int | None = None) -> DataFrame:
    """What became of the matches between two commits: ``term_id, k_number, was, now``.

    One row per match that is new (``was`` null), gone (``now`` null) or labelled otherwise. Only
    terms that a record or a watch has touched in between are worked out, and each of them whole,
    since one new record may change the label of all. A commit before the first match has none."""
    last = state(spark, base, after)
    first = state(spark, base, before)
    rows = last.read(spark, "masks")
    if rows is None:
        raise LookupError("no term is watched over any record yet")
    ids = rows.filter((F.col(AT) > before) | (F.col(SINCE) > before)).select("term_id")
    held, terms = first.read(spark, "masks"), first.read(spark, "terms")
    if held is not None:
        replaced = last.read(spark, "replaced")
        if replaced is not None:
            ids = ids.unionByName(among(held, replaced.filter(F.col(AT) > before), [KEY]).select("term_id"))
        stays = last.read(spark, "terms").select("term_id", SINCE)
        ids = ids.unionByName(terms.join(broadcast_if_small(stays), ["term_id", SINCE], "left_anti").select("term_id"))
    touched = stored(ids.distinct(), "touched")

    names = F.array(*[F.lit(t) for t in pl.TIERS])

    def labels(at: State, out: str) -> DataFrame:
        found = masks(spark, at)
        if found is None:
            found = masks(spark, last).limit(0)
        place = F.array_position(names, F.col("match_mode")).cast("int")
        return _waterfall(among(found, touched, ["term_id"]), at.read(spark, "terms")).select("term_id", KEY, place.alias(out))

    # Numbers for labels, so that both sides meet in one aggregate, which sorts nothing.
    both = labels(first, "was").unionByName(labels(last, "now"), allowMissingColumns=True)
    told = both.groupBy("term_id", KEY).agg(F.max("was").alias("was"), F.max("now").alias("now")).filter("NOT (was <=> now)")
    return told.select("term_id", KEY, *(F.get(names, F.col(c) - 1).alias(c) for c in ("was", "now")))


def compact(spark: SparkSession, base: str) -> State:
    """Put every store down again without what no longer counts."""
    change = Change(spark, base)
    terms = change.read("terms")
    if terms is not None:
        for store in ("clauses", "masks"):
            if (rows := change.read(store)) is not None:
                change.put(store, _watched(rows, terms))
    if (rows := change.read("masks")) is not None:
        change.put("masks", live(rows, change.read("replaced"), [KEY]))
    compacted(change, "records", "replaced", [KEY])
    return change.commit()
