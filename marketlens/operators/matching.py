"""Many terms against many records: phrase predicates, clause matching, tier waterfall.

The work per record is done where the record was read. A clause table that was measured to
fit is held by every task, which settles all clauses for a chunk of records at once
(:mod:`probe`); neither texts nor candidates are shuffled. With a clause table too large
for that, a clause is looked up through one anchor word: numbers of records and
conditions meet first, and phrases and texts are joined by row number.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.functions import text as tx
from marketlens.operators import probe as pr
from marketlens.operators.skew import salted_join
from marketlens.operators.store import upsert
from marketlens.plans import tiers as pl
from marketlens.session import broadcast_if_small, discard, fits_broadcast, ship_package, stored

SEARCH_FIELDS = ["device_name", "statement_or_summary", "openfda_device_names"]
REGISTRY_FIELDS = ["device_description", "brand_name"]


# -- predicates for a handful of terms --------------------------------------------------


def _padded_field(df: DataFrame, field: str) -> Column:
    kind = df.schema[field].dataType.typeName()
    text = tx.padded_values(F.col(field)) if kind == "array" else tx.padded(F.col(field))
    return F.coalesce(text, F.lit(" "))


def phrase_in_any_field(df: DataFrame, fields: list[str], phrase: str) -> Column:
    """Predicate: some field holds the phrase."""
    p = tx.padded(F.lit(phrase))
    return reduce(lambda a, b: a | b, [tx.contains_phrase(_padded_field(df, f), p) for f in fields])


def all_tokens_in_field(df: DataFrame, field: str, tokens: list[str]) -> Column:
    """Predicate: one given field holds every token."""
    text = _padded_field(df, field)
    return reduce(lambda a, b: a & b, [tx.contains_phrase(text, tx.padded(F.lit(t))) for t in tokens])


def all_tokens_same_field(df: DataFrame, fields: list[str], tokens: list[str]) -> Column:
    """Predicate: some single field holds every token."""
    return reduce(lambda a, b: a | b, [all_tokens_in_field(df, f, tokens) for f in fields])


def all_tokens_any_field(df: DataFrame, fields: list[str], tokens: list[str]) -> Column:
    """Predicate: every token is in some field, not necessarily the same one."""
    return reduce(lambda a, b: a & b, [phrase_in_any_field(df, fields, t) for t in tokens])


# -- searchable corpus ------------------------------------------------------------------


def searchable(df: DataFrame, key: str = "k_number", fields: list[str] = SEARCH_FIELDS,
               payload: list[str] | None = None) -> DataFrame:
    """``key, payload..., texts`` with one padded text per field.

    Writing this out once saves the normalisation on later searches.
    """
    texts = F.array(*[_padded_field(df, f) for f in fields])
    return df.select(key, *(payload or []), texts.alias("texts"))


def _all(texts: Column) -> Column:
    """All fields as one text; the bar keeps phrases from forming across fields."""
    return F.array_join(texts, "|")


def _words(whole: Column) -> Column:
    return F.array_distinct(tx.words_of(whole))


def antibody_flags(corpus: DataFrame) -> DataFrame:
    """Add ``has_anti`` (any antibody-type word) and ``has_antibody`` (the strict words)."""

    def flag(words: list[str]) -> Column:
        tests = [F.contains(F.col("whole"), F.lit(f" {w} ")) for w in words]
        return reduce(lambda a, b: a | b, tests)

    whole = corpus if "whole" in corpus.columns else corpus.withColumn("whole", _all(F.col("texts")))
    return whole.withColumn("has_anti", flag(tx.ANTI_WORDS)).withColumn("has_antibody", flag(tx.ANTIBODY_WORDS))


def with_antibody_requirement(satisfied: Column, mode: Column) -> Column:
    """AND a clause with the flag its mode asks for; the flag is the cheaper test."""
    carried = (
        F.when(mode == tx.EXPLICIT, F.col("has_anti"))
        .when(mode == tx.IMPLIED, F.col("has_antibody"))
        .otherwise(F.lit(True))
    )
    return carried & satisfied


def worded(corpus: DataFrame) -> DataFrame:
    """The corpus with antibody flags, all fields as one text and the distinct words of each record."""
    return antibody_flags(corpus).withColumn("words", _words(F.col("whole")))


def _counts(words: DataFrame) -> DataFrame:
    return words.select(F.explode_outer("words").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def token_counts(corpus: DataFrame) -> DataFrame:
    """Number of records each word occurs in; sharpens the choice of anchors."""
    return _counts(corpus.select(_words(_all(F.col("texts"))).alias("words")))


# -- phrases against records ------------------------------------------------------------


CONDITION = ["anchor", "scope", "anti", "phrases"]
USER = ["term_id", "tier", "clause_no"]
ASKED = ["scope", "anti", "phrases"]
PHRASES_FIRST, FIELDS_FIRST = 4, 3  # settled without moving a text


def _conditions(anchored: DataFrame) -> DataFrame:
    """Distinct conditions: ``anchor, scope, anti, phrases, need, runs``. ``need`` are the words besides
    the anchor, ``runs`` the phrases of several words."""
    words = F.array_distinct(F.flatten(F.transform("phrases", tx.words_of)))
    # Long words are rarer, so looking for them first settles most candidates at once.
    longest_first = F.transform(
        F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))),
        lambda s: s["w"],
    )
    return anchored.select(*CONDITION).distinct().select(
        "*",
        F.array_remove(longest_first, F.col("anchor")).alias("need"),
        F.filter("phrases", lambda p: F.size(tx.words_of(p)) > 1).alias("runs"),
    )


def _first(items: str, n: int, test) -> Column:
    """The test holds for the first items. Plain expressions, so that Spark compiles them into one
    loop with the explode and the join and copies no text for a candidate that fails."""
    wanted = [F.get(items, F.lit(i)) for i in range(n)]
    return reduce(lambda a, b: a & b, [w.isNull() | test(w) for w in wanted])


def _one_field() -> Column:
    return (F.col("scope") == "same") & (F.size("phrases") > 1)


def _in_first_field() -> Column:
    """The first phrases are together in one of the first fields."""
    fields = [F.get("texts", F.lit(i)) for i in range(FIELDS_FIRST)]
    return reduce(lambda a, b: a | b, [t.isNotNull() & _first("phrases", PHRASES_FIRST, lambda p, t=t: F.contains(t, p)) for t in fields])


def _likely(items: str, n: int) -> Column:
    """What the first ``items`` (runs or phrases) tell: false if the condition is not met, and met
    if true, given its words, unless it :func:`_goes_on`."""
    across = _first(items, n, lambda p: F.contains("whole", p))
    return F.when(_one_field() & (F.size("texts") <= FIELDS_FIRST), _in_first_field()).otherwise(across)


def _goes_on(items: str, n: int) -> Column:
    """More is asked for than what :func:`_likely` looks at."""
    return (F.size(items) > n) | (_one_field() & ((F.size("phrases") > PHRASES_FIRST) | (F.size("texts") > FIELDS_FIRST)))


def _in_text() -> Column:
    """The whole condition, for any number of words and phrases."""
    across = F.forall("phrases", lambda p: F.exists("texts", lambda t: F.contains(t, p)))
    same = F.exists("texts", lambda t: F.forall("phrases", lambda p: F.contains(t, p)))
    return F.when(_one_field(), same).otherwise(across)


def named_once(rows: pa.Table) -> bool:
    """No two clauses have the same term, tier and number."""
    return rows.group_by(USER).aggregate([]).num_rows == rows.num_rows


def probed(records: DataFrame, clauses: DataFrame, rows: pa.Table, keep: list[str]) -> DataFrame:
    """Records x clauses inside the record, see :mod:`probe`; ``rows`` are those of ``clauses``, which were
    measured to be few. Records have ``texts``, or ``phrases`` and ``fields`` that were found and a
    column for each antibody mode.

    ``_by_term`` of the result gives, of some of its ``_records``, one row per term instead of one per
    clause: ``term_id, keep..., tiers``."""
    spark = records.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(pr.Probe(rows, {tx.EXPLICIT: tx.ANTI_WORDS, tx.IMPLIED: tx.ANTIBODY_WORDS}))
    user, kept = clauses.select(*USER).schema.fields, records.select(*keep).schema.fields
    out = records.mapInArrow(lambda batches: pr.facts(batches, shared.value, keep), T.StructType([*kept, *user]))
    tiers = T.StructType([user[0], *kept, T.StructField("tiers", T.IntegerType())])
    out._by_term = lambda some: some.mapInArrow(lambda batches: pr.masks(batches, shared.value, keep), tiers)
    out._records, out._keep = records, keep
    return out


def _probed(corpus: DataFrame, clauses: DataFrame, keep: list[str]) -> DataFrame:
    table = clauses.select(*USER, *ASKED)
    rows = table.toArrow()
    if "anchor" not in clauses.columns and not named_once(rows):
        # Of several clauses under one name the choice of anchors keeps one.
        rows = anchor_clauses(clauses).select(table.columns).toArrow()
    return probed(corpus.select(*keep, "texts"), table, rows, keep)


def _numbered(records: DataFrame) -> DataFrame:
    """Records written once with a row number: copies of a record and records without a key
    stay rows of their own."""
    return stored(records.withColumn("_row", F.monotonically_increasing_id()), "records")


def _lookup_large(records: DataFrame, clauses: DataFrame, keep: list[str]) -> DataFrame:
    """As :func:`_probed` for condition tables of any size; records are :func:`worded` and
    :func:`_numbered`.

    Only numbers travel until a pair is likely: (word, row) postings meet (anchor, condition) under
    the antibody flags, and pairs that lack the condition's longest other word are cut by the same
    postings. What remains brings the condition's phrases, and nothing else of it, to the record.
    Who asks for a condition is told last, to those records that meet it.
    """
    numbered = stored(_conditions(clauses).withColumn("_condition", F.monotonically_increasing_id()), "conditions")
    postings = records.select("_row", "has_anti", "has_antibody", F.explode_outer("words").alias("anchor")).filter("anchor IS NOT NULL")
    second = F.xxhash64(F.get("need", F.lit(0)))
    wanted = numbered.select("anchor", "anti", "_condition", F.when(F.size("need") > 0, second).alias("second"))
    pairs = salted_join(postings, wanted, ["anchor"], salt_by=["_row"])
    pairs = pairs.filter(with_antibody_requirement(F.lit(True), F.col("anti"))).select("_row", "_condition", "second")
    # A hash that two words share lets a pair pass that the text cuts.
    held = postings.select("_row", F.xxhash64("anchor").alias("second"))
    sure = pairs.filter("second IS NULL").unionByName(pairs.join(held, ["_row", "second"], "left_semi").select(pairs.columns))
    sure = stored(sure.select("_row", "_condition"), "pairs")
    # A lone word stands where its postings say.
    settled = (F.size("phrases") == 1) & (F.size("runs") == 0)
    asked = numbered.select("_condition", *(F.when(~settled, F.col(c)).alias(c) for c in ("scope", "phrases")))
    named = salted_join(sure, asked, ["_condition"], salt_by=["_row"])
    met = named.join(records.select("_row", *keep, "texts", _all(F.col("texts")).alias("whole")), "_row")
    more = _goes_on("phrases", PHRASES_FIRST)
    slim = met.filter(_likely("phrases", PHRASES_FIRST)).select("_row", "_condition", *keep, "scope", "phrases", F.when(more, F.col("texts")).alias("texts"))
    hits = stored(slim.filter(F.col("texts").isNull() | _in_text()).select("_row", "_condition", *keep), "met")
    discard(sure)
    users = clauses.select(*CONDITION, *USER).join(numbered.select(*CONDITION, "_condition"), CONDITION).select("_condition", *USER)
    return salted_join(hits, users, ["_condition"], salt_by=["_row"]).select(*keep, *USER)


def anchor_clauses(clauses: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Clauses with their anchors, written once, as the next steps read them more than once."""
    return stored(
        pl.with_anchor(clauses, counts).select(
            "anchor", "term_id", "tier", "clause_no", "scope", "anti",
            F.array_sort("phrases").alias("phrases"),
        ),
        "anchors",
    )


def _hits(corpus: DataFrame, clauses: DataFrame, keep: list[str], small: bool | None,
          counts: DataFrame | None) -> DataFrame:
    """The way by the measured size of the clauses; either gives the same rows."""
    if "anchor" not in clauses.columns:
        clauses = stored(clauses, "clauses")  # read twice by the choice of anchors
    if small is None:
        small = fits_broadcast(clauses)
    if small:
        return _probed(corpus, clauses if counts is None or "anchor" in clauses.columns else anchor_clauses(clauses, counts), keep)
    records = _numbered(worded(corpus).drop("whole"))
    if "anchor" not in clauses.columns:
        clauses = anchor_clauses(clauses, _counts(records) if counts is None else counts)
    return _lookup_large(records, clauses, keep)


def satisfied_clauses(corpus: DataFrame, clauses: DataFrame, key: str = "k_number",
                      payload: list[str] | None = None, small: bool | None = None,
                      counts: DataFrame | None = None) -> DataFrame:
    """AND of a clause's phrases, decided inside the record: ``key, payload..., term_id,
    tier, clause_no``.

    No grouping is needed, since all the evidence for one record is in the row at hand. A large
    clause table chooses its anchors by the words' counts in the corpus.
    """
    return _hits(corpus, clauses, [key, *(payload or [])], small, counts)


def phrase_hits(phrases: DataFrame, corpus: DataFrame, key: str = "k_number",
                small: bool | None = None) -> DataFrame:
    """Which record holds which phrase: ``phrase_id, key, field`` (field number from 0).

    ``phrases(phrase_id, phrase)`` may hold any number of phrases.
    """
    clauses = phrases.select(
        F.col("phrase_id").alias("term_id"),
        F.lit(0).alias("tier"),
        F.lit(0).alias("clause_no"),
        F.lit("any").alias("scope"),
        F.lit(tx.NONE).alias("anti"),
        F.array(tx.padded(F.col("phrase"))).alias("phrases"),
    ).filter(F.element_at("phrases", 1) != " ")
    one_field = corpus.select(key, F.posexplode_outer("texts").alias("field", "text")).select(
        key, "field", F.array("text").alias("texts")
    )
    hits = _hits(one_field, clauses, [key, "field"], small, None)
    return hits.select(F.col("term_id").alias("phrase_id"), key, "field")


# -- tiers ------------------------------------------------------------------------------


def tier_bit(tier) -> Column:
    """Bit of a tier in a tier mask (exact = 1, broad = 2, ... expansion = 32)."""
    return F.expr(f"shiftleft(1, {tier} - 1)")


def union_tiers(satisfied: DataFrame, key: str = "k_number", payload: list[str] | None = None) -> DataFrame:
    """OR over clauses and tiers: ``term_id, key, payload..., tiers``, one bit per tier.

    Of what :func:`satisfied_clauses` finds in one pass over the records, the OR is worked out inside
    the record, and only records whose key is missing or comes again are grouped, which the keys alone
    tell. Other facts are combined on the map side; the shuffle key includes the record, so that a
    term matching a third of all records is still spread over all partitions.
    """
    by = ["term_id", key, *(payload or [])]
    union = lambda rows, bits: rows.groupBy(*by).agg(F.bit_or(bits).alias("tiers"))
    if not hasattr(satisfied, "_by_term") or satisfied._keep != by[1:]:
        return union(satisfied, tier_bit("tier"))
    records = satisfied._records
    keys = records.select(key).groupBy(key).agg(F.count("*").alias("_n"))
    again = stored(keys.filter(F.col(key).isNull() | (F.col("_n") > 1)).select(F.col(key).alias("_again")), "again")
    if not fits_broadcast(again):
        return union(satisfied._by_term(records), "tiers")
    among = [records.join(F.broadcast(again), F.col(key).eqNullSafe(F.col("_again")), how) for how in ("left_anti", "left_semi")]
    alone, shared = (satisfied._by_term(some) for some in among)
    out = alone.select(*by, "tiers").unionByName(union(shared, "tiers"))
    out._one_pass = True
    return out


_ALTERNATIVES = 0b000111
_MERGED = 0b111000


def _lowest(mask: str) -> str:
    return f"({mask} & -{mask})"


def tier_waterfall(masks: DataFrame, small_terms: bool = False) -> DataFrame:
    """First non-empty of tiers 1-3, plus tiers 4-6, with one label per term.

    Adds ``match_mode`` and keeps in ``tiers`` the tiers that counted.

    What a term found is a bitwise OR over its records, one small row per term from a
    partial aggregate; a window over the term would put all its records in one task. Masks are read
    twice; those that no exchange holds are written.
    """
    one_pass = getattr(masks, "_one_pass", False)
    if one_pass:
        masks = stored(masks, "masks")
    found = masks.groupBy("term_id").agg(F.bit_or("tiers").alias("found"))
    alternatives = f"(found & {_ALTERNATIVES})"
    used = found.select(
        "term_id",
        F.expr(f"{_lowest(alternatives)} | (found & {_MERGED})").alias("used"),
    )
    rank = F.expr(f"cast(log2({_lowest('used')}) as int)")
    labels = F.array(*[F.lit(t) for t in pl.TIERS])
    used = used.select("term_id", "used", F.get(labels, rank).alias("match_mode"))
    if small_terms:
        used = F.broadcast(used)
    elif one_pass:
        used = broadcast_if_small(stored(used, "used"))
    kept = F.expr("tiers & used")
    rest = [c for c in masks.columns if c != "tiers"]
    return masks.join(used, "term_id").filter(kept != 0).select(*rest, "match_mode", kept.alias("tiers"))


def match_terms(terms: DataFrame, devices: DataFrame, counts: DataFrame | None = None,
                corpus: DataFrame | None = None, payload: list[str] | None = None) -> DataFrame:
    """Confirmed matches of every term: ``term_id, k_number, payload..., match_mode, tiers``.

    ``payload`` names device columns to bring along from the scan, which saves a join
    with the devices afterwards.
    """
    corpus = searchable(devices, payload=payload) if corpus is None else corpus
    clauses = stored(pl.compile_terms(terms), "clauses")
    # The table of what each term found has at most one row per clause: where the clauses
    # were measured to fit a broadcast, so does it.
    small = fits_broadcast(clauses)
    hits = satisfied_clauses(corpus, clauses, payload=payload, small=small, counts=counts)
    return tier_waterfall(union_tiers(hits, payload=payload), small_terms=small)


def merge_results(a: DataFrame, b: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Union by key where the right side overrides the left; ``order`` settles copies in it."""
    return upsert(a, b, keys, order)


def merged_total(total_a: Column, total_b: Column, n_union: Column) -> Column:
    """Total of a merge: never below either total nor below the size of the union."""
    return F.greatest(total_a, total_b, n_union)
