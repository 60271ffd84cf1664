"""Search terms compiled into a clause table.

A *clause* is the unit of matching: a record satisfies it when all its phrases occur, each
in any searched field (scope ``any``) or all in one and the same field (scope ``same``),
and the record carries the antibody words the clause asks for. A term matches a record in
a tier when some clause of that term and tier is satisfied.

Clause rows: ``term_id, tier, clause_no, scope, anti, phrases`` with phrases in padded
normal form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.functions import text as tx

# Tier ranks, strictest first. 1-3 are alternatives, 4-6 are always merged in.
TIERS = ["exact", "broad", "antigen-only", "fused-anti", "wordform", "expansion"]
EXACT, BROAD, ANTIGEN_ONLY, FUSED_ANTI, WORDFORM, EXPANSION = range(1, 7)

CLAUSE_TYPE = "struct<tier:int,scope:string,anti:string,phrases:array<string>>"


def _clause(tier: int, scope, anti, phrases: Column) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(
        F.lit(tier).alias("tier"),
        as_col(scope).alias("scope"),
        as_col(anti).alias("anti"),
        phrases.alias("phrases"),
    ).cast(CLAUSE_TYPE)


def _phrases(tokens: Column) -> Column:
    return F.transform(tokens, tx.padded)


def _explode_clauses(df: DataFrame, clauses: Column) -> DataFrame:
    """One row per usable clause; a clause with an empty phrase can never match."""
    usable = (F.size("c.phrases") > 0) & ~F.array_contains("c.phrases", " ")
    return (
        df.select("term_id", F.posexplode(clauses).alias("clause_no", "c"))
        .filter(usable)
        .select("term_id", "c.tier", "clause_no", "c.scope", "c.anti",
                F.array_distinct("c.phrases").alias("phrases"))
    )


def compile_tiers(terms: DataFrame) -> DataFrame:
    """Clauses of tiers 1-5 for ``terms(term_id, term)``."""
    prepared = terms.select("term_id", tx.greek_to_latin(tx.strip_ws(F.col("term"))).alias("t"))
    t = F.col("t")
    prepared = prepared.select(
        "term_id",
        "t",
        tx.anti_requirement_mode(t).alias("mode"),
        tx.antigen_of(t).alias("antigen"),
        tx.split_tokens(tx.strip_anti_prefix(t)).alias("broad_tokens"),
        tx.fused_anti(t).alias("fused"),
    ).withColumn("antigen_tokens", tx.split_tokens(F.col("antigen")))

    mode, antigen = F.col("mode"), F.col("antigen")
    many = F.size("antigen_tokens") > 1
    exact = _clause(EXACT, "any", tx.NONE, F.array(tx.padded(t)))
    broad = F.when(
        (F.size("broad_tokens") > 0) & ((mode != tx.NONE) | (F.size("broad_tokens") >= 2)),
        _clause(BROAD, "same", mode, _phrases(F.col("broad_tokens"))),
    )
    # Left out where it would only repeat the exact tier.
    differs = many | (mode != tx.NONE) | (antigen != t)
    antigen_only = F.when(
        (antigen != "") & differs,
        _clause(
            ANTIGEN_ONLY,
            F.when(many, "same").otherwise("any"),
            mode,
            F.when(many, _phrases(F.col("antigen_tokens"))).otherwise(F.array(tx.padded(antigen))),
        ),
    )
    fused = F.when(
        F.col("fused").isNotNull(),
        _clause(FUSED_ANTI, "any", tx.NONE, F.array(tx.padded(F.col("fused")))),
    )
    wordforms = F.transform(
        F.when(antigen != "", tx.orthographic_variants(antigen)).otherwise(
            F.array().cast("array<string>")
        ),
        lambda v: _clause(WORDFORM, "any", tx.NONE, _phrases(tx.split_tokens(v))),
    )
    fixed = F.array_compact(F.array(exact, broad, antigen_only, fused))
    return _explode_clauses(prepared, F.concat(fixed, wordforms))


def compile_expansions(terms: DataFrame) -> DataFrame:
    """Clauses of tier 6 for ``terms(term_id, term, full, search)``.

    A group that already says ``anti...`` skips the antibody requirement.
    """
    t = tx.greek_to_latin(tx.strip_ws(F.col("term")))
    phrase = tx.expansion_phrase(F.col("full"), F.col("search"))
    prepared = terms.select(
        "term_id", tx.anti_requirement_mode(t).alias("mode"), tx.expansion_groups(phrase).alias("groups")
    ).filter(F.size("groups") > 0)
    clauses = F.transform(
        "groups",
        lambda g: _clause(
            EXPANSION,
            "any",
            F.when(tx.group_implies_anti(g), F.lit(tx.NONE)).otherwise(F.col("mode")),
            _phrases(g),
        ),
    )
    return _explode_clauses(prepared, clauses)


def compile_terms(terms: DataFrame) -> DataFrame:
    """Clauses of all tiers; the expansion columns are optional."""
    clauses = compile_tiers(terms)
    if {"full", "search"} <= set(terms.columns):
        clauses = clauses.unionByName(compile_expansions(terms))
    return clauses


def compile_registry(terms: DataFrame) -> DataFrame:
    """Clauses for the registry. Only a resolved expansion is ever searched there."""
    phrase = tx.expansion_phrase(F.col("full"), F.col("search"))
    prepared = terms.select("term_id", tx.registry_token_groups(phrase).alias("groups")).filter(
        F.size("groups") > 0
    )
    clauses = F.transform("groups", lambda g: _clause(EXPANSION, "any", tx.NONE, _phrases(g)))
    return _explode_clauses(prepared, clauses)


def with_anchor(clauses: DataFrame, token_counts: DataFrame | None = None) -> DataFrame:
    """Add ``anchor``: the one word through which a clause is looked up.

    Every record that satisfies a clause contains all words of all its phrases, so any of
    them is a sound anchor. The word shared by the fewest clauses is taken (rarest in the
    corpus first, when ``token_counts(token, n)`` is given), then the longest; a word such
    as "antibody" that many terms share is thus not the way into all of them.
    """
    key = ["term_id", "tier", "clause_no"]
    rest = [c for c in clauses.columns if c not in key]
    words = clauses.select(
        "*",
        F.explode(F.array_distinct(F.flatten(F.transform("phrases", tx.words_of)))).alias("token"),
    )
    shared = words.groupBy("token").agg(F.count("*").alias("clauses"))
    if token_counts is not None:
        seen = token_counts.select("token", F.col("n").alias("seen"))
        shared = shared.join(seen, "token", "left")
    else:
        shared = shared.withColumn("seen", F.lit(0).cast("long"))
    cost = [F.coalesce("seen", F.lit(0)).alias("seen"), F.col("clauses"), (-F.length("token")).alias("short")]
    best = words.join(shared, "token").groupBy(*key).agg(F.min(F.struct(*cost, "token", *rest)).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in rest], F.col("best.token").alias("anchor"))
