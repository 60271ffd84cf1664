"""Phrase predicates, clause matching, the tier waterfall, registry, citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.operators import citing as ci
from marketlens.operators import commits as cm
from marketlens.operators import evidence as ev
from marketlens.operators import graph as gr
from marketlens.operators import index as ix
from marketlens.operators import matching as m
from marketlens.operators import resolve as rs
from marketlens.operators import standing as sd
from marketlens.plans import tiers as pl
from marketlens.session import cut_lineage, scratch_dir
from marketlens.streaming import refresh as rf
from workload import views as v
from workload.registry import query
from workload.sql import norm

_ANY = "(contains(f1, '{0}') OR contains(f2, '{0}') OR contains(f3, '{0}'))"


@query("b1_phrase_in_any_field", "SELECT k_number FROM v_texts WHERE " + _ANY.format(" of the "), ("v_texts",))
def b1(spark, sf):
    d = v.devices(spark, sf)
    return d.filter(m.phrase_in_any_field(d, m.SEARCH_FIELDS, "Of the")).select("k_number")


@query("b2_all_tokens_same_field", """
  SELECT k_number FROM v_texts WHERE (contains(f1, ' the ') AND contains(f1, ' antibody '))
    OR (contains(f2, ' the ') AND contains(f2, ' antibody ')) OR (contains(f3, ' the ') AND contains(f3, ' antibody '))""", ("v_texts",))
def b2(spark, sf):
    d = v.devices(spark, sf)
    return d.filter(m.all_tokens_same_field(d, m.SEARCH_FIELDS, ["the", "Antibody"])).select("k_number")


@query("b3_all_tokens_any_field", f"""
  SELECT k_number FROM v_texts WHERE {_ANY.format(' the ')} AND {_ANY.format(' antibody ')} AND {_ANY.format(' en kit ')}""", ("v_texts",))
def b3(spark, sf):
    d = v.devices(spark, sf)
    return d.filter(m.all_tokens_any_field(d, m.SEARCH_FIELDS, ["the", "antibody", "en-kit"])).select("k_number")


@query("b4_antibody_flags", """
  SELECT k_number, CAST(has_anti AS INT) AS has_anti, CAST(has_strict AS INT) AS has_antibody FROM v_texts""", ("v_texts",))
def b4(spark, sf):
    f = m.antibody_flags(m.searchable(v.devices(spark, sf)))
    return f.select("k_number", F.col("has_anti").cast("int"), F.col("has_antibody").cast("int"))


@query("b5_with_antibody_requirement", """
  SELECT term_id, k_number FROM v_sat WHERE tier = 3""", ("v_sat",))
def b5(spark, sf):
    clauses = pl.compile_tiers(v.terms(spark, sf)).filter(F.col("tier") == pl.ANTIGEN_ONLY)
    return m.satisfied_clauses(m.searchable(v.devices(spark, sf)), clauses).select("term_id", "k_number")


@query("c8_phrase_hits", f"""
  SELECT term_id AS phrase_id, k_number, field FROM (
    SELECT term_id, k_number, unnest(list_filter([0, 1, 2], lambda i: contains([f1, f2, f3][i + 1], p))) AS field
    FROM (SELECT term_id, {norm('term')} AS p FROM v_terms), v_texts WHERE p <> ' ')""", ("v_terms", "v_texts"))
def c8(spark, sf):
    phrases = v.terms(spark, sf).select(F.col("term_id").alias("phrase_id"), F.col("term").alias("phrase"))
    return m.phrase_hits(phrases, m.searchable(v.devices(spark, sf)))


@query("c8_phrase_hits_large_plan", f"""
  SELECT term_id AS phrase_id, k_number, field FROM (
    SELECT term_id, k_number, unnest(list_filter([0, 1, 2], lambda i: contains([f1, f2, f3][i + 1], p))) AS field
    FROM (SELECT term_id, {norm('term')} AS p FROM v_terms), v_texts WHERE p <> ' ')""", ("v_terms", "v_texts"))
def c8_large(spark, sf):
    """The way taken when the phrases do not fit a broadcast."""
    phrases = v.terms(spark, sf).select(F.col("term_id").alias("phrase_id"), F.col("term").alias("phrase"))
    return m.phrase_hits(phrases, m.searchable(v.devices(spark, sf)), small=False)


@query("d6_satisfied_clauses", "SELECT term_id, tier, k_number, count(*) AS n FROM v_sat GROUP BY ALL", ("v_sat",))
def d6(spark, sf):
    clauses = pl.compile_terms(v.terms(spark, sf))
    sat = m.satisfied_clauses(m.searchable(v.devices(spark, sf)), clauses)
    return sat.groupBy("term_id", "tier", "k_number").agg(F.count("*").alias("n"))


@query("g2_union_tiers", """
  SELECT term_id, k_number, CAST(sum(1 << (tier - 1)) AS INT) AS tiers FROM v_hits GROUP BY ALL""", ("v_hits",))
def g2(spark, sf):
    clauses = pl.compile_terms(v.terms(spark, sf))
    return m.union_tiers(m.satisfied_clauses(m.searchable(v.devices(spark, sf)), clauses))


@query("e2_tier_waterfall", "SELECT term_id, k_number, label AS match_mode FROM v_match", ("v_match",))
def e2(spark, sf):
    return m.match_terms(v.terms(spark, sf), v.devices(spark, sf)).select("term_id", "k_number", "match_mode")


@query("e2_tier_waterfall_large_plan", "SELECT term_id, k_number, label AS match_mode FROM v_match", ("v_match",))
def e2_large(spark, sf):
    """The way taken when the clause table does not fit a broadcast; anchors by corpus counts."""
    clauses = pl.compile_terms(v.terms(spark, sf))
    sat = m.satisfied_clauses(m.searchable(v.devices(spark, sf)), clauses, small=False)
    return m.tier_waterfall(m.union_tiers(sat)).select("term_id", "k_number", "match_mode")


def _indexed(spark, sf):
    """An index of the devices, added in two deltas; the second replaces some of the first, whose
    texts were others then."""
    devices, base = v.devices(spark, sf), scratch_dir(spark, "index")
    late = F.pmod(F.xxhash64("k_number"), F.lit(3)) == 0
    old = devices.filter(late).withColumn("device_name", F.concat(F.lit("former "), "device_name"))
    ix.add(spark, base, devices.filter(~late).unionByName(old))
    return ix.add(spark, base, devices.filter(late))


@query("c8_indexed_phrase_hits", f"""
  SELECT term_id AS phrase_id, k_number, field FROM (
    SELECT term_id, k_number, unnest(list_filter([0, 1, 2], lambda i: contains([f1, f2, f3][i + 1], p))) AS field
    FROM (SELECT term_id, {norm('term')} AS p FROM v_terms), v_texts WHERE p <> ' ')""", ("v_terms", "v_texts"))
def c8_indexed(spark, sf):
    """From a kept positional index; no text is normalised or moved by the search."""
    phrases = v.terms(spark, sf).select(F.col("term_id").alias("phrase_id"), F.col("term").alias("phrase"))
    return ix.phrase_hits(spark, _indexed(spark, sf), phrases)


@query("e2_indexed_tier_waterfall", "SELECT term_id, k_number, label AS match_mode FROM v_match", ("v_match",))
def e2_indexed(spark, sf):
    """All tiers from the kept index."""
    sat = ix.satisfied_clauses(spark, _indexed(spark, sf), pl.compile_terms(v.terms(spark, sf)))
    return m.tier_waterfall(m.union_tiers(sat)).select("term_id", "k_number", "match_mode")


def _standing(spark, sf):
    """Terms watched before and after devices arrive in three batches; every second device came with
    another name first. Returns the folder and the number of the commit before the last batch."""
    base, devices, terms = scratch_dir(spark, "standing"), v.devices(spark, sf), v.terms(spark, sf)
    part = lambda n, key: F.pmod(F.xxhash64(key), F.lit(n))
    early = devices.withColumn("device_name", F.concat(F.lit("antibody "), "device_name"))
    landed = f"{base}/landed"
    sd.watch(spark, base, terms.filter(part(2, "term_id") == 0))
    early.filter(part(2, "k_number") == 0).coalesce(1).write.parquet(f"{landed}/0")
    sd.fold(spark, base, spark.read.schema(devices.schema).parquet(f"{landed}/0"))
    sd.watch(spark, base, terms.filter(part(2, "term_id") == 1))
    before = cm.state(spark, base).number
    devices.repartition(2, part(2, "k_number")).write.parquet(f"{landed}/1")
    stream = spark.readStream.schema(devices.schema).option("maxFilesPerTrigger", 1).parquet(f"{landed}/1")
    rf.follow(stream, base, f"{base}/progress").awaitTermination()
    return base, before


@query("i2_standing_searches", "SELECT term_id, k_number, label AS match_mode FROM v_match", ("v_match",))
def i2(spark, sf):
    """Kept searches met by new and by changed devices, batch by batch: as one search over all."""
    base, _ = _standing(spark, sf)
    return sd.matches(spark, cm.state(spark, base)).select("term_id", "k_number", "match_mode")


@query("i2_standing_changes", "SELECT term_id, k_number, label AS now FROM v_match", ("v_match",))
def i2_changes(spark, sf):
    """The matches before the last batches with what has changed since put in."""
    base, before = _standing(spark, sf)
    keys = ["term_id", "k_number"]
    held = sd.matches(spark, cm.state(spark, base, before)).select(*keys, F.col("match_mode").alias("now"))
    news = sd.changed(spark, base, before)
    return held.join(news, keys, "left_anti").unionByName(news.filter("now IS NOT NULL").select(*keys, "now"))


def _untidy(spark, sf):
    """Records with keys that are missing or name several of them."""
    key = F.when(F.col("doc_id") % 3 > 0, F.expr("printf('K%06d', doc_id - doc_id % 5)"))
    d = v.table(spark, sf, "documents").select("doc_id", key.alias("key"))
    return v.devices(spark, sf).join(d, F.col("k_number") == v.number("doc_id")).select(
        F.col("key").alias("k_number"), "device_name", "statement_or_summary", "openfda_device_names")


for _name, _small in (("c8_hits_with_untidy_keys", True), ("c8_hits_with_untidy_keys_large_plan", False)):
    @query(_name, """
      SELECT coalesce(CASE WHEN doc_id % 3 > 0 THEN printf('K%06d', doc_id - doc_id % 5) END, '-') AS k_number, term_id, tier, count(*) AS n
      FROM v_sat JOIN documents ON k_number = printf('K%06d', doc_id) GROUP BY ALL""", ("v_sat",))
    def c8_untidy(spark, sf, small=_small):
        clauses = pl.compile_terms(v.terms(spark, sf))
        sat = m.satisfied_clauses(m.searchable(_untidy(spark, sf)), clauses, small=small)
        return sat.groupBy("k_number", "term_id", "tier").agg(F.count("*").alias("n")).withColumn("k_number", F.coalesce("k_number", F.lit("-")))


# -- registry ---------------------------------------------------------------------------


@query("b12_exclude_bare_instruments", "SELECT p_partkey FROM v_registry WHERE NOT bare", ("v_registry",))
def b12(spark, sf):
    return ev.exclude_bare_instruments(v.registry(spark, sf)).select("p_partkey")


@query("c11_registry_hits", "SELECT term_id, k_number FROM v_reg_hits", ("v_reg_hits",))
def c11(spark, sf):
    return ev.registry_hits(v.registry_terms(spark, sf), v.registry(spark, sf))


@query("c11_registry_hits_large_plan", "SELECT term_id, k_number FROM v_reg_hits", ("v_reg_hits",))
def c11_large(spark, sf):
    return ev.registry_hits(v.registry_terms(spark, sf), v.registry(spark, sf), small=False)


_CONF = """v_conf AS (SELECT t.term_id, m.k_number FROM v_matches m JOIN v_reg_terms t USING (term) WHERE confidence = 'confirmed')"""


def _confirmed(spark, sf):
    facts = v.submission_matches(spark, sf).filter(F.col("confidence") == "confirmed")
    return facts.join(v.registry_terms(spark, sf).select("term", "term_id"), "term").select("term_id", "k_number")


@query("c3_new_registry_numbers", """
  SELECT term_id, k_number FROM v_reg_hits h WHERE NOT EXISTS (
    SELECT 1 FROM v_matches m JOIN v_reg_terms t USING (term)
    WHERE confidence = 'confirmed' AND t.term_id = h.term_id AND m.k_number = h.k_number)""", ("v_reg_hits", "v_matches"))
def c3(spark, sf):
    found = ev.registry_hits(v.registry_terms(spark, sf), v.registry(spark, sf))
    return ev.new_registry_numbers(found, _confirmed(spark, sf))


@query("c4_resolve_numbers", """
  SELECT h.term_id, h.k_number, d.applicant, d.decision_description FROM v_reg_hits h JOIN v_sub_devices d USING (k_number)""",
       ("v_reg_hits", "v_sub_devices"))
def c4(spark, sf):
    found = ev.registry_hits(v.registry_terms(spark, sf), v.registry(spark, sf))
    return ev.resolve_numbers(found, v.submission_devices(spark, sf)).select(
        "term_id", "k_number", "applicant", "decision_description")


# -- citations --------------------------------------------------------------------------

_HOP_SQL = """SELECT term_id, k_number, via_k_number, hop FROM (
  SELECT * FROM v_hop1 UNION ALL SELECT * FROM v_hop2 UNION ALL SELECT * FROM v_hop3)"""


def _hops() -> None:
    from workload.sql import CTE

    seen = "SELECT term_id, k_number FROM v_seeds"
    previous = "v_seeds"
    for hop in (1, 2, 3):
        CTE[f"v_hop{hop}"] = (
            ["v_seeds", "v_edges", *([f"v_hop{hop - 1}"] if hop > 1 else [])],
            f"""SELECT f.term_id, e.device_k AS k_number, min(f.k_number) AS via_k_number, {hop} AS hop
                FROM {previous} f JOIN v_edges e ON e.predicate_k = f.k_number
                WHERE (f.term_id, e.device_k) NOT IN ({seen}) GROUP BY 1, 2""",
        )
        seen += f" UNION ALL SELECT term_id, k_number FROM v_hop{hop}"
        previous = f"v_hop{hop}"


_hops()


@query("c5_propagate_citations", _HOP_SQL, ("v_hop3",))
def c5(spark, sf):
    return gr.propagate_citations(v.citation_seeds(spark, sf), cut_lineage(v.edges(spark, sf)))


@query("c5_citations_by_change", _HOP_SQL, ("v_hop3",))
def c5_by_change(spark, sf):
    """Half of the edges and some seeds that go again, then the others: as if from all at once."""
    base, some = scratch_dir(spark, "citing"), F.pmod(F.xxhash64("k_number"), F.lit(2)) == 0
    seeds = v.citation_seeds(spark, sf).select("term_id", "k_number")
    edges = cut_lineage(v.edges(spark, sf)).select("device_k", "predicate_k")
    half = F.pmod(F.xxhash64("device_k"), F.lit(2)) == 0
    wrong = seeds.filter(some).withColumn("term_id", (F.col("term_id") % 7 + 1).cast(seeds.schema["term_id"].dataType))
    gone = lambda yes: F.lit(yes).alias("gone")
    turned = edges.filter(~half).select(F.col("predicate_k").alias("device_k"), F.col("device_k").alias("predicate_k"))
    ci.advance(spark, base, seeds.filter(some).unionByName(wrong).select("*", gone(False)), edges.filter(half).unionByName(turned).select("*", gone(False)))
    ci.advance(spark, base, seeds.filter(~some).select("*", gone(False)).unionByName(wrong.join(seeds, ["term_id", "k_number"], "left_anti").select("*", gone(True))),
               edges.select("*", gone(False)).unionByName(turned.join(edges, ["device_k", "predicate_k"], "left_anti").select("*", gone(True))))
    return ci.reached(spark, cm.state(spark, base))


@query("e5_pick_via", """
  SELECT f.term_id, e.device_k AS k_number, min(f.k_number) AS via_k_number
  FROM v_seeds f JOIN v_edges e ON e.predicate_k = f.k_number GROUP BY 1, 2""", ("v_seeds", "v_edges"))
def e5(spark, sf):
    seeds = v.citation_seeds(spark, sf).withColumnRenamed("k_number", "predicate_k")
    cited = v.edges(spark, sf).withColumnRenamed("device_k", "k_number").join(seeds, "predicate_k")
    return gr.pick_via(cited)


# -- expansion of terms -----------------------------------------------------------------


@query("c6_resolve_expansions", """
  SELECT p.term_key,
    CASE WHEN c.term_key IS NOT NULL THEN c."full" WHEN m."full" IS NOT NULL THEN m."full" ELSE t."full" END AS "full",
    CASE WHEN c.term_key IS NOT NULL THEN c.search WHEN m."full" IS NOT NULL THEN m.search END AS search,
    CASE WHEN c.term_key IS NOT NULL THEN c.source WHEN m."full" IS NOT NULL THEN 'local-llm'
      WHEN t."full" IS NOT NULL THEN 'umls' ELSE 'none' END AS source,
    CAST(c.term_key IS NOT NULL AS INT) AS cached
  FROM (SELECT p_name || ' ' || p_partkey AS term_key FROM part) p LEFT JOIN v_cache c USING (term_key)
    LEFT JOIN v_model m USING (term_key) LEFT JOIN v_terminology t USING (term_key)""", ("v_cache", "v_model", "v_terminology"))
def c6(spark, sf):
    keys = v.table(spark, sf, "part").select(v.reply_key().alias("term_key"))
    out = rs.resolve_expansions(keys, v.expansion_cache(spark, sf), v.model_replies(spark, sf), v.terminology_replies(spark, sf))
    return out.withColumn("cached", F.col("cached").cast("int"))
