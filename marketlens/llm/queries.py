"""One query per operator, over whole tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import chat, collocations, langid, lexical, licenses, multiset, neighbours, packing, pitman_yor, simhash, toxicity, urls, winnowing
from marketlens.llm.letters import remainder
from marketlens.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: (ship_package(spark), fn(spark, sf_dir))[1]
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = rf"regexp_extract_all({ascii_lower('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_winnowing", f"""
  WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
  i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  iw AS (SELECT item_id, least(len(w), 10) AS n, list_aggregate(w[p : p + least(len(w), 10) - 1], 'string_agg', ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM i WHERE len(w) > 0)),
  dw AS (SELECT doc_id, n, p, list_aggregate(w[p : p + n - 1], 'string_agg', ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
  m AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN iw USING (n, g)),
  hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM m) GROUP BY 1),
  named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY 1)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op1(spark, sf_dir):
    found = winnowing.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_simhash")
def op2(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@query("op4_multiset")
def op4(spark, sf_dir):
    return multiset.compare_with_edited(table(spark, sf_dir, "documents"))


def tokenizer(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = toxicity.training_rows(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    found = toxicity.scored(docs.select("doc_id", "text"), toxicity.train(rows))
    return found.select(
        "doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.3).cast("int").alias("predicted"))


@query("op7_language")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identified(docs.select("doc_id", "text"), langid.train(docs, remainder("doc_id", 3) != 1))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"),
                        F.col("lang_odd").alias("odd"), langid.rejected().alias("rejected"))


@query("op9_pitman_yor")
def op9(spark, sf_dir):
    return pitman_yor.score(table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)


# The rules of the query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query("op10_urls")
def op10(spark, sf_dir):
    found = urls.judged(table(spark, sf_dir, "pages").select("page_id", "url"), urls.train(urls.labelled_urls(spark)), URL_RULES)
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op3_licenses")
def op3(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.templates(spark))


_CHAT = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations"
_TRIAL = r"\### Assistant: </turn> ok"  # fixed: the text of conversation -7


def _extra(x: str) -> str:
    return f"(2 * length({x}) - length(replace({x}, '\\', '')) - length(replace({x}, '<', '')))"


@query("op6_chat", f"""
  WITH c AS ({_CHAT} UNION ALL SELECT -7, 0, 'user', '{_TRIAL}' UNION ALL SELECT -7, 1, 'assistant', '{_TRIAL}')
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(role) + {_extra("role")} + length(text) + {_extra("text")} + {len(chat.OPEN) + 1 + len(chat.CLOSE)}) AS BIGINT) AS formatted_chars
  FROM c GROUP BY conv_id""")
def op6(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.createDataFrame([(-7, 0, "user", _TRIAL), (-7, 1, "assistant", _TRIAL)], given.schema)
    return chat.read_back(chat.prefix_tree(given.union(trial), tokenizer()), tokenizer())


_PHRASE_F = """
  p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(%s, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
  w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
  g AS (SELECT lang, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
  n AS (SELECT lang, count(*) AS n FROM g GROUP BY 1),
  f1 AS (SELECT lang, a, count(*) AS f FROM g GROUP BY ALL),
  f2 AS (SELECT lang, a, b, count(*) AS f FROM g WHERE b IS NOT NULL GROUP BY ALL),
  f3 AS (SELECT lang, a, b, c, count(*) AS f FROM g WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10)""" % ascii_lower("text")


@query("op11_collocations", f"""
  WITH {_PHRASE_F},
  inside AS (SELECT lang, a, b, max(f) AS most FROM (SELECT lang, a, b, f FROM f3 UNION ALL SELECT lang, b, c, f FROM f3) GROUP BY 1, 2, 3),
  short AS (SELECT f2.lang, a || ' ' || b AS phrase, f2.f AS a, x.f AS l, y.f AS r
    FROM f2 JOIN f1 x USING (lang, a) JOIN (SELECT lang, a AS b, f FROM f1) y USING (lang, b) LEFT JOIN inside USING (lang, a, b)
    WHERE f2.f >= 10 AND (most IS NULL OR 100 * most < 50 * f2.f)),
  cuts AS (SELECT lang, a || ' ' || b || ' ' || c AS phrase, f3.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2
    FROM f3 JOIN f1 x USING (lang, a) JOIN (SELECT lang, a AS b, b AS c, f FROM f2) yz USING (lang, b, c)
      JOIN f2 xy USING (lang, a, b) JOIN (SELECT lang, a AS c, f FROM f1) z USING (lang, c)),
  scored AS (SELECT lang, phrase, a, l, r, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS score FROM short
    UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
    FROM (SELECT *, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l1 AS HUGEINT) * r1) AS s1, (CAST(1000000 AS HUGEINT) * a * a) // (CAST(l2 AS HUGEINT) * r2) AS s2 FROM cuts))
  SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored) JOIN n USING (lang) WHERE rank <= 2000""")
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))


_TERMS = rf"regexp_extract_all({ascii_lower('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_lexical", f"""
  WITH t AS (SELECT doc_id, unnest({_TERMS}) AS w FROM documents),
  tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY ALL),
  dn AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
  g AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM dn),
  df AS (SELECT w, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, g GROUP BY w, nn),
  it AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS w FROM benchmark),
  m AS (SELECT doc_id, 10 + (90 * n * nn) // ll AS m FROM dn, g),
  s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM it JOIN df USING (w) JOIN tf USING (w) JOIN m USING (doc_id) GROUP BY ALL)
  SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
  FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10""")
def op12(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op13_neighbours")
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = neighbours.training_rows(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    found = neighbours.scored(docs, neighbours.train(rows, neighbours.rarity(docs)))
    return found.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
