"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens.llm.letters import gram_hash

BITS = 18  # of a feature's hash
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The small labelled table, 1 for pages to leave out.
BLOCKED_URLS = """
http://spam-farm.example/en/1
https://www.spamlinks.example/offers/best
http://seo-spam.example/links
http://link-farm.example/page/2
https://cheap-pills.example/buy
http://buy-pills-online.example/viagra
https://discount-pharmacy.example/no-prescription
http://cheap-meds.example/order/cialis
https://casino-win.example/slots
http://online-casino.example/bonus
https://lucky-casino.example/jackpot
http://poker-bets.example/play
https://free-bets.example/odds
http://sports-betting.example/bet-now
https://bets-bonus.example/free-spins
https://win-big.example/casino
http://adult-x.example/videos
https://adult-cams.example/live
http://xxx-porn.example/hot
https://sexy-adult.example/gallery
https://ads-track.example/click
http://ad-tracker.example/pixel.gif
https://ads-server.example/banner
http://track-ads.example/redirect
https://click-ads.example/popup
http://free-prizes.example/winner
https://win-free-iphone.example/claim
http://payday-loans.example/fast-cash
https://easy-cash.example/get-rich
http://crypto-giveaway.example/double
https://cheap-replica.example/watches
http://replica-bags.example/cheap
https://free-download-crack.example/keygen
http://warez-crack.example/serial
https://malware-download.example/setup.exe
http://phish-login.example/verify-account
https://clickbait-spam.example/shocking
http://miracle-diet-pills.example/weight-loss
""".split()
ALLOWED_URLS = """
https://www.weather.example/en/today
http://news.example/world/article/12
https://blog.gardening.example/posts/tomatoes
https://m.recipes.example/bread
http://www.library.example/catalogue/734
https://en.encyclopedia.example/wiki/Mathematics
https://docs.software.example/guide/install.html
http://university.example/departments/physics
https://museum.example/de/ausstellung/3
https://blog.travelling.example/fr/voyage
http://www.thethings.example/en/27
https://nation.example/station/ration
https://m.weathering.example/es/noticias/88
http://www.orchestra.example/events?page=2
https://theatre.example/season/tickets
http://history.example/en/853/
https://cooking.example/es/cocina/41.html
https://blog.tothe.example/en/374
http://other.example/en/685
https://themes.example/article/25#top
https://www.hospital.example/contact
http://school.example/timetable
https://blog.engineering.example/bridges
http://forum.photography.example/thread/990
https://shipping.example/harbour
http://www.handwriting.example/letters
https://winter.example/snow
http://tracks.example/railway/history
https://window.example/glass
http://freedom.example/rights
https://addresses.example/streets
http://betterworld.example/projects
https://alphabet.example/learn
http://expertise.example/papers
https://m.northern.example/de/532
http://www.eastern.example/fr/414
https://rainforest.example/species/tree-frog
http://council.example/minutes/2019
""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``, some hundreds at most) that fits, and its verdict.

    A rule fits its host and the subdomains, if the path starts with the rule's. Of fitting rules
    of equal length the first in the alphabet counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        where, slash, start = name.partition("/")
        fits = ((host == where) | F.endswith(host, F.lit("." + where))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def features(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all hosts and paths, with their row; a gram counts once in a row, and
    those of host and path are told apart."""
    rows, grams = [], []
    for kind, column, mark in ((0, hosts, "^"), (1, paths, "/")):
        texts = [f"\0{mark}{t or ''}$" for t in column.to_pylist()]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
        row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        for n in GRAMS:
            h = gram_hash(codes, n)
            own = (row[: len(h)] == row[n - 1 :]) & (codes[: len(h)] != 0)
            rows.append(row[: len(h)][own])
            grams.append(((h[own] + np.uint64(kind)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))
    pair = np.unique(np.concatenate(rows) * (1 << BITS) + np.concatenate(grams).astype(np.int64))
    return pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        row, gram = features(hosts, paths)
        z = np.bincount(row, self.weights[gram], len(hosts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table ``(url, label)``."""
    return spark.createDataFrame([(u, 1) for u in BLOCKED_URLS] + [(u, 0) for u in ALLOWED_URLS], "url string, label int")


def train(labelled: DataFrame, at_most: int = 100_000, rounds: int = 300, penalty: float = 1e-3) -> UrlModel:
    """Logistic regression by gradient steps on a small table ``(url, label)``; beyond
    ``at_most`` rows those whose URL has the least hash. Rows without label are left out."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.filter("label IN (0, 1)").select(host.alias("host"), path.alias("path"), "label", F.xxhash64("url").alias("h"))
    rows = rows.orderBy("h").limit(at_most).toArrow()
    label = rows.column("label").to_numpy().astype(float)
    w, b = np.zeros(1 << BITS), 0.0
    if not len(label):
        return UrlModel(w, -1.0)
    row, gram = features(rows.column("host").combine_chunks(), rows.column("path").combine_chunks())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[gram], len(label)) + b, -30, 30)))
        gap = (p - label) / len(label)
        w -= 2.0 * (np.bincount(gram, gap[row], 1 << BITS) + penalty * w)
        b -= 0.5 * gap.sum()
    return UrlModel(w, float(b))


def judged(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], url: str = "url", limit: float = 0.5) -> DataFrame:
    """The frame's columns and ``host, path, url_score, rule, verdict``: the rule's verdict, or
    ``block`` from a score of ``limit`` on, else ``allow``. Columns of these names are replaced.
    A null URL, or one without ``://``, has empty host and path and is judged like any."""
    made = ("host", "path", "url_score", "rule", "verdict")
    kept = [c for c in pages.columns if c not in made]
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    body = pages.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)), host.alias("host"), path.alias("path"))
    schema = T.StructType([*body.schema.fields, T.StructField("url_score", T.DoubleType())])
    shared = pages.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 10_000):
                part = batch.slice(lo, 10_000)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(part.column("host"), part.column("path")))], names=schema.names)

    scored = body.mapInArrow(run, schema)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("url_score") >= limit, "block").otherwise("allow")
    out = scored.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own))
    return out.toDF(*kept, *made)
