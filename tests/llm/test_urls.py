import re

import pytest

from marketlens.llm import urls
from marketlens.llm.queries import QUERIES, URL_RULES

URLS = [None, "", "no scheme", "http://", "HTTPS://WWW.Example.NET/en/1", "http://example.net/EN/1", "http://example.net/en", "ftp://a.b.net", "http://net/x", "http://anet/x",
        "http://example.com/de/?q=/fr/", "http://m.example.com?x=://y/de/", "http://example.com#/de/", "http://x.org/fr/a/b#c", "http://org/fr/", "http://xorg/fr/", "x://y://z/w",
        "http://Ünï.example.NET/de/", "http://" + "a" * 100_000 + ".net/" + "b" * 100_000, "http://example.net/en/\n?x"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = (None, None)
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return host, path, *best


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_hosts_paths_and_rules_equal_brute_force(spark, model):
    pages = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(URLS)] * 2 + [(None, URLS[4], "kept")], "page_id long, url string, rule string")
    rows = urls.judged(pages, model, URL_RULES).collect()
    assert len(rows) == 2 * len(URLS) + 1
    for r in rows:
        host, path, rule, verdict = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert urls.judged(pages.limit(0), model, URL_RULES).count() == 0


def test_learned_verdicts(spark, model):
    spam = ["http://cheap-pills.shop.example/x", "https://www.casino-online.example.com/en/3", "http://m.free-bets.example.org/1", "http://spamfarm.example.org/", "https://ads-tracker.example.com/a"]
    plain = ["http://ththre.example.com/fr/825?page=2", "https://blog.theron.example.org/es/5", "http://www.botany.example.com/leaves", "https://reading.example.org/shelf/2", None]
    rows = urls.judged(spark.createDataFrame([(u,) for u in spam + plain], "url string"), model, []).collect()
    assert [r.verdict for r in rows] == ["block"] * 5 + ["allow"] * 5
    untrained = urls.train(urls.labelled_urls(spark).limit(0))
    assert {r.verdict for r in urls.judged(spark.createDataFrame([(u,) for u in spam], "url string"), untrained, []).collect()} == {"allow"}


def test_query_on_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op10_urls"](spark, sf).collect()
    names = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "adult-x", "ads-track")
    free = [r for r in rows if r.rule is None]
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert all((r.verdict == "block") == any(n in r.host for n in names) for r in free)
