import pytest
from pyspark.sql import functions as F

from routelake.llm import url_filter
from routelake.llm.queries import URL_RULES
from routelake.llm.url_filter import Cascade, filter_urls, parse_rules

URLS = ["http://A.Example.ORG/es/1?x=/de/", "https://example.org/en/1", "https://example.org/en/2#t", "ftp://x.org", "http://org/", "http://a.com/fr/z", "http://com/de/",
        "http://notcom/de/", "http://a.b.com/de", "no url", None, "", "://", "http://a.org/é?://b.com/de/", "http://.com/fr/", "http://example.org/en/1"]


def brute(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host):].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or (len(rule), verdict) > (len(best[1]), best[0])):
            best = verdict, rule
    return host, path, best[1] if best else None, best[0] if best else default


@pytest.mark.parametrize("bits", [None, 0])
def test_equals_brute_force(spark, monkeypatch, bits):
    if bits is not None:  # lists over the bound are joined
        monkeypatch.setattr(url_filter, "MAX_LIST_BITS", bits)
    rules = URL_RULES + [("allow", "example.org/en/1"), ("block", "b.com/")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, rule string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, parse_rules(spark, rules)).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS)}


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = parse_rules(spark, URL_RULES).where("false")
    assert [(r.rule, r.verdict) for r in filter_urls(pages, none).collect()] == [(None, "allow")]
    assert filter_urls(pages.where("false"), parse_rules(spark, URL_RULES)).collect() == []


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_RATE", 0.5)  # many false positives: several levels
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(0, 3000, 17).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = Cascade(listed, universe)
    assert len(cascade.levels) > 2
    got = {r.key for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {f"k{i}" for i in range(0, 3000, 17)}
