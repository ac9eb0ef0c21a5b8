import re

import pytest

from lakeloom.llm.url_filter import HOST_RULES, WORD_RULES, Rule, filter_urls, host_rule

URLS = [
    "http://a.net/x", "http://A.Example.NET/en/x", "https://example.com/de/", "https://example.com/de", "http://b.example.com/de/x?y=/en/", "http://x.org/fr/a#b", "http://x.org/FR/a",
    "http://notnet/x", "http://net", "http://net/", "http://net?x=/", "ftp://casino-win.example.com/a", "http://mycasino.example.com/", "no-scheme.net/", "", None, "://", "a://b://c.net/d",
    "http://example.net:80/en/", "http://ex.ample.net/en/x\ny", "http://münchen.net/", "http://evil.net" + "/a" * 5000, "http://bets.casino.io/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url is not None and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if re.search(r.pattern, host + path)]
    best = min(fits, key=lambda r: (r.tier, -r.weight, r.name), default=None)
    return host, path, best and best.name, best.action if best else default


def test_every_url_against_every_rule(spark):
    df = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "y", 2), (None, URLS[1], "z", 3)], "page_id long, url string, host string, verdict int")
    rules = [*HOST_RULES, *WORD_RULES, Rule("any-long", "block", r"^.{2000,}", (), 0, 1), host_rule("x.org", "/f", "block")]
    got = filter_urls(df, rules)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    want = [(i, *brute(u, rules)) for i, u in enumerate(URLS)] + [(0, *brute(URLS[0], rules)), (None, *brute(URLS[1], rules))]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_rule_without_path_ends_at_the_host(spark):
    df = spark.createDataFrame([(1, "http://a.com"), (2, "http://a.com.org/")], "page_id long, url string")
    got = {r.page_id: r.rule for r in filter_urls(df, [host_rule("a.com", "", "block")]).collect()}
    assert got == {1: "a.com", 2: None}


@pytest.mark.parametrize("rules", [[], list(HOST_RULES)])
def test_empty_table_and_no_rules(spark, rules):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(empty, rules).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert filter_urls(some, rules).first().verdict == ("block" if rules else "allow")
