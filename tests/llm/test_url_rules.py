from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from geotext.llm import url_rules
from geotext.llm.url_rules import RULES, judge_urls, rules_of


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cutoff = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cutoff], rest[cutoff:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [
        r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])
    ]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[0])), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?q=://a/b#c",
    "https://example.com/en", "https://example.com/en/", "https://a.example.com/en/1", "http://x.net/fr/#y",
    "http://net/es/", "http://notnet/es/", "http://x.net/e", "http://a.com?x=/en/", "ftp://é.COM/Ü",
    "http://example.com./en/", "a://b://c.com/en/", "http://a.com/\n?x", "http://example.com" + "/en" * 5000,
]


@pytest.mark.parametrize("block_rules", [200_000, 2])
def test_against_brute(spark, block_rules):
    rules = [*RULES, ("example.com", "", "block"), ("b.example.com", "/e", "allow"), ("x.net", "/fr", "allow")]
    maker = random.Random(3)
    hosts = ["example.com", "www.example.com", "b.example.com", "x.net", "net", "org"]
    urls = URLS + [f"http://{maker.choice(hosts)}{maker.choice(['', '/', '/e', '/en', '/en/', '/fr/x', '/es/'])}" for _ in range(80)]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] * 2, "page_id int, url string, host string")
    got = judge_urls(pages, rules, block_rules=block_rules).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url, rules)


def test_default_and_no_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.org/"), (2, None)], "page_id int, url string")
    assert {r.verdict for r in judge_urls(pages, RULES, default="block").collect()} == {"block"}
    assert {r.rule for r in judge_urls(pages, []).collect()} == {None}
    assert judge_urls(pages.where(F.lit(False)), RULES).count() == 0


def test_rules_of():
    lines = ["allow com/", "", "block example.com/en/"]
    assert list(rules_of(lines)) == [("com", "/", "allow"), ("example.com", "/en/", "block")]
    with pytest.raises(ValueError):
        list(rules_of(["com/ allow"]))


def test_query_is_registered():
    assert url_rules.op7_url_rules


def test_many_rules_on_one_host_cost_a_look_up_for_each_length():
    rules = [("a.com", f"/user{i}", "block") for i in range(50_000)] + [("a.com", "/", "allow"), ("a.com", "/user", "allow")]
    trie = url_rules.build_trie(rules)
    node = trie.below["com"].below["a"].paths.below[""]
    assert len(node.tails) == 50_002 and node.lengths == [0, *range(4, 10)]
    for i in range(0, 60_000, 777):
        path = f"/user{i}x/y"
        want = max((p for _, p, _ in rules if path.startswith(p)), key=len)
        assert url_rules.longest_match(trie, "b.a.com", path)[0] == "a.com" + want
    assert url_rules.longest_match(trie, "a.com", "/use") == ("a.com/", "allow")
    assert url_rules.longest_match(trie, "a.com", "") is None
