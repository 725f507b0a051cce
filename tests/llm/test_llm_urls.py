import random
import re

import pytest

from seqsieve.llm import registry, urls

RULES = [*registry.URL_RULES, ("block", "a.example.org/"), ("allow", "net/x/y/z"), ("block", "net/x/"), ("block", "org/")]


def plain(url, rules):
    if not url or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = []
    for verdict, rule in rules:
        rule_host, rule_path = rule.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rule_path):
            fits.append((len(rule), verdict, rule))
    best = max(fits, default=(0, "allow", None))
    return host, path, best[2], best[1]


def test_trie_equals_plain_rules():
    rng = random.Random(5)
    trie = urls.RuleTrie(RULES)
    hosts = ["org", "example.org", "a.example.org", "b.A.Example.ORG", "net", "x.net", "com", "xcom", "example.org:80", "", "com.", "ünï.com"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/12/3", "/es", "/es/", "/es/5", "/fr/", "/de/x", "/x/", "/x/y/z1", "/x/y/", "//es/"]
    for _ in range(3000):
        url = rng.choice(["http://", "https://", "://", ""]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "?q=/es/", "#/en/1", "?a://b"])
        host, path = urls.split_url(url)
        verdict, rule = trie.judge(host, path) or ("allow", None)
        assert (host, path, rule, verdict) == plain(url, RULES), url


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "http://example.org/es/1", "c"), (4, "nothing", "d"), (4, "nothing", "d"), (6, "http://x.com/de/" + "a" * 100_000, "e")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = urls.judge_urls(pages, registry.URL_RULES).collect()
    assert sorted(map(repr, got)) == sorted(repr(type(g)(page_id=p, **dict(zip(["host", "path", "rule", "verdict"], plain(u, registry.URL_RULES))))) for (p, u, _), g in zip(rows, got))
    assert urls.judge_urls(pages.limit(0), registry.URL_RULES).collect() == []
    with pytest.raises(ValueError):
        urls.RuleTrie([("deny", "a/")])
