import random
import time

import pytest

from ruleweave.llm import url_filter as U
from ruleweave.llm.queries import URL_RULES


def brute(url, rules, default="allow"):
    host, path = U.split_url(url)
    fits = [(len(h.split(".")) if h else 0, len(p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h) or not h) and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, default)))


def judged(root, host, path):
    found = U.lookup(root, host, path)
    return found[2:] if found else (None, "allow")


CASES = ["http://a.example.com/en/x?q#f", "https://WWW.Example.COM/en/", "http://www.example.com/english", "http://x.net/es/1", "http://net/fr/", "http://netx/fr/", "ftp://example.com", "http://example.com?x/en/", "http://example.com#", "no scheme/en/", None, "", "http://", "http:///en/", "a://b://c.com/", "http://É.com/x", "http://x.example.com/en"]


@pytest.mark.parametrize("url", CASES)
def test_contract_rules(url):
    host, path = U.split_url(url)
    assert (host, path, *judged(U.build_trie(URL_RULES), host, path)) == brute(url, URL_RULES)


@pytest.mark.parametrize("trie", [200_000, 4])
def test_random_rules_against_brute_force(spark, monkeypatch, trie):
    monkeypatch.setattr(U, "TRIE_RULES", trie)
    rng = random.Random(4)
    hosts, paths = ["com", "a.com", "b.a.com", "net", "", "x.b.a.com"], ["", "/", "/e", "/e/", "/e/f", "/e/f/", "/en"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in [(rng.choice(hosts), rng.choice(paths)) for _ in range(15)]}.values())
    urls = [f"http://{rng.choice(['', 'w.', 'x.b.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'n/g', '?q', '/f/z'])}" for _ in range(300)] + CASES
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    want = sorted((i, *brute(u, rules)) for i, u in enumerate(urls))
    assert sorted(map(tuple, U.judge(df, rules).collect())) == want
    assert U.judge(df.limit(0), rules).count() == 0


def test_same_place_twice_blocks():
    root = U.build_trie([("a.com", "/", "block"), ("a.com", "/", "allow"), ("b.com", "/", "other"), ("b.com", "/", "allow")])
    assert U.lookup(root, "a.com", "/x") == (2, 1, "a.com/", "block")
    assert U.lookup(root, "b.com", "/x") == (2, 1, "b.com/", "allow")


def test_many_paths_under_one_host():
    root = U.build_trie([("a.com", f"/page{i}", "block") for i in range(100_000)])
    began = time.time()
    for i in range(20_000):
        assert U.lookup(root, "www.a.com", f"/page{i}x/y")[1:] == (len(f"/page{i}"), f"a.com/page{i}", "block")
    assert time.time() - began < 5
