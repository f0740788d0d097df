from __future__ import annotations

import numpy as np

from stationflow.llm.queries import URL_RULES
from stationflow.llm.source_urls import host_links, judge_source_urls, propagated

PAGES = "page_id bigint, url string, html string"


def link(*hosts):
    return "".join(f'<a href="https://{h}/x">t</a>' for h in hosts)


def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "https://A.Example.ORG/es/1?q", None), (2, "http://example.org/en/12", ""), (3, "http://example.org", None),
        (4, "x://shop.com/fr/a#b", None), (5, "http://com/de/?x", None), (6, None, None), (7, "no scheme", None),
        (8, "http://notorg/", None), (9, "http://a.org?x/", None), (10, "ftp://k.org/a://b/c", None), (11, "http:///p", None),
    ]
    found = {r.page_id: r for r in judge_source_urls(spark.createDataFrame(rows, PAGES), URL_RULES).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in found.items() if k != 8} == {
        1: ("a.example.org", "/es/1", "example.org/es/", "block"),
        2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("example.org", "", None, "block"),
        4: ("shop.com", "/fr/a", "com/fr/", "allow"),
        5: ("com", "/de/", "com/de/", "block"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        9: ("a.org", "", None, "allow"),
        10: ("k.org", "/a://b/c", "org/", "allow"),
        11: ("", "/p", None, "allow"),
    }
    assert found[8].rule is None


def test_trust_and_distrust_follow_links(spark):
    rows = [
        (1, "http://good.org/a", link("friend.net", "friend.net", "good.org")),
        (2, "http://friend.net/", link("second.net")),
        (3, "http://bad.com/de/1", ""),
        (4, "http://farm.net/", link("bad.com")),
        (5, "http://second.net/", None),
        (6, "http://alone.net/", '<img src="//cdn.net/i.png">'),
    ]
    pages = spark.createDataFrame(rows, PAGES)
    assert {(r[0], r[1], r[2]) for r in host_links(pages).collect()} == {
        ("good.org", "friend.net", 1), ("friend.net", "second.net", 1), ("farm.net", "bad.com", 1), ("alone.net", "cdn.net", 1)
    }
    found = {r.host: r for r in judge_source_urls(pages, URL_RULES).collect()}
    assert {h: r.verdict for h, r in found.items()} == {
        "good.org": "allow", "friend.net": "allow", "bad.com": "block", "farm.net": "block", "second.net": "allow", "alone.net": "allow"
    }
    assert found["friend.net"].trust > found["second.net"].trust > 0 and found["farm.net"].distrust > 0


def test_rank_against_power_iteration(spark):
    rng = np.random.default_rng(7)
    n = 12
    weight = rng.integers(0, 3, (n, n)) * (rng.random((n, n)) < 0.4)
    weight[5] = 0
    edges = [(f"h{i}", f"h{j}", int(weight[i, j])) for i in range(n) for j in range(n) if weight[i, j]]
    seed = np.zeros(n)
    seed[[0, 3]] = 2, 1
    score, start = seed / 3, seed / 3
    step = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1)
    for _ in range(12):
        score = 0.85 * score @ step + 0.15 * start
    found = propagated(
        spark.createDataFrame([("h0", 2.0), ("h3", 1.0)], "host string, seed double"),
        spark.createDataFrame(edges, "source_host string, target_host string, weight bigint"),
    )
    ranks = {r.host: r.score for r in found.collect()}
    assert np.allclose([ranks.get(f"h{i}", 0.0) for i in range(n)], score)
