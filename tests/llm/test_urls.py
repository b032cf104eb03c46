"""The URL filter against a dense solution of both ranks, and on odd rows."""

import numpy as np
import pytest

from weftspark.llm import urlgraph

PAGES = "page_id long, url string, html string, host int, score string, rule string"


def dense(hosts, links, seeds):
    """PageRank with restart at the seeds, also from hosts without links, by solving the linear system."""
    n = len(hosts)
    p = np.zeros((n, n))
    for (a, b), k in links.items():
        p[hosts.index(b), hosts.index(a)] = k
    mass = np.array([seeds.get(h, 0) for h in hosts], float)
    if not mass.sum():
        return dict.fromkeys(hosts, 0.0)
    total, mass = mass.sum(), mass / mass.sum()
    out = p.sum(0)
    p[:, out > 0] /= out[out > 0]
    p[:, out == 0] = mass[:, None]
    x = np.linalg.solve(np.eye(n) - 0.85 * p, 0.15 * mass)
    return dict(zip(hosts, total * x))


def link(*to):
    return "".join(f'<a href="https://{t}/">x</a>' for t in to)


GRAPHS = {
    "sink beside": [("g.net/de/", ["x.test", "h.test"]), ("h.test/", ["g.net"]), ("x.test/", ["b.com"]), ("b.com/en/", [])],
    "ring": [("g.net/de/", ["x.test"]), ("x.test/", ["b.com"]), ("b.com/en/", ["c.test"]), ("c.test/", ["b.com"])],
}


@pytest.mark.parametrize("name", [*GRAPHS, 1])
def test_ranks_equal_a_dense_solution(spark, name):
    if name in GRAPHS:
        pages = GRAPHS[name]
    else:
        rng = np.random.default_rng(name)
        names = [f"h{i}.test" for i in range(9)] + ["g.net", "k.net", "b.com"]
        path = lambda h: "/de/1" if h.endswith(".net") else "/en/1" if h.endswith(".com") else "/p"
        pages = [(h + path(h), list(rng.choice(names, rng.integers(0, 4), replace=False))) for h in rng.choice(names, 30)]
    rows = spark.createDataFrame([(i, "https://" + u, link(*to), 0, "", "") for i, (u, to) in enumerate(pages)], PAGES)
    got = urlgraph.judge(rows).collect()
    hosts = sorted({u.split("/")[0] for u, _ in pages} | {t for _, to in pages for t in to})
    links, good, bad = {}, {}, {}
    for u, to in pages:
        h = u.split("/")[0]
        kind = good if h.endswith(".net") and "/de/" in u else bad if h.endswith(".com") and "/en/" in u else {}
        kind[h] = kind.get(h, 0) + 1
        for t in set(to) - {h}:
            links[h, t] = links.get((h, t), 0) + 1
    trust, distrust = dense(hosts, links, good), dense(hosts, {(b, a): n for (a, b), n in links.items()}, bad)
    for r in got:
        assert (r.trust, r.distrust) == pytest.approx((trust[r.host], distrust[r.host]), abs=1e-7)
        if r.rule is None:
            assert r.verdict == ("block" if distrust[r.host] > trust[r.host] else "allow")
    if name in GRAPHS:
        assert {r.host: r.verdict for r in got}["x.test"] == ("allow" if name == "sink beside" else "block")


def test_odd_urls(spark):
    long = "https://a.com/en/" + "x" * 100_000
    rows = [(1, None, None), (1, None, None), (None, "http://a.com/en/", ""), (2, "x.com/en/", ""), (3, long, None), (4, "http://com/en/?q#f", ""), (5, "http://bcom/en/", ""), (6, "http://EXAMPLE.com/en/7", ""), (7, "http://a.example.net/de/8?x", ""), (8, "http://é.org/es/", ""), (9, "http://h.net#/de/", ""), (10, "a://b://c.com/en/", ""), (11, "http://com/EN/", "")]
    got = {(r.page_id, r.path): r for r in urlgraph.judge(spark.createDataFrame([(*r, 0, "", "") for r in rows], PAGES)).collect()}
    rules = {k: (r.host, r.rule, r.verdict) for k, r in got.items()}
    assert len(rules) == len(rows) - 1 and rules[1, ""] == ("", None, "allow")
    assert rules[None, "/en/"] == ("a.com", "com/en/", "block") and rules[2, ""] == ("", None, "allow") and rules[3, "/en/" + "x" * 100_000][1] == "com/en/"
    assert rules[4, "/en/"] == ("com", "com/en/", "block") and rules[5, "/en/"] == ("bcom", None, "allow") and rules[6, "/en/7"] == ("example.com", "example.com/en/7", "allow")
    assert rules[7, "/de/8"] == ("a.example.net", "example.net/de/8", "block") and rules[8, "/es/"] == ("é.org", "org/es/", "block") and rules[9, ""] == ("h.net", None, "allow")
    assert rules[10, "//c.com/en/"] == ("b:", None, "allow") and rules[11, "/EN/"][1] is None
    none = urlgraph.judge(spark.createDataFrame([], PAGES))
    assert none.count() == 0 and none.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
