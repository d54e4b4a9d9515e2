"""Propagation of trust and distrust against a dense power iteration."""
import random

import numpy as np

from lectern.llm import url_graph


def dense(pages, verdicts, damping=0.85):
    """Scores (trust, distrust) of every host from the full matrices."""
    host = lambda u: u.split("://", 1)[1].split("/", 1)[0].lower() if u and "://" in u else ""
    edges = {}

    def add(a, b):
        edges[a, b] = edges.get((a, b), 0) + 1
    names = set()
    for _, url, links in pages:
        if host(url):
            names.add(host(url))
            for link in links:
                to = link.split("//", 1)[1].split("/", 1)[0].lower() if "//" in link else host(url)
                add(host(url), to)
                names.add(to)
    ties = set()
    for h in names:
        while "." in h:
            up = h.split(".", 1)[1]
            ties.add((h, up))
            h = up
    for a, b in ties:
        add(a, b)
        add(b, a)
    hosts = sorted({x for e in edges for x in e} | names)
    at = {h: i for i, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for (a, b), w in edges.items():
        m[at[a], at[b]] += w
    out = []
    for kind, matrix in (("allow", m / np.maximum(m.sum(1, keepdims=True), 1e-300)), ("block", (m / np.maximum(m.sum(0), 1e-300)).T)):
        seed = np.zeros(len(hosts))
        for _, url, _ in pages:
            if host(url) and verdicts.get(url) == kind:
                seed[at[host(url)]] += 1
        seed /= max(seed.sum(), 1)
        x = seed
        for _ in range(400):
            x = (1 - damping) * seed + damping * x @ matrix
        out.append(x)
    return {h: (out[0][i], out[1][i]) for h, i in at.items()}


def test_against_a_dense_power_iteration(spark):
    rng = random.Random(6)
    hosts = ["a.com", "b.example.com", "f.net", "g.h.net", "x.org", "y.x.org", "deep.a.b.c.d.e.x.org", "q.io", "r.q.io", "solo.dev", "z.info", "f.z.info"]
    pages = []
    for i in range(160):
        h = rng.choice(hosts[:4] * 2 + hosts)
        links = [f"http://{rng.choice(hosts)}/p{j}" for j in range(rng.randint(0, 3))] + rng.choice([[], ["/own"]])
        pages.append((i, f"http://{h}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}", links))
    table = spark.createDataFrame([(i, u, " ".join(f'<a class=x href="{x}">t</a>' for x in links), "clash") for i, u, links in pages],
                                  "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_graph.judge_urls(table, tolerance=1e-5).collect()}
    verdicts = {u: got[i].verdict for i, u, _ in pages if got[i].rule}
    scores = dense(pages, verdicts)
    seen = set()
    for i, _, _ in pages:
        if got[i].rule is None:
            good, bad = scores[got[i].host]
            assert abs(good - bad) > 1e-4
            assert got[i].verdict == ("block" if bad > good else "allow")
            seen.add(got[i].verdict)
    assert seen == {"allow", "block"}


def test_distrust_reaches_any_depth_with_or_without_hosts_between(spark):
    far = [(1, "http://f.net/fr/1", ""), (2, "http://a.b.c.d.e.f.net/x", "")]
    for more in ([], [(3, "http://e.f.net/x", "")]):
        got = url_graph.judge_urls(spark.createDataFrame(far + more, "page_id long, url string, html string")).collect()
        assert {r.page_id: r.verdict for r in got}[2] == "block"


def test_odd_hosts_and_very_long_pages(spark):
    pages = [(1, "http://a..b./x", "<a href=//..>"), (2, "http://./", None), (3, None, "x"), (4, "http://q.io", "<a href='/y'>" * 50_000),
             (4, "http://q.io", ""), (None, "http://f.net/es/", "")]
    got = url_graph.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and {r.verdict for r in got} <= {"allow", "block"}
