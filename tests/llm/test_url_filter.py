import re

import numpy as np
import pytest

from tests.llm import frames
from threadloom.llm import url_filter
from threadloom.session import Scratch

PAGES = "page_id long, url string, html string"
URLS = [
    "http://A.Example.COM/en/x", "https://www.example.com/en/1?q", "https://www.example.com/fr/#a", "http://x.net/es/", "http://net/fr/a",
    "http://cnet/fr/a", "http://x.net/espresso", "http://example.com", "http://example.com?x=/en/", "mailto:x", "", None, "a://b://c/d",
    "http://ÄB.org/p\nq/r", "x://", "http://sub.www.example.com/en/9", "http://notexample.com/en/1",
]


def judged(url):
    """Host, path and rule by plain string work."""
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = re.search(r"[/?#]", rest)
    host = rest[: cut.start()] if cut else rest
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    tail = rest[cut.start() :] if cut else ""
    path = re.split(r"[?#]", tail, maxsplit=1)[0]
    best = None
    for rule in url_filter.RULES:
        name, begin = rule.pattern.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + begin):
            if best is None or len(rule.pattern) > len(best.pattern):
                best = rule
    return host, path, best


def test_rules(spark):
    rows = url_filter.judge(spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)], PAGES)).collect()
    for r in rows:
        host, path, rule = judged(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.pattern if rule else None)
        if rule:
            assert r["verdict"] == rule.verdict
    assert len(rows) == len(URLS)


def link(*hosts):
    return "".join(f'<a class="k" href="https://{h}/x">t</a><A HREF=//{h}>' for h in hosts) + '<a href="/own">'


def test_scores_are_those_of_a_dense_walk(spark):
    graph = {"t.com": ["m.org"], "m.org": ["n.org", "T.com"], "n.org": [], "x.net": ["y.org"], "y.org": ["x.net", "n.org"], "z.org": ["y.org"]}
    pages = [(i, f"http://{h}{'/es/' if h == 'x.net' else '/'}", link(*out)) for i, (h, out) in enumerate(graph.items())]
    rows = {r["host"]: r for r in url_filter.judge(spark.createDataFrame(pages, PAGES)).collect()}
    hosts = list(graph)
    step = np.zeros((6, 6))
    for h, out in graph.items():
        for o in out:
            step[hosts.index(h), hosts.index(o.lower())] = 1
    for column, matrix, seed in (("trust", step, "t.com"), ("distrust", step.T, "x.net")):
        share = matrix / np.maximum(matrix.sum(1, keepdims=True), 1)
        start = np.array([h == seed for h in hosts], float)
        mass = start
        for _ in range(300):
            moved = mass @ share
            mass = 0.15 * start + 0.85 * (moved + (1 - moved.sum()) * start)
        assert [rows[h][column] for h in hosts] == pytest.approx(mass, abs=1e-5)
    assert rows["y.org"]["verdict"] == "block" and rows["n.org"]["verdict"] == "allow"


def test_large_webs_settle_per_host(spark, monkeypatch):
    damping, weight = 0.2, 1e6
    monkeypatch.setattr(url_filter, "DAMPING", damping)
    edges = spark.createDataFrame([("trust", "a", "b", 1), ("trust", "b", "a", 1)], "kind string, src string, dst string, n long")
    seeds = spark.createDataFrame([("trust", "a", weight), ("distrust", "b", 0.0)], "kind string, host string, weight double")
    made = {r["host"]: r["mass"] for r in url_filter.propagate(edges, seeds, Scratch(spark, "cycle")).collect()}
    assert made["a"] == pytest.approx(weight / (1 + damping), abs=1e-5)
    assert made["b"] == pytest.approx(weight * damping / (1 + damping), abs=1e-5)


def test_awkward_pages(spark):
    pages = spark.createDataFrame(
        [(None, None, None, "a"), (1, "http://x.org/", None, "b"), (1, "http://x.org/", None, "b"), (2, "http://y.org", "<a href=", "c")],
        PAGES + ", host string",
    )
    assert url_filter.judge(pages).count() == 4
    assert url_filter.judge(frames.empty(spark, PAGES)).count() == 0
