"""Domain ranks against power iteration in numpy, and the reading of hosts, links and suffixes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators.domains import (
    domain_links, host_of, page_links, page_quality, rank_domains, registered_domains, source_quality,
)

EDGES = "src string, dst string, n long"


def power(edges, domains, damping=0.85):
    names = sorted({d for d in domains if d} | {x for s, t, n in edges for x in (s, t) if s and t and n > 0})
    at = {d: i for i, d in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for s, t, n in edges:
        if s and t and n > 0:
            m[at[t], at[s]] += n
    out = m.sum(axis=0)
    r = np.full(len(names), 1 / len(names))
    for _ in range(500):
        sent = m @ np.where(out > 0, r / np.where(out > 0, out, 1), 0)
        r = (1 - damping + damping * r[out == 0].sum()) / len(names) + damping * sent
    return dict(zip(names, r))


@pytest.mark.parametrize("crowd", [20_000, 10])
def test_ranks_equal_power_iteration(spark, crowd):
    """One domain links to all and is linked from all; with a small bound its links are dealt to parts."""
    rng = random.Random(3)
    edges = [(f"d{rng.randrange(60)}", f"d{rng.randrange(90)}", rng.randint(0, 4)) for _ in range(250)]
    edges += [("hub", f"d{i}", 1) for i in range(90)] + [(f"d{i}", "hub", 2) for i in range(0, 90, 2)]
    edges += [(None, "d1", 3), ("d1", None, 3), ("d2", "d3", -1)]
    domains = [(f"d{i}",) for i in range(95)] + [("alone",), (None,)]
    df = spark.createDataFrame(edges, EDGES).repartition(3).selectExpr("*", "1 AS part", "2 AS parts", "3 AS rank")
    got = {r.domain: r["rank"] for r in rank_domains(df, spark.createDataFrame(domains, "domain string"), crowd=crowd).collect()}
    want = power(edges, [d for d, in domains])
    assert got.keys() == want.keys() and max(abs(got[d] - want[d]) for d in want) < 1e-6
    assert abs(sum(got.values()) - 1) < 1e-6


def test_without_links_or_domains(spark):
    none, two = spark.createDataFrame([], EDGES), spark.createDataFrame([("a",), ("b",), ("a",)], "domain string")
    assert {tuple(r) for r in rank_domains(none, two).collect()} == {("a", 0.5), ("b", 0.5)}
    assert rank_domains(none, two.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="rounds"):
        rank_domains(spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "a", 1)], EDGES), two, max_rounds=2)


def test_hosts_and_registered_domains(spark):
    urls = {
        "http://A.Example.COM:80/x?y#z": "a.example.com", "https://u:p@b.org./": "b.org", "ftp://c": "c", "//no": None,
        "mailto:x@y.z": None, "": None, None: None, "http://[::1]:8/": "[::1]", " http://10.0.0.1/ ": "10.0.0.1",
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", host_of(F.col("url")).alias("host"))
    assert {r.url: r.host for r in df.collect()} == urls
    hosts = ["a.b.co.uk", "co.uk", "uk", "x.y.z.example.com", "example.com", "one", "a.b.c", "10.0.0.1", "[::1]", None]
    suffixes = spark.createDataFrame([("co.uk",), ("uk",), (" Example.com ",), (None,), ("",)], "suffix string")
    got = registered_domains(spark.createDataFrame([(h,) for h in hosts], "host string"), suffixes)
    assert {r.host: r.domain for r in got.collect()} == {
        "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "uk": "uk", "x.y.z.example.com": "z.example.com",
        "example.com": "example.com", "one": "one", "a.b.c": "b.c", "10.0.0.1": "10.0.0.1", "[::1]": "[::1]",
    }


def test_links_and_quality(spark):
    html = "<a href='/x'>1</a><a HREF=\"http://b.net/\">2</a><a href='//c.net/y'>3</a><a href='#t'>4</a><a href='mailto:a@b'>5</a><a href='z'>6</a>"
    pages = spark.createDataFrame([("http://w.a.net/p/q", html), ("http://b.net/", "<a href='http://a.net'>"), (None, html), ("x", None)],
                                  "url string, html string")
    links = page_links(pages)
    assert {r.target for r in links.filter("source = 'http://w.a.net/p/q'").collect()} == {
        "http://w.a.net/x", "http://b.net/", "http://c.net/y", "http://w.a.net/z"}
    suffixes = spark.createDataFrame([("net",)], "suffix string")
    assert {tuple(r) for r in domain_links(links, suffixes).collect()} == {("a.net", "b.net", 1), ("a.net", "c.net", 1), ("b.net", "a.net", 1)}
    got = {r.domain: (r.n_pages, r.n_in, r.place) for r in source_quality(pages, links, suffixes).collect()}
    assert got == {"a.net": (1, 1, 1), "b.net": (1, 1, 2), "c.net": (0, 1, 2)}
    ranked = source_quality(pages, links, suffixes)
    assert {(r.url, r.domain, r.place) for r in page_quality(pages, ranked, suffixes).collect()} == {
        ("http://w.a.net/p/q", "a.net", 1), ("http://b.net/", "b.net", 2), (None, None, None), ("x", None, None)}
    assert source_quality(pages.limit(0), links.limit(0), suffixes).count() == 0
