import random

import pytest

from attesta.llm.components import components
from attesta.llm.simhash import bk_insert, bk_search, fingerprint, keep_one, links, simhash_components

from . import brute
from .conftest import edge_texts

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint():
    for _, text in edge_texts():
        assert fingerprint((text or "").encode()) == brute.fingerprint(text)


def test_bk_tree_finds_all_within_the_radius():
    rng = random.Random(1)
    values = list({rng.getrandbits(9) for _ in range(300)})
    tree = {"root": (values[0], {})}
    for v in values[1:]:
        bk_insert(tree, v)
    for q in range(0, 512, 7):
        for radius in (0, 1, 2):
            assert sorted(bk_search(tree, q, radius)) == sorted(v for v in values if (v ^ q).bit_count() <= radius)


def test_documents_equal_brute_force(spark, edges):
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    more = spark.read.parquet(f"{SF}/documents.parquet")
    rows += [(r["doc_id"] + 1000, r["text"]) for r in more.collect()]
    df = edges.select("doc_id", "text").union(more.selectExpr("doc_id + 1000", "text"))
    got = simhash_components(df).collect()
    key = lambda r: str(r)
    assert sorted(((r[0], r[1], r[2]) for r in got), key=key) == sorted(brute.simhash(rows), key=key)


@pytest.mark.parametrize("bound", [4096, 3])
def test_links_of_a_crowded_neighbourhood(spark, bound):
    """Thousands of links around few centres; a bound of 3 sends all shards to the second dealing."""
    rng = random.Random(2)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    values |= {rng.getrandbits(64) for _ in range(200)}
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(4)
    got = {r["node"]: r["component"] for r in components(links(fps, bound=bound)).collect()}
    groups = {}
    for v, top in brute.near_groups(values).items():
        groups.setdefault(top, set()).add(signed(v))
    found = {}
    for v in map(signed, values):
        found.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_chains_stars_and_nothing(spark):
    chain = [(i, i + 1) for i in range(100, 180)] + [(5, 5), (7, None)]
    star = [(1, x) for x in range(2, 60)] * 2
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain + star, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1 for i in range(1, 60) if i != 0}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one_and_empty(edges, no_docs):
    kept = keep_one(edges)
    assert kept.schema == edges.schema
    rows = edge_texts()
    groups = {}
    for d, t in rows:
        groups.setdefault(brute.near_groups([brute.fingerprint(x) for _, x in rows])[brute.fingerprint(t)], []).append(d)
    want = sorted((min((x is None, x or 0) for x in g) for g in groups.values()))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == want
    assert keep_one(no_docs).count() == 0 and simhash_components(no_docs).count() == 0
