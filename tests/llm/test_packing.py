import random
from collections import defaultdict

from pyspark.sql import functions as F

from attesta.llm.packing import pack, pack_documents, pack_shard

from . import brute
from .conftest import edge_texts

ROWS = "doc_id long, source string, cluster string, n_tokens long, shard string"


def random_rows(n, seed=3):
    rng = random.Random(seed)
    return [
        (rng.choice([None, i, i]), rng.choice(["hot", "hot", "a", "b", None]), rng.choice([None, f"c{i % 40}"]),
         rng.choice([0, 1, 50, 99, 100, 101, 250, rng.randint(1, 100)])) for i in range(n)
    ]


def test_shard_equals_brute_force():
    rows = random_rows(400)
    bins = defaultdict(list)
    for doc_id, _, _, n, b, offset in pack_shard(rows, 100, "s"):
        if b and "-f" not in b:
            bins[b].append((doc_id, offset, n))
    assert sorted(bins.values(), key=str) == sorted((b["docs"] for b in brute.best_fit(rows, 100)), key=str)


def test_no_conflicts_and_nothing_lost(spark):
    rows = [(i, *r[1:]) for i, r in enumerate(random_rows(1500))]
    df = spark.createDataFrame([(*r, "x") for r in rows], ROWS).repartition(3)
    placed = pack(df, capacity=100, shard_rows=200).collect()
    of = {r[0]: r for r in rows}
    tokens, bins = defaultdict(int), defaultdict(list)
    for p in placed:
        tokens[p["doc_id"]] += p["n_tokens"]
        if p["bin_id"]:
            bins[p["bin_id"]].append(p)
    assert dict(tokens) == {r[0]: r[3] for r in rows}
    for held in bins.values():
        assert sum(p["n_tokens"] for p in held) <= 100
        spans = sorted((p["bin_offset"], p["n_tokens"]) for p in held)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        for k in (1, 2):
            values = [of[p["doc_id"]][k] for p in held if of[p["doc_id"]][k] is not None]
            assert len(values) == len(set(values))


def test_documents_and_empty(edges, no_docs):
    placed = pack_documents(edges, capacity=500).collect()
    assert sum(p["n_tokens"] for p in placed) == sum(brute.quality(t)[0] for _, t in edge_texts())
    assert len([p for p in placed if p["bin_id"] is None]) == 4
    long = sorted((p["piece"], p["start"]) for p in placed if p["doc_id"] == 7)
    assert long == [(k, 500 * k) for k in range(len(long))] and len(long) == 96
    assert pack_documents(no_docs).count() == 0


def test_repeated_rows_are_dealt_over_shards(docs_of):
    docs = docs_of([(None if i % 2 else 7, "the same four words") for i in range(400)])
    bins = [r["bin_id"] for r in pack_documents(docs, shard_rows=20).collect()]
    assert len(bins) == 400 and len({b.split("-")[0] for b in bins}) > 15


def test_clusters_may_be_given(docs_of):
    docs = docs_of([(0, "a text"), (4, "another text"), (8, "third text here")]).drop("source").selectExpr(
        "*", "CAST(NULL AS string) AS source"
    )
    apart = pack_documents(docs, cluster=F.lit(1)).collect()
    assert len({r["bin_id"] for r in apart}) == 3 and len({r["bin_id"] for r in pack_documents(docs).collect()}) == 1
