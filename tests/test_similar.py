"""Neighbours against all pairs in numpy, with copies, ties and unusable vectors."""

import numpy as np
import pytest

from attesta.operators import similar
from attesta.operators.similar import similar_claims

SF = "/root/testdata/sf0.01"
ROWS = "vec_id long, embedding array<float>"


def brute(vectors, k, every):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, similar.DIGITS)
    out = set()
    for q in np.flatnonzero(ids % every == 0):
        order = [j for j in np.lexsort((ids, -s[q])) if j != q][:k]
        out |= {(int(ids[q]), r + 1, int(ids[j]), round(float(s[q, j]), 6)) for r, j in enumerate(order)}
    return out


def clustered(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, n)] + 0.2 * rng.normal(size=(n, 8))
    x[n // 3 : n // 2] = x[0]
    return {i: x[i].astype(np.float32).tolist() for i in range(n)}


@pytest.mark.parametrize("block", [similar.BLOCK_ROWS, 16])
def test_exact_equals_all_pairs(spark, monkeypatch, block):
    """A sixth of the rows is one vector; small blocks make cells cross blocks on both sides."""
    monkeypatch.setattr(similar, "BLOCK_ROWS", block)
    vectors = clustered(600)
    df = spark.createDataFrame(list(vectors.items()), ROWS).repartition(5)
    got = {tuple(r) for r in similar_claims(df, 5, 10, exact=True, cells=9).collect()}
    assert got == brute(vectors, 5, 10)


def test_probing_reaches_the_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    exact = {(r.query_id, r.claim_id) for r in similar_claims(df, exact=True).collect()}
    found = {(r.query_id, r.claim_id) for r in similar_claims(df).collect()}
    assert len(exact) == 50 and len(exact & found) >= 0.9 * len(exact)


def test_few_probes_suffice_where_vectors_cluster(spark):
    vectors = clustered(3000, seed=4)
    df = spark.createDataFrame(list(vectors.items()), ROWS).repartition(3)
    index = similar.ClaimIndex(similar.usable_vectors(df), 5, cells=40)
    queries = similar._queries(similar.usable_vectors(df), 50)
    assert index.calibrate(queries) <= 12
    want, got = brute(vectors, 5, 50), {tuple(r) for r in similar_claims(df, 5, 50, cells=40).collect()}
    assert len({w[:1] + w[2:3] for w in want} & {g[:1] + g[2:3] for g in got}) >= 0.9 * len(want)


def test_unusable_vectors_and_clashing_columns(spark):
    nan = float("nan")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0]), (7, [nan, 1.0]),
        (8, [float("inf"), 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (10, [-1.0, 0.0]), (1, [5.0, 5.0]), (20, [0.0, 1.0]),
    ]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS vector", "2 AS cell", "3 AS members", "4 AS query_id")
    want = {(0, 1, 2, 1.0), (0, 2, 1, 0.707107), (0, 3, 20, 0.0), (0, 4, 10, -1.0)}
    want |= {(10, 1, 20, 0.0), (10, 2, 1, -0.707107), (10, 3, 0, -1.0), (10, 4, 2, -1.0)}
    want |= {(20, 1, 1, 0.707107), (20, 2, 0, 0.0), (20, 3, 2, 0.0), (20, 4, 10, 0.0)}
    for exact in (True, False):
        got = {tuple(r) for r in similar_claims(df, 9, 10, exact=exact).collect()}
        assert {(*g[:3], g[3] + 0.0) for g in got} == want
    assert similar_claims(spark.createDataFrame([], ROWS)).count() == 0
    assert similar_claims(spark.createDataFrame([(100, [1.0])], ROWS)).count() == 0
