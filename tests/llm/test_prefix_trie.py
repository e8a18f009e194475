"""The trie against nested dictionaries, and centroid totals against sums along all paths."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from attesta.llm.prefix_trie import centroid_totals, prefix_trie

SF = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def n_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def trie(rows):
    """The wanted nodes of (conv_id, turn, role, text) rows."""
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    node = {(None, None): 0}
    up, last, members, ends = [None], [""], [[]], [[]]
    for c, seq in whole.items():
        at = 0
        members[0].append(c)
        for turn in seq:
            if (at, turn) not in node:
                node[at, turn] = len(up)
                up.append(at)
                last.append(turn[1])
                members.append([])
                ends.append([])
            at = node[at, turn]
            members[at].append(c)
        ends[at].append(c)
    if not whole:
        return []
    children = [0] * len(up)
    depth = [0] * len(up)
    for i in range(1, len(up)):
        depth[i] = depth[up[i]] + 1
        children[up[i]] += 1
    leaves = [int(n == 0) for n in children]
    saved = [(len(m) - 1) * n_words(x) for m, x in zip(members, last, strict=True)]
    for i in range(len(up) - 1, 0, -1):
        leaves[up[i]] += leaves[i]
        saved[up[i]] += saved[i]
    return sorted(
        (
            min(members[i]), depth[i], min(members[up[i]]) if i else None, len(members[i]), children[i], leaves[i],
            saved[i], hashlib.sha256(",".join(map(str, sorted(ends[i]))).encode()).hexdigest(),
        )
        for i in range(len(up))
    )


def got(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def test_totals_of_random_forests():
    rng = random.Random(4)
    for n in (1, 2, 5, 60, 400):
        for chain in (0.0, 0.5, 0.99):
            parent = np.array([-1 if i == 0 or rng.random() < 0.02 else (
                i - 1 if rng.random() < chain else rng.randrange(i)) for i in range(n)])
            depth = np.zeros(n, np.int64)
            own = np.array([rng.randint(1, 9) for _ in range(n)])
            values = np.array([[rng.randint(0, 9) for _ in range(n)] for _ in range(2)])
            want, weight = values.copy(), own.copy()
            for i in range(n):
                depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
            for i in range(n - 1, -1, -1):
                if parent[i] >= 0:
                    want[:, parent[i]] += want[:, i]
                    weight[parent[i]] += weight[i]
            shuffled = np.array(rng.sample(range(n), n))
            place = np.argsort(shuffled)
            up = np.where(parent[shuffled] < 0, -1, place[parent[shuffled]])
            out = centroid_totals(up, depth[shuffled], weight[shuffled], values[:, shuffled])
            assert (out == want[:, shuffled]).all()


@pytest.mark.parametrize("small", [4096, 40, 3])
def test_nodes_equal_brute_force(spark, small):
    """With small bounds most components are split by joins, down to single nodes."""
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    if small == 3:
        rows = rows[:60]
        df = spark.createDataFrame(rows, ROWS)
    assert got(prefix_trie(df, small=small)) == trie(rows)


def edge_rows():
    rng = random.Random(9)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (3, 1, "a", "b c")]
    rows += [(7, 5, "user", "x" * 40 + str(i)) for i in range(3)] + [(8, 0, "user", None)]
    for c in (20, 21, 22, 25, 39, 41, 47):
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of many words") for t in range(c % 9)]
    rows += [(60, t, "user", "the same turn") for t in range(1300)]
    rows += [(c, t, "user", "the same turn") for c in (61, 62, 63, 80) for t in range(1000 + c)]
    rows += [(100 + i, 0, "system", "You help.") for i in range(90)]
    rows += [(100 + i, 1, "user", rng.choice("pqrs")) for i in range(90)]
    return rows


@pytest.mark.parametrize("small", [4096, 2_000_000])
def test_edges_long_conversations_and_clashing_columns(spark, small):
    rows = edge_rows()
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    df = df.selectExpr("*", "1 AS key", "2 AS parent", "3 AS depth", "4 AS length", "5 AS part", "6 AS at", "7 AS words")
    assert got(prefix_trie(df, small=small)) == trie(rows)


def test_no_rows(spark):
    assert prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], ROWS)).count() == 0
