"""A prefix trie of conversations, rolled up by centroid decomposition.

Turns get their place by one sort over ranges of (conversation, turn), so that a conversation with many turns is
spread over tasks. A node is the sum of hashes of (place, turn) over its prefix: sums are built per stretch of a
conversation and added up, so a long one is no chain of steps. Texts go no further than their hash.

Subtree totals come from a centroid decomposition of the forest of parent edges. The weight of a node is its number
of members, so the weight of any subtree is known beforehand: the turns its members have from there on. Each round
takes the centroid out of every component (no part left holds more than half of its weight), adds up what lies
under it, and adds this to the nodes on the path from the centroid to the top. Components above ``SMALL``
are split by joins, all of them in one round; smaller ones are dealt to tasks and split there in numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources import tables
from .common import materialise, words

FAMILY = 20
SHARED = 4
TIE_CHARS = 32
STRETCH = 1024
SMALL = 4096
CROWD = 4096
MAX_ROUNDS = 128
LANES = ("l1", "l2", "l3", "l4")
LANE_MASK = (1 << 32) - 1
TOTALS = ("n_leaves", "saved_tokens")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _key(depth: Column, lanes: list[Column]) -> Column:
    """The id of a node: a digest of its depth and the sums of its prefix."""
    return F.unhex(F.md5(F.concat_ws(",", depth.cast("string"), *[x.cast("string") for x in lanes])))


def _root() -> Column:
    return _key(F.lit(0), [F.lit(0)] * len(LANES))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns as digests, in ranges of (conversation, turn), with their row number within the range in ``at``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = turns.filter("conv_id IS NOT NULL").select(
        "conv_id",
        "turn",
        role.alias("role"),
        F.substring(text, 1, TIE_CHARS).alias("head"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.size(words(text)).cast("long").alias("words"),
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "head", "digest")
    dealt = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    return tables.materialise(dealt.select("conv_id", "digest", "words", at.alias("at")), "placed")


def rebuilt(turns: DataFrame, family: int = FAMILY, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and their rebuilt turns (conv_id, depth, length, digest, words)."""
    placed = _placed(turns)
    part = F.shiftright("at", 33).alias("part")
    spans = placed.groupBy("conv_id", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    counts = spans.groupBy("conv_id").agg(F.sum("n").alias("n_turns"))
    lent = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    plan = counts.select(
        "conv_id", "n_turns", lent.alias("h"),
        (F.col("conv_id") - F.pmod("conv_id", F.lit(family))).alias("base"),
    )
    bases = counts.select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    own = F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    plan = materialise(
        plan.join(bases, "base", "left").select(
            "conv_id", "base", "h", taken.alias("taken"), (taken + own).alias("length")
        ),
        "conversations",
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = (
        placed.withColumn("part", part)
        .join(spans.join(plan, "conv_id"), ["conv_id", "part"])
        .withColumn("place", F.col("at") - F.col("first") + F.col("before") + 1)
    )
    kept = ranked.filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "length", "digest", "words"
    )
    heads = ranked.filter(F.col("place") < shared).select(
        F.col("conv_id").alias("base"), F.col("place").alias("depth"), "digest", "words"
    )
    lent_turns = (
        plan.filter("taken > 0")
        .join(heads, "base")
        .filter("depth <= taken")
        .select("conv_id", "depth", "length", "digest", "words")
    )
    return plan.select("conv_id", "length"), kept.unionByName(lent_turns)


def prefixes(path: DataFrame) -> DataFrame:
    """(conv_id, depth, length, words, key, parent): the node at each place of each rebuilt conversation.

    Sums run within stretches of bounded length; those of the earlier stretches are added to them.
    """
    x, y = F.xxhash64("digest", "depth"), F.xxhash64("depth", "digest")
    halves = [
        h.alias(name)
        for name, h in zip(
            LANES,
            (x.bitwiseAND(LANE_MASK), F.shiftrightunsigned(x, 32), y.bitwiseAND(LANE_MASK), F.shiftrightunsigned(y, 32)),
            strict=True,
        )
    ]
    path = path.select(
        "conv_id", "depth", "length", "words", F.expr(f"depth div {STRETCH}").alias("stretch"), *halves
    )
    path = materialise(path, "path")
    within = Window.partitionBy("conv_id", "stretch").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = path.select("*", *[F.sum(n).over(within).alias(f"{n}_sum") for n in LANES])
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = path.filter(F.col("length") >= STRETCH).groupBy("conv_id", "stretch")
    whole = whole.agg(*[F.sum(n).alias(n) for n in LANES])
    whole = whole.select("conv_id", "stretch", *[F.sum(n).over(earlier).alias(f"{n}_before") for n in LANES])
    sums = [F.col(f"{n}_sum") + F.coalesce(f"{n}_before", F.lit(0)) for n in LANES]
    before = [s - F.col(n) for s, n in zip(sums, LANES, strict=True)]
    return running.join(whole, ["conv_id", "stretch"], "left").select(
        "conv_id", "depth", "length", "words",
        _key(F.col("depth"), sums).alias("key"), _key(F.col("depth") - 1, before).alias("parent"),
    )


def trie_nodes(convs: DataFrame, path: DataFrame) -> DataFrame:
    """One row per node: key, parent, conv_id (smallest member), depth, n_convs, words, weight, n_children."""
    below = path.groupBy("key").agg(
        F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count("*").alias("n_convs"), F.min("words").alias("words"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    top = convs.agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")
    ).filter("n_convs > 0")
    root = top.select(
        _root().alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"),
        "n_convs", F.lit(0).cast("long").alias("words"), "weight",
    )
    nodes = materialise(below.unionByName(root), "nodes")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key"))
    children = children.agg(F.count("*").alias("n_children"))
    return nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def _round(active: DataFrame, big: DataFrame, path: DataFrame) -> DataFrame:
    """Take the centroid out of every component in ``big`` (comp, total); rows with ``done`` are centroids."""
    own = active.join(big, "comp")
    own = own.withColumn("stretch", F.expr(f"depth div {STRETCH}"))
    centroid = (
        own.filter("2 * weight >= total")
        .groupBy("comp")
        .agg(F.min_by(F.struct("key", "conv_id", "depth", "weight"), "weight").alias("c"))
        .select("comp", *[F.col(f"c.{n}").alias(f"c_{n}") for n in ("key", "conv_id", "depth", "weight")])
    )
    centroid = materialise(centroid, "centroids")
    own = own.join(centroid, "comp")
    # Nodes under the centroid: their conversation passes through one of its children.
    step = path.select("conv_id", (F.col("depth") - 1).alias("c_depth"), F.col("key").alias("child"),
                       F.col("parent").alias("c_key"))
    through = own.filter("depth > c_depth").select("conv_id", "stretch", "comp", "c_depth", "c_key").distinct()
    through = through.join(step, ["conv_id", "c_depth", "c_key"]).select("conv_id", "stretch", "comp", "child")
    # Nodes above it: the earlier places of its own smallest member.
    above = centroid.join(path.select(F.col("conv_id").alias("c_conv_id"), "key", "depth"), "c_conv_id")
    above = above.filter("depth < c_depth").select("comp", "key", F.lit(True).alias("above"))
    own = own.join(through, ["conv_id", "stretch", "comp"], "left").join(above, ["comp", "key"], "left")
    own = own.withColumn("child", F.when(F.col("depth") > F.col("c_depth"), F.col("child")))
    own = own.withColumn("done", F.col("key") == F.col("c_key"))
    own = own.withColumn(
        "above", F.coalesce("above", F.lit(False)) | ((F.col("depth") == 0) & ~F.col("done"))
    )
    own = materialise(own, "split")
    under = own.filter("child IS NOT NULL OR done").groupBy("comp")
    under = under.agg(*[F.sum(f"w_{t}").alias(f"d_{t}") for t in TOTALS])
    gain = F.col("above") | F.col("done")
    return own.join(under, "comp").select(
        "key", "parent", "conv_id", "depth",
        F.coalesce("child", "comp").alias("comp"),
        (F.col("weight") - F.when(F.col("above"), F.col("c_weight")).otherwise(0)).alias("weight"),
        *[f"w_{t}" for t in TOTALS],
        *[(F.col(f"s_{t}") + F.when(gain, F.col(f"d_{t}")).otherwise(0)).alias(f"s_{t}") for t in TOTALS],
        "done",
    )


def order_forest(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Preorder numbers of a forest and where each subtree ends in them; parents come as indices, tops as -1."""
    n = len(parent)
    size = np.ones(n, np.int64)
    levels = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[levels])) + 1
    levels = np.split(levels, cuts)
    for level in reversed(levels):
        own = level[parent[level] >= 0]
        np.add.at(size, parent[own], size[own])
    pre, filled = np.zeros(n, np.int64), 0
    for level in levels:
        tops = level[parent[level] < 0]
        pre[tops] = filled + np.cumsum(size[tops]) - size[tops]
        filled += size[tops].sum()
        own = level[parent[level] >= 0]
        own = own[np.argsort(parent[own], kind="stable")]
        if len(own):
            up = parent[own]
            before = np.cumsum(size[own]) - size[own]
            first = np.r_[True, up[1:] != up[:-1]]
            pre[own] = pre[up] + 1 + before - before[first][np.cumsum(first) - 1]
    return pre, pre + size


def centroid_totals(
    parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, values: np.ndarray
) -> np.ndarray:
    """The sums of ``values`` (one row per measure) over the subtree of every node of a forest.

    ``weight`` holds the total weight of each node's subtree; all components are split in the same rounds.
    """
    pre, end = order_forest(parent, depth)
    n = len(parent)
    weight, added = weight.copy(), np.zeros_like(values)
    totals = np.zeros_like(values)
    comp = np.arange(n)
    by_depth = np.argsort(pre)
    starts = by_depth[parent[by_depth] < 0]
    comp[by_depth] = starts[np.cumsum(parent[by_depth] < 0) - 1]
    left = by_depth
    while len(left):
        left = left[np.lexsort((pre[left], comp[left]))]
        heavy = left[2 * weight[left] >= weight[comp[left]]]
        heavy = heavy[np.lexsort((weight[heavy], comp[heavy]))]
        first = np.r_[True, comp[heavy][1:] != comp[heavy][:-1]]
        centroid = np.zeros(n, np.int64)
        centroid[comp[heavy[first]]] = heavy[first]
        c = centroid[comp[left]]
        under = (pre[left] >= pre[c]) & (pre[left] < end[c])
        above = (pre[left] < pre[c]) & (end[left] > pre[c])
        sums = np.zeros_like(values)
        for total, value in zip(sums, values, strict=True):
            np.add.at(total, c[under], value[left[under]])
        chosen = heavy[first]
        totals[:, chosen] = sums[:, chosen] + added[:, chosen]
        up = left[above]
        added[:, up] += sums[:, c[above]]
        weight[up] -= weight[c[above]]
        begins = np.where(parent[left] == c, np.arange(len(left)), -1)
        child = left[np.maximum(np.maximum.accumulate(begins), 0)]
        comp[left] = np.where(under, child, comp[left])
        left = left[left != c]
    return totals


def _small_totals(rows: DataFrame) -> DataFrame:
    """(key, totals) of whole components, which are dealt to tasks; a task holds a batch and one component."""
    schema = "key binary, " + ", ".join(f"{t} long" for t in TOTALS)
    target = rows.sparkSession.createDataFrame([], schema).schema

    def solved(table: pa.Table) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_schema

        keys = pd.Index(table.column("key").to_pylist())
        up = keys.get_indexer(pd.Index(table.column("parent").to_pylist()))
        comp = pd.factorize(pd.Index(table.column("comp").to_pylist()))[0]
        up = np.where((up >= 0) & (comp[up] == comp), up, -1)
        column = {n: table.column(n).to_numpy() for n in table.column_names if n not in ("key", "parent", "comp")}
        values = np.stack([column[f"w_{t}"] for t in TOTALS])
        totals = centroid_totals(up, column["depth"], column["weight"], values)
        added = np.stack([column[f"s_{t}"] for t in TOTALS])
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.tolist(), pa.binary()), *map(pa.array, totals + added)], schema=to_arrow_schema(target)
        )

    def run(batches: Iterator[pa.RecordBatch]):
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            comp = batch.column("comp")
            at = batch.num_rows - 1
            last = comp[at].as_py()
            while at > 0 and comp[at - 1].as_py() == last:
                at -= 1
            opens = at > 0 or (kept and kept[-1].column("comp")[-1].as_py() != last)
            if opens:
                whole = pa.Table.from_batches([*kept, batch.slice(0, at)])
                yield solved(whole)
                kept = [batch.slice(at)]
            else:
                kept.append(batch)
        if kept:
            yield solved(pa.Table.from_batches(kept))

    return rows.repartition("comp").sortWithinPartitions("comp").mapInArrow(run, target)


def subtree_totals(nodes: DataFrame, path: DataFrame, small: int = SMALL) -> DataFrame:
    """(key, n_leaves, saved_tokens): the sums of both measures over the subtree of every node.

    ``nodes`` has key, parent, conv_id, depth, weight, comp (the key of the top) and w_ columns with each node's
    own measures.
    """
    active = nodes.select(
        "key", "parent", "conv_id", "depth", "comp", "weight", *[f"w_{t}" for t in TOTALS],
        *[F.lit(0).cast("long").alias(f"s_{t}") for t in TOTALS],
    )
    ready, finished = [], []
    for _ in range(MAX_ROUNDS):
        big = active.groupBy("comp").agg(F.max("weight").alias("total")).filter(F.col("total") > small)
        big = materialise(big, "components")
        ready.append(active.join(big, "comp", "left_anti"))
        if big.isEmpty():
            break
        after = materialise(_round(active, big, path), "round")
        finished.append(after.filter("done").select("key", *[F.col(f"s_{t}").alias(t) for t in TOTALS]))
        active = after.filter("NOT done").drop("done")
    else:
        raise RuntimeError(f"components did not become small in {MAX_ROUNDS} rounds")
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)
    totals = _small_totals(rest)
    for more in finished:
        totals = totals.unionByName(more)
    return totals


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the comma-joined ids per key, in order; a key's ids come in strings of a batch each."""
    spark = ends.sparkSession
    pieces = spark.createDataFrame([], "key binary, first long, ids string").schema
    digests = spark.createDataFrame([], "key binary, ends_sha256 string").schema

    def join(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            spans = list(zip(starts, [*starts[1:], len(keys)], strict=True))
            columns = [
                [keys[i] for i, _ in spans], [ids[i] for i, _ in spans], [",".join(map(str, ids[i:j])) for i, j in spans],
            ]
            if spans:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(pieces), strict=True)],
                    schema=to_arrow_schema(pieces),
                )

    def digest(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        now, running = None, None
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if key != now:
                    if running:
                        out.append((now, running.hexdigest()))
                    now, running = key, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), to_arrow_schema(digests), strict=True)],
                    schema=to_arrow_schema(digests),
                )
        if running:
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.binary()), pa.array([running.hexdigest()])], schema=to_arrow_schema(digests)
            )

    dealt = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    dealt = dealt.select("key", "conv_id").mapInArrow(join, pieces)
    return dealt.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, digests)


def _with_parent_conv(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Adds parent_conv_id. Parents with many children are looked up apart, so that these do not meet in one task."""
    found = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = found.filter(F.col("n_children") > crowd).drop("n_children")
    few = found.filter(F.col("n_children") <= crowd).drop("n_children")
    below = nodes.filter("parent IS NOT NULL")
    tops = nodes.filter("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    apart = below.join(many, "parent")
    rest = below.join(many.select("parent"), "parent", "left_anti").join(few, "parent")
    columns = [*nodes.columns, "parent_conv_id"]
    return tops.select(columns).unionByName(apart.select(columns)).unionByName(rest.select(columns))


def prefix_trie(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    family: int = FAMILY,
    shared: int = SHARED,
    small: int = SMALL,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, the textless root included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256). A conversation is
    rebuilt from the first h turns of the first one of its family of ``family`` ids and its own turns behind its
    first h; h is the CRC-32 of its decimal id modulo ``shared``. NULL roles and texts are empty, NULL turns come
    first, equal turns are ordered by role and text (the first 32 characters, then the hash), repeated rows are
    turns of their own. Rows without a conversation id belong to none. No rows give no nodes. Texts of any length count whole;
    further columns are ignored. Runs jobs while it is being defined; what they write is narrow and linear in turns.
    """
    narrow = turns.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role"), F.col(f"`{text_col}`").cast("string").alias("text"),
    )
    convs, path = rebuilt(narrow, family, shared)
    path = materialise(prefixes(path), "prefixes")
    nodes = trie_nodes(convs, path).withColumns(
        {
            "w_n_leaves": (F.col("n_children") == 0).cast("long"),
            "w_saved_tokens": (F.col("n_convs") - 1) * F.col("words"),
            "comp": _root(),
        }
    )
    nodes = materialise(nodes.drop("words"), "trie")
    ends = path.filter("depth = length").select("key", "conv_id").unionByName(
        convs.filter("length = 0").select(_root().alias("key"), "conv_id")
    )
    return (
        _with_parent_conv(nodes)
        .join(subtree_totals(nodes, path, small), "key")
        .join(_joined_ids(ends), "key", "left")
        .select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *TOTALS,
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
