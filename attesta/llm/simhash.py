"""SimHash near-duplicates: fingerprints of three-word shingles, linked at two or fewer bits.

Fingerprints. The text is lower-cased (A-Z), its words form shingles, repeats included; a bit is set
when it is set in over half of the shingles' XXH64 (seed 42). Fewer than three words are one
shingle; no words give zero.

Links. Two fingerprints within two bits agree on at least two of four 16-bit blocks. Each of
the six block pairs deals the distinct fingerprints into shards that share 32 bits. Inside a shard
a BK-tree (children keyed by their integer Hamming distance to the parent) is built, and a search
follows only the edges within the radius. A shard above ``SHARD_BOUND`` is dealt once more, by pairs
of 8-bit blocks of its other 32 bits: such a shard shares 48 bits, so 65,536 fingerprints at most. Thus
a tree is always bounded, whatever a group of copies holds. A tree goes to the rows of its shard
only: sending all trees to all tasks would have no size bound.

A shard reports one link per fingerprint and group, not the pairs, and ``components`` joins the groups.
Copies fold into one fingerprint before anything is linked.

Defined cases: NULL text is empty; empty texts have fingerprint zero, which links like any other. A
NULL id keeps its row; the component id is the smallest id that is not NULL, and NULL if there is none.
Repeated rows stay. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, map_batches, materialise, numbered, rows_only, sheltered, texts
from .components import components

SHINGLE = 3
SEED = 42
RADIUS = 2
SHARD_BOUND = 4096

PAIRS = tuple(combinations(range(4), 2))
CHUNK = 1 << 16


def fingerprint(text: bytes) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > SHINGLE:
        starts, ends = starts[: 1 - SHINGLE], ends[SHINGLE - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, len(starts), CHUNK):
        spans = zip(starts[k : k + CHUNK].tolist(), ends[k : k + CHUNK].tolist(), strict=True)
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * counts > len(starts), bitorder="little")
    return int(packed.view("<u8")[0])


def fingerprints(rows: DataFrame) -> DataFrame:
    """The columns beside the text, and ``fp``, the fingerprint as a signed long."""
    keep = [c for c in rows.columns if c != "text"]

    def make(batch):
        found = [fingerprint(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield {c: batch.column(c) for c in keep} | {"fp": pa.array(np.array(found, "<u8").view("<i8"))}

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep)
    return map_batches(rows.select("text", *keep), make, f"{schema}, fp long")


def _block(fp: Column, i: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, i * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _shards(fps: DataFrame) -> DataFrame:
    """(key, fp): the six shards of every fingerprint."""
    fp = F.col("fp")
    keys = [
        F.lit(n).cast("long") * (1 << 51) + _block(fp, i, 16) * (1 << 32) + _block(fp, j, 16) * (1 << 16)
        for n, (i, j) in enumerate(PAIRS)
    ]
    return fps.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _finer(hot: DataFrame) -> DataFrame:
    """(key, fp): the six shards of a crowded shard, by the 32 bits its rows need not share."""
    fp = F.col("fp")
    rest = F.lit(0).cast("long")
    for n, pair in enumerate(PAIRS):
        i, j = (b for b in range(4) if b not in pair)
        own = _block(fp, i, 16) * (1 << 16) + _block(fp, j, 16)
        rest = F.when(F.shiftrightunsigned(F.col("key"), 51) == n, own).otherwise(rest)
    keys = [
        F.col("key") + F.lit(n + 1).cast("long") * (1 << 48) * (1 << 6)
        + _block(rest, i, 8) * (1 << 8) + _block(rest, j, 8)
        for n, (i, j) in enumerate(PAIRS)
    ]
    return hot.select(F.explode(F.array(*keys)).alias("key"), "fp")


def bk_insert(tree: dict, fp: int) -> None:
    """Hang a fingerprint below the root; a node is its value and its children by distance."""
    value, children = tree["root"]
    while True:
        d = (value ^ fp).bit_count()
        if not d:
            return
        if d not in children:
            children[d] = (fp, {})
            return
        value, children = children[d]


def bk_search(tree: dict, fp: int, radius: int) -> list[int]:
    """All values within the radius; by the triangle inequality other edges lead nowhere."""
    found, open_nodes = [], [tree["root"]]
    while open_nodes:
        value, children = open_nodes.pop()
        d = (value ^ fp).bit_count()
        if d <= radius:
            found.append(value)
        if children:
            for k in range(max(1, d - radius), d + radius + 1):
                if k in children:
                    open_nodes.append(children[k])
    return found


def shard_links(fps: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """One link (member, first of its group) for each member that is not the first."""
    parent = {fp: fp for fp in fps}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = {"root": (fps[0], {})}
    for fp in fps[1:]:
        for near in bk_search(tree, fp, radius):
            a, b = top(fp), top(near)
            if a != b:
                parent[max(a, b)] = min(a, b)
        bk_insert(tree, fp)
    return [(fp, t) for fp in fps if (t := top(fp)) != fp]


def _runs(batches):
    """The fingerprints of one shard after the other, from rows sorted by shard."""
    key, run = None, []
    for batch in batches:
        for k, fp in zip(batch.column("key").to_pylist(), batch.column("fp").to_pylist(), strict=True):
            if k != key:
                if len(run) > 1:
                    yield run
                key, run = k, []
            run.append(fp)
    if len(run) > 1:
        yield run


def links(fps: DataFrame, radius: int = RADIUS, bound: int = SHARD_BOUND) -> DataFrame:
    """(a, b): enough links between distinct fingerprints to join all that are within the radius."""
    if not 0 <= radius <= 2:
        raise ValueError("four blocks serve a radius of two at most")
    shards = _shards(fps)
    sizes = shards.groupBy("key").count().filter("count > 1")
    shared = shards.join(sizes, "key")
    hot = F.col("count") > bound
    dealt = shared.filter(~hot).select("key", "fp").unionByName(_finer(shared.filter(hot)))

    def run(batches):
        for fps_of_shard in _runs(batches):
            ends = shard_links([fp & 0xFFFFFFFFFFFFFFFF for fp in fps_of_shard], radius)
            if ends:
                a, b = np.array(ends, "<u8").view("<i8").T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    sorted_shards = dealt.repartition("key").sortWithinPartitions("key", "fp")
    return sorted_shards.mapInArrow(run, "a long, b long")


def _fingerprinted(rows: DataFrame) -> DataFrame:
    return materialise(fingerprints(rows), "fingerprints")


def _by_root(folded: DataFrame) -> DataFrame:
    """One row per distinct fingerprint, with the smallest fingerprint reachable from it as ``root``."""
    reached = components(links(folded.select("fp")))
    roots = reached.select(F.col("node").alias("fp"), F.col("component").alias("root"))
    return folded.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, copies): one row per document.

    ``copies`` counts the rows of the component. Components are folded over distinct fingerprints,
    and only the last join meets the rows again.
    """
    kept = _fingerprinted(texts(docs, id_col, text_col))
    folded = kept.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    found = _by_root(folded)
    per_root = found.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("copies"))
    per_fp = found.select("fp", "root").join(per_root, "root").drop("root")
    return kept.join(per_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with the smallest id, of equal ids the first in the table."""
    plain, restored = sheltered(docs)
    rows = numbered(plain)
    place = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    own = texts(rows, id_col, text_col, ROW)
    folded = _fingerprinted(own).groupBy("fp").agg(F.min(place).alias("p"))
    first = _by_root(folded).groupBy("root").agg(F.min("p").alias("p"))
    return restored(rows.join(rows_only(first.select(f"p.{ROW}")), ROW, "left_semi"))
