"""Best-fit packing of documents into training windows, without conflicts inside a window.

Documents longer than the capacity are cut into pieces; a full piece is a window of its own. The rest
is placed longest first. Open bins are ordered by residual and carry two bitmaps, of the sources and of
the duplicate clusters they hold. A piece looks up the first bin with room for it and goes on to
the successors until the bin is compatible: the tightest compatible one. Without such a bin it opens
one. So no bin holds two documents of one source or of one cluster.

Rows are dealt by hash into shards of about ``SHARD_ROWS`` rows, packed one by one: a shard is
bounded, holds a fair mix of sources, and its loss is its last few bins. Only ids, sources, clusters and
lengths are shuffled, never texts. Bitmaps are exact: bits are numbered inside the shard.

Defined cases: a NULL text has no tokens; a document without tokens gets one row without a bin. NULL
sources and NULL clusters conflict with nothing. Repeated rows are packed apart, as they share source and
cluster. Ties in length go by id, source and cluster. A NULL id is packed as any other. With a row key, repeated rows are dealt over all shards. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, SPACE, SPACE_CHARS, numbered

CAPACITY = 2048
SHARD_ROWS = 4096
PLACED = "doc_id {id}, piece int, start long, n_tokens long, bin_id string, bin_offset long"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def copy_cluster(text: Column) -> Column:
    """The same value for texts that differ in case and white space only; NULL without words."""
    plain = F.lower(F.regexp_replace(F.btrim(text, F.lit(SPACE_CHARS)), SPACE, " "))
    return F.when(plain != "", F.md5(F.encode(plain, "UTF-8")))


class Bins:
    """Open bins in the order of their residuals, with a bitmap of sources and one of clusters."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.order: list[tuple[int, int]] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and offset for a piece; the two numbers are its bits, 0 for none."""
        at, order = bisect_left(self.order, (size, -1)), self.order
        while at < len(order):
            residual, b = order[at]
            if not (self.sources[b] & source or self.clusters[b] & cluster):
                del order[at]
                break
            at += 1
        else:
            residual, b = self.capacity, len(self.sources)
            self.sources.append(0)
            self.clusters.append(0)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        if residual > size:
            insort(order, (residual - size, b))
        return b, self.capacity - residual


def _bits(values: list, least: int) -> list[int]:
    """A bit of its own for each value that occurs at least ``least`` times, 0 for the others."""
    counts = Counter(v for v in values if v is not None)
    bit = {v: 1 << n for n, v in enumerate(v for v, c in counts.items() if c >= least)}
    return [bit.get(v, 0) for v in values]


def pack_shard(rows: list[tuple], capacity: int, name: str) -> list[tuple]:
    """Placements of (doc_id, source, cluster, n_tokens) rows, as rows of ``PLACED``."""
    rows = sorted(rows, key=lambda r: (-(r[3] % capacity), *((v is None, v) for v in r[:3])))
    sources, clusters = _bits([r[1] for r in rows], 1), _bits([r[2] for r in rows], 2)
    bins, out, full = Bins(capacity), [], 0
    for (doc_id, _, _, n), source, cluster in zip(rows, sources, clusters, strict=True):
        pieces, rest = divmod(n, capacity)
        for k in range(pieces):
            out.append((doc_id, k, k * capacity, capacity, f"{name}-f{full}", 0))
            full += 1
        if rest:
            b, offset = bins.place(rest, source, cluster)
            out.append((doc_id, pieces, pieces * capacity, rest, f"{name}-{b}", offset))
        elif not pieces:
            out.append((doc_id, 0, 0, 0, None, None))
    return out


def pack(rows: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Placements of a table (doc_id, source, cluster, n_tokens): bin, offset and token range.

    A key in ``__row``, where there is one, takes part in the dealing.
    """
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows have to be positive")
    own = [ROW] if ROW in rows.columns else []
    rows = rows.select("doc_id", "source", "cluster", "n_tokens", *own)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    dealt = rows.withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "cluster", "n_tokens", *own), F.lit(shards)).cast("int")
    ).drop(ROW)
    names = [c.split()[0] for c in PLACED.split(", ")]

    def run(key, pdf):
        held = [
            tuple(None if pd.isna(v) else v for v in r[:3]) + (int(r[3]),)
            for r in pdf[["doc_id", "source", "cluster", "n_tokens"]].itertuples(index=False, name=None)
        ]
        out = pd.DataFrame(pack_shard(held, capacity, str(key[0])), columns=names)
        return out.astype({"bin_offset": "Int64"})

    kind = dict(rows.dtypes)["doc_id"]
    return dealt.groupBy("shard").applyInPandas(run, PLACED.format(id=kind))


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, cluster: Column | None = None
) -> DataFrame:
    """Placements of a table of documents, by words, with exact copies as clusters or those given.

    ``cluster`` is a column over ``docs``, such as the class of a near-duplicate search.
    """
    text = F.col("text").cast("string")
    return pack(
        numbered(docs.select(
            "doc_id",
            F.col("source").cast("string").alias("source"),
            (copy_cluster(text) if cluster is None else cluster).alias("cluster"),
            word_count(text).alias("n_tokens"),
        )),
        capacity,
        shard_rows,
    )
