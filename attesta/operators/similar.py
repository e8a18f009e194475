"""Similar claims: nearest neighbours of claim vectors by cosine, over an index of cells.

Equal vectors are one class with its smallest ids, so copies cost nothing. Cells are learned by k-means in Spark on
a bounded sample; every class is assigned to its nearest cell, and a cell's classes are dealt to blocks of
bounded size. A query probes the cells nearest to it; the queries that probe a cell are dealt to blocks as well, and
blocks meet blocks in one matrix product. Each meeting keeps its best few per query, which merge to the answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..sources.tables import materialise

# What cells are learned from, at most: rows with the smallest hashes.
SAMPLE_ROWS = 16_384
MAX_CELLS = 1_024
BLOCK_ROWS = 1_024
# The queries that the number of probes is chosen by, at most, and the share of their neighbours to be met.
CALIBRATION_QUERIES = 64
TARGET_RECALL = 0.95
DIGITS = 9

FOUND = "query_id long, class_id long, cell int, similarity double"


def usable_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None
) -> DataFrame:
    """(vec_id, vector) of the rows that have a direction: an id and ``dim`` finite numbers, not all zero.

    Without ``dim`` it is the commonest length.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    out = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"))
    out = out.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0))
    if dim is None:
        lengths = out.groupBy(F.size("vector").alias("n")).count()
        first = lengths.orderBy(F.desc("count"), F.desc("n")).head()
        dim = first["n"] if first else 0
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return out.filter((F.size("vector") == dim) & finite & F.exists("vector", lambda x: x != 0))


def vector_classes(vectors: DataFrame, members: int) -> DataFrame:
    """(class_id, vector, members): distinct vectors with their smallest ids, the first one names the class.

    The limit on ids is applied in each task before the shuffle, so a vector with a third of all rows
    sends a few rows a task.
    """
    order = Window.partitionBy("vector").orderBy("vec_id")
    least = vectors.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= members)
    ids = F.sort_array(F.collect_list("vec_id"))
    return least.groupBy("vector").agg(ids.alias("members")).select(F.col("members")[0].alias("class_id"), "vector", "members")


def _unit(lists: pa.Array) -> np.ndarray:
    rows = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def learn_cells(classes: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Unit vectors of the cells; by default as many as the square root of the number of vectors, up to a bound."""
    sample = classes.orderBy(F.xxhash64("class_id"), "class_id").limit(sample_rows)
    sample = sample.select(array_to_vector("vector").alias("features")).cache()
    n = sample.count()
    cells = cells or max(1, min(MAX_CELLS, n // 16, round(classes.count() ** 0.5)))
    if cells == 1 or n <= cells:
        found = np.array([r[0].toArray() for r in sample.limit(cells).collect()])
    else:
        means = KMeans(k=cells, distanceMeasure="cosine", maxIter=8, seed=1, initMode="random")
        found = np.array(means.fit(sample).clusterCenters())
    sample.unpersist()
    if not len(found):
        return np.zeros((0, 1))
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def _cells_of(rows: DataFrame, cells: np.ndarray, probes: int) -> DataFrame:
    """The rows with the numbers of their nearest cells, nearest first, in ``near``."""
    schema = rows.select("*").schema.add("near", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            if not batch.num_rows:
                continue
            nearness = _unit(batch.column("vector")) @ cells.T
            near = np.argsort(-nearness, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(c.cast(f.type) for c, f in zip(batch.columns, target)), pa.array(near.tolist(), target[-1].type)],
                schema=target,
            )

    return rows.mapInArrow(run, schema)


def _in_blocks(rows: DataFrame, id_col: str, name: str) -> DataFrame:
    """(cell, ids, vectors): the rows of each cell dealt to blocks by hash of their id."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).alias("blocks"))
    dealt = rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64(id_col), F.col("blocks")))
    packed = dealt.groupBy("cell", "block").agg(F.collect_list(F.struct(id_col, "vector")).alias("rows"))
    return packed.select(
        "cell", F.col(f"rows.{id_col}").alias(f"{name}_ids"), F.col("rows.vector").alias(f"{name}_vectors")
    )


def _meetings(pairs: DataFrame, k: int) -> DataFrame:
    """The best ``k`` classes of a block for each query of another."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                queries, classes = (
                    np.array(one.column(c)[0].as_py(), np.int64) for c in ("query_ids", "class_ids")
                )
                left, right = (_unit(one.column(c).flatten()) for c in ("query_vectors", "class_vectors"))
                score = np.round(left @ right.T, DIGITS)
                order = np.lexsort((np.broadcast_to(classes, score.shape), -score))[:, :k]
                rows = np.repeat(np.arange(len(queries)), order.shape[1])
                at = order.ravel()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(queries[rows]), pa.array(classes[at]),
                        pa.array(np.full(len(at), one.column("cell")[0].as_py(), np.int32)), pa.array(score[rows, at]),
                    ],
                    schema=target,
                )

    schema = pairs.sparkSession.createDataFrame([], FOUND).schema
    return pairs.mapInArrow(run, schema)


class ClaimIndex:
    """Written classes with their cells; ``probes`` cells of a query reach ``TARGET_RECALL`` on a sample."""

    def __init__(self, vectors: DataFrame, k: int, cells: int | None = None):
        self.k = k
        self.classes = materialise(vector_classes(vectors, k + 1), "classes")
        self.cells = learn_cells(self.classes, cells)
        near = _cells_of(self.classes.select("class_id", "vector"), self.cells, 1)
        near = near.withColumn("cell", F.get("near", F.lit(0))).drop("near")
        self.blocks = materialise(_in_blocks(near, "class_id", "class"), "blocks")

    def search(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, class_id, cell, similarity): for each (query_id, vector) its best k + 1 classes
        of the probed cells; without ``probes`` of all of them, which is exact."""
        if not len(self.cells):
            return queries.sparkSession.createDataFrame([], FOUND)
        asked = _cells_of(queries, self.cells, probes or len(self.cells))
        asked = asked.withColumn("cell", F.explode("near")).drop("near")
        pairs = _in_blocks(asked, "query_id", "query").join(self.blocks, "cell")
        best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "class_id")
        met = _meetings(pairs, self.k + 1).withColumn("n", F.row_number().over(best))
        return met.filter(F.col("n") <= self.k + 1).drop("n")

    def calibrate(self, queries: DataFrame, target: float = TARGET_RECALL) -> int:
        """The least number of probes that meets ``target`` of the neighbours of a bounded sample of queries."""
        sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES)
        sample = materialise(sample, "calibration")
        if not len(self.cells) or sample.isEmpty():
            return 1
        order = _cells_of(sample, self.cells, len(self.cells)).select("query_id", "near")
        met = self.search(sample).join(order, "query_id")
        rank = met.select(F.array_position("near", F.col("cell")).alias("rank"))
        return int(rank.agg(F.percentile_approx("rank", target, 10_000)).head()[0])


def _queries(vectors: DataFrame, every: int) -> DataFrame:
    return vectors.filter(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), "vector")


def _expanded(met: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Ids instead of classes: a query's own id goes, ties by id."""
    rows = met.join(classes.select("class_id", "members"), "class_id")
    rows = rows.select("query_id", "similarity", F.explode("members").alias("claim_id")).filter("claim_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "claim_id")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "claim_id", F.round("similarity", 6).alias("similarity"))


def similar_claims(
    rows: DataFrame,
    k: int = 10,
    every: int = 100,
    exact: bool = False,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    cells: int | None = None,
) -> DataFrame:
    """(query_id, rank, claim_id, similarity): the ``k`` nearest rows of each row whose id ``every`` divides.

    All rows are searched, through the probes that calibration finds to meet 95% of the neighbours, or through all
    cells with ``exact``. Similarity is the cosine; ties go to the smaller id, a row is not its own neighbour, and of
    several rows with one id the one with the smallest vector counts. Rows without an id and vectors that are NULL, empty, of another length, zero or not
    finite have no neighbours and are none; fewer rows than ``k`` give fewer neighbours, an empty table none. Further columns
    are ignored. Bounded: the sample for cells, the number of cells (both broadcast as one small matrix) and
    the calibration queries; the index holds every row. Runs jobs while it is being defined.
    """
    vectors = usable_vectors(rows, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    vectors = materialise(vectors, "vectors")
    index = ClaimIndex(vectors, k, cells)
    queries = _queries(vectors, every)
    probes = None if exact else index.calibrate(queries)
    return _expanded(index.search(queries, probes), index.classes, k)


def recall_report(rows: DataFrame, k: int = 10, every: int = 100, least: float = 0.9) -> DataFrame:
    """One row: queries, exact neighbours, and whether probing met at least the share ``least`` of them.

    A neighbour counts as met if a claim of its similarity was found at its rank, so copies do not matter.
    """
    exact = similar_claims(rows, k, every, exact=True)
    found = similar_claims(rows, k, every).select("query_id", "rank", F.col("claim_id").alias("met"))
    both = exact.join(found.groupBy("query_id").agg(F.collect_set("met").alias("met")), "query_id", "left")
    met = F.coalesce(F.array_contains("met", F.col("claim_id")), F.lit(False))
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"),
        (F.coalesce(F.avg(met.cast("double")), F.lit(1.0)) >= least).alias("reached"),
    )
