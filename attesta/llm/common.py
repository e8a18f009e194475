"""What several text operators share: reading, word rules, row keys and batch mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import tables

# The white space between words, and the same as characters.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

ROW, PATH, PLACE = "__row", "__path", "__place"
# Column names that operators use beside those of a table.
RESERVED = frozenset((ROW, PATH, PLACE, "__lines", "_metadata"))
FILE_SHIFT = 40
PORTION = 4 << 20

__all__ = [
    "ROW", "SPACE", "SPACE_CHARS", "map_batches", "materialise", "numbered", "portions",
    "rows_only", "sheltered", "table", "texts", "words",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow intermediate under the shared folder and read it back.

    The rows are first gathered into files of the advisory size, as many tasks with a few rows each would
    leave as many small files.
    """
    return tables.materialise(df.hint("rebalance"), name)


def words(text: Column) -> Column:
    """The words of a text as an array; NULL and blank texts give an empty one."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """(doc_id, text) alone, so that no further column can clash; a NULL text is empty."""
    return docs.select(
        *more,
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def sheltered(docs: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The table with columns that clash with an operator's own renamed, and how to give their names back.

    Names are compared without case, as Spark does.
    """
    taken = {c.lower() for c in docs.columns}
    names = []
    for c in docs.columns:
        free = c
        while free.lower() in RESERVED or (free != c and free.lower() in taken):
            free += "_own"
        names.append(free)
    if names == docs.columns:
        plain = docs
    else:
        plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def restored(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{n}`").alias(c) for c, n in zip(docs.columns, names, strict=True)])

    return plain, restored


def _reads_rows_once(docs: DataFrame) -> bool:
    """Whether a table is a scan of files under projections and filters, so that each row is one row of a file."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "ResolvedHint", "View"):
        plan = plan.children().head()
    return plan.nodeName().startswith(("Relation", "LogicalRelation"))


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own in ``__row``, whatever their ids are.

    The key is the file's place among the sorted files and the row's place in its file. It does not
    depend on how files are split or how many executors there are, so each scan gives the same keys. A table
    that is not a plain scan of files (also one that repeats, joins or limits the rows of such a scan, where several rows
    would have one place) is written first; call this once and use what it returns. Columns with
    the names of ``RESERVED`` have to be renamed before (``sheltered``).
    The list of files, one short row each, is broadcast.
    """
    if not _reads_rows_once(docs):
        docs = tables.materialise(docs, "rows")
    try:
        file = docs.metadataColumn("_metadata")
        placed = docs.select("*", file["file_path"].alias(PATH), file["row_index"].alias(PLACE))
    except AnalysisException:  # files of a format without places
        docs = tables.materialise(docs, "rows")
        file = docs.metadataColumn("_metadata")
        placed = docs.select("*", file["file_path"].alias(PATH), file["row_index"].alias(PLACE))
    files = sorted(r[0] for r in placed.select(PATH).distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), f"{ROW} long, {PATH} string")
    key = F.shiftleft(F.col(ROW), FILE_SHIFT) + F.col(PLACE)
    return placed.join(F.broadcast(numbers), PATH).select(*[f"`{c}`" for c in docs.columns], key.alias(ROW))


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``PORTION`` bytes, so that a task's lists of texts stay small."""
    step = max(1, batch.num_rows * PORTION // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


def rows_only(narrow: DataFrame) -> DataFrame:
    """Marks a table of row keys and little else as the hashed side of a join with whole texts.

    Texts then stream past it and are not sorted; each partition holds its share of the keys.
    """
    return narrow.hint("shuffle_hash")


def map_batches(
    df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[dict]], schema: str
) -> DataFrame:
    """Apply ``make`` to each Arrow batch; it yields columns by name, in the schema's types."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    target = to_arrow_schema(fields)

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole)):
            for columns in make(batch):
                yield pa.RecordBatch.from_arrays(
                    [
                        c if isinstance(c, pa.Array) else pa.array(c, f.type)
                        for c, f in ((columns[f.name], f) for f in target)
                    ],
                    schema=target,
                )

    return df.mapInArrow(run, fields)
