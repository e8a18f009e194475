"""Line dedup: content-defined chunks of lines that occur again anywhere are removed.

A rolling hash runs over the hashes of the lines of a text, ``ROLL`` of them at a time. A chunk is a longest
stretch of such windows that each occurred before, so its boundaries lie where the rolling hash meets something
new. They follow content alone: lines added or lost elsewhere do not shift them, and a chunk may have
as few as ``ROLL`` lines. No sparser choice of boundaries does: a repeated run of two lines has one window, which
then has to be a boundary.

A window is looked for in the whole table by the two 64-bit hashes of its lines; it counts if a line of it has a
word. Then the lines of repeated windows are compared byte by byte: a hash that stands for two different
lines shows as a smallest and a largest line that differ, and no window with such a hash goes. The first
occurrence of a window stays (smallest id, first in the table, first in the text), the lines of all others go, unless
they overlap the first. So the first occurrence of each line always stays.

Hashes are counted and lines are compared with map-side folding, so a passage in a third of all texts costs a few
rows per task. Lines are fetched only where a window repeats.

Defined cases: NULL text stays NULL. A text that loses all its lines becomes empty; its row stays. A
line that is repeated without a neighbour is never removed. Repeated rows are copies: the first keeps its text.
NULL ids count as the largest. ``n_chars``, where present, follows the new text. All other columns, whatever
their names, come out as they were. An empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import ROW, map_batches, materialise, numbered, portions, rows_only, sheltered

ROLL = 2
WORD = re.compile(rb"[^\x20\x09-\x0D]")


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def line_hashes(lines: list[bytes]) -> np.ndarray:
    return np.fromiter(map(line_hash, lines), np.uint64, len(lines)).view(np.int64)


def _utf8(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def _windows(rows: DataFrame) -> DataFrame:
    """(doc_id, __row, line, a, b): every two neighbouring lines of which one has a word, as hashes."""

    def make(batch):
        at, line, first, second = [], [], [], []
        for i, text in enumerate(_utf8(batch.column("text"))):
            if not text or b"\n" not in text:
                continue
            lines = text.split(b"\n")
            worded = np.array([WORD.search(x) is not None for x in lines])
            hashes = line_hashes(lines)
            places = np.flatnonzero(worded[1:] | worded[:-1])
            at.append(np.full(len(places), i, np.int32))
            line.append(places.astype(np.int32))
            first.append(hashes[places])
            second.append(hashes[places + 1])
        joined = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
        at = joined(at, np.int32)
        yield {
            "doc_id": batch.column("doc_id").take(at), ROW: batch.column(ROW).take(at),
            "line": joined(line, np.int32), "a": joined(first, np.int64), "b": joined(second, np.int64),
        }

    kind = dict(rows.dtypes)["doc_id"]
    return map_batches(
        rows.select("doc_id", ROW, "text"), make, f"doc_id {kind}, {ROW} long, line int, a long, b long"
    )


def _line_bytes(rows: DataFrame) -> DataFrame:
    """(h, body): the lines of the windows that start at ``wanted``, each once a batch."""

    def make(batch):
        found = set()
        wanted = batch.column("wanted").to_pylist()
        for i, text in enumerate(_utf8(batch.column("text"))):
            lines = text.split(b"\n")
            found.update(lines[k] for place in wanted[i] for k in range(place, place + ROLL))
        bodies = list(found)
        yield {"h": line_hashes(bodies), "body": bodies}

    return map_batches(rows.select("text", "wanted"), make, "h long, body binary")


def repeated_lines(marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(__row, __lines): the places of the lines that go, for every numbered row that loses some."""
    rows = marked.select(
        F.col(f"`{id_col}`").alias("doc_id"), ROW, F.col(f"`{text_col}`").cast("string").alias("text")
    )
    found = materialise(_windows(rows), "line-windows")
    # Written, as the planner splits a crowded key only between two plain exchanges.
    again = materialise(
        found.groupBy("a", "b").count().filter("count > 1").select("a", "b"), "line-repeats"
    )
    met = materialise(found.join(again, ["a", "b"], "left_semi"), "line-matches")
    wanted = met.groupBy(ROW).agg(F.collect_set("line").alias("wanted"))
    bodies = _line_bytes(rows.join(rows_only(wanted), ROW))
    unlike = bodies.groupBy("h").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    unlike = materialise(unlike.filter("low != high").select("h"), "line-unlike")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", ROW, "line")
    first = materialise(met.groupBy("a", "b").agg(F.min(place).alias("first")), "line-firsts")
    apart = (F.col(ROW) != F.col(f"first.{ROW}")) | (F.col("line") >= F.col("first.line") + ROLL)
    later = met.join(first, ["a", "b"]).filter((place > F.col("first")) & apart)
    for side in ("a", "b"):
        later = later.join(unlike.withColumnRenamed("h", side), side, "left_anti")
    places = F.explode(F.sequence(F.col("line"), F.col("line") + (ROLL - 1))).alias("line")
    return later.select(ROW, places).groupBy(ROW).agg(F.collect_set("line").alias("__lines"))


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False
) -> DataFrame:
    """The rows with repeated chunks removed; ``counts`` adds removed_chunks and removed_lines.

    A chunk is counted for each stretch of lines that goes.

    Columns may have any names; with ``counts``, columns of those two names are replaced.
    """
    if counts:
        docs = docs.drop("removed_chunks", "removed_lines")
    original = docs
    docs, restored = sheltered(original)
    rows = numbered(docs)
    marked = rows.join(rows_only(repeated_lines(rows, id_col, text_col)), ROW, "left")
    added = [StructField("removed_chunks", IntegerType()), StructField("removed_lines", IntegerType())]
    schema = StructType([*docs.schema.fields, *(added if counts else [])])
    target, names = to_arrow_schema(schema), docs.columns

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole)):
            lost = batch.column("__lines").to_pylist()
            texts = _utf8(batch.column(text_col))
            gone_chunks, gone_lines = [0] * len(lost), [0] * len(lost)
            for i, own in enumerate(lost):
                if own:
                    lines, own = texts[i].split(b"\n"), set(own)
                    gone_lines[i] = len(own)
                    gone_chunks[i] = sum(k - 1 not in own for k in own)
                    texts[i] = b"\n".join(x for k, x in enumerate(lines) if k not in own)
            text = pa.array(texts, pa.binary()).cast(pa.string())
            columns = [text if n == text_col else batch.column(n) for n in names]
            extra = [pa.array(gone_chunks, pa.int32()), pa.array(gone_lines, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + (extra if counts else []), schema=target)

    out = marked.select(*[f"`{c}`" for c in names], "__lines").mapInArrow(run, schema)
    if "n_chars" in names and isinstance(docs.schema["n_chars"].dataType, (IntegerType, LongType)):
        n = F.length(f"`{text_col}`").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(n, F.col("n_chars")))
    if docs is original:
        return out
    return restored(out) if not counts else out.toDF(*original.columns, *[f.name for f in added])
