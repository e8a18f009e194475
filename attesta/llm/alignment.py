"""Alignment of two tokenizers over a corpus by inverted pair bitmaps.

Both tokenizers cut a text into byte ranges. Where tokens of both end at the same byte a group ends, and a
token of one is linked to every token of the other whose range overlaps its own. For each pair of ids a
block of documents keeps a compressed bitmap of the documents that hold it linked, and bitmaps (planes) of the
bits of how often they do beyond once. Popcounts over the disjoint blocks give the document count of a pair. The
postings then carry the counts back: each bitmap adds its pair's count to the documents it holds.

Texts are read once, in one pass that writes documents and postings together. Neither tokenizer has a
token that reaches over the start of white space, so texts are cut there (see ``CHUNK``) and each distinct piece is
encoded once per task.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, texts

FOLDER = "/opt/tokenizers"
BYTE_BPE = f"{FOLDER}/byte_bpe_50k.json"
PIECE_BPE = f"{FOLDER}/piece_bpe_32k.model"

# A piece of a text starts with white space behind other characters, of a kind that no token of either
# vocabulary holds behind other characters (a carriage return, for one, is not of that kind).
CHUNK = re.compile(r"\s*\S+(?:[^\S \n\t]\s*\S*)*|\s+")

BLOCK_DOCS = 1 << 13
BLOCK_CHARS = 6 << 20
KEPT_CHUNKS = 1 << 18
KEPT_LENGTH = 256
# Encoded pieces take some kilobytes each until their ids are read, so this many are encoded at a time.
ENCODED = 1 << 12
DENSE = 16
# A pair, a document of the block and a number of times share one sorted 63-bit value.
B_BITS, POS_BITS, TIMES_BITS = 15, 13, 19
MOST_TIMES = (1 << TIMES_BITS) - 1
DOCS_PLANE = -1

POSTINGS = (
    "block long, pos int, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, pair int, plane int, n int, dense boolean, bits binary"
)
_DOC = ("pos", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_POSTING = ("pair", "plane", "n", "dense", "bits")


def byte_level_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies, by their common rule.

    Printable characters of Latin-1 stand for themselves, all other bytes for characters from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Pair:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, byte_bpe: str, piece_bpe: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        byte_of = byte_level_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in byte_of for c in token)
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if known else token.encode()
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            one = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            self.b_bytes.append(one)
        self.space = self.b.piece_to_id("▁")
        if len(self.b_bytes) > 1 << B_BITS or len(self.a_bytes) > 1 << (31 - B_BITS):
            raise ValueError("ids of a pair have to fit into 31 bits")

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int], bool]]:
        """Ids of both for each piece, and whether the bytes of both are those of the piece.

        The second tokenizer puts a space in front, which is the first one of a piece that starts with a space.
        """
        ours = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        bare = [c[1:] if c[0] == " " else c for c in chunks]
        theirs = self.b.encode(bare, num_threads=1)
        for chunk, a, b in zip(chunks, ours, theirs, strict=True):
            if chunk == " ":
                b = [self.space]
            elif chunk[0] != " ":
                b = b[1:] if b and b[0] == self.space else []
            raw = chunk.encode()
            same = (
                b"".join([self.a_bytes[i] for i in a]) == raw and b"".join([self.b_bytes[i] for i in b]) == raw
            )
            yield a, b, same


class Chunks:
    """The pieces met so far: number of tokens, groups and links, group text, and linked pairs of ids."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.a_size = np.array([len(x) for x in pair.a_bytes])
        self.b_size = np.array([len(x) for x in pair.b_bytes])
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.n_a, self.n_b, self.n_groups, self.n_links = (array("q") for _ in range(4))
        self.same = bytearray()
        self.groups: list[str] = []
        self.pairs = array("q")
        self.starts = array("q")

    def ids(self, block: list[str | None]) -> list[np.ndarray]:
        """The pieces of each text, none where a tokenizer changes it; new ones are encoded together.

        Long pieces are encoded for each block that has them.
        """
        pieces = [CHUNK.findall(" " + t) if t else [] for t in block]
        found = [list(map(self.index.get, own)) for own in pieces]
        new = dict.fromkeys(p for own, ids in zip(pieces, found, strict=True) if None in ids
                            for p, i in zip(own, ids, strict=True) if i is None)
        if new:
            at = dict(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            added = list(new)
            for start in range(0, len(added), ENCODED):
                self._add(added[start : start + ENCODED])
            self.index.update((p, i) for p, i in at.items() if len(p) <= KEPT_LENGTH)
            found = [
                [at[p] if i is None else i for p, i in zip(own, ids, strict=True)] if None in ids else ids
                for own, ids in zip(pieces, found, strict=True)
            ]
        out = [np.array(ids, np.int64) for ids in found]
        same = np.frombuffer(self.same, np.uint8)
        return [ids if same[ids].all() else ids[:0] for ids in out]

    def _add(self, new: list[str]) -> None:
        coded = list(self.pair.encode(new))
        empty = ([], [])
        kept = [(a, b) if same else empty for a, b, same in coded]
        self.same.extend(same for _, _, same in coded)
        n_a = np.array([len(a) for a, _ in kept], np.int64)
        n_b = np.array([len(b) for _, b in kept], np.int64)
        a_ids = np.array([i for a, _ in kept for i in a], np.int64)
        b_ids = np.array([i for _, b in kept for i in b], np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        # The second tokens that overlap each first one lie between these two, both included.
        low = np.searchsorted(b_end, a_end - self.a_size[a_ids], "right")
        high = np.searchsorted(b_end, a_end, "left")
        times = high - low + 1
        partner = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        a_chunk = np.repeat(np.arange(len(new)), n_a)
        last_a = np.searchsorted(a_end, both, "left")
        last_b = np.searchsorted(b_end, both, "left")
        n_groups = np.bincount(a_chunk[last_a], minlength=len(new))
        n_links = np.bincount(a_chunk, weights=times, minlength=len(new)).astype(np.int64)
        start = len(self.pairs)
        self.pairs.frombytes(((np.repeat(a_ids, times) << B_BITS) | b_ids[partner]).tobytes())
        self.starts.frombytes((start + np.cumsum(n_links) - n_links).tobytes())
        for own, figures in (
            (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, n_links),
        ):
            own.frombytes(figures.astype(np.int64).tobytes())
        a_text, b_text = list(map(str, a_ids.tolist())), list(map(str, b_ids.tolist()))
        cuts = zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True)
        spelled, i, j = [], 0, 0
        for x, y in cuts:
            spelled.append(f"{','.join(a_text[i:x])}|{','.join(b_text[j:y])}")
            i, j = x, y
        done = 0
        for n in n_groups.tolist():
            self.groups.append(";".join(spelled[done : done + n]))
            done += n

    def figures(self, name: str) -> np.ndarray:
        return np.frombuffer(getattr(self, name), np.int64)


def runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def bitmaps(pairs: np.ndarray, pos: np.ndarray, n_docs: int) -> Iterator[dict]:
    """One compressed bitmap per run of a pair: a list of 16-bit places, or bits where these are shorter."""
    starts = runs(pairs)
    counts = np.diff(np.r_[starts, len(pairs)])
    dense = counts > max(1, n_docs // DENSE)
    if (~dense).any():
        chosen = np.repeat(~dense, counts)
        offsets = np.r_[0, np.cumsum(2 * counts[~dense])].astype(np.int32)
        places = pos[chosen].astype("<u2").tobytes()
        bits = pa.Array.from_buffers(
            pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(places)]
        )
        yield {"pair": pairs[starts[~dense]], "n": counts[~dense], "dense": False, "bits": bits}
    at = np.flatnonzero(dense)
    for some in (at[i : i + 1024] for i in range(0, len(at), 1024)):
        rows = np.zeros((len(some), (n_docs + 7) // 8 * 8), np.uint8)
        for row, k in enumerate(some):
            rows[row, pos[starts[k] : starts[k] + counts[k]]] = 1
        bits = pa.array([r.tobytes() for r in np.packbits(rows, axis=1)], pa.binary())
        yield {"pair": pairs[starts[some]], "n": counts[some], "dense": True, "bits": bits}


def places(bits: pa.Array, dense: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, document) for every set bit of some bitmaps of one kind."""
    if dense:
        raw = bits.to_pylist()
        found = [np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))) for x in raw]
        sizes = [len(f) for f in found]
        return np.repeat(np.arange(len(raw)), sizes), np.concatenate(found) if found else np.zeros(0, np.int64)
    _, offsets, data = bits.buffers()
    ends = np.frombuffer(offsets, np.int32)[bits.offset : bits.offset + len(bits) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u2") if data else np.zeros(0, "<u2")
    return np.repeat(np.arange(len(bits)), np.diff(ends) // 2), values.astype(np.int64)


def flattened(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(document, piece) for all pieces of a block."""
    return np.repeat(np.arange(len(ids)), [len(x) for x in ids]), np.concatenate([np.zeros(0, np.int64), *ids])


def postings_of(ids: list[np.ndarray], chunks: Chunks) -> Iterator[dict]:
    """The bitmaps and planes of the linked pairs of a block of documents, given as lists of pieces."""
    pos, flat = flattened(ids)
    key, times = np.unique(pos * max(1, len(chunks.groups)) + flat, return_counts=True)
    parts = -(-times // MOST_TIMES)
    key, last = np.repeat(key, parts), times - (parts - 1) * MOST_TIMES
    times = np.full(len(key), MOST_TIMES)
    times[np.cumsum(parts) - 1] = last
    pos, flat = np.divmod(key, max(1, len(chunks.groups)))
    n_links, starts = chunks.figures("n_links")[flat], chunks.figures("starts")[flat]
    where = np.repeat(starts - np.cumsum(n_links) + n_links, n_links) + np.arange(n_links.sum())
    pair = chunks.figures("pairs")[where]
    key = np.sort((pair << (POS_BITS + TIMES_BITS)) | np.repeat((pos << TIMES_BITS) | times, n_links))
    if not len(key):
        return
    mult, key = key & MOST_TIMES, key >> TIMES_BITS
    at = runs(key)
    mult, key = np.add.reduceat(mult, at) - 1, key[at]
    pairs, pos = key >> POS_BITS, key & ((1 << POS_BITS) - 1)
    for part in bitmaps(pairs, pos, len(ids)):
        yield {"plane": DOCS_PLANE, **part}
    for plane in range(int(mult.max()).bit_length()):
        held = (mult >> plane) & 1 == 1
        for part in bitmaps(pairs[held], pos[held], len(ids)):
            yield {"plane": plane, **part}


def documents_of(ids: list[np.ndarray], doc_ids: list, chunks: Chunks) -> dict:
    """The figures and group hash of a block of documents; without tokens these are zeros and ''."""
    out = {"pos": range(len(ids)), "doc_id": doc_ids, "groups_sha256": []}
    for x in ids:
        spelled = ";".join(map(chunks.groups.__getitem__, x.tolist()))
        out["groups_sha256"].append(hashlib.sha256(spelled.encode()).hexdigest() if len(x) else "")
    pos, flat = flattened(ids)
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        sums = np.bincount(pos, weights=chunks.figures(name)[flat], minlength=len(ids))
        out[name] = sums.astype(np.int64)
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts in blocks of a bounded number of documents and, one long text aside, of characters."""
    doc_ids, block, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            doc_ids.append(doc_id)
            block.append(text)
            chars += len(text)
            if len(block) == BLOCK_DOCS or chars >= BLOCK_CHARS:
                yield doc_ids, block
                doc_ids, block, chars = [], [], 0
    if block:
        yield doc_ids, block


def index(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Documents and postings of all texts, tagged by ``pair`` (NULL for documents), from one written pass.

    A block numbers the documents of a stretch of one task, so blocks are disjoint, and a block's documents
    and postings stem from one attempt of that task. The vocabularies (2 MB) are read by the driver.
    """
    spark = docs.sparkSession
    target = spark.createDataFrame([], POSTINGS).schema
    with open(byte_bpe, encoding="utf-8") as f, open(piece_bpe, "rb") as g:
        vocabularies = spark.sparkContext.broadcast((f.read(), g.read()))

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(target)
        chunks = Chunks(Pair(*vocabularies.value))
        number = TaskContext.get().partitionId() << 32

        def rows(columns):
            n = len(columns["n"] if "n" in columns else columns["pos"])
            full = []
            for f in schema:
                value = columns.get(f.name)
                if f.name == "block":
                    value = number
                if value is None:
                    full.append(pa.nulls(n, f.type))
                elif isinstance(value, (int, bool)):
                    full.append(pa.array(np.full(n, value), f.type))
                else:
                    full.append(value if isinstance(value, pa.Array) else pa.array(value, f.type))
            return pa.RecordBatch.from_arrays(full, schema=schema)

        for doc_ids, block in blocks(batches):
            ids = chunks.ids(block)
            yield rows(documents_of(ids, doc_ids, chunks))
            for part in postings_of(ids, chunks):
                yield rows(part)
            number += 1
            if len(chunks.groups) > KEPT_CHUNKS:
                chunks.clear()

    return materialise(texts(docs).mapInArrow(run, target), "alignment")


def pair_counts(indexed: DataFrame) -> DataFrame:
    """(pair, n_docs, n_links, best) for every linked pair of ids; ``best`` says whether no other partner
    of the first id is in more documents.

    Popcounts of the disjoint blocks add up: those of the document bitmaps, and 2^k times those of plane k.
    """
    times = F.expr(f"if(plane = {DOCS_PLANE}, 1L, shiftleft(1L, plane))")
    counts = (
        indexed.filter("pair IS NOT NULL")
        .groupBy("pair")
        .agg(
            F.sum(F.when(F.col("plane") == DOCS_PLANE, F.col("n")).otherwise(0)).alias("n_docs"),
            F.sum(F.col("n") * times).alias("n_links"),
        )
        .withColumn("a", F.shiftright("pair", B_BITS))
    )
    highest = counts.groupBy("a").agg(F.max("n_docs").alias("highest"))
    return counts.join(highest, "a").select(
        "pair", "n_docs", "n_links", (F.col("n_docs") == F.col("highest")).alias("best")
    )


def _scores(scored: DataFrame) -> DataFrame:
    """(block, pos, count_sum, n_best): what the postings of a block, dealt to one task, return to its documents."""
    schema = "block long, pos int, count_sum long, n_best long"
    target = scored.sparkSession.createDataFrame([], schema).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            block = batch.column("block").to_numpy()
            dense = batch.column("dense").to_numpy(zero_copy_only=False)
            plane = batch.column("plane").to_numpy()
            weight = np.where(plane == DOCS_PLANE, 1, 1 << np.maximum(plane, 0).astype(np.int64))
            gain = np.stack(
                [
                    batch.column("n_docs").to_numpy() * weight,
                    batch.column("best").to_numpy(zero_copy_only=False).astype(np.int64) * weight,
                ]
            )
            for one in np.unique(block):
                own = sums.setdefault(int(one), np.zeros((2, 1 << POS_BITS), np.int64))
                for kind in (False, True):
                    at = np.flatnonzero((block == one) & (dense == kind))
                    row, pos = places(batch.column("bits").take(pa.array(at)), kind)
                    for total, values in zip(own, gain, strict=True):
                        np.add.at(total, pos, values[at][row])
        for one, (counts, best) in sums.items():
            held = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(held), one)), pa.array(held.astype(np.int32)), pa.array(counts[held]),
                 pa.array(best[held])],
                schema=to_arrow_schema(target),
            )

    return scored.repartition("block").mapInArrow(run, target)


def align_tokenizers(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    byte_bpe: str = BYTE_BPE,
    piece_bpe: str = PIECE_BPE,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document.

    ``n_best`` counts the links whose pair is in the most documents of all pairs with its first id, ties
    included; ``count_sum`` adds up the document counts of the pairs of all links. A NULL or empty text, and
    one that either tokenizer changes, has no tokens: zeros and ''. Whole texts of any length are encoded.
    Repeated rows give a row each and count as documents of their own; NULL ids stay; an empty table gives no
    rows; further columns are ignored. Runs one job while it is being defined.
    """
    indexed = index(texts(docs, id_col, text_col), byte_bpe, piece_bpe)
    postings = indexed.filter("pair IS NOT NULL").select("block", *_POSTING)
    scores = _scores(postings.join(pair_counts(indexed).drop("n_links"), "pair").drop("pair", "n"))
    return (
        indexed.filter("pair IS NULL")
        .select("block", *_DOC)
        .join(scores, ["block", "pos"], "left")
        .select(
            "doc_id", "n_a", "n_b", "n_groups", "n_links",
            F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
            F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
            "groups_sha256",
        )
    )


def linked_pairs(docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(a_id, b_id, n_docs, n_links, best) of every pair of ids that some document holds linked."""
    return pair_counts(index(texts(docs), byte_bpe, piece_bpe)).select(
        F.shiftright("pair", B_BITS).alias("a_id"),
        F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b_id"),
        "n_docs", "n_links", "best",
    )
