"""LM scoring by masked pseudo-likelihood: each word is predicted from the words on both its sides.

The network sees ``REACH`` words to the left and to the right of a masked place. Each place of the window
has an embedding table; their sum goes through tanh, and a softmax in two steps (class, then word in
the class) gives the probability of the masked word. A document's score is the sum of the log
probabilities of all its words.

Vocabulary. All words of the corpus are counted. The most frequent ones have outputs of their own, in
classes of equal size by frequency; the others share one class of hash buckets. The probability of such a
word is that of its bucket times its share of the words in the bucket, from the counts of all words. A word
without a count gets the share of ``UNSEEN`` occurrences.

Texts are read twice: to count words, and to be encoded. Encoding writes the outputs of the words and, by block of
neighbouring documents, each rare word once with a place in the block. Training reads the outputs. The rare words of
blocks meet the counts, and the counts go back to their block, which is scored as a whole. A block has at most
``BLOCK_WORDS`` rare words and ``BLOCK_TOKENS`` words, and one document more.

Training covers the whole corpus. Every task goes once over all windows of its documents, in
mini-batches with Adagrad steps from a common start, whose output biases are the corpus frequencies.
The tasks' parameters are averaged by Spark, weighted by their words: sums of vectors in ``SALTS`` groups, then
their sum, before it reaches the driver, which holds one network of fixed size. Tasks read the same documents
again after the loss of an executor and get the same network.

Defined cases: a NULL or blank text has no words and the score 0. Rows come out one for one, also
repeated ones; NULL ids stay. Ties in frequency go by the word. An empty table gives an empty table. Other
columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources import tables
from .common import ROW, map_batches, materialise, numbered, portions, texts

CLASS_SIZE = 32
CLASSES = 32
REACH = 2
HIDDEN = 16
BATCH = 16384
SCORED = 4096
RATE = 0.1
COUNTER_BOUND = 300_000
BLOCK = 512
SALTS = 256
BLOCK_WORDS = 150_000
BLOCK_TOKENS = 3_000_000
UNSEEN = 0.5
# A count and a place in a block as one long: places have 31 bits, as a text has less than 2 GB, counts of rare words 32.
PLACE_BITS = 31

VOCABULARY = CLASS_SIZE * (CLASSES - 1)
OUTPUTS = CLASS_SIZE * CLASSES
PAD = OUTPUTS

Params = dict[str, np.ndarray]


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


class Vocabulary(dict):
    """Ids of words; a word without its own goes to a hash bucket of the last class."""

    def __missing__(self, word: bytes) -> int:
        return VOCABULARY + xxhash.xxh32_intdigest(word) % CLASS_SIZE


def fresh_params(counts: np.ndarray) -> Params:
    """The common start: small fixed embeddings, and biases that say the corpus frequencies."""
    rng = np.random.default_rng(7)
    n = counts.reshape(CLASSES, CLASS_SIZE) + 0.5
    return {
        "embed": rng.normal(0, 0.1, (2 * REACH, OUTPUTS + 1, HIDDEN)).astype(np.float32),
        "hidden": np.zeros(HIDDEN, np.float32),
        "class": rng.normal(0, 0.1, (HIDDEN, CLASSES)).astype(np.float32),
        "class_bias": np.log(n.sum(1) / n.sum()).astype(np.float32),
        "word": rng.normal(0, 0.1, (CLASSES, HIDDEN, CLASS_SIZE)).astype(np.float32),
        "word_bias": np.log(n / n.sum(1, keepdims=True)).astype(np.float32),
    }


def windows(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (one row per place of the window), masked words, and the document of each."""
    gap = np.full(REACH, PAD, np.int64)
    flat = np.concatenate([gap, *(x for d in docs for x in (d, gap))])
    at = np.flatnonzero(flat != PAD)
    places = [k for k in range(-REACH, REACH + 1) if k]
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return np.stack([flat[at + k] for k in places]), flat[at], owner


def _softmax(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of ``y`` and all probabilities, by columns; ``z`` is overwritten."""
    z -= z.max(0)
    own = z[y, np.arange(len(y))]
    np.exp(z, out=z)
    total = z.sum(0)
    z /= total
    return own - np.log(total), z


def forward(params: Params, context: np.ndarray, y: np.ndarray, grads: bool = False):
    """Log probabilities of the masked words, and the gradients of their mean if asked for.

    Words are ordered by class and lie in columns, so that each class is one slice.
    """
    cls = (y // CLASS_SIZE).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    context, cls, member = context[:, order], cls[order], y[order] % CLASS_SIZE
    ends = np.searchsorted(cls, np.arange(CLASSES + 1))
    h = np.take(params["embed"][0], context[0], 0)
    for k in range(1, len(context)):
        h += np.take(params["embed"][k], context[k], 0)
    h += params["hidden"]
    h = np.tanh(np.ascontiguousarray(h.T))
    n = np.arange(len(y))
    logp, p = _softmax(params["class"].T @ h + params["class_bias"][:, None], cls)
    if grads:
        p[cls, n] -= 1
        g = {"class": h @ p.T, "class_bias": p.sum(1)}
        g["word"], g["word_bias"] = np.zeros_like(params["word"]), np.zeros_like(params["word_bias"])
        back = params["class"] @ p
    for c in range(CLASSES):
        at = slice(ends[c], ends[c + 1])
        if at.start == at.stop:
            continue
        own, m = h[:, at], member[at]
        lp, q = _softmax(params["word"][c].T @ own + params["word_bias"][c][:, None], m)
        logp[at] += lp
        if grads:
            q[m, n[: len(m)]] -= 1
            g["word"][c], g["word_bias"][c] = own @ q.T, q.sum(1)
            back[:, at] += params["word"][c] @ q
    placed = np.empty_like(logp)
    placed[order] = logp
    if not grads:
        return placed
    back *= 1 - h * h
    g["hidden"] = back.sum(1)
    g["embed"] = np.empty_like(params["embed"])
    columns = back.astype(np.float64)
    for k, ids in enumerate(context):
        for j in range(HIDDEN):
            g["embed"][k, :, j] = np.bincount(ids, columns[j], OUTPUTS + 1)
    return placed, {k: v / len(y) for k, v in g.items()}


def train(params: Params, batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[Params, int]:
    """One pass of Adagrad steps; the trained copy and the number of words seen."""
    params = {k: v.copy() for k, v in params.items()}
    square = {k: np.full_like(v, 1e-8) for k, v in params.items()}
    seen = 0
    for context, y in batches:
        _, grads = forward(params, context, y, grads=True)
        for k, g in grads.items():
            square[k] += g * g
            params[k] -= RATE * g / np.sqrt(square[k])
        seen += len(y)
    return params, seen


def word_ids(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The rows with ``ids``, the outputs of their words, in place of ``text``."""

    def make(batch):
        found = [split(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        ids = [np.fromiter(map(vocabulary.__getitem__, w), np.int16, len(w)).tobytes() for w in found]
        yield {**{c: batch.column(c) for c in names}, "ids": ids}

    names = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    return map_batches(docs, make, ", ".join([*(f"{c} {kinds[c]}" for c in names), "ids binary"]))


def _decoded(column) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int16) for x in column.to_pylist()]


class RareWords(dict):
    """Places of the words of a block: outputs of their own, or ``OUTPUTS`` and more for rare ones as they come."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.words: list[bytes] = []
        self.buckets: list[int] = []
        self.tokens, self.docs = 0, []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = OUTPUTS + len(self.words)
        self.words.append(word)
        self.buckets.append(VOCABULARY + xxhash.xxh32_intdigest(word) % CLASS_SIZE)
        return place

    def add(self, text: bytes) -> None:
        words = split(text)
        self.docs.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.tokens += len(words)

    def full(self) -> bool:
        return len(self.words) >= BLOCK_WORDS or self.tokens >= BLOCK_TOKENS

    def take(self) -> tuple[list[bytes], list[bytes]]:
        """The outputs of the words of the documents since the last call, and the places of the rare ones."""
        outputs = np.array([*range(OUTPUTS), *self.buckets], np.int16)
        rare = [(d[d >= OUTPUTS] - OUTPUTS).astype(np.int32).tobytes() for d in self.docs]
        ids = [outputs[d].tobytes() for d in self.docs]
        self.docs = []
        return ids, rare


def encode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Numbered texts as outputs, and the rare words of each block; written.

    A row is a document (block, doc_id, __row, ids, rare) or a rare word (block, word, at); the
    other columns are NULL. A block is named by the key of its first document.
    """
    kind = dict(rows.dtypes)["doc_id"]
    fields = rows.sparkSession.createDataFrame(
        [], f"block long, doc_id {kind}, {ROW} long, ids binary, rare binary, word binary, at int"
    ).schema
    target = to_arrow_schema(fields)

    def emit(n, **columns):
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, f.type) if f.name not in columns
                else columns[f.name] if isinstance(columns[f.name], pa.Array)
                else pa.array(columns[f.name], f.type)
                for f in target
            ],
            schema=target,
        )

    def documents(batch, first, last, name, block):
        ids, rare = block.take()
        own = batch.slice(first, last - first)
        return emit(
            len(ids), block=[name] * len(ids), doc_id=own.column("doc_id"), ids=ids, rare=rare,
            **{ROW: own.column(ROW)},
        )

    def words(name, block):
        n = len(block.words)
        return emit(n, block=[name] * n, word=block.words, at=list(range(n)))

    def run(batches):
        block = name = None
        for batch in (part for whole in batches for part in portions(whole)):
            keys, first = batch.column(ROW).to_pylist(), 0
            for i, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                if block is None:
                    block, name = RareWords(vocabulary), keys[i]
                block.add(text)
                if block.full():
                    yield documents(batch, first, i + 1, name, block)
                    yield words(name, block)
                    block, first = None, i + 1
            if block is not None and first < len(keys):
                yield documents(batch, first, len(keys), name, block)
        if block is not None:
            yield words(name, block)

    coded = rows.select("doc_id", ROW, "text").mapInArrow(run, fields)
    return tables.materialise(coded, "encoded-words")


def _together(docs: list[np.ndarray], size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Neighbouring documents together until they hold ``size`` words, with the first one's index."""
    start, words = 0, 0
    for i, d in enumerate(docs):
        words += len(d)
        if words >= size:
            yield start, docs[start : i + 1]
            start, words = i + 1, 0
    if start < len(docs):
        yield start, docs[start:]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; tasks fold their words before the shuffle."""

    def run(batches):
        counts: Counter = Counter()
        for batch in (part for whole in batches for part in portions(whole)):
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                counts.update(split(t))
                if len(counts) > COUNTER_BOUND:
                    yield emit(counts)
                    counts.clear()
        yield emit(counts)

    def emit(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
            ["word", "n"],
        )

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def bucket_totals(counted: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How many words of the corpus each hash bucket has."""

    def run(batches):
        totals = np.zeros(CLASS_SIZE, np.int64)
        for batch in batches:
            ids = np.fromiter(map(vocabulary.__getitem__, batch.column("word").to_pylist()), np.int64)
            rare = ids >= VOCABULARY
            np.add.at(totals, ids[rare] - VOCABULARY, batch.column("n").to_numpy()[rare])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CLASS_SIZE), pa.int32()), pa.array(totals)], ["bucket", "n"]
        )

    summed = counted.select("word", "n").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")
    )
    totals = np.zeros(CLASS_SIZE)
    for r in summed.collect():
        totals[r["bucket"]] = r["n"]
    return totals


def counted_vocabulary(counted: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, the counts of its outputs, and the words in each bucket: results of fixed size."""
    top = counted.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    vocabulary = Vocabulary({bytes(r["word"]): i for i, r in enumerate(top)})
    counts = np.zeros(OUTPUTS)
    counts[: len(top)] = [r["n"] for r in top]
    counts[VOCABULARY:] = totals = bucket_totals(counted, vocabulary)
    return vocabulary, counts, totals


def fit(docs: DataFrame) -> tuple[Vocabulary, Params]:
    """The vocabulary and the averaged network of all documents."""
    return fit_counted(docs)[:2]


def fit_counted(docs: DataFrame) -> tuple[Vocabulary, Params, DataFrame, np.ndarray]:
    """The vocabulary, the averaged network, the counts of all words, and the words in each bucket."""
    counted = materialise(count_words(docs), "word-counts")
    vocabulary, counts, totals = counted_vocabulary(counted)
    return vocabulary, average(docs, vocabulary, fresh_params(counts)), counted, totals


def average(docs: DataFrame, vocabulary: Vocabulary, start: Params) -> Params:
    """The mean of the networks that the tasks train on texts, weighted by their words."""
    return average_encoded(word_ids(docs.select("text"), vocabulary), start)


def average_encoded(encoded: DataFrame, start: Params) -> Params:
    """The mean of the networks that the tasks train on ``ids``, weighted by their words."""

    def examples(batches):
        for batch in (part for whole in batches for part in portions(whole)):
            for _, portion in _together(_decoded(batch.column("ids")), 4 * BATCH):
                context, y, _ = windows(portion)
                for k in range(0, len(y), BATCH):
                    yield context[:, k : k + BATCH], y[k : k + BATCH]

    def run(batches):
        params, seen = train(start, examples(batches))
        if seen:
            flat = np.concatenate([params[k].ravel() for k in sorted(params)]).astype(np.float64) * seen
            for b in range(0, len(flat), BLOCK):
                yield vector(b, seen, flat[b : b + BLOCK])

    def vector(block, seen, values):
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([seen], pa.int64()),
             pa.array([values], pa.list_(pa.float64()))],
            ["block", "seen", "values"],
        )

    def summed(key, table):
        values = np.sum([np.asarray(v) for v in table.column("values").to_pylist()], 0)
        whole = vector(key[0].as_py(), sum(table.column("seen").to_pylist()), values)
        return pa.Table.from_batches([whole])

    schema = "block int, seen long, values array<double>"
    trained = encoded.select("ids").mapInArrow(run, schema)
    salted = trained.withColumn("salt", F.spark_partition_id() % SALTS)
    sums = salted.groupBy("block", "salt").applyInArrow(summed, schema).groupBy("block").applyInArrow(summed, schema)
    held = sorted(sums.collect())
    if not held:
        return start
    flat = np.concatenate([np.array(r["values"]) / r["seen"] for r in held]).astype(np.float32)
    out, at = {}, 0
    for k in sorted(start):
        out[k] = flat[at : at + start[k].size].reshape(start[k].shape)
        at += start[k].size
    return out


def log_probs(docs: list[np.ndarray], params: Params, less: np.ndarray | None = None) -> np.ndarray:
    """The summed log probabilities of documents, with ``less`` taken off for each word by its output."""
    sums = np.zeros(len(docs))
    for start, portion in _together(docs, 4 * BATCH):
        context, y, owner = windows(portion)
        for k in range(0, len(y), SCORED):
            logp = forward(params, context[:, k : k + SCORED], y[k : k + SCORED])
            if less is not None:
                logp = logp - less[y[k : k + SCORED]]
            sums[start : start + len(portion)] += np.bincount(owner[k : k + SCORED], logp, len(portion))
    return sums


def _rounded(sums: DataFrame) -> DataFrame:
    n, total = F.col("n_tokens"), F.col("log_prob")
    mean = F.when(n > 0, F.round(total / n, 4))
    return sums.select("doc_id", "n_tokens", F.round(total, 2).alias("log_prob"), mean.alias("mean_log_prob"))


def score(docs: DataFrame, vocabulary: Vocabulary, params: Params) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row, by outputs: a bucket counts as one word."""

    def make(batch):
        found = _decoded(batch.column("ids"))
        n = np.array([len(d) for d in found], np.int64)
        yield {"doc_id": batch.column("doc_id"), "n_tokens": n, "log_prob": log_probs(found, params)}

    kind = dict(docs.dtypes)["doc_id"]
    return _rounded(map_batches(
        word_ids(docs.select("doc_id", "text"), vocabulary), make, f"doc_id {kind}, n_tokens long, log_prob double"
    ))


def score_encoded(encoded: DataFrame, params: Params, counted: DataFrame, totals: np.ndarray) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every encoded document, by words."""
    less = np.zeros(OUTPUTS)
    less[VOCABULARY:] = np.log(totals + UNSEEN)
    docs = encoded.filter("ids IS NOT NULL").select("block", "doc_id", "ids", "rare")
    rare = encoded.filter("word IS NOT NULL").select("block", "at", "word")
    # No word of the corpus has the count 0, so it stands for words without a count.
    held = F.shiftleft(F.coalesce("n", F.lit(0).cast("long")), PLACE_BITS).bitwiseOR(F.col("at").cast("long"))
    shares = rare.join(counted, "word", "left").select(F.col("block").alias("part"), held.alias("held"))

    def run(left, right):
        found = _decoded(left.column("ids"))
        logs = np.zeros(right.num_rows)
        held = right.column("held").to_numpy()
        n = held >> PLACE_BITS
        logs[held & ((1 << PLACE_BITS) - 1)] = np.log(np.where(n > 0, n, UNSEEN))
        more = [logs[np.frombuffer(x, np.int32)].sum() for x in left.column("rare").to_pylist()]
        return pa.table({
            "doc_id": left.column("doc_id"),
            "n_tokens": pa.array([len(d) for d in found], pa.int64()),
            "log_prob": pa.array(log_probs(found, params, less) + np.array(more, np.float64), pa.float64()),
        })

    kind = dict(encoded.dtypes)["doc_id"]
    return _rounded(
        docs.groupBy("block").cogroup(shares.groupBy("part")).applyInArrow(
            run, f"doc_id {kind}, n_tokens long, log_prob double"
        )
    )


def score_words(
    rows: DataFrame, vocabulary: Vocabulary, params: Params, counted: DataFrame, totals: np.ndarray
) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every numbered row, by words."""
    return score_encoded(encode(rows, vocabulary), params, counted, totals)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Train on all texts, then score them all."""
    rows = numbered(texts(docs, id_col, text_col))
    counted = materialise(count_words(rows), "word-counts")
    vocabulary, counts, totals = counted_vocabulary(counted)
    encoded = encode(rows, vocabulary)
    params = average_encoded(encoded.filter("ids IS NOT NULL"), fresh_params(counts))
    return score_encoded(encoded, params, counted, totals)
