"""Toxicity: a chain of linear models, each fed the probabilities of those before it.

The categories are label columns, in the order of the chain. A model sees the text's features and
the earlier probabilities. While fitting, earlier probabilities are out-of-fold predictions, so a later
model learns from inputs as uncertain as those it meets when scoring.

Features: count and density of the terms that speak for a category in the labelled sample (document
frequencies, smoothed log odds over their standard error), and a few ratios of the whole text. Terms are
words and word beginnings, as languages that inflect or compound vary a stem.
Fitting takes at most ``MAX_TRAIN`` labelled documents, those with the smallest hash of their id; words
are counted and features made by Spark, and only the sample's feature rows (a bounded number of
numbers each) reach the driver, where numpy fits ridge-penalised logistic regressions. Scoring reads every
document in full.

A document is rejected when the last category's probability reaches its threshold: the lowest one, at
least ``LEAST_THRESHOLD``, above which out-of-fold predictions are right in ``PRECISION`` of the cases. Where
no threshold is that precise, as with noisy labels, the one with the best out-of-fold F score counts, and none
if no prediction above ``LEAST_THRESHOLD`` is right.

Defined cases: NULL text is empty and scored as such. Labels that are NULL, and labelled ids without a
document, are not used; of several labels of one id the largest counts; of several documents of one id
one is used for fitting. A category with one class only gets that class's share as its probability.
Without any labels all probabilities are 0 and nothing is rejected. NULL ids are scored, never fitted.
Repeated rows are scored alike. An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, materialise, portions, texts

MAX_TRAIN = 8192
TERMS_PER_CATEGORY = 64
STEMS = (3, 4, 5, 6, 7)
LEAST_DOCS = 5
FOLDS = 5
RIDGE = 0.1
PRECISION = 0.95
LEAST_THRESHOLD = 0.5
STEPS = 25

TOKEN = re.compile(r"\w+")
RATIOS = 6


@dataclass(frozen=True)
class Chain:
    """The fitted models: words and their places, feature scales, one weight vector per category."""

    categories: tuple[str, ...]
    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: tuple[np.ndarray, ...]
    thresholds: tuple[float, ...]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def term_counts(found: list[str]) -> Counter:
    """How often each word and each beginning of a longer word occurs."""
    out: Counter = Counter()
    for w, n in Counter(found).items():
        out[w] += n
        for k in STEMS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def features(text: str, words: dict[str, int]) -> np.ndarray:
    """Counts and densities of terms, then log length, word length, and shares of capitals, digits,
    symbols and distinct words."""
    found = tokens(text)
    n, size = max(1, len(found)), max(1, len(text))
    out = np.zeros(2 * len(words) + RATIOS)
    for w, c in term_counts(found).items():
        if w in words:
            out[words[w]] = np.log1p(c)
            out[len(words) + words[w]] = np.sqrt(100 * c / n)
    raw = np.frombuffer(text.encode(), np.uint8)
    letters = np.count_nonzero(((raw | 32) >= 97) & ((raw | 32) <= 122)) + np.count_nonzero(raw > 191)
    capitals = np.count_nonzero((raw >= 65) & (raw <= 90))
    digits = np.count_nonzero((raw >= 48) & (raw <= 57))
    spaces = np.count_nonzero(raw <= 32)
    out[2 * len(words) :] = (
        np.log1p(len(found)), min(50.0, sum(map(len, found)) / n), capitals / size, digits / size,
        max(0, size - letters - digits - spaces) / size, len(set(found)) / n,
    )
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Ridge-penalised weights, the intercept last, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        out = np.zeros(x.shape[1])
        out[-1] = np.log(max(share, 1e-13) / max(1 - share, 1e-13))
        return out
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        p = sigmoid(x @ w)
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> float:
    """The lowest cut from which on the predictions are right often enough.

    Where no cut is, the one with the best F score counts; above 1 only where none has a right prediction.
    """
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    right = hits / np.arange(1, len(p) + 1)
    last = np.append(p[order][1:] < p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = last & (right >= precision) & (p[order] >= LEAST_THRESHOLD)
    if good.any():
        return float(p[order][good].min())
    allowed = last & (p[order] >= LEAST_THRESHOLD) & (hits > 0)
    score = np.where(allowed, 2 * hits / (np.arange(1, len(p) + 1) + y.sum()), 0.0)
    return float(p[order][int(np.argmax(score))]) if allowed.any() else 2.0


def fit_models(x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> tuple:
    """Weights and thresholds of each category in turn, on out-of-fold earlier probabilities."""
    weights, cuts = [], []
    for c in range(labels.shape[1]):
        y, held = labels[:, c], np.zeros(len(x))
        for k in np.unique(folds):
            own = folds == k
            held[own] = predict(x[own], fit_logistic(x[~own], y[~own]))
        weights.append(fit_logistic(x, y))
        cuts.append(threshold(held, y))
        x = np.hstack([x, held[:, None]])
    return tuple(weights), tuple(cuts)


def chain_probabilities(chain: Chain, x: np.ndarray) -> np.ndarray:
    """Probabilities of rows of raw features, one column per category."""
    x = (x - chain.mean) / chain.scale
    start = x.shape[1]
    for w in chain.weights:
        x = np.hstack([x, predict(x, w)[:, None]])
    return x[:, start:]


def _sample(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], bound: int) -> DataFrame:
    known = F.col("doc_id").isNotNull()
    for c in categories:
        known = known & F.col(c).isNotNull()
    marks = labels.filter(known).groupBy("doc_id").agg(
        *[F.max(F.col(c).cast("int")).alias(f"y{n}") for n, c in enumerate(categories)]
    )
    chosen = marks.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    # At most ``bound`` rows of a few numbers: small enough for every task.
    return materialise(docs.join(F.broadcast(chosen), "doc_id"), "labelled-sample")


def _telling_terms(sample: DataFrame, n_categories: int) -> list[str]:
    """The words whose log odds between the classes lie furthest above zero, for each category."""
    ys = [f"y{n}" for n in range(n_categories)]

    def make(batch):
        at, word = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            own = term_counts(tokens(text))
            at += [i] * len(own)
            word += own
        at = pa.array(at, pa.int32())
        yield {"word": word} | {y: batch.column(y).take(at) for y in ys}

    schema = "word string, " + ", ".join(f"{y} int" for y in ys)
    seen = map_batches(sample.select("text", *ys), make, schema).groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]
    )
    seen = materialise(seen.filter(F.col("n") >= LEAST_DOCS), "word-counts")
    sizes = sample.agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).first()
    out: dict[str, None] = {}
    for y in ys:
        pos, neg = F.col(y) + 0.5, F.col("n") - F.col(y) + 0.5
        all_pos, all_neg = (sizes[y] or 0) + 1.0, sizes["n"] - (sizes[y] or 0) + 1.0
        z = F.log(pos / all_pos / (neg / all_neg)) / F.sqrt(1 / pos + 1 / neg)
        ranked = seen.select("word", z.alias("z")).filter("z > 0").orderBy(
            F.desc("z"), F.desc(F.length("word")), "word"
        )
        chosen: list[str] = []
        # Bounded: the terms asked for and some spare, as those that share a stem say the same.
        for row in ranked.limit(8 * TERMS_PER_CATEGORY).collect():
            stem = row["word"].rstrip("*")
            if len(chosen) < TERMS_PER_CATEGORY and not any(
                stem.startswith(c) or c.startswith(stem) for c in (t.rstrip("*") for t in chosen)
            ):
                chosen.append(row["word"])
        out |= dict.fromkeys(chosen)
    return list(out)


def _feature_rows(df: DataFrame, words: dict[str, int], keep: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)

    def make(batch):
        made = [features(t, words).tolist() for t in batch.column("text").to_pylist()]
        yield {"x": pa.array(made, pa.list_(pa.float64()))} | {c: batch.column(c) for c in keep}

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", x array<double>"
    return map_batches(df.select("text", *keep), make, schema)


def fit_chain(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_train: int = MAX_TRAIN
) -> Chain:
    """Fit the chain on the documents that have all labels, ``max_train`` of them at most."""
    n = len(categories)
    sample = _sample(texts(docs), labels, categories, max_train)
    words = {w: i for i, w in enumerate(_telling_terms(sample, n))}
    keep = ["doc_id", *[f"y{k}" for k in range(n)]]
    rows = _feature_rows(sample, words, keep).groupBy("doc_id").agg(
        *[F.min_by(c, F.xxhash64("x")).alias(c) for c in [*keep[1:], "x"]]
    )
    # Bounded: ``max_train`` rows of some hundred numbers.
    held = sorted(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))).collect(),
                  key=lambda r: r["doc_id"])
    size = 2 * len(words) + RATIOS
    x = np.array([r["x"] for r in held], float).reshape(len(held), size)
    y = np.array([[r[c] for c in keep[1:]] for r in held], float).reshape(len(held), n)
    mean, scale = np.zeros(size), np.ones(size)
    if len(held):
        # Words keep their zero; the ratios are centred, so that one penalty fits all.
        mean[-RATIOS:] = x[:, -RATIOS:].mean(axis=0)
        scale[-RATIOS:] = np.maximum(x[:, -RATIOS:].std(axis=0), 1e-6)
    weights, cuts = fit_models((x - mean) / scale, y, np.array([r["fold"] for r in held], int))
    return Chain(tuple(categories), words, mean, scale, weights, cuts)


def score(docs: DataFrame, chain: Chain, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, p_<category> ..., toxic): every document, read in full."""
    names = [f"p_{c}" for c in chain.categories]

    def make(batch):
        x = np.array([features(t or "", chain.words) for t in batch.column("text").to_pylist()])
        p = chain_probabilities(chain, x.reshape(batch.num_rows, len(chain.mean)))
        toxic = p[:, -1] >= chain.thresholds[-1]
        yield {"toxic": toxic.tolist()} | {c: batch.column(c) for c in keep} | {
            n: np.round(p[:, i], 6) for i, n in enumerate(names)
        }

    keep = ["doc_id", *extra]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{n}` double" for n in names])
    return map_batches(docs.select("text", *keep), make, schema + ", toxic boolean")


def toxicity(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_train: int = MAX_TRAIN
) -> DataFrame:
    """Probabilities of all categories and the verdict on the last one, for every row."""
    return score(texts(docs), fit_chain(docs, labels, categories, max_train))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_train: int = MAX_TRAIN
) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    chain = fit_chain(docs, labels, categories, max_train)

    def run(batches):
        for batch in (part for whole in batches for part in portions(whole)):
            found = batch.column("text").to_pylist()
            x = np.array([features(t or "", chain.words) for t in found])
            p = chain_probabilities(chain, x.reshape(batch.num_rows, len(chain.mean)))
            yield batch.filter(pa.array(p[:, -1] < chain.thresholds[-1]))

    return docs.mapInArrow(run, docs.schema)
