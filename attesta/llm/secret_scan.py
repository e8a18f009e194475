"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

Patterns give the base spans, leftmost and without overlap within a kind: ``assign`` (a name such as
password or token, then a value of 6 or more characters), ``access`` (AKIA keys of 20 or more) and
``hex`` (24 or more).

Other candidates are runs of 20 or more characters of the base-64 alphabets that hold a letter and a
digit and do not touch a base span. The smallest alphabet that holds all characters of a run is taken as
its encoding. Three tests ask whether the run looks drawn uniformly from it: chi-squared over the
alphabet, runs above and below the middle, and correlation of neighbours. Three times the smallest
p-value, at most 1, is the run's p-value.

Two decisions make a ``random`` span, each by the Benjamini-Hochberg rule at rate ``RATE`` over all runs of the table:

1. The battery must not reject that the run is random; a rejected run is text, a path or a counter. Length classes are
   judged apart, because short runs give these tests little power and would set the bar for long ones.
2. That the run is text must be rejected, so ``RATE`` bounds the share of text among what is reported as secrets. Text is a chain
   of letter, capital, digit and symbol stretches: camel case (``TEXT_MOVES``), the same in capitals, or the moves counted
   in the table's own text-like runs (those that cannot be keys, and those the battery rejected), with
   ``PRIOR_MOVES`` moves of ``TEXT_MOVES`` to start from. The run's likelihood when drawn uniformly from its encoding, over
   the largest of the three likelihoods and the number of encodings, is an e-value: under any of the chains it exceeds
   ``1 / a`` with a chance of at most ``a``, so its inverse serves as a p-value. It grows with each character, so all lengths share
   one bar.

P-values are counted on a fixed grid of ``GRID`` steps per factor of two, so each rule needs a few hundred counts, and the
moves are sixteen, whatever the size of the table.

Positions are code points, ends exclusive. Defined cases: a NULL text is empty; a text without spans has
the hash of the empty string. Rows come out one for one; repeated rows and NULL ids stay. An empty table
gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_batches, materialise, texts

KINDS = ("assign", "access", "hex", "random")
RATE = 0.05
LENGTH_CLASSES = (20, 32, 48, 64)
LEAST_DISTINCT = 8
GRID = 8
SMALLEST = 64

# Names in front of a value, and the shortest value, key and hexadecimal run.
NAMES = ("password", "passwd", "secret", "token", "api_?key")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24


def _either_case(name: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", name)


ASSIGN = re.compile(
    "(" + "|".join(map(_either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile("AKIA[A-Z0-9]+")
LONG_HEX = re.compile(f"[0-9a-f]{{{LEAST_HEX},}}")
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

# Alphabets by which a run may be encoded, the smaller ones first.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "hex_lower": DIGITS + "abcdef",
    "hex_upper": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower": DIGITS + LOWER,
    "upper": DIGITS + UPPER,
    "mixed": DIGITS + UPPER + LOWER,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64_url": UPPER + LOWER + DIGITS + "-_",
    "any": UPPER + LOWER + DIGITS + "+/-_",
}
SETS = {name: frozenset(chars) for name, chars in ALPHABETS.items()}
PLACES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
NORMAL = NormalDist()

# Small letters, capitals, digits, symbols: how many characters each kind has, and the chances of text to move from a kind (row)
# to a kind (column). Text stays within a kind, and a capital is followed by small letters.
KIND_SIZES = (26, 26, 10, 4)
TEXT_MOVES = (
    (0.80, 0.08, 0.06, 0.06),
    (0.70, 0.22, 0.04, 0.04),
    (0.12, 0.12, 0.66, 0.10),
    (0.50, 0.20, 0.28, 0.02),
)
PRIOR_MOVES = 100
KIND_OF = np.full(256, 3, np.int64)
for _kind, _chars in enumerate((LOWER, UPPER, DIGITS)):
    KIND_OF[list(_chars.encode())] = _kind


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    # A run is as long as it can be, so asking for its length at once finds the same runs.
    out += [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(run: str) -> str:
    held = set(run)
    return next(name for name, chars in SETS.items() if held <= chars)


def chi_squared_p(codes: np.ndarray, size: int) -> float:
    """Upper tail of the uniformity statistic, by the cube-root normal approximation."""
    n, df = len(codes), size - 1
    expected = n / size
    x = float(((np.bincount(codes, minlength=size) - expected) ** 2).sum() / expected)
    z = ((max(x, 1e-9) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return max(NORMAL.cdf(-z), 0.0)


def runs_p(codes: np.ndarray, size: int) -> float:
    """Both tails of the number of runs above and below the middle of the alphabet."""
    above = codes >= size / 2
    a, b = int(above.sum()), int((~above).sum())
    n = a + b
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 1 + 2 * a * b / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    return 2 * NORMAL.cdf(-abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0


def serial_p(codes: np.ndarray) -> float:
    """Both tails of the correlation of neighbours, around its mean of -1/n."""
    n, x = len(codes), codes - codes.mean()
    spread = float((x * x).sum())
    if not spread:
        return 0.0
    r = float((x[1:] * x[:-1]).sum()) / spread
    return 2 * NORMAL.cdf(-abs(r + 1 / n) * math.sqrt(n))


def random_p(run: str) -> float:
    """The run's p-value under the hypothesis that it is random in its encoding."""
    name = encoding(run)
    codes = np.array([PLACES[name][c] for c in run])
    size = len(ALPHABETS[name])
    return min(1.0, 3 * min(chi_squared_p(codes, size), runs_p(codes, size), serial_p(codes)))


def moves(run: str) -> np.ndarray:
    """How often the run moves from each kind of character to each, sixteen counts."""
    kinds = KIND_OF[np.frombuffer(run.encode(), np.uint8)]
    return np.bincount(kinds[:-1] * 4 + kinds[1:], minlength=16)


def text_runs(text: str, taken: list[tuple[int, int, str]]) -> tuple[list[tuple], np.ndarray]:
    """The runs outside the base spans: candidates as (start, end, length class, grid step, encoding's size, moves), and
    the moves of those that cannot be keys."""
    out, plain = [], np.zeros(16, np.int64)
    for m in RUN.finditer(text):
        run, (start, end) = m[0], m.span()
        if any(s < end and start < e for s, e, _ in taken):
            continue
        chars = set(run)
        if len(chars) < LEAST_DISTINCT or not any(c.isdigit() for c in chars) or not any(c.isalpha() for c in chars):
            plain += moves(run)
            continue
        step = math.floor(-GRID * math.log2(max(random_p(run), 2.0**-SMALLEST)))
        size = len(ALPHABETS[encoding(run)])
        out.append((start, end, sum(len(run) >= c for c in LENGTH_CLASSES) - 1, step, size, moves(run).tolist()))
    return out, plain


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple]:
    return text_runs(text, taken)[0]


def _spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, runs, plain): the base spans, the candidates with class, grid step and moves, and other runs' moves."""
    span = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string())])
    names = ("s", "e", "class", "step", "size", "moves")
    run = pa.struct([(n, pa.int32()) for n in names[:-1]] + [("moves", pa.list_(pa.int32()))])

    def make(batch):
        base, runs, plain = [], [], []
        for text in batch.column("text").to_pylist():
            own = base_spans(text)
            found, rest = text_runs(text, own)
            base.append([{"s": s, "e": e, "kind": k} for s, e, k in own])
            runs.append([dict(zip(names, r, strict=True)) for r in found])
            plain.append(rest.tolist() if rest.any() else None)
        yield {
            "doc_id": batch.column("doc_id"), "plain": pa.array(plain, pa.list_(pa.int64())),
            "base": pa.array(base, pa.list_(span)), "runs": pa.array(runs, pa.list_(run)),
        }

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(
        docs, make,
        f"doc_id {kind}, base array<struct<s:int,e:int,kind:string>>, "
        "runs array<struct<s:int,e:int,class:int,step:int,size:int,moves:array<int>>>, plain array<bigint>",
    )


def _summed(counts: DataFrame) -> np.ndarray:
    """The sum of arrays of sixteen counts in the only column."""
    sums = counts.select(F.posexplode(counts.columns[0]).alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(16)
    for r in sums.collect():  # sixteen rows at most
        out[r["i"]] = r["n"]
    return out.reshape(4, 4)


def text_chains(counted: np.ndarray) -> list[np.ndarray]:
    """Logarithms of the chances of each move and character: camel case, capitals, and the table's own text."""
    camel = np.array(TEXT_MOVES)
    swap = [1, 0, 2, 3]
    own = (counted + PRIOR_MOVES * camel) / (counted.sum(axis=1, keepdims=True) + PRIOR_MOVES)
    return [np.log(chain / np.array(KIND_SIZES)).ravel() for chain in (camel, camel[swap][:, swap], own)]


def key_step(run: Column, chains: list[np.ndarray]) -> Column:
    """The grid step of the p-value of a run under the hypothesis that it is text."""

    def total(weights: np.ndarray) -> Column:
        pairs = F.zip_with(run["moves"], F.array(*[F.lit(float(w)) for w in weights]), lambda n, w: n * w)
        return F.aggregate(pairs, F.lit(0.0), lambda x, y: x + y)

    drawn = -F.log(run["size"].cast("double")) * (run["e"] - run["s"] - 1) - math.log(len(ALPHABETS))
    steps = F.floor((drawn - F.greatest(*map(total, chains))) * (GRID / math.log(2)))
    return F.least(F.greatest(steps, F.lit(0)), F.lit(GRID * SMALLEST)).cast("int")


def rejection_steps(runs: DataFrame, rate: float = RATE) -> DataFrame:
    """(class, least): from which grid step on a run of a length class is rejected.

    The step-up rule on the grid: the largest p-value on it of which ``p * all <= rate * rejected``
    holds. A step's p-value is its upper end, so the rule errs towards keeping.
    """
    counts = runs.groupBy("class", "step").count()
    by_class = Window.partitionBy("class")
    down = by_class.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.select(
        "class", "step", F.sum("count").over(down).alias("rejected"),
        F.sum("count").over(by_class).alias("all"),
    )
    p = F.pow(F.lit(2.0), -F.col("step") / GRID)
    return ranked.filter(p * F.col("all") <= rate * F.col("rejected")).groupBy("class").agg(
        F.min("step").alias("least")
    )


def scan_secrets(
    docs: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, base, random): the spans of every row as arrays of (s, e, kind)."""
    found = materialise(_spans(texts(docs, id_col, text_col)), "secret-spans")

    def bars(runs: DataFrame) -> dict[int, int]:
        # One number per length class, so this stays as small as the list of classes.
        return {r["class"]: r["least"] for r in rejection_steps(runs, rate).collect()}

    def rejected(run: Column, step: Column, least: dict[int, int]) -> Column:
        out = F.lit(False)
        for c, bar in sorted(least.items()):
            out = out | ((run["class"] == c) & (step >= bar))
        return out

    battery = bars(found.select(F.inline("runs")))
    as_text = F.transform(F.filter("runs", lambda r: rejected(r, r["step"], battery)), lambda r: r["moves"])
    moved = found.select(F.explode(as_text).alias("m")).select(F.col("m").cast("array<bigint>").alias("m"))
    chains = text_chains(_summed(found.select(F.col("plain").alias("m")).unionByName(moved)))
    run = F.col("run")
    keyed = found.select(F.explode("runs").alias("run")).select(F.lit(0).alias("class"), key_step(run, chains).alias("step"))
    least = bars(keyed).get(0, GRID * SMALLEST + 1)
    kept = F.filter("runs", lambda r: ~rejected(r, r["step"], battery) & (key_step(r, chains) >= least))
    return found.select(
        "doc_id", "base",
        F.transform(
            kept, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e"), F.lit("random").alias("kind"))
        ).alias("random"),
    )


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def span_digests(found: DataFrame) -> DataFrame:
    """Counts per kind, the hash of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    placed = F.sort_array(
        F.transform(
            F.concat("base", "random"),
            lambda x: F.struct(
                x["s"].alias("s"),
                F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("rank"),
                x["e"].alias("e"), x["kind"].alias("kind"),
            ),
        )
    )
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"), F.size("random").cast("long").alias("n_random"),
        F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"),
        _joined(placed).alias("spans"),
    )
