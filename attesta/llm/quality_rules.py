"""Quality rules: a table of thresholds compiled into Spark columns, without user functions.

Base figures of a text (words are runs of characters other than white space):

* ``n_words``, ``word_chars`` (code points in words), ``n_symbols``;
* ``n_dup_lines``: lines with a word that equal an earlier line;
* ``n_repeat_words``: words inside five-word windows that occur twice or more in the text.

``base_failed`` is true under 10 words or with over a fifth of the words repeated. ``kept`` asks
for every rule of the table as well. A rule holds for texts of at least ``min_words`` words.

Defined cases: a NULL or blank text has no words, fails the base and is not kept. Rows come out
one for one, so repeated rows and ties stay as they are; a NULL id stays NULL; an empty table gives
an empty one; columns other than id and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, texts, words

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Symbols that count, and frequent function words of the four languages.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "a", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "that", "the",
    "this", "to", "was", "with",
    "au", "avec", "dans", "des", "du", "en", "est", "et", "la", "le", "les", "par", "pour", "que",
    "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "und", "von",
    "zu",
    "con", "de", "del", "el", "los", "no", "para", "por", "se", "su", "y",
)


@dataclass(frozen=True)
class Rule:
    """A ratio that has to lie between two bounds; NULL bounds are open."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    min_words: int = MIN_WORDS


RULES = (
    Rule("mean_word_length", "word_length", low=2.0, high=12.0),
    Rule("symbols_per_word", "symbols", high=0.25),
    Rule("letters", "letters", low=0.5, min_words=20),
    Rule("stop_words", "stop_words", low=0.01, min_words=50),
    Rule("repeated_lines", "dup_lines", high=0.5),
    Rule("ellipsis_lines", "ellipsis_lines", high=0.5),
)


def _ratios() -> dict[str, Column]:
    return {
        "word_length": F.try_divide("word_chars", "n_words"),
        "symbols": F.try_divide("n_symbols", "n_words"),
        "letters": F.try_divide("n_letters", "word_chars"),
        "stop_words": F.try_divide("n_stop_words", "n_words"),
        "dup_lines": F.try_divide("n_dup_lines", "n_lines"),
        "ellipsis_lines": F.try_divide("n_ellipsis_lines", "n_lines"),
    }


def compile_rules(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row breaks, comma-joined in table order."""
    ratios = _ratios()
    broken = []
    for r in rules:
        outside = F.lit(False)
        if r.low is not None:
            outside = outside | (ratios[r.ratio] < r.low)
        if r.high is not None:
            outside = outside | (ratios[r.ratio] > r.high)
        broken.append(F.when((F.col("n_words") >= r.min_words) & outside, F.lit(r.name)))
    return F.concat_ws(",", *broken)


def _counts(text_rows: DataFrame) -> DataFrame:
    text, split = F.col("text"), F.col("words")
    with_word = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    arrays = text_rows.select("doc_id", "text", words(text).alias("words"), with_word.alias("lines"))
    return arrays.select(
        "doc_id",
        F.transform(split, lambda w: F.xxhash64(w)).alias("hashes"),
        F.size(split).cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: F.rtrim(line).rlike(r"(\.\.\.|…)$")))
        .cast("long").alias("n_ellipsis_lines"),
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, rf"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.size(F.filter(split, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long")
        .alias("n_stop_words"),
    )


def _repeat_words(counts: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: windows are hashed, sorted with their places, and their union measured.

    Texts without a repeated window, nearly all, end at the comparison of two sizes. Word hashes
    are 64 bits wide and compared within one text only.
    """
    h = F.col("hashes")
    window = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
        lambda first, i: F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WINDOW)]),
    )
    windows = counts.withColumn("windows", window)
    placed = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))),
    )
    ordered = windows.withColumn("placed", placed)
    p = F.col("placed")
    again = F.filter(
        p,
        lambda x, i: (x["w"] == F.get(p, i - 1)["w"]) | (x["w"] == F.get(p, i + 1)["w"]),
    )
    starts = ordered.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    s = F.col("starts")
    gained = F.transform(
        s, lambda x, i: F.least(F.coalesce(F.get(s, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
    )
    total = F.aggregate(gained, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return starts.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long")))


def quality_rules(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The base figures, ``base_failed``, ``kept`` and the broken rules of every row."""
    figures = _repeat_words(_counts(texts(docs, id_col, text_col)))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    judged = figures.withColumn("base_failed", failed).withColumn("broken", compile_rules(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken",
    )
