"""Benchmark decontamination by templates, in DataFrame code alone.

Numbers, units behind numbers and names (capitalised words inside a sentence) become typed
placeholders, so a question asked again with other figures or other names has the same template. Windows
of ``WINDOW`` template words are hashed and joined with those of the benchmark. A window with less than
``LITERALS`` words that are no placeholders says too little as a template: it is hashed with its values in
place of the placeholders, so it meets only windows with the same values.

Matches of a document and an item are grouped by their diagonal, the distance of the two places, so each
occurrence stands alone. In it a value of the item that stands for several values of the document is in conflict, and
windows in which such a value was changed do not count; the other windows do, as what they say is either the
item's own words or changed throughout. A document is contaminated by an
item when the windows that count cover ``SHARE`` of the item's windows, or a passage of ``RUN`` words. The
windows that are templates are counted first; where they do not suffice, all windows are. ``matched`` and
``item_windows`` are of the count that sufficed.

Benchmark windows are broadcast when counted to be few; above ``BROADCAST_WINDOWS`` the join shuffles.
Only hashes and places are compared; the texts behind matches are read once more where an item has values
to check. Nothing is collected by document but the places and slots that matched.

Defined cases: NULL texts are empty on both sides; items shorter than a window are one window of all their
words, which only texts of these words alone hold. A document that repeats an item is listed once.
Repeated rows are listed each; of equal items each is listed, also if they have one id or none, as windows are
counted by row. NULL ids stay NULL. Empty tables give no
rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, SPACE_CHARS, materialise, numbered, rows_only, sheltered, texts, words

WINDOW = 5
LITERALS = 3
SHARE = 0.8
RUN = 13
BROADCAST_WINDOWS = 200_000

# Placeholders and the units that become one behind a number.
NUMBER, UNIT, NAME = "<num>", "<unit>", "<name>"
UNITS = (
    "%", "km", "kg", "mg", "cm", "mm", "ml", "km/h", "mph", "kwh", "kw", "mb", "gb", "tb", "hz",
    "m", "g", "l", "s", "h", "km2", "m2", "meters", "metres", "miles", "feet", "inches", "pounds",
    "grams", "kilograms", "liters", "litres", "seconds", "minutes", "hours", "days", "weeks",
    "months", "years", "dollars", "euros", "cents", "degrees", "percent", "usd", "eur", "gbp",
)

# Fixed value: punctuation that is no part of a value.
AROUND = ".,;:!?()[]\"'"

_UNIT = "|".join(u.replace("/", "\\/") for u in sorted(UNITS, key=len, reverse=True))
_VALUE = r"[$€£]?[+-]?\d+(?:[.,:/]\d+)*"
_EDGE = r"(?=[.,;:!?)\]\"']*(?:[\x20\x09-\x0D]|$))"
_OPEN = r"(?<![^\x20\x09-\x0D(\[\"'])"


def spaced(text: Column) -> Column:
    """The text with units apart from their numbers, so that each is a word."""
    apart = F.regexp_replace(text, rf"(?i)(?<=\d)({_UNIT}){_EDGE}", " $1")
    return F.when(text.rlike(r"\d"), apart).otherwise(text)


def template(spaced_text: Column) -> Column:
    """Placeholders for numbers, units and names; one word stays one word."""
    numbers = F.regexp_replace(spaced_text, rf"{_OPEN}{_VALUE}{_EDGE}", NUMBER)
    units = F.regexp_replace(numbers, rf"(?i)(?<={NUMBER}[\x20\x09])({_UNIT}){_EDGE}", UNIT)
    valued = F.when(spaced_text.rlike(r"\d"), units).otherwise(spaced_text)
    names = F.regexp_replace(
        valued, r"\p{Lu}(?<=[^.!?:\x20\x09-\x0D][\x20\x09]\p{Lu})[\p{L}\p{M}'’-]*", NAME
    )
    return F.lower(F.regexp_replace(names, r"(?<=[\p{L}\p{N}>])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", ""))


def value(word: Column) -> Column:
    """A word as the value of a slot: without the punctuation around it."""
    return F.btrim(word, F.lit(AROUND))


def _is_slot(word: Column) -> Column:
    return F.contains(word, F.lit(NUMBER)) | F.contains(word, F.lit(UNIT)) | F.contains(word, F.lit(NAME))


def _templated(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids, spaced, template: in steps, so that each text is rewritten once.

    Array functions evaluate their arguments as written, also what stands there twice; a column of an
    earlier step that is used twice stays a column.
    """
    apart = rows.select(*ids, spaced(F.col("text")).alias("spaced"))
    return apart.select(
        *ids, "spaced", F.btrim(template(F.col("spaced")), F.lit(SPACE_CHARS)).alias("template")
    )


def _window_hashes(rows: DataFrame, ids: list[str]) -> DataFrame:
    """ids, windows: the hashes of the template windows of a text, in their order."""
    split = _templated(rows, ids).select(
        *ids, words(F.col("template")).alias("words"), words(F.col("spaced")).alias("raw")
    )
    coded = split.select(
        *ids, F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.transform("words", lambda w: F.when(_is_slot(w), 1).otherwise(0)).alias("s"),
        F.transform(
            "words", lambda w, i: F.when(_is_slot(w), F.xxhash64(w, value(F.get(F.col("raw"), i))))
        ).alias("v"),
    )
    h, s, v = F.col("h"), F.col("s"), F.col("v")
    starts = F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.least(F.size(h), F.lit(1))))

    def window(first, i):
        slots = sum((F.coalesce(F.get(s, i + k), F.lit(1)) for k in range(WINDOW)), F.lit(0))
        exact = [F.coalesce(F.get(v, i + k), F.get(h, i + k)) for k in range(WINDOW)]
        return F.when(
            slots <= WINDOW - LITERALS, F.xxhash64(first, *[F.get(h, i + k) for k in range(1, WINDOW)])
        ).otherwise(F.xxhash64(F.lit("values"), *exact))

    return coded.select(*ids, F.transform(starts, window).alias("windows"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, hash, q, slots, item_windows, all_windows): the windows of every row, ``item`` its key.

    ``slots`` holds the values of templates and is NULL for other windows.
    """
    rows = numbered(texts(benchmark, "item_id")).select(
        F.struct(F.col(ROW).alias("item"), F.col("doc_id").alias("item_id"), "text").alias("row")
    )
    hashed = _window_hashes(rows.select("row", "row.text"), ["row"])
    ids = ["item", "item_id", "windows"]
    bodies = _templated(hashed.select("row.*", "windows"), ids)
    split = bodies.select(
        *ids, words(F.col("spaced")).alias("raw"), words(F.col("template")).alias("words")
    )
    values = F.transform(
        "words", lambda w, i: F.when(_is_slot(w), value(F.get(F.col("raw"), i)))
    )
    valued = split.select(*ids, values.alias("values"))
    # A short item has fewer words than a window, so absent ones are no literals.
    says_enough = lambda v: F.size(F.filter(v, lambda x: x.isNull())) >= LITERALS
    slots = lambda i: F.slice("values", i + 1, WINDOW)
    window = F.transform(
        "windows",
        lambda w, i: F.struct(
            w.alias("hash"), i.alias("q"), F.when(says_enough(slots(i)), slots(i)).alias("slots")
        ),
    )
    held = valued.select("item", "item_id", window.alias("held"))
    return held.select(
        "item", "item_id", F.size(F.filter("held", lambda w: w["slots"].isNotNull())).alias("item_windows"),
        F.size("held").alias("all_windows"), F.inline("held"),
    )


def _document_values(docs: DataFrame, met: DataFrame) -> DataFrame:
    """(__row, p, raw): the words of the matched windows in which the item has a value."""
    wanted = met.filter(F.exists("slots", lambda v: v.isNotNull())).groupBy(ROW).agg(
        F.collect_set("p").alias("places")
    )
    split = docs.join(rows_only(wanted), ROW).select(ROW, "places", words(spaced(F.col("text"))).alias("raw"))
    # ``raw`` stands here twice, so that it is computed once for the text and not for each place.
    cut = F.transform(
        "places",
        lambda p: F.struct(
            p.alias("p"), F.when(F.size("raw") > p, F.transform(F.slice("raw", p + 1, WINDOW), value)).alias("raw")
        ),
    )
    return split.select(ROW, cut.alias("cut")).select(ROW, F.inline_outer("cut"))


def contaminated(marked: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, __row, item_id, matched, item_windows, changed_slots): what numbered documents leak."""
    bench = benchmark_windows(benchmark)
    if bench.count() <= BROADCAST_WINDOWS:
        bench = F.broadcast(bench)
    rows = texts(marked, "doc_id", "text", ROW)
    # The outer form, as the plain one would make the optimizer test the arrays below, where every
    # element would compute its text again. The join drops the empty rows.
    seen = _window_hashes(rows, ["doc_id", ROW]).select(
        "doc_id", ROW, F.posexplode_outer("windows").alias("p", "hash")
    )
    # Written, so that the texts behind the few matches are fetched without computing them again.
    met = materialise(seen.join(bench, "hash").drop("hash"), "template-matches")
    valued = met.join(_document_values(rows, met), [ROW, "p"], "left")
    pairs = F.filter(
        F.arrays_zip(F.col("slots").alias("item"), F.col("raw").alias("doc")),
        lambda x: x["item"].isNotNull() & x["doc"].isNotNull(),
    )
    no_pairs = F.array().cast("array<struct<item:string,doc:string>>")
    item = ["doc_id", ROW, "item", "item_id", "item_windows", "all_windows"]
    window = F.struct(
        "q", F.col("slots").isNotNull().alias("template"), F.coalesce(pairs, no_pairs).alias("pairs")
    )
    occurrences = valued.groupBy(*item, (F.col("p") - F.col("q")).alias("diagonal")).agg(
        F.collect_set(window).alias("held")
    )
    # A value in conflict has two pairs or more; sorted, it stands next to itself.
    of_item = F.array_sort(
        F.transform(F.array_distinct(F.flatten(F.transform("held", lambda w: w["pairs"]))), lambda x: x["item"])
    )
    sorted_values = occurrences.select(*item, "held", of_item.alias("values"))
    conflicts = sorted_values.select(
        *item, "held", F.filter("values", lambda v, i: F.get("values", i + 1) == v).alias("conflicts")
    )
    changed = lambda x: x["item"] != x["doc"]
    counted = F.filter(
        "held",
        lambda w: ~F.exists(w["pairs"], lambda x: changed(x) & F.array_contains("conflicts", x["item"])),
    )
    places = lambda windows: F.transform(windows, lambda w: w["q"])
    consistent = conflicts.select(*item, counted.alias("held")).select(
        *item, places(F.filter("held", lambda w: w["template"])).alias("places"),
        places(F.col("held")).alias("all_places"),
        F.size(F.array_distinct(F.filter(
            F.flatten(F.transform("held", lambda w: w["pairs"])), changed
        ))).alias("changed"),
    )
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    found = consistent.groupBy(*item).agg(
        distinct("places").alias("matched"),
        distinct("all_places").alias("all_matched"),
        F.max("changed").alias("changed_slots"),
    )
    enough = lambda n: F.least(F.ceil(F.col(n) * SHARE), F.lit(RUN - WINDOW + 1))
    by_templates = (F.col("item_windows") > 0) & (F.col("matched") >= enough("item_windows"))
    return found.filter(by_templates | (F.col("all_matched") >= enough("all_windows"))).select(
        "doc_id", ROW, "item_id",
        F.when(by_templates, F.col("matched")).otherwise(F.col("all_matched")).alias("matched"),
        F.when(by_templates, F.col("item_windows")).otherwise(F.col("all_windows")).alias("item_windows"),
        "changed_slots",
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, matched, item_windows, changed_slots) of every leaked item."""
    return contaminated(numbered(texts(docs)), benchmark).drop(ROW)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that leak no item, with all their columns."""
    plain, restored = sheltered(docs)
    rows = numbered(plain)
    found = contaminated(rows, benchmark).select(ROW).distinct()
    return restored(rows.join(rows_only(found), ROW, "left_anti"))
