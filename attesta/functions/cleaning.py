"""Scalar cleaning rules, each a column in, a column out."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..packs import NAME_ACRONYMS, NAME_SMALL_WORDS

# The accepted coordinate range, ends included.
LAT_RANGE = (6.0, 37.0)
LNG_RANGE = (68.0, 98.0)


# Besides decimal digits, the characters that count as digits, such as superscripts.
DIGIT = (
    r"[\p{Nd}\u00B2\u00B3\u00B9\u1369-\u1371\u19DA\u2070\u2074-\u2079\u2080-\u2089\u2460-\u2468"
    r"\u2474-\u247C\u2488-\u2490\u24EA\u24F5-\u24FD\u24FF\u2776-\u277E\u2780-\u2788\u278A-\u2792"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]"
)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def clean_category(c: Column) -> Column:
    return F.lower(blank_to_null(c))


def title(c: Column) -> Column:
    return F.initcap(F.trim(c))


def normalize_name(c: Column) -> Column:
    return title(F.regexp_replace(c, r"\s+", " "))


def parse_json_array(c: Column) -> Column:
    """Distinct elements of a JSON array held as text; anything else gives NULL."""
    return F.array_distinct(F.from_json(c, "array<string>"))


def safe_int(c: Column) -> Column:
    return c.try_cast("int")


def sentinel_double(c: Column, sentinel: str = "NA") -> Column:
    return F.nullif(c, F.lit(sentinel)).try_cast("double")


def in_bbox(lat: Column, lng: Column) -> Column:
    """Three-valued: NULL coordinates stay undecided unless the other one is outside."""
    return lat.between(*LAT_RANGE) & lng.between(*LNG_RANGE)


def text_bool(c: Column) -> Column:
    return F.lower(c) == "true"


def prefix_match(query: str, *columns: Column) -> Column:
    """Case-blind literal prefix on any of the columns; wildcards in the query are plain text."""
    q = F.lower(F.lit(query.strip()))
    hit = F.startswith(F.lower(columns[0]), q)
    for c in columns[1:]:
        hit = hit | F.startswith(F.lower(c), q)
    return hit


def substring_match(query: str, c: Column) -> Column:
    return F.contains(F.lower(c), F.lower(F.lit(query)))


def percent(part: Column, total: Column) -> Column:
    return F.round(F.lit(100.0) * part / F.nullif(total, F.lit(0)), 1)


def top_urls(urls: Column, n: int | None = 10) -> Column:
    """First ``n`` distinct non-empty entries, order kept; None keeps all."""
    kept = F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))
    return kept if n is None else F.slice(kept, 1, n)


def cut(c: Column, n: int | None) -> Column:
    """The first ``n`` characters; None keeps all."""
    return c if n is None else F.left(c, F.lit(n))


def display_name(c: Column) -> Column:
    """Readable capitals: known acronyms upper, joining words lower, odd tokens untouched."""

    def word(token: Column, i: Column) -> Column:
        core = F.btrim(F.lower(token), F.lit(".,():;'\""))
        pieces = F.transform(
            F.split(token, "-"),
            lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(F.substring(p, 2, 2147483647))),
        )
        return (
            F.when(core.isin(*NAME_ACRONYMS), F.upper(core))
            .when((i > 0) & core.isin(*NAME_SMALL_WORDS), core)
            .when(F.contains(token, F.lit("&")), token)
            .when(F.startswith(token, F.lit("'")) | token.rlike(DIGIT), token)
            .otherwise(F.concat_ws("-", pieces))
        )

    tokens = F.filter(F.split(c, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")
    return F.coalesce(F.concat_ws(" ", F.transform(tokens, word)), F.lit(""))


# A figure as published: suppressed, estimated from few cases (in brackets), or plain.
_FIGURE = r"^\s*(\()?\s*([+-]?[0-9]+(?:[.][0-9]+)?)\s*%?\s*(\))?\s*$"


def figure_value(text: Column) -> Column:
    """The number of a published figure, also of one in brackets; NULL for ``*`` and for what is no figure."""
    opened, closed = (F.regexp_extract(text, _FIGURE, i) != "" for i in (1, 3))
    return F.when(opened == closed, F.regexp_extract(text, _FIGURE, 2).try_cast("double"))


def figure_low_sample(text: Column) -> Column:
    """Whether a published figure rests on few cases: in brackets, or suppressed as ``*``. NULL for no text."""
    return (F.btrim(text) == "*") | (figure_value(text).isNotNull() & F.startswith(F.ltrim(text), F.lit("(")))
