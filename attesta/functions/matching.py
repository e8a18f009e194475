"""Regular-expression columns: first match, all matches, and the text around a match.

Spark lists all matches of a pattern but not where they are. The window pattern below
returns each match with the characters around it instead, in one linear pass and
counted in characters even next to surrogate pairs.
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, functions as F

# Case-blind and Unicode-aware: the meaning \b, \s, \d and letters have on text strings.
FLAGS = "(?iU)"

# Everything that counts as white space at the ends of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "    　"
)

_GROUP = re.compile(r"(\\.|\[(?:\\.|[^\]\\])*\])|\((?!\?)")
_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|.", re.DOTALL)
_HEAD = re.compile(r"([A-Za-z0-9 #@%]|\\d|\\[+$.*?()]|\[[^\]\\^]+\])(?![?*]|\{0)")


def ungrouped(pattern: str) -> str:
    """The same pattern with plain groups made non-capturing."""
    return _GROUP.sub(lambda m: m.group(1) or "(?:", pattern)


def _branches(pattern: str) -> list[str]:
    """The alternatives on the top level of a pattern."""
    out, depth = [""], 0
    for token in _TOKEN.findall(pattern):
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += token
    return out


def _heads(pattern: str) -> list[str] | None:
    """What the first character can be, as items of a character class; None if unknown."""
    heads: list[str] = []
    for branch in _branches(pattern):
        rest = branch.removeprefix(r"\b")
        if rest.startswith("(?:"):
            inner, tail = _first_group(rest)
            found = None if re.match(r"[?*]|\{0", tail) else _heads(inner)
        else:
            head = _HEAD.match(rest)
            found = [head.group(1)] if head else None
        if found is None:
            return None
        heads += found
    return heads


def _first_group(pattern: str) -> tuple[str, str]:
    """Content of the group that a pattern starts with, and what follows the group."""
    depth, used = 0, ""
    for token in _TOKEN.findall(pattern):
        depth += (token == "(") - (token == ")")
        used += token
        if depth == 0:
            break
    return used[3:-1], pattern[len(used):]


def _guard(patterns: list[str]) -> str:
    """Look-ahead at one character, which is far cheaper than a word-boundary test."""
    heads = [_heads(p) for p in patterns]
    if any(h is None for h in heads):
        return ""
    return f"(?=[{''.join(dict.fromkeys(x for h in heads for x in h))}])"


def _alternatives(tails: list[str]) -> str:
    """One branch per first letter, so a word is compared with few of the patterns."""
    shared: dict[str, list[str]] = {}
    for t in tails:
        letter = re.match(r"[A-Za-z](?![?*+{])", t)
        shared.setdefault(letter.group().lower() if letter else t, []).append(t)
    return "|".join(
        group[0] if len(group) == 1 else f"{key}(?:{'|'.join(t[1:] for t in group)})"
        for key, group in shared.items()
    )


def regex(pattern: str) -> str:
    p = ungrouped(pattern)
    return f"{FLAGS}{_guard([p])}(?:{p})"


def any_of(patterns: tuple[str, ...]) -> str:
    """One pattern that hits wherever any of ``patterns`` does, quick to say no."""
    flat = list(dict.fromkeys(b for p in patterns for b in _branches(ungrouped(p))))
    bounded = [p[2:] for p in flat if p.startswith(r"\b")]
    others = [f"(?:{p})" for p in flat if not p.startswith(r"\b")]
    if bounded:
        others.insert(0, rf"\b(?:{_alternatives(bounded)})")
    return f"{FLAGS}{_guard(flat)}(?:{'|'.join(others)})"


_PART = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\{[^}]*\}|.", re.DOTALL)
_ODD = re.compile(r"\\[^\WbBdDsSwW]|\(\?(?!:)|[^ -~]")
# A literal that equals one character and its capital only: i, k and s have further forms (dotted and dotless i,
# Kelvin sign, long s).
_PLAIN = re.compile(r"[^\\.^$|?*+(){}\[\]IiKkSs]|\\[^A-Za-z0-9]")


def _needs(branch: str) -> tuple[str, bool]:
    """The longest literal, in small letters, that every match of one alternative holds, and whether it holds a digit."""
    if _ODD.search(branch):
        return "", False
    depth, runs, digit = 0, [""], False
    parts = _PART.findall(branch)
    for part, after in zip(parts, [*parts[1:], ""], strict=True):
        depth += (part == "(") - (part == ")")
        surely = depth == 0 and after[:1] not in ("?", "*") and not after.startswith("{0")
        if surely and _PLAIN.fullmatch(part) and after[:1] != "{":
            runs[-1] += part[-1].lower()
            runs += [""] if after == "+" else []
        else:
            digit |= surely and part == r"\d"
            runs.append("")
    return max(runs, key=len), digit


def searchable(text: Column) -> Column:
    """A text with what ``may_match`` asks of it, worked out once for all patterns."""
    return F.struct(
        text.alias("text"), F.lower(text).alias("low"), text.rlike(r"(?U)\d").alias("digit")
    )


def may_match(held: Column, pattern: str) -> Column:
    """False only where no match can be: the ``searchable`` text lacks a literal or a digit that each match has."""
    tests = []
    for literal, digit in dict.fromkeys(_needs(b) for b in _branches(ungrouped(pattern))):
        test = held["digit"] if digit else F.lit(True)
        tests.append(test & F.contains(held["low"], F.lit(literal)) if literal else test)
    return reduce(operator.or_, tests)


def matches(held: Column, pattern: str) -> Column:
    return may_match(held, pattern) & held["text"].rlike(regex(pattern))


def matches_any(held: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern hits a ``searchable`` text; a pattern is tried only where it may match."""
    return reduce(operator.or_, [matches(held, p) for p in patterns])


# Fills windows that reach beyond the text. It is neither a letter nor white space and has
# no use in text (DEL). Being ASCII, it keeps the JVM's compact strings.
PAD = "\x7f"


def window_regex(pattern: str, width: int) -> str:
    """Matches ``pattern`` in a padded text; patterns may not be anchored to the text ends.

    Group 1 is the whole window: ``width`` characters, the match, ``width`` characters.
    The first look-ahead keeps the look-behind from running at every offset. The
    never-matching branch widens the look-behind, which Java measures in code units,
    so that the window may hold surrogate pairs; it may not start inside one.
    """
    p = ungrouped(pattern)
    window = rf"(?=((?s:.{{{width}}})(?:{p})(?s:.{{{width}}})))"
    behind = rf"(?<=(?![\uDC00-\uDFFF]){window}(?s:.{{{width}}})(?:|(?!).{{{width}}}))"
    return rf"{FLAGS}{_guard([p])}(?=(?:{p})){behind}(?:{p})"


def padded(text: Column, width: int) -> Column:
    return F.concat(F.lit(PAD * width), text, F.lit(PAD * width))


def match_windows(padded_text: Column, pattern: str, width: int) -> Column:
    """The window of every match, as array<string>."""
    return F.regexp_extract_all(padded_text, F.lit(window_regex(pattern, width)), F.lit(1))


def first_window(padded_text: Column, window_pattern: Column) -> Column:
    """The window of the first match of a window pattern held in a column."""
    return F.call_function("regexp_extract", padded_text, window_pattern, F.lit(1))


def text_before(window: Column, width: int, n: int) -> Column:
    """The last ``n`` characters before the match."""
    return F.substring(window, width - n + 1, n)


def text_after(window: Column, width: int, n: int) -> Column:
    """The first ``n`` characters after the match."""
    return F.left(F.right(window, F.lit(width)), F.lit(n))


def quote(window: Column) -> Column:
    """A window as a snippet: without padding and without white space at its ends."""
    return F.btrim(window, F.lit(PAD + WHITE_SPACE))


def trimmed(text: Column, ends: str) -> Column:
    """Like ``btrim``, which copies every character that it takes off; windows of short texts are mostly padding."""
    other = "[^" + "".join(f"\\u{ord(c):04x}" for c in ends) + "]"
    return F.regexp_extract(text, rf"(?s){other}(?:.*{other})?", 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def short_sha1(*parts: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)
