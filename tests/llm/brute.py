"""Plain Python versions of the text operators, over lists of rows."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

import regex
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Groups:
    def __init__(self):
        self.parent = {}

    def top(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.parent[max(a, b)] = min(a, b)


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    held = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(held),
    )


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(fps, radius=2):
    """The first fingerprint of each one's group, by comparing all."""
    groups, distinct = Groups(), sorted(set(fps))
    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= radius:
            groups.join(a, b)
    return {fp: groups.top(fp) for fp in distinct}


def simhash(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    top = near_groups(fps)
    least = {}
    for (doc_id, _), fp in zip(rows, fps, strict=True):
        if doc_id is not None:
            least[top[fp]] = min(doc_id, least.get(top[fp], doc_id))
    return [(d, f"{fp:016x}", least.get(top[fp])) for (d, _), fp in zip(rows, fps, strict=True)]


def repeated_lines(rows):
    """Places of the lines of each row that occurred before next to the same neighbour."""
    first, gone = {}, [set() for _ in rows]
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)):
        lines = (rows[i][1] or "").split("\n")
        for k, pair in enumerate(zip(lines, lines[1:], strict=False)):
            if any(WORD.search(x) for x in pair):
                row, at = first.setdefault(pair, (i, k))
                if row != i or k >= at + 2:
                    gone[i] |= {k, k + 1}
    return gone


def line_dedup(rows):
    """Texts of (doc_id, text) rows, in their order, without lines repeated in runs of two or more."""
    return [
        None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
        for (_, text), gone in zip(rows, repeated_lines(rows), strict=True)
    ]


def best_fit(rows, capacity):
    """Bins of (doc_id, source, cluster, size) rows, longest first, by looking at every bin."""
    bins = []
    rows = sorted(rows, key=lambda r: (-(r[3] % capacity), *((v is None, v) for v in r[:3])))
    clusters = Counter(r[2] for r in rows)
    for doc_id, source, cluster, size in rows:
        rest = size % capacity
        if not rest:
            continue
        fits = [
            (b["free"], n) for n, b in enumerate(bins)
            if b["free"] >= rest and (source is None or source not in b["sources"])
            and (cluster is None or clusters[cluster] < 2 or cluster not in b["clusters"])
        ]
        if fits:
            n = min(fits)[1]
        else:
            n = len(bins)
            bins.append({"free": capacity, "sources": set(), "clusters": set(), "docs": []})
        bins[n]["docs"].append((doc_id, capacity - bins[n]["free"], rest))
        bins[n]["free"] -= rest
        bins[n]["sources"].add(source)
        bins[n]["clusters"].add(cluster)
    return bins


def template(text):
    """(raw words, template words) of a text, by the rules of the operator."""
    from attesta.llm import decontaminate as d

    text = regex.sub(rf"(?i)(?<=\d)({d._UNIT}){d._EDGE}", r" \1", text or "")
    out = regex.sub(rf"{d._OPEN}{d._VALUE}{d._EDGE}", d.NUMBER, text)
    out = regex.sub(rf"(?i)(?<={d.NUMBER}[\x20\x09])({d._UNIT}){d._EDGE}", d.UNIT, out)
    out = regex.sub(r"(?<=[^.!?:\x20\x09-\x0D][\x20\x09])\p{Lu}[\p{L}\p{M}'’-]*", d.NAME, out)
    out = regex.sub(r"(?<=[\p{L}\p{N}>])[.,;:!?]+(?=[\x20\x09-\x0D]|$)", "", out).lower()
    raw, words = WORD.findall(text), WORD.findall(out)
    assert len(raw) == len(words)
    return raw, words


def leaks(rows, items):
    """(doc_id, item_id, matched) of (doc_id, text) rows against (item_id, text) items."""
    slot = lambda w: any(p in w for p in ("<num>", "<unit>", "<name>"))
    out = []
    for item_id, item in items:
        raw, words = template(item)
        n = min(5, len(words))
        wins = {}
        for q in range(max(0, len(words) - 4) or min(1, len(words))):
            w = tuple(words[q : q + 5])
            if len(words) >= 3 and sum(not slot(x) for x in w) >= min(3, n):
                wins.setdefault(w, []).append(q)
        total = sum(map(len, wins.values()))
        for doc_id, text in rows:
            doc_raw, doc_words = template(text)
            met = defaultdict(list)
            for p in range(max(0, len(doc_words) - 4) or min(1, len(doc_words))):
                for q in wins.get(tuple(doc_words[p : p + 5]), ()):
                    met[p - q].append((p, q))
            found = set()
            for places in met.values():
                pairs = {
                    q: {(raw[q + k], doc_raw[p + k]) for k in range(5) if q + k < len(words) and slot(words[q + k])}
                    for p, q in places
                }
                values = defaultdict(set)
                for old, new in set().union(*pairs.values()):
                    values[old].add(new)
                found |= {q for q, own in pairs.items() if all(a == b or len(values[a]) == 1 for a, b in own)}
            if found and len(found) >= min(-(-total * 4 // 5), 9):
                out.append((doc_id, item_id, len(found)))
    return out
