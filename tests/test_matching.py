import random
import re

from pyspark.sql import functions as F

from attesta.functions.matching import (
    PAD, any_of, match_windows, padded, quote, regex, strip, text_after, text_before, ungrouped,
)
from attesta.packs import CARE_INDICATORS, CARE_PACK, NOTICE_INDICATORS, NOTICE_PACK

ALPHABETS = (
    ["the", "The ", "é", " ", "\n", "xthe", "a", "no "],
    ["the", "The ", "😀", " ", "\n", "a", "no "],
    ["the", "THE ", " ", "a", "𝒳", "x-ray ", "of the "],
)


def _texts(seed, n=150, longest=200):
    rnd = random.Random(seed)
    for letters in ALPHABETS:
        for _ in range(n):
            yield "".join(rnd.choice(letters) for _ in range(rnd.randint(0, longest)))


def test_windows_equal_finditer(spark):
    texts = list(_texts(3))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for p in (r"\bthe\b", r"\bof the\b|\bthe\b", r"\bx-?ray\b", "the"):
        windows = df.select("i", match_windows(padded(F.col("t"), 100), p, 100).alias("w"))
        parts = lambda w: F.array(
            w, text_before(w, 100, 50), text_after(w, 100, 80), quote(w)
        )
        rows = windows.select("i", F.transform("w", parts).alias("w")).collect()
        for r in rows:
            t = texts[r.i]
            want = [
                [t[max(0, m.start() - 100):m.end() + 100], t[max(0, m.start() - 50):m.start()],
                 t[m.end():m.end() + 80], t[max(0, m.start() - 100):m.end() + 100].strip()]
                for m in re.finditer(p, t, re.I)
            ]
            assert [[x.strip(PAD) for x in w] for w in r.w] == want


def test_any_of_equals_trying_each(spark):
    packs = [CARE_PACK.patterns, NOTICE_PACK.patterns]
    packs += [tuple(p for r in k.rules for p in r.patterns) for k in (CARE_INDICATORS, NOTICE_INDICATORS)]
    packs += [(c,) for k in (CARE_PACK, NOTICE_PACK) for c in (k.cue_before, k.cue_after)]
    rnd = random.Random(5)
    literal = lambda p: re.sub(r"\\b|\?|\(\?:|[()\[\]\\]|\|.*", "", p).replace("d{1,3}", "12")
    words = [literal(p) for pack in packs for p in pack] + [
        "no", "the", "ward", "é", "1.2.3.4", "1234567890123", "a.b@mail.example.com", "+49 (123) 555-1234",
        "doesn't have", "do not have", "in house  none", "non functional", "case referred to", "not in-house",
        "being set up", "yet to be", "$$$", "###", "version 3", "x by", "refers out",
        "X-ray", "xray", "haemodialysis", "hemodialysis", "24x7", "24 / 7", "ſurgery", "İCU", "cardıac", "",
    ]
    texts = [rnd.choice(["", " ", "é"]).join(rnd.sample(words, 3)) for _ in range(1500)] + words
    texts += [" ".join(rnd.sample(words, 2)).upper() for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for patterns in packs:
        got = df.select(
            "i", F.col("t").rlike(any_of(patterns)).alias("any"),
            F.array(*[F.col("t").rlike(regex(p)) for p in patterns]).alias("each"),
        ).collect()
        for r in got:
            each = [bool(re.search(p, texts[r.i], re.I)) for p in patterns]
            assert r.each == each, (texts[r.i], patterns)
            assert r.any == any(each), (texts[r.i], patterns)


def test_strip_is_str_strip(spark):
    texts = ["\x1f a\x85", "  b ", "\u2003c\u3000", "", " \t\n", "d\xa0", "\u200be"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", strip(F.col("t")).alias("s")).collect()
    assert all(r.s == r.t.strip() for r in rows)


def test_groups_become_non_capturing():
    assert ungrouped(r"a (b|c) \(d\) [(] (?:e)") == r"a (?:b|c) \(d\) [(] (?:e)"
