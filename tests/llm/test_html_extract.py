"""Extraction against pages whose article is known."""

import html
import random

import pytest

from attesta.llm.html_extract import main_blocks, main_text, smooth

from .conftest import sentence

PAGES = "page_id long, url string, html string"
MENU = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a><li><a href=/c>About us</a></ul></nav>"
FOOT = "<footer><p>&copy; 2024 Example &middot; all rights reserved for ever and a day by the owners</p></footer>"
SCRIPT = '<script>var t="<p>no text</p>"; if (a < b) { track("x"); }</script><style>p{margin:0}</style>'


def article(rng, n):
    return [sentence(rng, rng.choice([1, 2, 3, 30, 60, 90])) for _ in range(n)]


def paragraphs(blocks):
    return "".join(f"<p>{html.escape(b)}</p>\n" for b in blocks)


def pages():
    """(name, page, wanted blocks)."""
    rng = random.Random(12)
    own = [article(rng, 9) for _ in range(20)]
    own = [[f"Title {i} & more", *a] for i, a in enumerate(own)]
    heads = [f"<h1>{html.escape(a[0])}</h1>{paragraphs(a[1:])}" for a in own]
    remarks = "".join(f"<p>{sentence(rng, 50)}</p>" for _ in range(4))
    return [
        ("plain", f"<html><body>{MENU}<article>{heads[0]}</article>{FOOT}</body></html>", own[0]),
        ("no closing", f"<html><body>{MENU}<article>{heads[1]}</article>{FOOT}", own[1]),
        ("main", f"<body><header><h2>Site name</h2></header>{MENU}<main>{heads[2]}</main>{FOOT}</body>", own[2]),
        ("named div", f"<body><div id=top-menu><a href=/>x</a></div><div class='post-content'>{heads[3]}</div>"
                      f"<div class='sidebar widget'>{remarks}</div>{FOOT}</body>", own[3]),
        ("comments inside", f"<body>{MENU}<article>{heads[4]}<section class=comments>{remarks}</section></article>", own[4]),
        ("comment articles", f"<body><article>{heads[5]}</article><div id='comments'>"
                             f"<article class='comment'>{remarks}</article></div>{FOOT}", own[5]),
        ("advert in the middle", f"<article><h1>{html.escape(own[6][0])}</h1>{paragraphs(own[6][1:4])}"
                                 f"<div class='ad-slot ad'>{remarks}</div>{paragraphs(own[6][4:])}</article>{FOOT}", own[6]),
        ("scripts", f"<head><title>T</title>{SCRIPT}</head><body>{SCRIPT}<article>{heads[7]}{SCRIPT}</article>", own[7]),
        ("forms and notices", f"<body><div class='cookie-notice'><p>{sentence(rng, 70)}</p></div><article>{heads[8]}"
                              f"<form><p>Subscribe</p><input name=q><button>Go</button></form></article>{FOOT}", own[8]),
        ("hidden", f"<body><article><p hidden>no</p><p style='display: none'>no</p>{heads[9]}</article>{FOOT}", own[9]),
        ("bare body", f"<body><ul><li><a href=/1>One</a><li><a href=/2>Two</a><li><a href=/3>Three</a></ul>"
                      f"{heads[10]}<div class=footer>{sentence(rng, 12)}</div></body>", own[10]),
        ("text only", "just a few words", ["just a few words"]),
        ("upper case", f"<BODY><NAV><A HREF=/>x</A></NAV><ARTICLE>{heads[11].upper()}</ARTICLE></BODY>",
         [html.unescape(html.escape(x).upper()) for x in own[11]]),
        ("unclosed tags", "<article><h1>A</h1><p><b>First part<br>of it<p>Second <i>part</i><ul><li>x one<li>y two</ul>"
                          f"</article>{FOOT}", ["A", "First part of it", "Second part", "x one", "y two"]),
        ("references", "<article><p>a &lt;b&gt; &amp;amp; &#233; &#xe9; &nbsp; &unknown; &copy</p></article>",
         ["a <b> &amp; é é &unknown; ©"]),
        ("open comment", f"<article>{heads[12]}</article><!-- never closed <p>no</p>", own[12]),
        ("declarations", f"<!DOCTYPE html><![CDATA[x]]><?php y ?><article>{heads[13]}<![if x]>", own[13]),
        ("modifiers", f"<body class='has-sidebar'><article class='no-comments with-ads'>{heads[14]}</article>", own[14]),
        ("all set aside by name", f"<body><div class=widget>{heads[15]}</div></body>", own[15]),
        ("sections", "<body>" + MENU + "<main><section class='story'>" + heads[16] + "</section><section class='story'>"
                     + paragraphs(own[17][1:]) + "</section></main>" + FOOT, own[16] + own[17][1:]),
        ("article header", f"<article><header><h1>{html.escape(own[18][0])}</h1></header>{paragraphs(own[18][1:])}"
                           f"<footer>Filed under x</footer></article>", own[18]),
        ("menu only", MENU, []),
        ("empty", "", []),
        ("blank", " \n ", []),
        ("null", None, []),
    ]


@pytest.mark.parametrize("name,page,want", pages(), ids=[p[0] for p in pages()])
def test_blocks(name, page, want):
    assert main_blocks(page)[0] == want


def test_long_and_deep_pages():
    rng = random.Random(3)
    blocks = article(rng, 4000)
    page = f"<body>{MENU}<article>{paragraphs(blocks)}</article>{FOOT}</body>"
    assert main_blocks(page)[0] == blocks
    assert main_blocks("<div>" * 30_000 + "<p>deep text</p>")[0] == ["deep text"]
    assert main_blocks("<!--" * 100_000)[0] == []
    assert main_blocks("<article><p>x</p>" + "</b>" * 50_000 + "<p>y</p></article>")[0] == ["x", "y"]


def test_smoothing_keeps_constant_ratios():
    import numpy as np

    assert np.allclose(smooth(np.full(9, 4.0)), 4.0) and len(smooth(np.ones(1))) == 1


def test_table(spark):
    rows = [(i % 20, f"http://x/{i}", page) for i, (_, page, _) in enumerate(pages())] + [(None, None, None)]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'a' AS text", "1 AS n_chars", "2 AS blocks")
    got = main_text(df).collect()
    want = [("\n\n".join(w)) for _, _, w in pages()] + [""]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got), key=key) == sorted(
        ((p, u, w, len(w)) for (p, u, _), w in zip(rows, want, strict=True)), key=key
    )
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0
