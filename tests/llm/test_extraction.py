"""HTML extraction: the cut against all labellings, and the text against pages whose main text is known."""

import itertools
import random

import pytest

from gridsense.llm import extraction

LONG = "The committee met on Tuesday to discuss the new budget, which has been debated for weeks by all sides of the council."
SHORT = "Short line."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">News of today</a></li></ul>'

PAGES = {
    "semantic": (
        f'<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav>{MENU}</nav><!-- ad -->'
        f'<div class="ad">Buy this thing now.</div><article><h1>T &amp; U</h1><p><b>{LONG}<br><p>{SHORT}</p></article>'
        "<footer>&copy; site</footer></body></html>",
        ["T & U", LONG, SHORT],
    ),
    "classes": (
        f'<div id="header"><a href="/">Site</a></div><div class="menu">{MENU}</div><div id="content"><h1>Council meets</h1><p>{LONG}</p>'
        f'<p>{SHORT}</p><ul><li>First item of the list here</li></ul></div><div class="sidebar"><p>{LONG}</p></div>'
        f'<div id="comments"><p>{LONG}</p></div><div class="footer">All rights reserved.</div>',
        ["Council meets", LONG, SHORT, "First item of the list here"],
    ),
    "no hints": (
        f'<table><tr><td><a href="1">Home</a></td><td><a href="2">Away</a></td></tr></table><h2>Title here</h2>{LONG}<div>{LONG}</div>'
        '<div><a href="1">next</a> <a href="2">prev</a></div><p>Copyright 2020 ©</p>',
        ["Title here", LONG, LONG],
    ),
    "inside": (
        f'<main><article><header><h1>A title</h1></header><p>{LONG}</p><div class="advert">Buy now!</div><p>Ok.</p><aside>{LONG}</aside>'
        f'<form>Name <input><button>Send</button></form></article><section id="comments"><article><p>{LONG}{LONG}</p></article></section></main>',
        ["A title", LONG, "Ok."],
    ),
    "framed": (
        f'<body class="no-sidebar"><div class="page-header-wrap header"><article><h1>Hello</h1><p>{LONG}</p></article></div>'
        '<div class="cookie-banner"><p>We use cookies. By continuing you agree.</p></div></body>',
        ["Hello", LONG],
    ),
    "references": ("<article><p>a&nbsp;b &lt;c&gt; &#233; x<b>y</b>z</p><p> \t</p><pre>a\n  b</pre></article>", ["a b <c> é xyz", "a b"]),
    "broken": (f'</p></div><article><p>{LONG}<div class="ad">x</div><p>unclosed <b>bold <p>next</article><footer>f</footer', [LONG, "unclosed bold", "next"]),
    "plain text": (f"{LONG}", [LONG]),
    "only menus": (f"<nav>{MENU}</nav>", []),
    "long": ("<article>" + f"<p>{LONG}</p><div class='ad'>x</div>" * 5000 + "</article>", [LONG] * 5000),
    "deep": ("<div>" * 50_000 + f"<p>{LONG}</p>", [LONG]),
    "open comment": (f"<article><p>{LONG}</p><!-- {LONG}", [LONG]),
}


@pytest.mark.parametrize("name", PAGES)
def test_the_main_text_of_a_page(name):
    html, blocks = PAGES[name]
    assert extraction.main_text(html) == "\n\n".join(blocks)


def test_the_cut_is_the_cheapest_with_the_smallest_content_side():
    rnd = random.Random(1)
    for _ in range(1500):
        size = rnd.randint(1, 7)
        scores = [rnd.randint(-6, 6) for _ in range(size)]
        edges = [(rnd.randrange(size), rnd.randrange(size), rnd.randint(0, 5)) for _ in range(rnd.randint(0, 12))]

        def cost(sides, scores=scores, edges=edges):
            own = sum(max(-s, 0) if side else max(s, 0) for s, side in zip(scores, sides, strict=True))
            return own + sum(w for i, j, w in edges if sides[i] != sides[j])

        all_sides = list(itertools.product([False, True], repeat=size))
        least = min(map(cost, all_sides))
        assert extraction.content_side(scores, edges) == [all(s[i] for s in all_sides if cost(s) == least) for i in range(size)]


def test_a_long_chain_of_undecided_blocks_is_cut():
    size = 20_000
    scores = [3 if i % 2 else -3 for i in range(size)]
    sides = extraction.content_side(scores, [(i, i + 1, 4) for i in range(size - 1)])
    assert len(set(sides)) == 1


def test_rows_of_pages(spark):
    pages = [(i, f"u{i}", html, "x", 5) for i, (html, _) in enumerate(PAGES.values())]
    pages += [(None, None, None, "x", 5), (0, "u0", "", "x", 5), (0, "u0", "", "x", 5)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string, key int").repartition(3)
    rows = extraction.extract(df).collect()
    texts = {i: "\n\n".join(blocks) for i, (_, blocks) in enumerate(PAGES.values())}
    want = [(i, f"u{i}", text, len(text)) for i, text in texts.items()] + [(None, None, "", 0), (0, "u0", "", 0), (0, "u0", "", 0)]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert extraction.extract(df.limit(0)).collect() == []
