"""Article text that must stay, pages that nest deeply or never close, and path scores worked out plainly."""

import math
import time

import numpy as np
import pytest

from retail_spark.llm.html_text import SMOOTHING, _Page, _scores, extract, main_text

LONG = "One two, three. Four, five and six. " * 20
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<main><h1>T</h1><p>Lead, it.</p><article><p>{LONG}</p></article></main>", ["T", "Lead, it.", TEXT]),
        (f"<div><h1>T</h1><p>Lead, it.</p><article><p>{LONG}</p></article></div>", ["T", "Lead, it.", TEXT]),
        (f"<div><h1>T</h1></div><article><h1>Own</h1><p>{LONG}</p></article>", ["Own", TEXT]),
        (f"<article><h2>A</h2><p>{LONG * 9}</p></article><article><h2>B</h2><p>{LONG}</p></article>", ["A", (LONG * 9).strip(), "B", TEXT]),
        (f"<article><p>{LONG}</p><p><a>Go here</a></p><ul><li><a>One</a></li></ul><h2><a>Two</a></h2></article>", [TEXT, "Go here", "One", "Two"]),
        (f"<article><p>{LONG}</p><p>So <math><mi>x</mi></math> is <label>y</label>, ze​ro.</p></article>", [TEXT, "So x is y, ze​ro."]),
        (f"<article><p>{LONG}</p></article><article class=comment><p>{LONG}</p></article>", [TEXT]),
        (f"<article><p>{LONG}</p><!-- never ends<p>After, it.</p></article>", [TEXT, "never ends", "After, it."]),
        (f"<article><p>{LONG}</p><p>a < b, <i>c</i> <", [TEXT, "a < b, c <"]),
    ],
)
def test_nothing_of_the_article_is_lost(page, want):
    assert main_text(f"<body>{page}").split("\n") == want


@pytest.mark.parametrize("name", ["social-impact", "legal-history", "side-effects", "search-results"])
def test_a_section_whose_name_holds_a_faint_mark(name):
    page = f"<body><article><p>{LONG}</p><section class={name}><p>Some, text.</p></section></article></body>"
    assert main_text(page).split("\n") == [TEXT, "Some, text."]


@pytest.mark.parametrize("name", ["social-links", "share", "comments", "newsletter-teaser", "search box"])
def test_a_section_that_is_no_article(name):
    page = f"<body><article><p>{LONG}</p><section class='{name}'><p>Some, text.</p></section></article></body>"
    assert main_text(page) == TEXT


@pytest.mark.parametrize("unit", ["<b>", "<div>", "<b><p>x", "<ul><li>x", "<div class=ad>x", "<svg>", "<!--", "<a b='", "<", "<table><td>x", "</p>x"])
def test_time_grows_with_length(unit):
    page = unit * (500_000 // len(unit))
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 60
    found = main_text(f"<body><article><h1>T</h1><p>{LONG}</p></article>{page}")
    assert found.startswith(f"T\n{TEXT}")


def test_scores_match_a_plain_version():
    page = _Page()
    page.feed(f"<body><div><p>{LONG}</p><p>Two, it.</p><b>x</b></div><ul><li>a</li><li>b, c</li></ul><div><p>End.</p></div></body>")
    page.close()
    nodes = [(e, len(d.strip()), d.count(",") + d.count(".")) for block in page.blocks for e, d in block if d.strip()]

    def path(element):
        tags = []
        while element.parent:
            tags.append(element.tag)
            element = element.parent
        return tuple(tags)

    paths = [path(e) for e, _, _ in nodes]
    plain = []
    for p in paths:
        same = [(size, marks) for (_, size, marks), q in zip(nodes, paths) if q == p]
        plain.append(sum(s for s, _ in same) / len(same) * (1 + sum(m for _, m in same) / len(same)))
    n = len(plain)
    smooth = [sum(SMOOTHING[k + 3] * plain[min(max(i + k, 0), n - 1)] for k in range(-3, 4)) for i in range(n)]
    fused = [math.sqrt(a * b) for a, b in zip(plain, smooth)]
    want = [np.mean([f for f, q in zip(fused, paths) if q == p]) for p in paths]
    assert np.allclose(_scores(nodes), want)


def test_odd_rows(spark):
    deep = "<b>" * 20_000 + "<p>Text, it.</p>"
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", 1, 2), (1, "u", None, 3, 4), (None, None, "", 5, 6), (2, "v", deep, 7, 8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int, n_chars int")
    found = sorted(((r.page_id or 0, r.text, r.n_chars) for r in extract(pages).collect()), key=str)
    assert found == sorted([(1, TEXT, len(TEXT)), (1, "", 0), (0, "", 0), (2, "Text, it.", 9)], key=str)
    assert extract(pages.limit(0)).count() == 0
