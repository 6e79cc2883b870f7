"""Parts of an article that stand outside the element with most of its text."""

import pytest

from retail_spark.llm.html_text import main_text

LONG = "One two, three. Four, five and six. " * 20
ITEMS = "".join(f"<li>Item {k}, with a comma. And a stop.</li>" for k in range(40))


@pytest.mark.parametrize(
    "page, first, last",
    [
        (f"<body><article><h1>Head</h1><div class=entry-content><p>{LONG}</p><p>End.</p></div></article></body>", "Head", "End."),
        (f"<body><div id=story><div class=intro><p>Lead, short.</p></div><div class=body><p>{LONG}</p><p>End.</p></div></div></body>", "Lead, short.", "End."),
        (f"<body><article><h1>Head</h1><p>Before, it.</p><ul>{ITEMS}</ul><p>After, it.</p></article></body>", "Head", "After, it."),
        (f"<body><main><h2>Head</h2><blockquote><p>{LONG}</p></blockquote><p>After, it.</p></main></body>", "Head", "After, it."),
        (f"<body><article><h1>Head</h1><section><p>{LONG}</p></section><section><p>After, it.</p></section></article></body>", "Head", "After, it."),
    ],
)
def test_whole_article(page, first, last):
    lines = main_text(page).split("\n")
    assert lines[0] == first and lines[-1] == last


def test_links_are_elements_named_a():
    page = f"<body><article><h2>Head</h2><p>{LONG}</p></article><article><h2>Other</h2><p>{LONG}</p><ul><li><a href=1>Go</a></li></ul></article></body>"
    assert main_text(page).split("\n") == ["Head", LONG.strip(), "Other", LONG.strip()]


@pytest.mark.parametrize("rest", [f"<body><p>{LONG}</p></body>", f"<p>{LONG}</p>", LONG])
def test_a_head_without_end(rest):
    assert main_text(f"<html><head><title>x</title><meta name=a>{rest}</html>") == LONG.strip()


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content with-sidebar'><h1>Head</h1><p>{LONG}</p><div class=sidebar><p>Aside, this.</p></div></div></body>",
        f"<body><form id=page><h1 class=entry-header>Head</h1><p>{LONG}</p><div class=comments><p>{LONG}</p></div></form></body>",
        f"<body><article><div class=entry-header><h1>Head</h1></div><p>{LONG}</p><div class=share><p>Share, now.</p></div></article></body>",
        f"<body><div class=legal><div class=page-with-comments><h1>Head</h1><p>{LONG}</p></div></div></body>",
    ],
)
def test_marks_on_what_holds_the_article(page):
    assert main_text(page).split("\n") == ["Head", LONG.strip()]


def test_a_long_advert_beside_a_short_article():
    assert main_text(f"<body><div class=ad>{LONG}</div><article><h1>Head</h1><p>Short.</p></article></body>") == "Head\nShort."
