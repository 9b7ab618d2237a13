"""Ratio clusters decide which regions of a page are content, and which of their lines stay."""

import pytest

from gleanery.llm.html_text import main_text

LONG = [f"Sentence {k} of some longer running text of an article, with several words in it, and then a few more." for k in range(8)]


def paras(*at):
    return "".join(f"<p>{LONG[k]}</p>" for k in at)


def text(*at):
    return " ".join(LONG[k] for k in at)


@pytest.mark.parametrize(
    "page, want",
    [
        # The main element's own text beside a teaser in an article.
        (f"<main><div>{paras(0, 1, 2, 3)}</div><article><p>Teaser.</p></article></main>", text(0, 1, 2, 3)),
        # All articles with clusters, whatever their weights.
        (f"<article>{paras(0, 1, 2)}</article><article>{paras(3, 4)}</article><article>{paras(5)}</article>", text(0, 1, 2, 3, 4, 5)),
        (f"<main><h1>Head</h1><article>{paras(0, 1)}</article><article>{paras(2, 3)}</article></main>", "Head " + text(0, 1, 2, 3)),
        # Text outside of a short article.
        (f"<body><div class='text'>{paras(0, 1, 2, 3, 4, 5)}</div><article><p>{LONG[6]}</p></article></body>", text(0, 1, 2, 3, 4, 5, 6)),
        # Lines of links without any telling class, inside an article; a link in running text and a linked heading stay.
        (
            f"<article><h2><a href='/h'>Linked head</a></h2>{paras(0, 1)}<ul><li><a href='/1'>More one</a></li><li><a href='/2'>More two</a></li></ul><p>{LONG[2]} <a href='/3'>With link.</a></p></article>",
            f"Linked head {text(0, 1, 2)} With link.",
        ),
        # Short lines between clusters are no links and stay.
        (f"<article>{paras(0)}<p>Short.</p>{paras(1)}<p>End.</p></article>", f"{LONG[0]} Short. {LONG[1]} End."),
        # Nothing but links: nothing tells them apart.
        ("<article><p><a href='/1'>One</a></p><p><a href='/2'>Two</a></p></article>", "One Two"),
        # A link that isn't closed ends where the next begins.
        (f"<article><p><a href='/1'>x <a href='/2'>y</a> {LONG[0]}</p>{paras(1)}</article>", f"x y {text(0, 1)}"),
    ],
)
def test_regions(page, want):
    if "Teaser." in page:
        assert main_text(page).startswith(want)
    else:
        assert main_text(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        # A name that only holds a telling word is left to the cluster; a name of nothing else is boilerplate, prose or not.
        (f"<article>{paras(0)}<div class='search-trees'>{paras(1)}</div>{paras(2)}</article>", text(0, 1, 2)),
        (f"<article>{paras(0)}<section id='notices-of-intent'>{paras(1)}</section>{paras(2)}</article>", text(0, 1, 2)),
        (f"<article>{paras(0, 1)}<div class='search-box'>{paras(2)}</div><div class='ad-slot-3'>{paras(3)}</div><div id='comments'>{paras(4)}</div></article>", text(0, 1)),
        (f"<article>{paras(0, 1)}<div class='related-reading-mountains'><a href='/1'>One other page</a> <a href='/2'>Two</a></div></article>", text(0, 1)),
        # Outside of a region a telling word is enough.
        (f"<body><div class='search-trees'>{paras(5)}</div><article>{paras(0, 1)}</article></body>", text(0, 1)),
        # Formulas are text; their sources aren't.
        (f"<article><p>Area is <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>x=2</annotation></semantics></math> ok. {LONG[0]}</p></article>", f"Area is x=2 ok. {LONG[0]}"),
        # End tags without a start, across blocks.
        (f"<article><b><p>{LONG[0]}</b></i></span></p><p>{LONG[1]}</p></article></div>", text(0, 1)),
    ],
)
def test_names_and_formulas(page, want):
    assert main_text(page) == want


def test_work_is_linear_in_depth():
    import time

    def seconds(depth):
        pages = [f"<article>{f'<{tag}>' * depth}<p>{LONG[0]}{'</i>' * depth}{'</q></table>' * depth}{f'</{tag}>' * depth}</article>" for tag in ("div", "b", "li", "a")]
        start = time.perf_counter()
        assert all(main_text(p) == LONG[0] for p in pages)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(32_000) < 40 * max(0.05, seconds(4000))


def test_every_line_of_a_region_is_weighed_against_brute_force(spark):
    """Pages of the table against their article with markup taken off by hand, for every page."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r in pages:
        inner = re.sub(r"<(/?(p|h1)|br)>", " ", re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1))
        assert main_text(r["html"]) == " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())
