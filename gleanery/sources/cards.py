"""Cards around links of listing pages: what a link, its box and the headings in the box say.

Boxes are found in one parse of the page; which links count is decided by expressions over the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, url
from ..operators.dedup import first_wins as first_rows
from .html import Node, Tree, _absolute

LINKS = "page_url string, position int, href string, url string, text string, title string, company string, location string, snippet string, name string, box string"
LIST_BOX = ("tr", "article", "li", "div", "section")
CARD_BOX = ("li", "article", "section")
HEADS = ("h1", "h2", "h3", "h4")


def _named(node: Node, parts: tuple[str, ...]) -> bool:
    return any(p in node.attrs.get("class", "") for p in parts)


def links(html: str | None, page: str | None) -> Iterator[tuple]:
    """A row per link in page order, see ``LINKS``; texts of boxes are taken once each."""
    if not html:
        return
    memo: dict[int, str] = {}
    found: dict[tuple[int, str], str] = {}

    def text(node: Node) -> str:
        if id(node) not in memo:
            memo[id(node)] = node.text()
        return memo[id(node)]

    def first(box: Node, kind: str, tags: tuple[str, ...], parts: tuple[str, ...]) -> str:
        key = id(box), kind
        if key not in found:
            hit = next((n for n in box.walk() if n is not box and (n.tag in tags or _named(n, parts))), None)
            found[key] = text(hit) if hit is not None else ""
        return found[key]

    def closest(node: Node, test) -> Node:
        up = node
        while up is not None and not test(up):
            up = up.parent
        return up if up is not None else node

    position = 0
    for a in Tree(html).root.walk():
        if a.tag != "a" or "href" not in a.attrs:
            continue
        href = a.attrs["href"].strip()
        box = closest(a, lambda n: n.tag in LIST_BOX)
        card = closest(a, lambda n: n.tag in CARD_BOX or n.tag == "div" and _named(n, ("result", "card", "listing")))
        own = text(a)
        yield (
            page, position, href, _absolute(page or "", href), own,
            first(box, "title", ("h2", "h3"), ("title", "Title")) or own, first(box, "company", (), ("company", "Company", "employer")), first(box, "place", (), ("location", "Location", "city")), text(box)[:240],
            first(card, "name", HEADS, ("title", "name", "Name")) or own, text(card)[:280],
        )
        position += 1


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links of all pages as rows; null and empty markup gives none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in LINKS.split(", ")]
        kinds = [pa.int32() if n == "position" else pa.string() for n in names]
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                rows = [r for h, u in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), strict=True) for r in links(h, u)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(names), kinds, strict=True)], names)

    return pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, LINKS)


def job_list(found: DataFrame) -> DataFrame:
    """``page_url, position, title, company, location, url, snippet``: links to jobs, the first of each URL on a page.

    A link counts by its path, a title by its words. On known aggregators any link counts, there and on career pages any title.
    """
    host = F.lower(url.authority(F.col("page_url")))
    any_link = host.rlike(f"(?i){fixed.AGGREGATORS}")
    any_title = any_link | url.path(F.col("page_url")).rlike(f"(?i){fixed.CAREERS_PAGE}")
    href = F.col("href")
    usable = (href != "") & (href != "#") & ~href.startswith("javascript:")
    rows = found.where((any_link & usable | ~any_link & href.rlike(f"(?i){fixed.LIST_PATH}")) & (F.col("url") != ""))
    rows = rows.where((F.length("title") >= 3) & (any_title | F.col("title").rlike(f"(?i){fixed.LIST_TITLE}")))
    return first_rows(rows, [F.col("page_url"), F.col("url")], [F.col("position")]).select("page_url", "position", "title", "company", "location", "url", "snippet")


def business_cards(found: DataFrame) -> DataFrame:
    """``page_url, position, name, url, snippet``: links to detail pages of the same host, the first of each URL on a page; navigation goes."""
    href, own = F.col("href"), F.col("text")
    rows = found.where(href.rlike(f"(?i){fixed.DETAIL_PATH}") & ~href.startswith("javascript:") & ~href.startswith("mailto:"))
    rows = rows.where((url.authority(F.col("url")) == url.authority(F.col("page_url"))) & (F.length(own) >= 3) & ~own.rlike(f"(?i){fixed.NAVIGATION_TEXT}"))
    return first_rows(rows, [F.col("page_url"), F.col("url")], [F.col("position")]).select("page_url", "position", "name", "url", F.col("box").alias("snippet"))
