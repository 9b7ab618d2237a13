"""Main text of web pages: streaming parser events, text-to-tag ratios, Gaussian smoothing, clustering.

Parser events are folded into lines (blocks of text between block-level tags), each with its ratio of text outside links to tags and
the element it lies in. Ratios are smoothed with a Gaussian over neighbouring lines; lines above a threshold relative to
their spread are content, and runs of them are clusters. Every article and main element that holds a cluster is a content region. If
those hold less than nearly all content, the smallest element that does is one as well. A main element around articles
gives, besides them, its own lines from the first to the last content line. Lines of regions stay, in page order, short ones between
clusters included, apart from those that are mostly link text with a ratio below the threshold and those in elements that are
boilerplate by tag, role or name. A name that only contains a telling word ("search-trees") decides nothing inside a region: lines of
such an element stay if the cluster says so. Work is linear in the page, however deep its markup is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_rows

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img "
    "math semantics mrow mi mn mo ms mtext mspace mstyle mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mfenced mpadded mphantom".split()
)
DROPPED = set("script style noscript template nav footer aside form button select option textarea iframe object embed svg annotation annotation-xml canvas audio video head title menu dialog fieldset".split())
NAMED = set(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search social share sharing related recommended "
    "comment comments disqus respond replies reply discussion pagination pager skip".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: What stands beside a telling word in names of boilerplate: such a name is as good as the word alone.
BESIDE = set(
    "area bar block body bottom box btn button card center col column container content count cta desktop field fixed footer form global group head header heading holder icon inline inner input item items "
    "l label layer left link links list main message mobile module new next nested nav note outer page panel placeholder policy popup post posts prev primary reader readers region right row secondary section "
    "side single site slot small static sticky story summary tag target teaser text thread title toggle top unit user users view widget wide wrap wrapper zone".split()
)
OF_ARTICLE = set("article post entry content story main page body".split())
KEPT = {"html", "body", "article", "main"}
REGIONS = {"article", "main"}
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A start tag of the first ends an open element of the second that nothing of the third separates from it.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROWS = 128  # pages that a worker holds as text at a time
SIGMA, SPREAD, NEARLY, LINKED = 1.5, 0.5, 0.8, 0.5


class Lines(HTMLParser):
    """Folds events into lines; elements are numbered as they open, so a parent's number is below its children's.

    Open elements are found by their tag's depths, not by walking up.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.dropped, self.link, self.region, self.doubtful = [-1], [""], [False], [False], [False], [False]
        self.stack = [0]
        self.depths: dict[str, list[int]] = {}  # of each tag's open elements
        self.blocks: list[int] = []  # depths of open elements that an inline end tag doesn't reach across
        self.lines: list[tuple[str, int, int, bool, int]] = []  # text, tags, element, dropped, characters in links
        self.bits: list[str] = []
        self.tags = 0
        self.linked = 0
        self.where = 0

    def flush(self) -> None:
        text = " ".join("".join(self.bits).split())
        if text:
            self.lines.append((text, self.tags, self.where, self.dropped[self.where], min(self.linked, len(text))))
            self.tags = 0
        self.bits = []
        self.linked = 0

    def _named(self, tag: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool]:
        """If the element is boilerplate by tag, role or name, and if its name makes that likely only."""
        if tag in DROPPED:
            return True, False
        if tag == "header" and not inside:
            return True, False
        if tag in KEPT:
            return False, False
        likely = False
        for key, value in attrs:
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return True, False
            if not value:
                continue
            if key == "role" and value.lower() in ROLES:
                return True, False
            if key in ("class", "id"):
                for name in value.split():
                    words = {w.lower() for w in _NAME.findall(name)}
                    if words & NAMED:
                        if not inside or all(w in NAMED or w in BESIDE or w.isdigit() for w in words):
                            return True, False
                        likely = True
                words = {w.lower() for w in _NAME.findall(value)}
                if "header" in words and not inside and not words & OF_ARTICLE:
                    return True, False
            if key == "style" and "display:none" in value.replace(" ", "").lower():
                return True, False
        return False, likely

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag not in INLINE:
                self.flush() if tag != "br" else self.bits.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if tag in CLOSES_P:
                self._close({"p"}, {"article", "aside", "body", "button", "div", "section", "td", "th", "main"})
            if tag in IMPLIED:
                self._close(*IMPLIED[tag])
        elif tag == "a" and self.link[self.stack[-1]]:
            # A link ends the one it begins in.
            self.handle_endtag("a")
            self.tags -= 1
        top = self.stack[-1]
        gone, likely = self._named(tag, attrs, self.region[top])
        self.parent.append(top)
        self.tag.append(tag)
        self.dropped.append(self.dropped[top] or gone)
        self.doubtful.append(self.doubtful[top] or likely)
        self.region.append(self.region[top] or tag in REGIONS)
        self.link.append(self.link[top] or tag == "a" and any(k == "href" for k, _ in attrs))
        self._enter(len(self.tag) - 1)

    def _enter(self, element: int) -> None:
        if self.dropped[element] != self.dropped[self.stack[-1]]:
            self.flush()
        tag = self.tag[element]
        self.depths.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE and tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        if not self.bits:
            self.where = element

    def _leave(self, depth: int) -> None:
        for element in self.stack[depth:]:
            self.depths[self.tag[element]].pop()
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def _open(self, tags) -> int:
        """Depth of the innermost open element of these tags; 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _close(self, names: set[str], stops: set[str]) -> None:
        depth = self._open(names)
        if depth > self._open(stops):
            self._leave(depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "iframe"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        depth = self._open((tag,))
        # An inline end tag without its start in this block closes nothing outside it.
        if depth and (tag not in INLINE or depth > (self.blocks[-1] if self.blocks else 0)):
            if self.dropped[self.stack[depth]] != self.dropped[self.stack[depth - 1]]:
                self.flush()
            self._leave(depth)

    def handle_data(self, data: str) -> None:
        # Markup that the parser could not end is not text.
        if not self.bits:
            self.where = self.stack[-1]
        self.bits.append(data)
        if self.link[self.stack[-1]]:
            self.linked += len(" ".join(data.split()))


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over neighbouring lines, edges repeated."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), "valid")


def main_text(html: str | None) -> str:
    """Main text of one page: empty for null, for empty pages and for pages of boilerplate only."""
    if not html:
        return ""
    page = Lines()
    page.feed(html)
    page.close()
    page.flush()
    kept = [x for x in page.lines if not x[3]]
    if not kept:
        return ""
    sizes = np.array([len(x[0]) for x in kept], float)
    prose = sizes - [x[4] for x in kept]
    ratio = prose / np.maximum(1, [x[1] for x in kept])
    smooth = smoothed(ratio)
    level = SPREAD * smooth.std()
    content = smooth >= level
    # Content text of every element, children before parents.
    weight, text = np.zeros(len(page.tag)), np.zeros(len(page.tag))
    for (_, _, where, *_), n, m, good in zip(kept, sizes, prose, content, strict=True):
        weight[where] += m * good
        text[where] += n
    for e in range(len(page.tag) - 1, 0, -1):
        weight[page.parent[e]] += weight[e]
        text[page.parent[e]] += text[e]
    # The outermost article, the innermost main element and the nearest heading around each element.
    article, main, heading = [0], [0], [False]
    for e in range(1, len(page.tag)):
        up, tag = page.parent[e], page.tag[e]
        article.append(article[up] or (e if tag == "article" else 0))
        main.append(e if tag == "main" else main[up])
        heading.append(heading[up] or tag in HEADINGS)
    around = {main[e] for e in set(article) if e and text[e]}
    stay = np.zeros(len(kept), bool)
    own: dict[int, list[int]] = {}
    for n, (_, _, where, *_) in enumerate(kept):
        region = article[where] or main[where]
        if region and (article[where] or main[where] not in around):
            stay[n] = weight[region] > 0
        elif region:
            own.setdefault(region, []).append(n)
    for at in own.values():
        stay[_span(at, content, heading, kept)] = True
    if prose[stay & content].sum() < NEARLY * weight[0] or not stay.any():
        best = max(range(len(page.tag)), key=lambda e: (weight[e] >= NEARLY * weight[0], e)) if weight[0] else 0
        # Whatever holds little more than that belongs to it: headings, leads.
        while best and text[page.parent[best]] * NEARLY <= text[best]:
            best = page.parent[best]
        while best and page.tag[best] not in ("div", "section", "td", "article", "main", "body", "html"):
            best = page.parent[best]
        inside = np.zeros(len(page.tag), bool)
        inside[best] = True
        for e in range(best + 1, len(page.tag)):
            inside[e] = inside[page.parent[e]]
        # Where no element sets the text apart, it runs from the first to the last content line, with the headings before it.
        at = _span(range(len(kept)), content, heading, kept) if page.tag[best] in ("", "html", "body") else range(len(kept))
        stay[[n for n in at if inside[kept[n][2]]]] = True
    for n, (_, _, where, _, linked) in enumerate(kept):
        if linked > LINKED * sizes[n] and ratio[n] < level and not heading[where]:
            stay[n] = False
        if page.doubtful[where] and not (content[n] and linked <= LINKED * sizes[n]):
            stay[n] = False
    return " ".join(x[0] for x, good in zip(kept, stay, strict=True) if good)


def _span(at, content: np.ndarray, heading: list[bool], kept: list) -> list[int]:
    """Of some lines those from the first to the last content line and the headings before; all without content."""
    good = [n for n in at if content[n]]
    return [n for n in at if good[0] <= n <= good[-1] or n < good[0] and heading[kept[n][2]]] if good else list(at)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``text`` to ``page_id, url``: one row per input row, in any multiplicity; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, ROWS):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    picked = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string")


def op8_ratio_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
