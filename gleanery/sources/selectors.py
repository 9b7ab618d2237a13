"""Cards and fields by CSS selectors: rules of known sites, learned maps, configured cards.

Rules are data. A page is matched to a site by host; its rules are evaluated in the same kind of single Arrow pass that parses
pages, and what comes out are rows for joins and merges.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import Node, Tree, _absolute

# Selectors of listing cards by site. Lists of alternatives; the first element found counts.
CARD_SITES = {
    "jobrapido": (r"(^|\.)jobrapido\.com$", "article, li[class*='result'], div[class*='result-list-item'], div[class*='job-result']", {"link": "a[href]", "title": "h2, h3, [class*='title']", "company": "[class*='company']", "location": "[class*='location']"}),
    "indeed": (r"(^|\.)indeed\.[a-z.]+$", "div.job_seen_beacon, [data-jk]", {"link": "a.jcs-JobTitle, a[id^='job_'], a[data-jk]", "company": "[data-testid='company-name'], .companyName", "location": "[data-testid='text-location'], .companyLocation"}),
    "stepstone": (r"(^|\.)stepstone\.(de|com|at|nl|fr|be)$", "article[data-at='job-item'], article[data-testid='job-item']", {"link": "a[data-at='job-item-title'], a[data-testid='job-item-title']", "company": "[data-at='job-item-company-name']", "location": "[data-at='job-item-location']"}),
    "linkedin": (r"(^|\.)linkedin\.com$", "li.jobs-search-results__list-item, div.job-card-container, li.scaffold-layout__list-item", {"link": "a.job-card-list__title, a[data-control-name='job_card_click'], a.base-card__full-link", "company": ".job-card-container__company-name, .base-search-card__subtitle", "location": ".job-card-container__metadata-item, .job-search-card__location"}),
    "glassdoor": (r"(^|\.)glassdoor\.[a-z.]+$", "li[data-test='jobListing'], li.react-job-listing", {"link": "a[data-test='job-link'], a.jobLink", "company": "[data-test='employer-name']", "location": "[data-test='emp-location']"}),
    "monster": (r"(^|\.)monster\.[a-z.]+$", "section[data-testid='svx_jobCard'], article.results-card", {"link": "a[data-testid='svx_jobTitle'], a", "company": "[data-testid='company']", "location": "[data-testid='jobDetailLocation']"}),
    "xing": (r"(^|\.)xing\.com$", "article[data-qa='job-search-result']", {"link": "a[data-qa='job-search-result-link']", "title": "[data-qa='job-search-result-title']", "company": "[data-qa='job-search-result-company']", "location": "[data-qa='job-search-result-location']"}),
    "finn.no": (r"(^|\.)finn\.no$", "article, li, div[class*='card'], div[class*='listing']", {"link": "a[href*='/job/ad/']", "title": "h2, h3, [class*='title']", "company": "[class*='company'], [class*='employer']", "location": "[class*='location'], [class*='place'], [class*='workplace']"}),
    "nav.no": (r"(^|\.)nav\.no$", "article, li, div[class*='card'], div[class*='result'], div[class*='aksel']", {"link": "a[href*='/stillinger/stilling/']", "title": "h2, h3, [class*='title']", "company": "[class*='employer'], [class*='company']", "location": "[class*='location'], [class*='place']"}),
    "jobs.ch": (r"(^|\.)jobs\.ch$", "article, li, div[class*='vacancy'], div[class*='card'], div[class*='result']", {"link": "a[href*='/detail/']", "title": "h2, h3, [class*='title']", "company": "[class*='company'], [class*='employer']", "location": "[class*='location'], [class*='place']"}),
    "naukri": (r"(^|\.)naukri\.com$", "article.jobTuple, .cust-job-tuple, .srp-jobtuple-wrapper, [class*='jobTuple']", {"link": "a.title, a[class*='title'], a[href*='/job/'], a[href*='job-listings']", "title": ".title, h2, [class*='desig'], [class*='title']", "company": ".subTitle, .comp-name, [class*='company']", "location": ".locWdth, .loc-wrap, .loc, [class*='location']"}),
    "yelp": (r"(^|\.)yelp\.[a-z.]+$", "div[data-testid='serp-ia-card'], li[class*='businessCard'], div[class*='businessName']", {"link": "a[href*='/biz/']", "company": "[class*='priceCategory'], [class*='categoryStr']", "location": "[class*='secondaryAttributes'], [class*='neighborhood']"}),
    "google-maps": (r"(^|\.)google\.[a-z.]+$", "div[role='article']", {"link": "a[href*='/maps/place/']", "title": "[class*='fontHeadlineSmall']"}),
    "tripadvisor": (r"(^|\.)tripadvisor\.[a-z.]+$", "div[data-automation], div[class*='result']", {"link": "a[href*='_Review-']"}),
    "yellowpages": (r"(^|\.)yellowpages\.[a-z.]+$", "div.result, div[class*='listing']", {"link": "a.business-name, a[href*='/mip/']", "location": ".adr, [class*='address']", "company": ".categories"}),
}
# Selectors of detail pages by hiring system; ``@name`` reads an attribute.
DETAIL_SITES = {
    "greenhouse": (r"greenhouse\.io$", {"title": ".app-title, .posting-headline h2, h1", "company": ".company-name, #company_name", "location": ".location", "department": ".department", "description": "#content, .content, .opening", "apply_url": "a#apply_button@href, a[href*='application']@href"}),
    "lever": (r"lever\.co$", {"title": ".posting-headline h2, h2[data-qa='posting-name']", "company": ".main-header-logo img@alt", "location": ".posting-category.location", "team": ".posting-category.department", "employment_type": ".posting-category.commitment", "remote_type": ".posting-category.workplaceTypes", "description": ".section-wrapper.page-full-width, .content-wrapper", "apply_url": "a[data-qa='btn-apply']@href, a[href*='application']@href"}),
    "ashby": (r"ashbyhq\.com$", {"title": "h1, h2[class*='Heading']", "company": "[class*='OrganizationName'], img[alt]@alt", "location": "[class*='Location']", "employment_type": "[class*='EmploymentType']", "description": "[class*='JobDescription'], main, article", "apply_url": "a[class*='ApplyButton']@href, a[href*='application']@href"}),
    "workday": (r"myworkdayjobs\.com$", {"title": "[data-automation-id='jobPostingHeader'], h2[data-automation-id='jobTitle']", "location": "[data-automation-id='locations']", "posted_date": "[data-automation-id='postedOn']", "description": "[data-automation-id='jobPostingDescription']", "requisition_id": "[data-automation-id='requisitionId']", "apply_url": "a[data-uxi-element-id='Apply']@href"}),
    "personio": (r"jobs\.personio\.(de|com)$", {"title": "h1, [data-test='job-title']", "location": "[data-test='job-location']", "department": "[data-test='job-department']", "employment_type": "[data-test='job-employment-type']", "description": "[data-test='job-description'], main, .content", "apply_url": "a[href*='apply']@href"}),
    "smartrecruiters": (r"smartrecruiters\.com$", {"title": "h1.job-title, h1[data-test='job-title']", "company": ".company-name, [data-test='company-name']", "location": ".job-location, [data-test='location']", "department": "[data-test='department']", "description": ".job-sections, main, article", "apply_url": "a.application-link@href, a[href*='apply']@href"}),
    "linkedin": (r"linkedin\.com$", {"title": ".top-card-layout__title, h1", "company": ".topcard__org-name-link", "location": ".topcard__flavor--bullet", "posted_date": ".posted-time-ago__text, time", "description": ".description__text, .show-more-less-html", "employment_type": ".description__job-criteria-text--criteria", "apply_url": "a.top-card-layout__cta@href"}),
}


@dataclass
class Step:
    """One compound selector and how it is tied to the one before it."""

    tag: str = ""
    near: bool = False  # child instead of descendant
    tests: list[tuple[str, str, str]] = field(default_factory=list)  # attribute, operator, value

    def fits(self, node: Node) -> bool:
        if self.tag and self.tag != "*" and node.tag != self.tag:
            return False
        for name, how, want in self.tests:
            have = node.attrs.get(name)
            if have is None:
                return False
            ok = {"": True, "=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split()}[how]
            if not ok:
                return False
        return True


_PART = re.compile(r"""\s*(>)\s*|(\s+)|(\*|[a-zA-Z][\w-]*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$~]?=)\s*(?:'([^']*)'|"([^"]*)"|([^\]\s]+))\s*(?:i\s*)?)?\]""")


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[list[Step], str], ...]:
    """Alternatives of a selector list, each a chain of steps and an attribute to read (empty: text).

    Tags, ids, classes, attribute tests, descendants and children; what isn't understood makes the alternative match nothing.
    """
    out = []
    for text in re.split(r",(?![^\[]*\])", selector):
        text, _, read = text.strip().partition("@") if "@" in re.sub(r"\[[^\]]*\]", "", text) else (text.strip(), "", "")
        steps, at = [Step()], 0
        while at < len(text):
            m = _PART.match(text, at)
            if not m or m.end() == at:
                steps = []
                break
            at = m.end()
            child, space, tag, ident, name, attr, how, a, b, c = m.groups()
            if child or space:
                steps.append(Step(near=bool(child)))
            elif tag:
                steps[-1].tag = tag.lower()
            elif ident:
                steps[-1].tests.append(("id", "=", ident))
            elif name:
                steps[-1].tests.append(("class", "~=", name))
            else:
                steps[-1].tests.append((attr.lower(), how or "", next((v for v in (a, b, c) if v is not None), "")))
        if steps:
            out.append((steps, read))
    return tuple(out)


def _fits(node: Node, steps: list[Step], root: Node) -> bool:
    if not steps[-1].fits(node):
        return False
    if len(steps) == 1:
        return True
    above = node.parent
    while above is not None and above is not root.parent:
        if _fits(above, steps[:-1], root):
            return True
        if steps[-1].near:
            return False
        above = above.parent
    return False


def select(root: Node, selector: str) -> list[Node]:
    """Elements below ``root`` that fit any alternative, in document order."""
    chains = [steps for steps, _ in compiled(selector)]
    return [n for n in root.walk() if n is not root and any(_fits(n, s, root) for s in chains)]


def pick(root: Node, selector: str) -> str:
    """Value of the first element of the first alternative that has one: the named attribute, ``content``, ``src`` of images, or text."""
    for steps, read in compiled(selector):
        for n in root.walk():
            if n is not root and _fits(n, steps, root):
                value = n.attrs.get(read, "") if read else n.attrs["content"].strip() if "content" in n.attrs else n.attrs["src"].strip() if n.tag == "img" and "src" in n.attrs else n.text()
                if value:
                    return value
    return ""


def _site(table: dict, url: str):
    host = (urlparse(url).hostname or "") if url else ""
    return next((v for v in table.values() if re.search(v[0], host, re.I)), None)


def cards_of(html: str | None, url: str | None, rule: tuple[str, dict[str, str]] | None = None) -> list[dict]:
    """Cards of a page by its site's rule (or a configured one): the first of each URL, with title."""
    if not html:
        return []
    found = rule or ((s[1], s[2]) if (s := _site(CARD_SITES, url or "")) else None)
    if not found:
        return []
    tree, out, seen = Tree(html).root, [], set()
    for card in select(tree, found[0]):
        links = select(card, found[1].get("link") or found[1].get("url") or "a[href]")
        href = next((n.attrs.get("href", "") for n in links if n.attrs.get("href")), "")
        title = pick(card, found[1]["title"]) if found[1].get("title") else ""
        title = title or next((n.text() or n.attrs.get("aria-label", "") for n in links), "")
        address = _absolute(url or "", href) if href and "[[" not in href and "{{" not in href else ""
        if title and address and address not in seen:
            seen.add(address)
            out.append({"title": title, "company": pick(card, found[1]["company"]) if found[1].get("company") else "", "location": pick(card, found[1]["location"]) if found[1].get("location") else "", "url": address, "snippet": card.text()[:240]})
    return out


CARD = pa.list_(pa.struct([(k, pa.string()) for k in ("title", "company", "location", "url", "snippet")]))


def site_cards(pages: DataFrame, rule: tuple[str, dict[str, str]] | None = None) -> DataFrame:
    """``url, position, title, company, location, card_url, snippet`` of all cards of pages (``url, html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([cards_of(h, u, rule) for u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], CARD)], ["url", "cards"])

    rows = pages.select("url", "html").mapInArrow(run, "url string, cards array<struct<title:string,company:string,location:string,url:string,snippet:string>>")
    return rows.select("url", F.posexplode("cards").alias("position", "c")).select("url", "position", "c.title", "c.company", "c.location", F.col("c.url").alias("card_url"), "c.snippet")


def replayed(html: str | None, url: str | None, fields: dict[str, str] | None) -> dict[str, str]:
    """Values of a learned map: ``TEXT:`` entries are patterns over the page's text (their first group), others selectors.

    Values of 5000 characters and more are no values; a broken pattern gives none.
    """
    if not html or not fields:
        return {}
    tree, out, text = Tree(html).root, {}, None
    for name, rule in fields.items():
        if rule.startswith("TEXT:"):
            text = tree.text() if text is None else text
            try:
                m = re.search(rule[5:].strip(), text, re.I)
            except re.error:
                continue
            value = (m.group(1) if m.groups() else m.group(0)) if m else ""
        else:
            value = pick(tree, rule)
            value = _absolute(url or "", value) if name.endswith("_url") and value else value
        if value and len(value) < 5000:
            out[name] = value.strip()
    return out


def selected_fields(pages: DataFrame) -> DataFrame:
    """``url, source_ats, fields`` (a string map) of detail pages of known hiring systems, and of learned maps.

    ``pages`` has ``url, html`` and may have ``field_map``, a learned map by host, which fills what the system's rules leave empty.
    """
    learned = F.col("field_map") if "field_map" in pages.columns else F.lit(None).cast("map<string,string>")
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {id(v): k for k, v in DETAIL_SITES.items()}
        for b in batches:
            systems, values = [], []
            for u, h, own in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                site = _site(DETAIL_SITES, u or "")
                systems.append(names[id(site)] if site else None)
                found = {**replayed(h, u, dict(own or [])), **(replayed(h, u, site[1]) if site else {})}
                values.append(list(found.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(systems, pa.string()), pa.array(values, kind)], ["url", "source_ats", "fields"])

    return pages.select("url", "html", learned.alias("field_map")).mapInArrow(run, "url string, source_ats string, fields map<string,string>")
