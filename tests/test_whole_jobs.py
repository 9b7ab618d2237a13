"""Queries that cover the whole job where an older query of the same operator reads a part of it; against brute force."""

from pyspark.sql import functions as F

import gleanery.queries as registered
from gleanery.functions import text
from gleanery.sources import html


def brute_uniq(values):
    seen = {}
    for v in (v.strip(" ") for v in values if v is not None):
        if v:
            seen.setdefault(v.lower(), v)
    return list(seen.values())


def test_ordered_uniq_keeps_first_spelling_and_order(spark):
    lists = [["b", "A", " B", "a ", "", None, "c", "C"], [], [None, ""], None, ["x"] * 5, ["Ä", "ä", "z", "Z", "y"]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "i int, v array<string>")
    for r in rows.select("v", text.ordered_uniq(F.col("v")).alias("u")).collect():
        assert r["u"] == (None if r["v"] is None else brute_uniq(r["v"]))


def test_ordered_uniq_of_many_words(spark):
    words = [f"{'W' if i % 2 else 'w'}{i * 7919 % 60_000}" for i in range(120_000)]
    got = spark.createDataFrame([(words,)], "v array<string>").select(text.ordered_uniq(F.col("v")).alias("u")).first()["u"]
    assert len(got) == 60_000 and got == brute_uniq(words)


def test_terms_come_from_the_whole_text(spark, data):
    want = {r["doc_id"]: set(filter(None, r["text"].lower().split(" "))) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {r["doc_id"]: r["terms"] for r in registered.QUERIES["ordered_uniq_whole_terms"](spark, data).collect()}
    assert got == {k: ",".join(sorted(v, key=str.encode)) for k, v in want.items()}
    assert sum(map(len, want.values())) > 5 * sum(len(t.split(",")) for t in (r["terms"] for r in registered.QUERIES["ordered_uniq_terms"](spark, data).collect()))


def test_reach_uses_every_edge(spark, data):
    """Breadth-first search in Python over all part-supplier pairs, four steps from s1."""
    near = {}
    for r in spark.read.parquet(f"{data}/lineitem.parquet").select("l_partkey", "l_suppkey").distinct().collect():
        near.setdefault(f"p{r[0]}", set()).add(f"s{r[1]}")
        near.setdefault(f"s{r[1]}", set()).add(f"p{r[0]}")
    want, front = {"s1": 0}, {"s1"}
    for depth in range(1, 5):
        front = {n for f in front for n in near[f]} - want.keys()
        want |= dict.fromkeys(front, depth)
    got = [(r["node"], r["depth"]) for r in registered.QUERIES["bfs_whole_reachability"](spark, data).collect()]
    assert len(got) == len(dict(got)) and dict(got) == want
    assert len(got) > registered.QUERIES["bfs_reachability"](spark, data).count()


FILLER = " words of a page" * 10
ADVERTS = [
    (0, "https://x.example.com/fr/1", f"<title>a</title><p>Plain{FILLER}", 0.0, False),
    (1, "https://x.example.com/jobs/1", f"<title>a</title><p>Plain{FILLER}", 0.3, False),
    (2, "https://x.example.com/fr/2", f"<title>Cook</title><h1>Cook</h1><p>Apply now. Responsibilities, qualifications, requirements.{FILLER}", 0.32, False),
    (3, "https://x.example.com/fr/3", f"""<title>Cook</title><script type="application/ld+json">{{"@type": "JobPosting", "title": "Cook"}}</script><p>Text{FILLER}""", 1.0, True),
    (4, "https://x.example.com/fr/4", f"""<div itemscope itemtype="https://schema.org/JobPosting"><h1 itemprop="title">Cook</h1>{FILLER}</div>""", 0.9, True),
    (5, "https://x.example.com/jobs/2", f"""<h1>Cook</h1><iframe src="https://boards.greenhouse.io/embed/acme"></iframe><p>Text{FILLER}""", 0.6, True),
    (6, "https://x.example.com/fr/5", "", 0.0, False),
    (7, "https://x.example.com/fr/6", None, 0.0, False),
]


def test_detection_and_job_pages_read_the_page(spark, tmp_path):
    spark.createDataFrame([a[:3] for a in ADVERTS], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: (r["confidence"], r["is_job"]) for r in registered.QUERIES["page_detection"](spark, str(tmp_path)).collect()}
    assert got == {a[0]: a[3:] for a in ADVERTS}
    # By path: 1 and 5; by signals: 2; by JSON-LD: 3. Titles and headings don't leave a record out.
    one = registered.QUERIES["job_pages"](spark, str(tmp_path)).first()
    assert (one["pages"], one["postings"]) == (8, 4)


def test_condensed_markup_is_whole(spark, data, tmp_path):
    import re

    bare = "<p>" + "word " * 200 + "</p><b>end</b>"
    page = "<svg><path/></svg><noscript>n</noscript>" + bare + "<IFRAME src='x'>i</IFRAME ><style>s</style>\n\n<script>if (a < b) {}</script>"
    spark.createDataFrame([(1, page), (2, ""), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["markup"] for r in registered.QUERIES["condensed_whole_html"](spark, str(tmp_path)).collect()}
    assert got == {1: bare, 2: "", 3: ""}
    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    got = {r["page_id"]: r["markup"] for r in registered.QUERIES["condensed_whole_html"](spark, data).collect()}
    assert got == {k: " ".join(re.sub(r"(?is)<(script|style|noscript|iframe|svg)\b.*?</\1\s*>", "", v).split()) for k, v in raw.items()}
    assert min(map(len, got.values())) > 400


def brute_score(links, lengths):
    links, lengths = links[:10], lengths[:10]
    n, mean = len(lengths), sum(lengths) / len(lengths)
    spread = (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5 / mean if mean else None
    even = 0.0 if spread is None else 0.2 if spread < 0.5 else 0.1 if spread < 1 else 0.0
    return min(1.0, sum(links) / n * 0.3 + even + (0.15 if 20 < mean < 500 else 0.0))


def test_groups_of_every_shape(spark, data, tmp_path):
    cards = "<div>" + "".join(f"<div><h3>Card {i}</h3><p>Some words about number {i}.</p></div>" for i in range(4)) + "</div>"
    table = "<table><tbody>" + "".join(f"<tr><td>Some cell of row {i}</td><td>and one more</td></tr>" for i in range(12)) + "</tbody></table>"
    lists = "".join("<ul>" + "".join(f"<li><a href='/{k}{i}'>Link {i}</a></li>" for i in range(3)) + "</ul>" for k in "ab")
    pages = [(1, "u", cards), (2, "u", table), (3, "u", lists), (4, "u", "<div><p>a</p><p>b</p></div>"), (5, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["page_id"], r["shape"], r["members"]) for r in registered.QUERIES["repeated_groups_whole"](spark, str(tmp_path)).collect())
    assert got == [(1, "div|h3,p|0", 4), (2, "tr|td,td|0", 12), (3, "li|a|1", 3), (3, "li|a|1", 3)]

    want = {}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        for at, g in enumerate(html.parse(r["html"], r["url"])["groups"]):
            if (score := brute_score(g["links"], g["lengths"])) > 0.3:
                want[r["page_id"], at] = (g["shape"], len(g["lengths"]), round(score, 9))
    rows = registered.QUERIES["repeated_groups_whole"](spark, data).collect()
    assert {(r["page_id"], r["position"]): (r["shape"], r["members"], round(r["score"], 9)) for r in rows} == want and len(rows) == len(want)
    assert len({s for s, _, _ in want.values()}) > 1
