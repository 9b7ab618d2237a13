"""Plans, stored pages, selectors and streaming sinks on small inputs."""

import json

from pyspark.sql import functions as F

from gleanery.functions import fixed
from gleanery.operators import joins, library, reports
from gleanery.plans import general, jobs
from gleanery.sources import cache, html, payloads, registry, selectors, structured
from gleanery.streaming import attempts

def now():
    return F.lit("2024-02-02 00:00:00").cast("timestamp")


def test_business_plan_merges_cards_with_details(spark):
    items = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Store", "name": "Uno", "url": "https://b.ch/1"}}, {"item": {"@type": "Store", "name": "Due", "url": "https://b.ch/2"}}]}
    detail = {"@type": "LocalBusiness", "name": "Uno Store", "telephone": "+41 44 111 22 33"}
    pages = spark.createDataFrame(
        [("https://b.ch/", f'<script type="application/ld+json">{json.dumps(items)}</script>'), ("https://b.ch/1", f'<script type="application/ld+json">{json.dumps(detail)}</script>'), ("https://b.ch/none", ""), ("https://b.ch/null", None)],
        "url string, html string",
    )
    parsed = html.parsed(pages)
    made = {r["source_url"]: r for r in general.run(general.cards(parsed), general.details(parsed), now()).collect()}
    assert made["https://b.ch/1"]["name"] == "Uno Store" and made["https://b.ch/1"]["phone"] == "+41 44 111 22 33"
    assert made["https://b.ch/2"]["name"] == "Due" and len(made["https://b.ch/2"]["id"]) == 40


def test_job_pages_of_every_strategy(spark):
    micro = '<div itemtype="https://schema.org/JobPosting"><h2 itemprop="title">Cook</h2><meta itemprop="datePosted" content="2024-01-01"><p itemprop="description">Long text of some words that tells what there is to do.</p></div>'
    cards = '<h1>Baker</h1><div class="fact-card"><div class="fact-card-title">Arbeidssted</div><div class="fact-card-content">Oslo</div></div><div class="fact-card"><p class="fact-card-title">Kaffe</p><p class="fact-card-content">ja</p></div>'
    pages = html.parsed(spark.createDataFrame([("https://a.no/jobs/1", micro), ("https://a.no/jobs/2", cards), ("https://a.no/blog", "<h1>x</h1><p>y</p>")], "url string, html string"))
    got = {r["url"]: r for r in jobs.extract(pages, tech_terms=["python"]).collect()}
    assert set(got) == {"https://a.no/jobs/1", "https://a.no/jobs/2"}
    assert got["https://a.no/jobs/1"]["title"] == "Cook" and got["https://a.no/jobs/1"]["posted_date"] == "2024-01-01"
    assert got["https://a.no/jobs/2"]["location"] == "Oslo" and got["https://a.no/jobs/2"]["extras"] == {"card_kaffe": "ja"}
    assert list(got["https://a.no/jobs/1"].asDict()) == ["url", *fixed.JOB_FIELDS, "extras"]


def test_plain_page_is_no_job(spark):
    pages = html.parsed(spark.createDataFrame([("https://a.com/blog", "<h1>Hello</h1><p>World</p>")], "url string, html string"))
    assert jobs.extract(pages).count() == 0


def test_empty_filters_keep_everything(spark):
    rows = spark.createDataFrame([("a", "b", None, None, None)], "title string, company string, location string, description string, remote_type string")
    assert jobs.matching(rows, registry.Filters()).count() == 1
    assert jobs.matching(rows, registry.Filters(include=["zz"])).count() == 0


def test_broken_feeds_give_nothing(spark):
    bad = spark.createDataFrame([("s", "{"), ("s", None), ("s", "[]"), ("s", "{}"), ("s", "<?xml version='1.0'?><r/>")], "slug string, body string")
    assert all(parse(bad).count() == 0 for parse in payloads.PARSERS.values())


def test_workday_details_join_by_path(spark):
    base = "https://t.wd1.myworkdayjobs.com"
    listing = spark.createDataFrame([(base, json.dumps({"jobPostings": [{"title": "A", "externalPath": "/job/1"}, {"title": "B", "externalPath": "/job/2"}]}))], "slug string, body string")
    details = spark.createDataFrame([(base, "/job/1", json.dumps({"jobPostingInfo": {"jobDescription": "<p>do</p>"}}))], "slug string, path string, body string")
    assert {r["title"]: r["description"] for r in payloads.workday(listing, details).collect()} == {"A": "do", "B": None}


def test_slug_candidates_are_ordered_and_distinct(spark):
    got = spark.range(1).select(payloads.slug_candidates(F.lit("acme")).alias("c")).first()["c"]
    assert got[0] == "acme" and got[1] == "acmeGroup" and len(got) == len(set(got)) and "ACMEInc" in got


def test_stored_pages(spark):
    old = spark.createDataFrame([("u1", "<p>old</p>", "2024-02-01 00:00:00"), ("u2", "<p>stale</p>", "2024-01-01 00:00:00"), ("u3", "captcha", "2024-02-01 23:00:00")], "url string, html string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    new = spark.createDataFrame([("u1", "<p>new</p>", "2024-02-01 12:00:00")], "url string, html string, fetched_at string").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    rows = cache.stored(old, new)
    assert {r["url"]: r["html"] for r in rows.collect()}["u1"] == "<p>new</p>"
    assert [r["url"] for r in cache.readable(rows, now(), 86_400).collect()] == ["u1"]
    assert {r["url"] for r in cache.stored(old, new, now(), 86_400).collect()} == {"u1", "u3"}


def test_selectors():
    tree = html.Tree('<div id="a" class="x y"><p><b data-k="v1">one</b></p><b>two</b></div><b>three</b>').root
    found = lambda s: [n.text() for n in selectors.select(tree, s)]
    assert found("b") == ["one", "two", "three"] and found("div b") == ["one", "two"] and found("div > b") == ["two"]
    assert found("#a.x p [data-k^='v']") == ["one"] and found("[data-k*=1], .nope") == ["one"] and found("b:hover") == []
    assert selectors.pick(tree, ".none, b@data-k, p") == "v1"


def test_adverts_and_paging(spark):
    rows = spark.createDataFrame([(['{"advertId": "1", "title": "<b>Chef</b>", "company": "Inn"}', "{"],)], "a array<string>")
    cards = rows.select(structured.advert_cards(F.col("a")).alias("c")).first()["c"]
    assert [(c["id"], c["title"], c["company"]) for c in cards] == [("1", "Chef", "Inn")]
    assert html.parse("<button>Load more</button>", "")["paging"] == "more"


def test_salvage_keeps_all_sides(spark):
    a, b = spark.createDataFrame([("u/", "x"), ("v", "long")], "u string, t string"), spark.createDataFrame([("u", "xyz"), ("w", "new")], "u string, t string")
    got = {r["key"]: (r["t"], r["origin"]) for r in joins.salvage(a, b, joins.url_key(F.col("u")), joins.url_key(F.col("u")), ["t"]).collect()}
    assert got == {"u": ("xyz", "both"), "v": ("long", "stub"), "w": ("new", "page")}


def test_exported_falls_back_to_all(spark):
    rows = spark.range(3)
    assert library.exported(rows, rows.where("id > 5")).count() == 3 and library.exported(rows, rows.where("id > 1")).count() == 1


def test_run_status(spark):
    rows = spark.createDataFrame([(0, 0, 4), (2, 1, 4), (4, 0, 4), (4, 3, 4), (0, 0, 0)], "done long, ok long, total long")
    assert [(r["status"], r["progress"]) for r in attempts.run_status(rows).collect()] == [("queued", 0.0), ("running", 50.0), ("failed", 100.0), ("done", 100.0), ("queued", 0.0)]


def test_upsert_batches_keep_the_last_row(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "k long, o long, v string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for more in ([], [(1, 5, "new"), (1, 3, "older")]):
        if more:
            spark.createDataFrame(more, "k long, o long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k long, o long, v string").parquet(str(tmp_path / "in"))
        attempts.upsert_batches(stream, str(tmp_path / "out"), "k", "o", str(tmp_path / "ck")).awaitTermination()
    assert {r["k"]: r["v"] for r in spark.read.parquet(str(tmp_path / "out")).drop("part").collect()} == {1: "new", 2: "b"}


def test_stage_counts_of_nothing(spark):
    r = reports.stage_counts(spark.createDataFrame([], "a int"), {"total": F.lit(True), "big": F.col("a") > 1}).first()
    assert (r["total"], r["big"]) == (0, 0)
