"""Registered queries over pages and over literal payloads whose results are known."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .functions import contact, fixed, salary, scoring, text
from .operators import ordered
from .plans import general, jobs
from .queries import _values, query, table
from .sources import html, payloads, registry, selectors, sinks, structured

# Pages of the fixtures ----------------------------------------------------------------------------------------------------


def _parsed(spark, sf):
    return html.parsed(table(spark, sf, "pages"))


_TEXT = "trim(regexp_replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&amp;', '&'), '\\s+', ' ', 'g'))"
_UNQUOTED = "replace(replace({}, '&amp;', '&'), '&quot;', '\"')"


@query(
    f"SELECT page_id, {_UNQUOTED.format(chr(34) + 't' + chr(34))} AS title, {_UNQUOTED.format(chr(34) + 'h' + chr(34))} AS h1, lang FROM (SELECT page_id, "
    "trim(regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS h, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang FROM pages)"
)
def page_title_h1(spark, sf):
    return _parsed(spark, sf).select("page_id", "page.title", "page.h1", "page.lang")


@query("SELECT page_id, i - 1 AS position, hrefs[i] AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS hrefs FROM pages), generate_series(1, 40) g(i) WHERE i <= len(hrefs)")
def page_anchors(spark, sf):
    return _parsed(spark, sf).select("page_id", F.posexplode("page.anchors").alias("position", "a")).select("page_id", F.col("position").cast("long").alias("position"), "a.href")


@query()
def page_text(spark, sf):
    return _parsed(spark, sf).select("page_id", "page.text", "page.main_text")


@query("SELECT page_id, len(string_split(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<li>')) - 1 AS members FROM pages WHERE len(string_split(regexp_extract(html, '(?s)<ul>(.*?)</ul>', 1), '<li>')) > 3")
def repeated_groups(spark, sf):
    groups = _parsed(spark, sf).select("page_id", F.explode("page.groups").alias("g")).where(F.col("g.shape") == "li|a|1")
    score = ordered.group_score("links", "lengths")
    return groups.select("page_id", "g.links", "g.lengths").where(score > 0.3).select("page_id", F.size("links").cast("long").alias("members"))


@query()
def repeated_groups_whole(spark, sf):
    groups = _parsed(spark, sf).select("page_id", F.posexplode("page.groups").alias("position", "g"))
    groups = groups.select("page_id", "position", "g.shape", "g.links", "g.lengths").withColumn("score", ordered.group_score("links", "lengths"))
    return groups.where(F.col("score") > 0.3).select("page_id", "position", "shape", F.size("links").cast("long").alias("members"), "score")


@query(
    "WITH t AS (SELECT page_id, lower(html) AS h, url FROM pages) SELECT page_id, "
    + " + ".join(f"contains(h, '{s}')::INT" for s in ("the", "thtion", "von", "heand"))
    + " AS signals FROM t"
)
def signal_score(spark, sf):
    return table(spark, sf, "pages").select("page_id", scoring.count_hits(F.lower("html"), ("the", "thtion", "von", "heand")).alias("signals"))


@query("SELECT page_id, 0.0::DOUBLE AS confidence, false AS is_job FROM pages")
def page_detection(spark, sf):
    found = jobs.detected(html.parsed(table(spark, sf, "pages"), keep_html=True))
    return found.select("page_id", "seen.confidence", "seen.is_job")


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '\s+', ' ', 'g'))[:400] AS head FROM pages")
def condensed_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.left(text.condensed(F.col("html"), 1 << 30), F.lit(400)).alias("head"))


_BARE = "html"
for _tag in ("script", "style", "noscript", "iframe", "svg"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}\b.*?</{_tag}\s*>', '', 'g')"


@query(rf"SELECT page_id, trim(regexp_replace(coalesce({_BARE}, ''), '\s+', ' ', 'g')) AS markup FROM pages")
def condensed_whole_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.condensed(F.col("html")).alias("markup"))


@query("SELECT count(*) AS pages, 0 AS postings FROM pages")
def job_pages(spark, sf):
    """No fixture page is a job page: the plan must find none."""
    p = _parsed(spark, sf)
    found = jobs.extract(p)
    return p.agg(F.count(F.lit(1)).alias("pages")).crossJoin(found.agg(F.count(F.lit(1)).cast("int").alias("postings")))


# Running text -------------------------------------------------------------------------------------------------------------

_PAY = [
    ("CHF 80'000 - 110'000 / Jahr", "80000", "110000", "CHF", "hour"), ("Pay: $120,000 - $150,000 per year", "120000", "150000", "USD", "year"), ("EUR 60.000 – 75.000 pro Monat", "60000", "75000", "EUR", "year"),
    ("£25 per hour", "25", None, "GBP", "hour"), ("no pay given", None, None, None, None),
]


@query(_values(_PAY, "pay, low, high, currency, period"))
def salary_parse(spark, sf):
    rows = spark.createDataFrame([(p[0],) for p in _PAY], "pay string")
    return rows.select("pay", salary.salary(F.col("pay")).alias("s")).select("pay", "s.low", "s.high", "s.currency", "s.period")


_LINES = [
    ("Senior engineer, fully remote, 5+ years of experience", "senior", "remote", None, None, "5"), ("Principal staff role on-site with equity", "principal", "onsite", "yes", None, None),
    ("Junior, hybrid, visa sponsorship, Bachelor of Science", "junior", "hybrid", None, "Bachelor of Science", None), ("Praktikum vor Ort, mind. 3 Jahre", "intern", "onsite", None, None, "3"), ("plain words", None, None, None, None, None),
]


@query(_values(_LINES, "line, level, place, equity, education, years"))
def text_heuristics(spark, sf):
    rows, line = spark.createDataFrame([(x[0],) for x in _LINES], "line string"), F.col("line")
    return rows.select("line", text.seniority(line).alias("level"), text.workplace(line).alias("place"), text.flag(line, "equity").alias("equity"), text.education(line).alias("education"), text.experience_years(line).alias("years"))


_CONTACTS = [
    ("Kontakt: Anna Müller, HR Manager, +41 44 215 15 78, anna@firma.ch", "Anna Müller", "HR", "+41 44 215 15", "anna@firma.ch"), ("Frau Eva Stein hilft", "Eva Stein", None, None, None), ("Dr. Max Huber", "Dr. Max Huber", None, None, None), ("nothing", None, None, None, None),
]


@query(_values([(c[0], c[1], c[4]) for c in _CONTACTS], "block, name, email"))
def contact_blocks(spark, sf):
    rows = spark.createDataFrame([(c[0],) for c in _CONTACTS], "block string")
    return rows.select("block", contact.contact_block(F.col("block")).alias("c")).select("block", "c.name", "c.email")


_TITLES = [("Data Engineer | FINN.no", "Data Engineer"), ("The Hub | Chef - Oslo", "Chef - Oslo"), ("Plain  title", "Plain title")]


@query(_values(_TITLES, "raw, title"))
def title_cleaning(spark, sf):
    return spark.createDataFrame([(t[0],) for t in _TITLES], "raw string").select("raw", text.clean_title(F.col("raw")).alias("title"))


_TERMS = ["python", "java", "c++", "go", ".net", "spark"]


@query("SELECT 'c++, Java; spark.' AS line, 'java,c++,spark' AS hits UNION ALL SELECT 'javascript going', ''")
def dictionary_terms(spark, sf):
    rows = spark.createDataFrame([("c++, Java; spark.",), ("javascript going",)], "line string")
    return rows.select("line", F.array_join(text.dictionary_hits(F.lower("line"), _TERMS), ",").alias("hits"))


_PLACES = [("Storgata 1, 0155 Oslo", "0155", "Oslo"), ("Bergen sentrum, Bergen", None, "Bergen")]


@query(_values(_PLACES, "place, postal_code, city"))
def postal_city(spark, sf):
    return spark.createDataFrame([(p[0],) for p in _PLACES], "place string").select("place", text.postal_city(F.col("place")).alias("p")).select("place", "p.postal_code", "p.city")


# Payloads -----------------------------------------------------------------------------------------------------------------

_BODIES = {
    "greenhouse": ("acme", {"jobs": [{"title": "A", "absolute_url": "https://x.io/1?utm_source=q", "updated_at": "2024-01-02", "content": "<p>Do &amp; be</p>", "location": {"name": ""}, "offices": [{"name": "Oslo"}, {"name": "Bern"}]}]}),
    "lever": ("acme", [{"text": "B", "description": "<div>d</div>", "lists": [{"text": "T", "content": "<li>c</li>"}], "additional": "more", "hostedUrl": "https://l.co/2/", "applyUrl": "https://l.co/2/apply", "workplaceType": "Remote", "createdAt": 1700000000000, "categories": {"location": "X", "commitment": "Full"}, "allLocations": ["Rome", "Pisa"]}]),
    "ashby": ("acme", {"jobs": [{"title": "C", "descriptionPlain": "plain", "location": "Ulm", "secondaryLocations": [{"location": "Bonn"}], "workplaceType": "Hybrid", "employmentType": "FullTime", "publishedAt": "2024-03-01", "jobUrl": "https://a.com/3"}]}),
    "workday": ("https://ten.wd3.myworkdayjobs.com", {"total": 1, "jobPostings": [{"title": "D", "externalPath": "/job/4", "locationsText": "Graz", "postedOn": "Today"}]}),
    "recruitee": ("acme", {"offers": [{"title": "E", "description": "<b>e</b>", "remote": True, "locations": [{"city": "Kiel", "country": "DE"}, {"city": "Lyon"}], "careers_url": "https://r.com/5", "created_at": "2024-05-05"}]}),
    "workable": ("acme", {"results": [{"shortcode": "S6", "title": "F", "location": {"city": "Bari", "country": "IT"}, "remote": False, "employment_type": "part", "published_on": "2024-06-06"}]}),
    "smartrecruiters": ("Acme", {"content": [{"id": "7", "name": "G", "company": {"name": ""}, "location": {"city": "Nice", "region": "PACA"}, "typeOfEmployment": {"label": "Perm"}, "releasedDate": "2024-07-07", "jobAd": {"sections": {"jobDescription": {"text": "<p>g1</p>"}, "qualifications": {"text": "g2"}}}}]}),
    "arbeitsagentur": ("q", {"stellenangebote": [{"refnr": "8", "beruf": "H", "arbeitgeber": "Amt", "arbeitsort": {"ort": "Jena", "land": "DE"}}, {"refnr": "8", "beruf": "again"}]}),
    "jobs.ch": ("q", {"documents": [{"job_id": "9", "title": "I", "company_name": "Co", "place": "Chur", "preview": "p", "publication_date": "2024-09-09", "employment_grades": [80, 60, 100], "_links": {"detail_de": {"href": "https://www.jobs.ch/de/9/"}}}, {"job_id": "10", "title": "no link"}]}),
}
_XML = "<?xml version='1.0'?><r><position><id>11</id><name>J</name><office>Remote Berlin</office><schedule>full</schedule><department>Dev</department><jobDescriptions><jobDescription><name>Role</name><value>&lt;p&gt;code&lt;/p&gt;</value></jobDescription></jobDescriptions></position></r>"
_EXPECTED = [
    ("greenhouse", "A", "acme", "Oslo, Bern", None, None, "2024-01-02", "Do & be", "https://x.io/1", "https://x.io/1"),
    ("lever", "B", "acme", "Rome, Pisa", "remote", "Full", "2023-11-14T22:13:20Z", "d T c more", "https://l.co/2/apply", "https://l.co/2"),
    ("ashby", "C", "acme", "Ulm, Bonn", None, "FullTime", "2024-03-01", "plain", "https://a.com/3", "https://a.com/3"),
    ("workday", "D", "ten", "Graz", None, None, "Today", None, "https://ten.wd3.myworkdayjobs.com/job/4", "https://ten.wd3.myworkdayjobs.com/job/4"),
    ("recruitee", "E", "acme", "Kiel, DE; Lyon", "remote", None, "2024-05-05", "e", "https://r.com/5", "https://r.com/5"),
    ("workable", "F", "acme", "Bari, IT", None, "part", "2024-06-06", None, "https://apply.workable.com/acme/j/S6", "https://apply.workable.com/acme/j/S6"),
    ("smartrecruiters", "G", "Acme", "Nice, PACA", None, "Perm", "2024-07-07", "g1 g2", "https://jobs.smartrecruiters.com/Acme/7", "https://jobs.smartrecruiters.com/Acme/7"),
    ("arbeitsagentur", "H", "Amt", "Jena, DE", None, None, None, None, "https://www.arbeitsagentur.de/jobsuche/jobdetail/8", "https://www.arbeitsagentur.de/jobsuche/jobdetail/8"),
    ("jobs.ch", "I", "Co", "Chur", None, "60–100%", "2024-09-09", "p", "https://www.jobs.ch/de/9", "https://www.jobs.ch/de/9"),
    ("personio", "J", "firm", "Remote Berlin", "remote", "full", None, "Role: code Dev", "https://firm.jobs.personio.de/job/11", "https://firm.jobs.personio.de/job/11"),
]


@query(_values(_EXPECTED, "adapter, title, company, location, remote_type, employment_type, posted_date, description, apply_url, job_url"))
def feed_listings(spark, sf):
    rows = [(k, slug, json.dumps(body), "t", 0) for k, (slug, body) in _BODIES.items()] + [("personio", "https://firm.jobs.personio.de/", _XML, "t", 0), ("lever", "broken", "{", "t", 1)]
    made = registry.stubs(spark.createDataFrame(rows, "adapter string, slug string, body string, target string, target_position int"))
    return made.select("adapter", "title", "company", "location", "remote_type", "employment_type", "posted_date", "description", "apply_url", "job_url")


@query("SELECT * FROM (VALUES (1, '12', 'https://www.finn.no/job/ad/12'), (1, '34', 'https://www.finn.no/job/ad/34'), (2, '56', 'https://www.finn.no/job/ad/56')) t(page, id, job_url)")
def listing_links(spark, sf):
    rows = [("r", 1, '<a href="/job/ad/12">x</a><a href="/job/ad/34"><a href="/job/ad/12">'), ("r", 2, '<a href="/job/ad/34"><a href="/job/ad/56">')]
    return payloads.listing_ids(spark.createDataFrame(rows, "run string, page int, html string"), "finn.no").select("page", "id", "job_url")


@query("SELECT * FROM (VALUES ('https://a.com/jobs/1', false), ('https://a.com/x', false), ('https://a.com/s2.xml', true)) t(loc, is_index)")
def sitemap_scan(spark, sf):
    rows = [("a", "<urlset><url><loc>https://a.com/jobs/1</loc></url><url><loc> https://a.com/x </loc></url></urlset>"), ("a", "<sitemapindex><sitemap><loc>https://a.com/s2.xml</loc></sitemap></sitemapindex>")]
    return payloads.sitemap_urls(spark.createDataFrame(rows, "site string, body string")).select("loc", "is_index")


_LD = {
    "@type": ["JobPosting"], "title": "Data Engineer", "description": "<p>Build &amp; run things for quite a while, in a team that is nice.</p>", "datePosted": "2024-02-01", "validThrough": "2024-03-01", "employmentType": ["FULL_TIME", "CONTRACTOR"],
    "hiringOrganization": {"name": "Acme", "logo": {"url": "https://acme.io/l.png"}, "sameAs": "https://acme.io"}, "jobLocation": [{"address": {"addressLocality": "Bern", "addressCountry": {"name": "CH"}, "postalCode": "3000"}}, {"address": {"addressLocality": "Basel"}}],
    "baseSalary": {"currency": "CHF", "value": {"minValue": 90000, "maxValue": 110000, "unitText": "YEAR"}}, "experienceRequirements": {"monthsOfExperience": 30}, "identifier": {"value": "J-1"}, "url": "https://acme.io/jobs/1",
}
_JOB_HTML = f"""<html lang="en"><head><title>Data Engineer - Acme</title><meta property="og:title" content="OG title"><script type="application/ld+json">{json.dumps({"@graph": [_LD, {"@type": "WebSite"}]})[:-2]},]}}</script></head>
<body><h1>Data Engineer</h1><dl><dt>Sektor<dd>Privat<dt>Kaffee<dd>ja</dl><h2>Requirements</h2><ul><li>Five years of pipelines</li><li>Good tests</li></ul>
<aside>Talent Partner <b>Anna Kern</b> <a href="https://www.linkedin.com/in/anna-kern">in</a></aside><p>Senior role, hybrid, equity. Mail jobs@acme.io</p><a href="https://acme.recruitee.com/o/1">Apply now</a></body></html>"""
_JOB_FIELDS = ["title", "company", "location", "city", "country", "postal_code", "employment_type", "salary_min", "salary_max", "salary_period", "posted_date", "experience_years", "external_id", "job_url", "apply_url", "company_industry", "seniority", "remote_type", "equity", "recruiter_email", "requirements", "source_domain", "confidence"]


@query(
    _values(
        [("Data Engineer", "Acme", "Bern, CH, 3000 | Basel", "Bern", "CH", "3000", "FULL_TIME, CONTRACTOR", "90000", "110000", "YEAR", "2024-02-01", "2", "J-1", "https://acme.io/jobs/1", "https://acme.recruitee.com/o/1", "Privat", "senior", "hybrid", "yes", "jobs@acme.io", "Five years of pipelines • Good tests", "acme.io", "1.0")],
        ", ".join(_JOB_FIELDS),
    )
)
def jsonld_job(spark, sf):
    pages = html.parsed(spark.createDataFrame([("https://acme.io/jobs/1?utm_source=x", _JOB_HTML)], "url string, html string"))
    return jobs.extract(pages).select(*_JOB_FIELDS)


_BIZ = {
    "@type": "Restaurant", "name": "Pizza Uno", "telephone": "+41 44 111 22 33", "address": {"streetAddress": "Weg 1", "addressLocality": "Zug", "postalCode": "6300", "addressCountry": "CH"}, "geo": {"latitude": 47.1, "longitude": 8.5},
    "aggregateRating": {"ratingValue": 4.5, "reviewCount": 12}, "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "Tuesday"], "opens": "10:00", "closes": "22:00"}], "sameAs": ["https://f.com/u", "https://i.com/u"], "servesCuisine": ["Italian", "Pizza"],
}


@query(
    _values([("Pizza Uno", "Restaurant", "Italian, Pizza", "Weg 1, Zug, 6300, CH", "47.1", "+41 44 111 22 33", "4.5", "12", "Monday/Tuesday: 10:00-22:00", "https://f.com/u, https://i.com/u", "biz.ch")], "name, category, subcategories, address, latitude, phone, rating, review_count, hours, social_links, source_domain")
)
def business_record(spark, sf):
    page = f'<html><script type="application/ld+json">{json.dumps(_BIZ)}</script><h1>x</h1></html>'
    pages = html.parsed(spark.createDataFrame([("https://biz.ch/1", page)], "url string, html string"))
    return general.details(pages).select("name", "category", "subcategories", "address", "latitude", "phone", "rating", "review_count", "hours", "social_links", "source_domain")


@query("SELECT * FROM (VALUES (0, 'Uno', 'https://b.ch/1'), (1, 'Due', 'https://b.ch/2')) t(position, name, source_url)")
def business_cards(spark, sf):
    items = {"@type": "ItemList", "itemListElement": [{"item": {"@type": "Store", "name": "Uno", "url": "https://b.ch/1"}}, {"item": {"@type": "Store", "name": "Due", "url": "https://b.ch/2"}}, {"item": {"@type": "Thing", "name": "no"}}, {"item": {"@type": "Store", "name": "Uno again", "url": "https://b.ch/1"}}]}
    page = f'<html><script type="application/ld+json">{json.dumps(items)}</script></html>'
    return general.cards(html.parsed(spark.createDataFrame([("https://b.ch/", page)], "url string, html string"))).select("position", "name", "source_url")


@query("""SELECT 'Dev' AS title, 'Acme' AS company, '0150' AS postal_code, '{"title":"a \\"}\\" b","n":{"k":1}}' AS sliced""")
def application_payload(spark, sf):
    entry = json.dumps({"props": {"pageProps": {"jobEntry": {"title": "Dev", "company": {"name": "Acme"}, "locations": [{"zipCode": "0150"}]}}}})
    rows = spark.createDataFrame([(entry, 'x "adData":{"title":"a \\"}\\" b","n":{"k":1}} rest }')], "payload string, stream string")
    fields = structured.next_entry(F.col("payload"))
    return rows.select(fields["title"].alias("title"), fields["company"].alias("company"), fields["postal_code"].alias("postal_code"), structured.balanced(F.col("stream"), "adData").alias("sliced"))


@query("SELECT 1 AS found, 'jobposting' AS kind UNION ALL SELECT 2, 'store' UNION ALL SELECT 3, 'a' UNION ALL SELECT 3, 'b'")
def jsonld_variants(spark, sf):
    rows = spark.createDataFrame([(1, ['{"script:ld+json": {"@type": "JobPosting"}}']), (2, ['[{"@type": "Store",}]', "not json"]), (3, ['{"@graph": [{"@type": "a"}, {"@type": ["b"]}]}'])], "found int, scripts array<string>")
    return structured.blocks(rows, F.col("scripts")).select("found", F.get(structured.types(F.col("item")), F.lit(0)).alias("kind"))


@query("SELECT * FROM (VALUES ('https://a.com/jobs/1', 'Long title', 'remote', 'python'), ('https://a.com/jobs/2', 'Other python', NULL, 'python')) t(job_url, title, remote_type, keywords)")
def job_plan(spark, sf):
    """Stubs, one detail page, a keyword and a location filter, a duplicate under a tracking parameter."""
    stub = "target_position int, position int, title string, company string, location string, remote_type string, description string, apply_url string, job_url string, saved_at string, source string"
    stubs = spark.createDataFrame(
        [
            (0, 0, "Long", "Acme", "Oslo", None, None, "https://a.com/jobs/1", "https://a.com/jobs/1", None, "s"), (0, 1, "Other python", "Acme", "Oslo", None, None, "https://a.com/jobs/2", "https://a.com/jobs/2", None, "s"),
            (1, 0, "Other python", "Acme", "Oslo", None, None, "https://a.com/jobs/2?utm_source=q", "https://a.com/jobs/2?utm_source=q", None, "s"), (1, 1, "Cook", "Acme", "Oslo", None, None, None, "https://a.com/jobs/3", None, "s"),
            (1, 2, "Far python", "Acme", "Rome", None, None, None, "https://a.com/jobs/4", None, "s"),
        ],
        stub,
    )
    detail = spark.createDataFrame([("https://a.com/jobs/1/", "Long title", "remote", "python work")], "url string, title string, remote_type string, description string")
    detail = detail.select("url", *[F.col(f) if f in detail.columns else F.lit(None).cast("string").alias(f) for f in fixed.JOB_FIELDS])
    made = jobs.run(stubs, detail, registry.Filters(include=["Python"], locations=["oslo"]), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return made.select("job_url", "title", "remote_type", F.lower(F.array_join("keywords_matched", ",")).alias("keywords"))


_LIST = """<ul><li class="result-1"><a href="/joboffer/1"><h3>Cook</h3></a><span class="x company">Inn</span><i class="location">Bern</i></li>
<li class="result-2"><a href="/joboffer/2"><h3>Baker</h3></a></li><li class="result-3"><a href="/joboffer/2">again</a></li><li class="result-4">no link</li></ul>"""


@query("SELECT * FROM (VALUES (0, 'Cook', 'Inn', 'Bern', 'https://ch.jobrapido.com/joboffer/1'), (1, 'Baker', '', '', 'https://ch.jobrapido.com/joboffer/2')) t(position, title, company, location, card_url)")
def site_cards(spark, sf):
    pages = spark.createDataFrame([("https://ch.jobrapido.com/q", _LIST), ("https://unknown.org/", _LIST)], "url string, html string")
    return selectors.site_cards(pages).select("position", "title", "company", "location", "card_url")


@query("SELECT * FROM (VALUES ('greenhouse', 'Chef', 'Oslo', 'https://boards.greenhouse.io/apply', '12'), (NULL, 'Head', NULL, NULL, '12')) t(source_ats, title, location, apply_url, reference)")
def learned_selectors(spark, sf):
    """Rules of a known hiring system first; a learned map fills the rest, by selector and by pattern."""
    page = '<div class="app-title">Chef</div><p class="location">Oslo</p><a id="apply_button" href="/apply">go</a><h1>Head</h1><p>Ref: 12</p>'
    pages = spark.createDataFrame([("https://boards.greenhouse.io/a", page, {"reference": r"TEXT:Ref:\s*(\d+)", "title": "h1"}), ("https://x.org/a", page, {"reference": r"TEXT:Ref:\s*(\d+)", "title": "h1"})], "url string, html string, field_map map<string,string>")
    got = selectors.selected_fields(pages)
    return got.select("source_ats", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("title", "location", "apply_url", "reference")])


@query("SELECT s_suppkey, '{\"Name\":{\"title\":[{\"text\":{\"content\":\"' || s_name || '\"}}]},\"Link\":{\"url\":\"u' || s_suppkey || '\"},\"Note\":{\"rich_text\":[{\"text\":{\"content\":\"' || s_nationkey || '\"}}]}}' AS properties FROM supplier")
def page_properties(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("title"), F.concat(F.lit("u"), "s_suppkey").alias("job_url"), F.col("s_nationkey").alias("note"))
    return s.select("s_suppkey", sinks.properties({"title": "Name", "job_url": "Link", "note": "Note"}).alias("properties"))


_NAMES = [("Kari Nordmann Seksjonssjef +47 11 22 33 44", "Kari Nordmann", "Seksjonssjef"), ("Ola Hansen prosjektleder for data", "Ola Hansen", "prosjektleder for data"), ("no name here", None, None)]


@query(_values(_NAMES, "line, name, role"))
def name_and_role(spark, sf):
    rows = spark.createDataFrame([(n[0],) for n in _NAMES], "line string")
    return rows.select("line", contact.name_role(F.col("line")).alias("x")).select("line", "x.name", "x.role")


@query("SELECT 'Kontakt: Frist 1.2.2025, Yrke: Kokk' AS line, '1.2.2025' AS deadline, 'Kokk' AS trade, 'Kontakt: Frist' AS around")
def labelled_values(spark, sf):
    rows, line = spark.createDataFrame([("Kontakt: Frist 1.2.2025, Yrke: Kokk",)], "line string"), F.col("line")
    return rows.select(
        "line",
        text.labelled_value(line, "Frist", r"(\d{1,2}\.\d{1,2}\.\d{2,4})").alias("deadline"),
        text.labelled_value(line, "Yrke", r"([A-ZÆØÅa-zæøå][^\n]{3,80})").alias("trade"),
        F.left(contact.context(line, r"\bkontakt\b", 10, 100), F.lit(14)).alias("around"),
    )
