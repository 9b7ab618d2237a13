"""Registered queries of text, page and feed operators over texts, pages and feeds that are made from rows of the fixture tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import contact, fixed, salary, scoring, text, url
from .plans import general, jobs
from .queries import query, table
from .sources import cards, html, payloads, registry, selectors, structured

NB = " "


def _pick(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int"))


def _sql_pick(key: str, values: list[str | None]) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({key}) % {len(values)} + 1]"


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


# Running text -------------------------------------------------------------------------------------------------------------


@query(
    f"SELECT o_orderkey, (20 + o_orderkey % 70)::VARCHAR || '000' AS low, (30 + o_orderkey % 70)::VARCHAR || '000' AS high, {_sql_pick('o_orderkey', ['EUR', 'CHF', 'SEK', 'GBP'])} AS currency, "
    f"{_sql_pick('o_custkey', ['month', 'year', 'hour'])} AS period FROM orders"
)
def salary_of_orders(spark, sf):
    """Ranges with no-break and narrow spaces between thousands."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    line = _text("Pay ", _pick(k, ["EUR", "CHF", "SEK", "£"]), NB, 20 + k % 70, NB, "000 - ", 30 + k % 70, " ", "000 per ", _pick(F.col("o_custkey"), ["month", "year", "hour"]))
    return o.select("o_orderkey", salary.salary(line).alias("s")).select("o_orderkey", "s.low", "s.high", "s.currency", "s.period")


_LEVELS = [("senior", "senior"), ("Principal", "principal"), ("junior", "junior"), (f"tech{NB}lead", "lead"), (f"Head{NB}of things", "head"), ("plain", None)]
_WHERE = [("fully remote", "remote"), ("hybrid", "hybrid"), (f"vor{NB}Ort", "onsite"), ("anywhere", None)]


@query(
    f"SELECT p_partkey, {_sql_pick('p_partkey', [b for _, b in _LEVELS])} AS level, {_sql_pick('p_size', [b for _, b in _WHERE])} AS place, (p_size % 12 + 1)::VARCHAR AS years, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'yes' END AS equity, CASE WHEN p_partkey % 5 = 0 THEN 'Bachelor of Science' END AS education FROM part"
)
def heuristics_of_parts(spark, sf):
    k = F.col("p_partkey")
    line = _text("Offer ", k, ", ", _pick(k, [a for a, _ in _LEVELS]), ", ", _pick(F.col("p_size"), [a for a, _ in _WHERE]), ", ", F.col("p_size") % 12 + 1, NB, "years")
    line = F.concat(line, F.when(k % 3 == 0, f", stock{NB}options").otherwise(""), F.when(k % 5 == 0, ", Bachelor of Science").otherwise(""))
    rows = table(spark, sf, "part").select("p_partkey", line.alias("line"))
    x = F.col("line")
    return rows.select("p_partkey", text.seniority(x).alias("level"), text.workplace(x).alias("place"), text.experience_years(x).alias("years"), text.flag(x, "equity").alias("equity"), text.education(x).alias("education"))


@query("SELECT p_partkey, p_name AS title FROM part")
def titles_of_parts(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat("p_name", F.lit(" | FINN.no"))).when(k % 3 == 1, F.concat(F.lit("The Hub | "), "p_name")).otherwise(F.concat("p_name", F.lit(" – LinkedIn Norge")))
    return table(spark, sf, "part").select("p_partkey", text.clean_title(raw).alias("title"))


@query("SELECT c_custkey, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS postal_code, 'By' || chr((65 + c_nationkey)::INT) AS city FROM customer")
def places_of_customers(spark, sf):
    place = _text("Vei A,", NB, F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), NB, "By", F.char(65 + F.col("c_nationkey")))
    return table(spark, sf, "customer").select("c_custkey", text.postal_city(place).alias("p")).select("c_custkey", "p.postal_code", "p.city")


@query("SELECT n_nationkey, 'Z' || chr(252) || 'rich ' || chr(8211) || ' ' || n_name || ' & ' || chr((65 + n_nationkey)::INT) || ' <b>' AS line FROM nation")
def references_of_nations(spark, sf):
    markup = _text("<p>Z&uuml;rich&nbsp;&#8211;</p> ", F.col("n_name"), " &amp; &#", 65 + F.col("n_nationkey"), "; &lt;b&gt;<script>x</script>")
    return table(spark, sf, "nation").select("n_nationkey", text.strip_tags(markup).alias("line"))


@query("SELECT c_custkey, c_custkey % 5 NOT IN (0, 1) AS valid FROM customer")
def phones_of_customers(spark, sf):
    k = F.col("c_custkey")
    number = F.lpad((k % 1000).cast("string"), 3, "0")
    phone = F.when(k % 5 == 0, F.concat(F.lit("0441"), number, F.lit("578"))).when(k % 5 == 1, _text("12.", F.lpad((k % 12 + 1).cast("string"), 2, "0"), ".2024")).otherwise(_text("+41 44 ", number, " 15 78"))
    return table(spark, sf, "customer").select("c_custkey", contact.valid_phone(phone).alias("valid"))


_NAMES, _ROLES = ["Anna Müller", "Eva Stein", "Max Huber", "Lena Kern-Roth"], ["Recruiter", "Hiring Manager", "Sourcer"]


@query(
    f"SELECT c_custkey, {_sql_pick('c_custkey', _NAMES)} AS name, {_sql_pick('c_nationkey', _ROLES)} AS title, '+41 44 ' || (100 + c_custkey % 900) || ' 15' AS phone, 'u' || c_custkey || '@firma.ch' AS email FROM customer"
)
def contacts_of_customers(spark, sf):
    k = F.col("c_custkey")
    block = _text("Fragen? ", _pick(k, _NAMES), ", ", _pick(F.col("c_nationkey"), _ROLES), ", +41 44 ", 100 + k % 900, " 15 78, u", k, "@firma.ch")
    return table(spark, sf, "customer").select("c_custkey", contact.contact_block(block).alias("c")).select("c_custkey", "c.*")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'Firma ' || s_suppkey || ' AS' END AS employer FROM supplier")
def employers_of_suppliers(spark, sf):
    k = F.col("s_suppkey")
    about = F.when(k % 3 == 0, _text("Om stillingen Vi i avdeling ", k, " søker folk")).otherwise(_text("Hei. Om stillingen", NB, "Firma ", k, " AS søker folk til lager"))
    return table(spark, sf, "supplier").select("s_suppkey", text.employer_in(about).alias("employer"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS valid_through, 'Kokk ' || o_custkey AS department, 'R-' || o_orderkey AS requisition_id, CASE WHEN o_orderkey % 2 = 0 THEN 'snart' END AS start_date FROM orders")
def labels_of_orders(spark, sf):
    """Labels in running text; a label whose value is another label fills nothing."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    line = _text("Søknadsfrist", NB, F.date_format("o_orderdate", "dd.MM.yyyy"), "\nReferansenr: R-", k, "\nOppstart: ", F.when(k % 2 == 0, "snart").otherwise("Sektor"), "\nYrke: Kokk ", F.col("o_custkey"), "\n")
    found = text.inline_labels(line)
    return o.select("o_orderkey", *[found[f].alias(f) for f in ("valid_through", "department", "requisition_id", "start_date")])


# URLs and scores ----------------------------------------------------------------------------------------------------------

_HOSTS = [("https://boards.greenhouse.io/a", "greenhouse"), ("https://jobs.lever.co/a", "lever"), ("https://a.recruitee.com", "recruitee"), ("https://a.wd3.myworkdayjobs.com/x", "workday"), ("https://www.finn.no/a", "finn.no"), ("https://a.example.org", "generic")]


@query(f"SELECT s_suppkey, {_sql_pick('s_suppkey', [b for _, b in _HOSTS])} AS adapter FROM supplier")
def adapters_of_suppliers(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", url.adapter(_text(_pick(F.col("s_suppkey"), [a for a, _ in _HOSTS]), "/", F.col("s_suppkey"))).alias("adapter"))


_ON_PATH = rf"regexp_matches(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '(?i){fixed.OLD_PATH}')"


@query(f"SELECT page_id, CASE WHEN {_ON_PATH} THEN 0.4 WHEN regexp_matches(url, '(?i){fixed.OLD_QUERY}') THEN 0.2 ELSE 0.0 END + CASE WHEN page_id % 4 = 0 THEN 0.5 ELSE 0.0 END AS confidence, {_ON_PATH} AND page_id % 4 = 0 AS is_job FROM pages")
def old_page_scores(spark, sf):
    """The older score over URLs, texts and markup of pages; every fourth page is given an advert."""
    p = html.parsed(table(spark, sf, "pages"), keep_html=True)
    adverts = F.size("page.adverts") + F.when(F.col("page_id") % 4 == 0, 1).otherwise(0)
    seen = scoring.old_detection(F.col("url"), F.col("page.text"), F.col("html"), F.lit(False), F.size("page.job_props") > 0, adverts)
    return p.select("page_id", seen.alias("seen")).select("page_id", F.col("seen.confidence").cast("decimal(11,1)").alias("confidence"), "seen.is_job")


# Feeds and lists ----------------------------------------------------------------------------------------------------------


def _joined(rows: DataFrame, key: str, order: str, piece: Column, name: str) -> DataFrame:
    """Pieces of a key's rows in order, as one string."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("x")))).alias("l"))
    return held.select(key, F.array_join(F.transform("l", lambda r: r["x"]), "").alias(name))


@query(
    "SELECT t.target, p_name AS title, lower(p_brand) AS company, 'Sted ' || p_size AS location, 'd ' || p_type || ' ' || chr(228) AS description, 'https://x.io/' || p_partkey AS job_url "
    "FROM part, (VALUES ('first'), ('second')) t(target)"
)
def greenhouse_of_brands(spark, sf):
    """A feed per brand, fetched for two targets."""
    item = F.struct(F.col("p_name").alias("title"), _text("https://x.io/", F.col("p_partkey"), "/?utm_source=q").alias("absolute_url"), _text("<p>d</p>", F.col("p_type"), " &auml;").alias("content"), F.struct(_text("Sted ", F.col("p_size")).alias("name")).alias("location"))
    feeds = table(spark, sf, "part").groupBy(F.lower("p_brand").alias("slug")).agg(F.to_json(F.struct(F.collect_list(item).alias("jobs"))).alias("body"))
    both = feeds.withColumn("t", F.explode(F.array(F.lit("first"), F.lit("second"))))
    made = registry.stubs(both.select(F.lit("greenhouse").alias("adapter"), "slug", "body", F.col("t").alias("target"), F.when(F.col("t") == "first", 0).otherwise(1).alias("target_position")))
    return made.select("target", "title", "company", "location", "description", "job_url")


@query(
    "SELECT c_name AS title, lower(c_mktsegment) AS company, 'L' || c_nationkey AS location, CASE WHEN c_custkey % 2 = 0 THEN 'remote' END AS remote_type, 'https://l.co/' || c_custkey AS job_url, 'https://l.co/' || c_custkey || '/apply' AS apply_url FROM customer"
)
def lever_of_segments(spark, sf):
    k = F.col("c_custkey")
    item = F.struct(F.col("c_name").alias("text"), _text("https://l.co/", k).alias("hostedUrl"), _text("https://l.co/", k, "/apply").alias("applyUrl"), F.when(k % 2 == 0, "Remote").otherwise("Onsite").alias("workplaceType"), F.struct(_text("L", F.col("c_nationkey")).alias("location")).alias("categories"))
    feeds = table(spark, sf, "customer").groupBy(F.lower("c_mktsegment").alias("slug")).agg(F.to_json(F.collect_list(item)).alias("body"))
    return payloads.PARSERS["lever"](feeds).select("title", "company", "location", "remote_type", "job_url", "apply_url")


@query("SELECT (o_custkey % 10)::VARCHAR AS run, (o_orderkey % 3)::INT AS page, o_orderkey::VARCHAR AS id, 'https://www.finn.no/job/ad/' || o_orderkey AS job_url FROM orders")
def listing_links_of_orders(spark, sf):
    """Each order is linked on a page and on the next one; the first counts."""
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 10).cast("string").alias("run"), F.explode(F.array((F.col("o_orderkey") % 3).cast("int"), (F.col("o_orderkey") % 3 + 1).cast("int"))).alias("page"), "o_orderkey")
    pages = _joined(o.withColumn("key", F.struct("run", "page")), "key", "o_orderkey", _text('<a href="/job/ad/', F.col("o_orderkey"), '">x</a>'), "html")
    return payloads.listing_ids(pages.select("key.*", "html"), "finn.no").select("run", "page", "id", "job_url")


@query("SELECT s_nationkey::VARCHAR AS site, 'https://s.org/' || s_suppkey AS loc, s_nationkey % 2 = 0 AS is_index FROM supplier")
def sitemaps_of_nations(spark, sf):
    body = _joined(table(spark, sf, "supplier"), "s_nationkey", "s_suppkey", _text("<loc> https://s.org/", F.col("s_suppkey"), "\n</loc>"), "locs")
    body = body.select(F.col("s_nationkey").cast("string").alias("site"), F.concat(F.when(F.col("s_nationkey") % 2 == 0, "<sitemapindex>").otherwise("<urlset>"), "locs").alias("body"))
    return payloads.sitemap_urls(body)


def _brand_pages(spark, sf, piece: Column, name: str = "url") -> DataFrame:
    made = _joined(table(spark, sf, "part").withColumn("brand", F.lower(F.regexp_replace("p_brand", "#", ""))), "brand", "p_partkey", piece, "body")
    return made.select(_text("https://", F.col("brand"), ".example.org/list").alias(name), _text("<html><body><ul>", F.col("body"), "</ul></body></html>").alias("html"))


_PAGE = "'https://' || lower(replace(p_brand, '#', '')) || '.example.org/list'"


_JOBS = ["Engineer", "Bakery", "Recruiter", "Zzz"]
_TITLE = f"p_name || ' ' || {_sql_pick('p_size', _JOBS)}"


@query(
    f"SELECT {_PAGE} AS page_url, {_TITLE} AS title, 'Firma ' || p_size AS company, 'Sted' AS location, 'https://' || lower(replace(p_brand, '#', '')) || '.example.org/jobs/' || p_partkey AS url FROM part "
    f"WHERE p_partkey % 4 > 0 AND regexp_matches({_TITLE}, '(?i){fixed.LIST_TITLE}')"
)
def job_links_of_brands(spark, sf):
    """Lists of links: other paths go, titles count by their words, a link that comes again counts once."""
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, "/about/").otherwise("/jobs/")
    piece = _text('<li><a href="', path, k, '"><h3>', F.col("p_name"), " ", _pick(F.col("p_size"), _JOBS), '</h3></a><i class="company">Firma ', F.col("p_size"), '</i><b class="job-location">Sted</b><a href="', path, k, '">data</a></li>')
    return cards.job_list(cards.page_links(_brand_pages(spark, sf, piece))).select("page_url", "title", "company", "location", "url")


@query(f"SELECT {_PAGE} AS page_url, p_name AS name, 'https://' || lower(replace(p_brand, '#', '')) || '.example.org/biz/' || p_partkey AS url FROM part WHERE p_partkey % 5 NOT IN (0, 1)")
def business_links_of_brands(spark, sf):
    """Links to detail pages: navigation texts and other hosts go."""
    k = F.col("p_partkey")
    piece = _text('<li><h3>', F.col("p_name"), '</h3><a href="', F.when(k % 5 == 0, "https://other.org").otherwise(""), "/biz/", k, '">', F.when(k % 5 == 1, "Reviews").otherwise(F.concat(F.lit("go to "), "p_name")), "</a></li>")
    return cards.business_cards(cards.page_links(_brand_pages(spark, sf, piece))).select("page_url", "name", "url")


@query("SELECT n_regionkey, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_name AS title, 'R' || n_regionkey AS company, 'https://ch.jobrapido.com/joboffer/' || n_nationkey AS card_url FROM nation")
def site_cards_of_regions(spark, sf):
    piece = _text('<li class="result-', F.col("n_nationkey"), '"><a href="/joboffer/', F.col("n_nationkey"), '"><h3>', F.col("n_name"), '</h3></a><span class="x company">R', F.col("n_regionkey"), "</span></li>")
    pages = _joined(table(spark, sf, "nation"), "n_regionkey", "n_nationkey", piece, "body")
    pages = pages.select(_text("https://ch.jobrapido.com/q?", F.col("n_regionkey")).alias("url"), _text("<ul>", F.col("body"), "</ul>").alias("html"))
    return selectors.site_cards(pages).select(F.regexp_extract("company", r"R(\d+)", 1).cast("long").alias("n_regionkey"), "position", "title", "company", "card_url")


@query("SELECT 'greenhouse' AS source_ats, s_name AS title, 'L' || s_nationkey AS location, 'N-' || s_suppkey AS reference FROM supplier")
def learned_selectors_of_suppliers(spark, sf):
    page = _text('<div class="app-title">', F.col("s_name"), '</div><p class="location">L', F.col("s_nationkey"), "</p><p>Ref: N-", F.col("s_suppkey"), ".</p>")
    pages = table(spark, sf, "supplier").select(_text("https://boards.greenhouse.io/", F.col("s_suppkey")).alias("url"), page.alias("html"), F.create_map(F.lit("reference"), F.lit(r"TEXT:Ref:\s*(N-\d+)")).alias("field_map"))
    got = selectors.selected_fields(pages)
    return got.select("source_ats", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("title", "location", "reference")])


# Records ------------------------------------------------------------------------------------------------------------------


def _ld(item: Column) -> Column:
    return _text('<html><head><script type="application/ld+json">', F.to_json(item), "</script></head><body><h1>x</h1></body></html>")


@query(
    "SELECT p_name AS title, CASE WHEN p_partkey % 4 = 0 THEN 'Logo ' || p_size ELSE p_brand END AS company, 'P-' || p_partkey AS external_id, (floor(p_retailprice)::INT)::VARCHAR AS salary_min, '2024-01-02' AS posted_date, "
    "'01.02.2025' AS valid_through, 'https://acme.io/jobs/' || p_partkey AS job_url, 'acme.io' AS source_domain FROM part"
)
def job_records_of_parts(spark, sf):
    """A posting per part; every fourth names no company, its page a logo does."""
    k = F.col("p_partkey")
    posting = F.struct(
        F.lit("JobPosting").alias("@type"), F.col("p_name").alias("title"), _text("<p>", F.repeat(F.lit("Work and more work. "), 6), "</p>").alias("description"), F.lit("2024-01-02").alias("datePosted"),
        F.when(k % 4 > 0, F.struct(F.col("p_brand").alias("name"))).alias("hiringOrganization"), F.struct(_text("P-", k).alias("value")).alias("identifier"),
        F.struct(F.lit("CHF").alias("currency"), F.struct(F.col("p_retailprice").cast("int").alias("minValue")).alias("value")).alias("baseSalary"),
    )
    page = F.concat(_ld(posting), _text('<div class="jobad_company_logo"><img alt="Logo ', F.col("p_size"), '"></div><span class="jobad-deadline-date">01.02.2025</span>'))
    pages = table(spark, sf, "part").select(_text("https://acme.io/jobs/", k).alias("url"), page.alias("html"))
    return jobs.extract(html.parsed(pages)).select("title", "company", "external_id", "salary_min", "posted_date", "valid_through", "job_url", "source_domain")


@query("SELECT s_name AS name, 'Restaurant' AS category, 'Weg ' || s_suppkey || ', Zug, CH' AS address, '+41 44 111 22 ' || (10 + s_suppkey % 90) AS phone, (s_suppkey % 50 / 10)::DECIMAL(3,1)::VARCHAR AS rating, 'biz.ch' AS source_domain FROM supplier")
def business_records_of_suppliers(spark, sf):
    k = F.col("s_suppkey")
    item = F.struct(
        F.lit("Restaurant").alias("@type"), F.col("s_name").alias("name"), _text("+41 44 111 22 ", 10 + k % 90).alias("telephone"),
        F.struct(_text("Weg ", k).alias("streetAddress"), F.lit("Zug").alias("addressLocality"), F.lit("CH").alias("addressCountry")).alias("address"), F.struct((k % 50 / 10).cast("decimal(3,1)").cast("string").alias("ratingValue")).alias("aggregateRating"),
    )
    pages = table(spark, sf, "supplier").select(_text("https://biz.ch/", k).alias("url"), _ld(item).alias("html"))
    return general.details(html.parsed(pages)).select("name", "category", "address", "phone", "rating", "source_domain")


@query("SELECT 'https://r' || n_regionkey || '.ch/' AS source_listing_url, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS position, n_name AS name, 'https://b.ch/' || n_nationkey AS source_url FROM nation")
def business_cards_of_regions(spark, sf):
    store = F.struct(F.struct(F.lit("Store").alias("@type"), F.col("n_name").alias("name"), _text("https://b.ch/", F.col("n_nationkey")).alias("url")).alias("item"))
    held = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", store.alias("x")))).alias("l"))
    lists = held.select(_text("https://r", F.col("n_regionkey"), ".ch/").alias("url"), _ld(F.struct(F.lit("ItemList").alias("@type"), F.transform("l", lambda r: r["x"]).alias("itemListElement"))).alias("html"))
    return general.cards(html.parsed(lists)).select("source_listing_url", "position", "name", "source_url")


@query("SELECT s_suppkey, s_name AS title, 'Firma ' || s_nationkey AS company, lpad(s_suppkey::VARCHAR, 4, '0') AS postal_code FROM supplier")
def payloads_of_suppliers(spark, sf):
    entry = F.struct(F.col("s_name").alias("title"), F.struct(_text("Firma ", F.col("s_nationkey")).alias("name")).alias("company"), F.array(F.struct(F.lpad(F.col("s_suppkey").cast("string"), 4, "0").alias("zipCode"))).alias("locations"))
    rows = table(spark, sf, "supplier").select("s_suppkey", F.to_json(F.struct(F.struct(F.struct(entry.alias("jobEntry")).alias("pageProps")).alias("props"))).alias("payload"))
    fields = structured.next_entry(F.col("payload"))
    return rows.select("s_suppkey", *[fields[f].alias(f) for f in ("title", "company", "postal_code")])


@query(
    "SELECT 'https://a.com/jobs/' || p_partkey AS job_url, p_name || ' in detail' AS title, CASE WHEN p_size % 2 = 0 THEN 'remote' END AS remote_type, 'widget' AS keywords FROM part WHERE contains(p_name, 'widget') AND p_partkey % 2 = 0 AND p_size % 7 > 0"
)
def job_plan_of_parts(spark, sf):
    """Stubs, their detail pages, keyword and location filters, an exclusion, and duplicates under a tracking parameter."""
    k, p = F.col("p_partkey"), table(spark, sf, "part")
    stub = p.select(
        F.lit(0).alias("target_position"), k.cast("int").alias("position"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.when(k % 2 == 0, "Oslo").otherwise("Rome").alias("location"), F.lit(None).cast("string").alias("remote_type"),
        F.when(F.col("p_size") % 7 == 0, "unwanted trade").alias("description"), _text("https://a.com/jobs/", k).alias("job_url"), F.lit("s").alias("source"),
    )
    again = stub.where(F.col("position") % 3 == 0).withColumn("target_position", F.lit(1)).withColumn("job_url", F.concat("job_url", F.lit("?utm_source=q")))
    stubs = stub.unionByName(again).withColumn("apply_url", F.col("job_url")).withColumn("saved_at", F.lit(None).cast("string"))
    known = {"title": F.concat("p_name", F.lit(" in detail")), "remote_type": F.when(F.col("p_size") % 2 == 0, "remote")}
    found = p.select(F.explode(F.array(_text("https://a.com/jobs/", k, "/"), _text("https://a.com/jobs/", k, "?utm_source=q"))).alias("url"), *[known.get(f, F.lit(None).cast("string")).alias(f) for f in fixed.JOB_FIELDS])
    made = jobs.run(stubs, found, registry.Filters(include=["Widget"], exclude=["unwanted"], locations=["oslo"]), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return made.select("job_url", "title", "remote_type", F.lower(F.array_join("keywords_matched", ",")).alias("keywords"))
