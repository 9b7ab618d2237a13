"""Job feeds of hiring systems and portals: one JSON or XML document per row in, listings out.

Each parser takes ``payloads(slug, body)`` and returns listings with null for what is missing. Polymorphic or unknown keys are
ignored; broken documents give no rows. Everything is ``from_json`` / ``from_xml`` with a schema, ``explode`` and column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.salary import grade_range
from ..functions.text import filled, strip_tags
from ..functions.url import canonical, segments

LISTING = ["slug", "position", "title", "company", "location", "remote_type", "employment_type", "posted_date", "description", "apply_url", "job_url"]


def _listings(items: DataFrame, **columns: Column) -> DataFrame:
    """Named columns in the order of ``LISTING``; URLs are canonical, empty strings null; extra names follow."""
    columns = {"company": F.col("slug"), "apply_url": columns.get("job_url"), **columns}
    for k in ("apply_url", "job_url"):
        if columns.get(k) is not None:
            columns[k] = canonical(F.coalesce(columns[k], F.lit("")))
    names = [n for n in LISTING if n not in ("slug", "position")] + [n for n in columns if n not in LISTING]
    return items.select(*_own(items), "position", *[filled(columns[n]).alias(n) if columns.get(n) is not None else F.lit(None).cast("string").alias(n) for n in names])


def _own(payloads: DataFrame) -> list[str]:
    """Columns that a listing takes from its payload: the slug, and where the payload comes from if that is given."""
    return ["slug", *[c for c in ("origin",) if c in payloads.columns]]


def _items(payloads: DataFrame, schema: str, array: str | None = None) -> DataFrame:
    # A lone object would be read as a list of one.
    shape = "{" if array else "["
    body = F.from_json(F.when(F.ltrim("body").startswith(shape), F.col("body")), schema)
    return payloads.select(*_own(payloads), F.posexplode(body[array] if array else body).alias("position", "x"))


def _remote(test: Column) -> Column:
    return F.when(test, "remote")


def _joined(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[filled(p) for p in parts])


def greenhouse(payloads: DataFrame) -> DataFrame:
    x = _items(payloads, "jobs array<struct<title:string,absolute_url:string,updated_at:string,content:string,location:struct<name:string>,offices:array<struct<name:string>>>>", "jobs")
    offices = F.array_join(F.filter(F.transform("x.offices", lambda o: o["name"]), lambda n: n != ""), ", ")
    return _listings(x, title=F.col("x.title"), location=F.coalesce(filled(F.col("x.location.name")), offices), posted_date=F.col("x.updated_at"), description=strip_tags(F.col("x.content")), job_url=F.col("x.absolute_url"))


def lever(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "array<struct<text:string,description:string,additional:string,hostedUrl:string,applyUrl:string,workplaceType:string,createdAt:bigint,categories:struct<location:string,commitment:string>,allLocations:array<string>,lists:array<struct<text:string,content:string>>>>",
    )
    lists = F.array_join(F.transform("x.lists", lambda b: F.concat(F.lit("<h3>"), F.coalesce(b["text"], F.lit("")), F.lit("</h3>"), F.coalesce(b["content"], F.lit("")))), "")
    body = F.concat(F.coalesce("x.description", F.lit("")), F.coalesce(lists, F.lit("")), F.coalesce("x.additional", F.lit("")))
    every = F.array_join(F.filter("x.allLocations", lambda v: v != ""), ", ")
    posted = F.date_format(F.timestamp_millis("x.createdAt"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return _listings(
        x, title=F.col("x.text"), location=F.coalesce(filled(every), F.col("x.categories.location")), remote_type=_remote(F.lower("x.workplaceType") == "remote"),
        employment_type=F.col("x.categories.commitment"), posted_date=posted, description=strip_tags(body), apply_url=F.col("x.applyUrl"), job_url=F.col("x.hostedUrl"),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "jobs array<struct<title:string,descriptionHtml:string,descriptionPlain:string,location:string,workplaceType:string,employmentType:string,publishedAt:string,updatedAt:string,jobUrl:string,applyUrl:string,secondaryLocations:array<struct<location:string>>>>",
        "jobs",
    )
    others = F.array_join(F.filter(F.transform("x.secondaryLocations", lambda s: s["location"]), lambda v: v != ""), ", ")
    url = F.coalesce(filled(F.col("x.jobUrl")), F.col("x.applyUrl"))
    return _listings(
        x, title=F.col("x.title"), location=_joined(", ", F.col("x.location"), others), remote_type=_remote(F.lower("x.workplaceType") == "remote"), employment_type=F.col("x.employmentType"),
        posted_date=F.coalesce(filled(F.col("x.publishedAt")), F.col("x.updatedAt")), description=F.coalesce(filled(strip_tags(F.col("x.descriptionHtml"))), F.col("x.descriptionPlain")),
        apply_url=F.coalesce(filled(F.col("x.applyUrl")), url), job_url=url,
    )


def workday(payloads: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``slug`` is the tenant's base URL; ``details(slug, path, body)`` adds descriptions by path."""
    x = _items(payloads, "jobPostings array<struct<title:string,externalPath:string,locationsText:string,postedOn:string>>", "jobPostings").withColumn("path", F.col("x.externalPath"))
    if details is not None:
        more = details.select("slug", "path", F.from_json("body", "jobPostingInfo struct<jobDescription:string>")["jobPostingInfo"]["jobDescription"].alias("html"))
        x = x.join(more, ["slug", "path"], "left")
    else:
        x = x.withColumn("html", F.lit(None).cast("string"))
    tenant = F.regexp_extract("slug", r"://([^./]+)", 1)
    return _listings(x, title=F.col("x.title"), company=tenant, location=F.col("x.locationsText"), posted_date=F.col("x.postedOn"), description=strip_tags(F.col("html")), job_url=F.concat(F.col("slug"), F.col("path")))


def recruitee(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "offers array<struct<title:string,description:string,requirements:string,remote:boolean,locations:array<struct<city:string,state:string,country:string>>,location:string,city:string,careers_url:string,careers_apply_url:string,employment_type_code:string,created_at:string>>",
        "offers",
    )
    each = F.filter(F.transform("x.locations", lambda p: _joined(", ", p["city"], p["state"], p["country"])), lambda v: v != "")
    url = F.coalesce(filled(F.col("x.careers_url")), F.col("x.careers_apply_url"))
    return _listings(
        x, title=F.col("x.title"), location=F.coalesce(filled(F.array_join(each, "; ")), filled(F.col("x.location")), F.col("x.city")), remote_type=_remote(F.col("x.remote")), employment_type=F.col("x.employment_type_code"),
        posted_date=F.col("x.created_at"), description=strip_tags(F.coalesce(filled(F.col("x.description")), F.col("x.requirements"))), apply_url=F.coalesce(filled(F.col("x.careers_apply_url")), url), job_url=url,
    )


def workable(payloads: DataFrame) -> DataFrame:
    """Both shapes: ``jobs`` of the widget, else ``results`` of the paged API."""
    item = "array<struct<shortcode:string,title:string,url:string,type:string,employment_type:string,published:string,published_on:string,created_at:string,remote:boolean,location:struct<city:string,region:string,country:string,workplace:string>>>"
    body = F.from_json("body", f"jobs {item}, results {item}")
    x = payloads.select(*_own(payloads), F.posexplode(F.coalesce(F.when(F.size(body["jobs"]) > 0, body["jobs"]), body["results"])).alias("position", "x"))
    url = F.coalesce(filled(F.col("x.url")), F.concat(F.lit("https://apply.workable.com/"), F.col("slug"), F.lit("/j/"), F.col("x.shortcode"), F.lit("/")))
    return _listings(
        x, title=F.col("x.title"), location=_joined(", ", F.col("x.location.city"), F.col("x.location.region"), F.col("x.location.country")),
        remote_type=_remote(F.coalesce("x.remote", F.lit(False)) | (F.coalesce("x.location.workplace", F.lit("")) == "remote")), employment_type=F.coalesce(filled(F.col("x.type")), F.col("x.employment_type")),
        posted_date=F.coalesce(filled(F.col("x.published")), filled(F.col("x.published_on")), F.col("x.created_at")), job_url=url,
    )


def smartrecruiters(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "content array<struct<id:string,name:string,ref:string,releasedDate:string,createdOn:string,company:struct<name:string>,location:struct<city:string,region:string,country:string>,typeOfEmployment:struct<label:string>,jobAd:struct<sections:map<string,struct<text:string>>>>>",
        "content",
    )
    parts = [filled(strip_tags(F.col("x.jobAd.sections")[k]["text"])) for k in ("companyDescription", "jobDescription", "qualifications", "additionalInformation")]
    public = F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), F.col("x.id"))
    return _listings(
        x, title=F.col("x.name"), company=F.coalesce(filled(F.col("x.company.name")), F.col("slug")), location=_joined(", ", F.col("x.location.city"), F.col("x.location.region"), F.col("x.location.country")),
        employment_type=F.col("x.typeOfEmployment.label"), posted_date=F.coalesce(filled(F.col("x.releasedDate")), F.col("x.createdOn")), description=F.concat_ws(" ", *parts), job_url=F.coalesce(public, F.col("x.ref")),
    )


def _first_of_id(items: DataFrame, id_: Column) -> DataFrame:
    """First occurrence of each id; rows without one go."""
    nth = F.row_number().over(W.partitionBy(*_own(items), "id").orderBy("position"))
    return items.withColumn("id", id_).where(filled(F.col("id")).isNotNull()).withColumn("nth", nth).where("nth = 1")


def arbeitsagentur(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "stellenangebote array<struct<hashId:string,refnr:string,titel:string,beruf:string,arbeitgeber:string,arbeitsort:struct<ort:string,region:string,land:string>,arbeitszeitmodelle:string,aktuelleVeroeffentlichungsdatum:string,stellenbeschreibung:string>>",
        "stellenangebote",
    )
    x = _first_of_id(x, F.coalesce(filled(F.col("x.hashId")), F.col("x.refnr")))
    return _listings(
        x, title=F.coalesce(filled(F.col("x.titel")), F.col("x.beruf")), company=F.col("x.arbeitgeber"), location=_joined(", ", F.col("x.arbeitsort.ort"), F.col("x.arbeitsort.region"), F.col("x.arbeitsort.land")),
        employment_type=F.col("x.arbeitszeitmodelle"), posted_date=F.col("x.aktuelleVeroeffentlichungsdatum"), description=F.col("x.stellenbeschreibung"), job_url=F.concat(F.lit("https://www.arbeitsagentur.de/jobsuche/jobdetail/"), F.col("id")),
    )


def jobs_ch(payloads: DataFrame) -> DataFrame:
    x = _items(
        payloads,
        "documents array<struct<job_id:string,datapool_id:string,title:string,company_name:string,place:string,preview:string,publication_date:string,initial_publication_date:string,employment_grades:array<int>,tags:array<struct<type:string,value_min:int,value_max:int>>,language_skills:array<string>,work_experience:array<string>,_links:map<string,struct<href:string>>>>",
        "documents",
    )
    x = _first_of_id(x, F.coalesce(filled(F.col("x.job_id")), F.col("x.datapool_id")))
    link = F.coalesce(*[filled(F.col("x._links")[k]["href"]) for k in ("detail_en", "detail_fr", "detail_de")])
    tag = F.get(F.filter("x.tags", lambda t: (t["type"] == "employment_grade") & (t["value_min"] > 0) & (t["value_max"] > 0)), F.lit(0))
    grades = F.when(F.size("x.employment_grades") > 0, grade_range(F.col("x.employment_grades"))).otherwise(F.concat(tag["value_min"].cast("string"), F.lit("–"), tag["value_max"].cast("string"), F.lit("%")))
    return _listings(
        x.where(link.isNotNull()), title=F.col("x.title"), company=F.col("x.company_name"), location=F.col("x.place"), employment_type=grades, posted_date=F.coalesce(filled(F.col("x.publication_date")), F.col("x.initial_publication_date")),
        description=F.col("x.preview"), job_url=link, city=F.col("x.place"), country=F.lit("Switzerland"), external_id=F.col("x.job_id"), source_ats=F.lit("jobs.ch"), source_domain=F.lit("www.jobs.ch"),
        language=F.array_join("x.language_skills", ", "), experience_years=F.array_join("x.work_experience", ", "),
    )


def personio(payloads: DataFrame) -> DataFrame:
    """XML feed; ``slug`` is the base URL, whose first host label names the company."""
    fields = "id:string,name:string,office:string,department:string,employmentType:string,schedule:string,seniority:string,recruitingCategory:string,occupation:string,occupationCategory:string,createdAt:string,url:string,jobDescriptions:struct<jobDescription:array<struct<name:string,value:string>>>"
    body = F.from_xml("body", f"position array<struct<{fields}>>")
    x = payloads.where(F.ltrim("body").startswith("<?xml")).select(*_own(payloads), F.posexplode(body["position"]).alias("position", "x"))
    parts = F.transform("x.jobDescriptions.jobDescription", lambda d: F.when(filled(d["value"]).isNotNull(), F.concat(F.when(filled(F.trim(d["name"])).isNotNull(), F.concat(F.trim(d["name"]), F.lit(": "))).otherwise(""), strip_tags(d["value"]))))
    tags = _joined(" ", *[F.col(f"x.{k}") for k in ("department", "recruitingCategory", "occupation", "occupationCategory", "seniority")])
    base = F.regexp_replace("slug", "/+$", "")
    return _listings(
        x, title=F.trim("x.name"), company=F.regexp_extract("slug", r"://([^./]+)", 1), location=F.trim("x.office"), remote_type=_remote(F.concat_ws(" ", "x.schedule", "x.office").rlike(r"(?i)\bremote\b")),
        employment_type=F.coalesce(filled(F.trim("x.employmentType")), F.col("x.schedule")), posted_date=F.col("x.createdAt"), description=_joined(" ", F.array_join(F.array_compact(parts), " "), tags),
        job_url=F.coalesce(filled(F.trim("x.url")), F.concat(base, F.lit("/job/"), F.col("x.id"))),
    )


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workday": workday, "recruitee": recruitee, "workable": workable, "smartrecruiters": smartrecruiters, "arbeitsagentur": arbeitsagentur, "jobs.ch": jobs_ch, "personio": personio,
}

DETAIL_URLS = {
    "jobs.ch": "https://www.jobs.ch/en/vacancies/detail/{}", "finn.no": "https://www.finn.no/job/ad/{}", "nav.no": "https://arbeidsplassen.nav.no/stillinger/stilling/{}",
    "karrierestart.no": "https://karrierestart.no/ledig-stilling/{}", "jobbsafari.no": "https://jobbsafari.no/jobb/{}",
}


def listing_ids(pages: DataFrame, site: str) -> DataFrame:
    """``run, page, position, id, job_url`` of detail links on listing pages; the first occurrence of an id in a run stays."""
    ids = F.regexp_extract_all("html", F.lit(fixed.LISTING_LINKS[site]), F.lit(1))
    found = pages.select("run", "page", F.posexplode(ids).alias("position", "id"))
    first = found.groupBy("run", "id").agg(F.min(F.struct("page", "position")).alias("at"))
    before, after = DETAIL_URLS[site].split("{}")
    return first.select("run", "at.page", "at.position", "id", F.concat(F.lit(before), F.col("id"), F.lit(after)).alias("job_url"))


def sitemap_urls(documents: DataFrame, limit: int | None = None) -> DataFrame:
    """``site, loc, is_index`` of sitemap documents (``site, body``); ``limit`` keeps so many pages, in URL order."""
    index = F.col("body").contains("<sitemapindex")
    locs = documents.select("site", F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("loc"), index.alias("is_index")).distinct()
    return locs.orderBy("is_index", "site", "loc").limit(limit) if limit else locs


def robots_sitemaps(documents: DataFrame) -> DataFrame:
    return documents.select("site", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("loc"))


def workday_base(url: Column) -> Column:
    """Tenant base of a career-site URL; null unless the path has a language and a site."""
    found = F.regexp_extract(F.lower(url), r"^(https?://[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com)(?:/|$)", 1)
    return F.when((found != "") & (F.size(segments(url)) >= 2), found)


def slug_candidates(name: Column) -> Column:
    """Spellings under which a company may be registered, in a fixed order."""
    suffixes = ["", "Group", "SE", "AG", "GmbH", "Inc", "Holding", "International"]
    bases = F.array_distinct(F.array(name, F.lower(name), F.upper(name), F.initcap(name)))
    return F.array_distinct(F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(s)) for s in suffixes]))))
