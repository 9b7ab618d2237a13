"""From parsed pages to stored job records, one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, fixed, salary, scoring, text, url
from ..functions.merge import fingerprint, first_wins, longest_wins, merged_extras
from ..operators.dedup import first_wins as first_rows
from ..operators.joins import url_key
from ..sources import structured
from ..sources.registry import Filters

SCALARS = [f for f in fixed.JOB_FIELDS if f not in ("confidence", "scraped_at")]


def _props(names: dict[str, str], column: str) -> dict[str, Column]:
    return {field: text.filled(F.try_element_at(F.col(column), F.lit(name))) for field, name in names.items()}


def _heuristics(body: Column) -> dict[str, Column]:
    pay, mails, phones = salary.salary(body), contact.emails(body, "page"), contact.page_phones(body)
    return {
        "seniority": text.seniority(body), "remote_type": text.workplace(body), "salary_min": pay["low"], "salary_max": pay["high"], "salary_currency": pay["currency"], "salary_period": pay["period"],
        **{name: text.flag(body, name) for name in fixed.FLAGS}, "recruiter_email": contact.recruiter_email(mails), "application_email": contact.preferred_email(mails), "application_phone": F.get(phones, F.lit(0)),
        "education_required": text.education(body), "experience_years": text.experience_years(body), "hiring_manager": text.hiring_manager(body),
    }


def _sections(column: str) -> dict[str, Column]:
    """Longest section of each kind."""
    out = {}
    for kind in ("responsibilities", "requirements", "benefits"):
        own = F.transform(F.filter(column, lambda s: F.coalesce(text.section_kind(s["label"]) == kind, F.lit(False))), lambda s: s["value"])
        out[kind] = text.filled(F.reduce(own, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)))
    return out


def _labels(column: str) -> tuple[dict[str, Column], Column]:
    """Fields named by label pairs (the first of each), and the remaining pairs as extras."""
    tables = {"dl": fixed.LABELS, "heading": fixed.LABELS, "card": fixed.FACT_LABELS}
    names = sorted({f for t in tables.values() for f in t.values()})

    def of(pair: Column, table: dict[str, str], field: str) -> Column:
        return pair["label"].isin(*[k for k, v in table.items() if v == field])

    def hit(pair: Column, field: str) -> Column:
        out = F.lit(False)
        for kind, table in tables.items():
            if field in table.values():
                out = out | ((pair["kind"] == kind) & of(pair, table, field))
        return out

    def first(field: str) -> Column:
        return F.get(F.transform(F.filter(column, lambda p: hit(p, field)), lambda p: p["value"]), F.lit(0))

    found = {f: first(f) for f in names}
    known = {k for t in tables.values() for k in t}
    rest = F.filter(column, lambda p: (p["kind"] != "heading") & ~p["label"].isin(*known) & (F.length(p["value"]) < 500))
    extras = F.map_from_entries(F.array_distinct(F.transform(rest, lambda p: F.struct(F.concat(p["kind"], F.lit("_"), F.replace(F.lower(p["label"]), F.lit(" "), F.lit("_"))).alias("key"), F.lit("").alias("value")))))
    values = F.transform_values(extras, lambda k, v: F.get(F.transform(F.filter(rest, lambda p: F.concat(p["kind"], F.lit("_"), F.replace(F.lower(p["label"]), F.lit(" "), F.lit("_"))) == k), lambda p: p["value"]), F.lit(0)))
    return found, values


def apply_url(anchors: Column, page: Column) -> Column:
    """First link to a hiring system, else the first that says apply and is no junk, else null."""
    host = F.filter(anchors, lambda a: a["url"].rlike(f"(?i){fixed.APPLY_HOST}"))
    says = F.filter(anchors, lambda a: (a["text"].rlike(f"(?i){fixed.APPLY_TEXT}") | a["url"].rlike(f"(?i){fixed.APPLY_PATH}")) & ~url.is_junk(a["url"]))
    return F.coalesce(F.get(host, F.lit(0))["url"], F.get(says, F.lit(0))["url"])


def extract(parsed: DataFrame, tech_terms: list[str] = (), page_url: str = "url") -> DataFrame:
    """One record per posting of a page (or per page that looks like one), fields merged first-wins by strategy.

    Strategies in order: JSON-LD, microdata, page metadata, label pairs, sections, running text.
    Adds ``url``, all job fields and ``extras``; pages without title and description give no row.
    """
    # One row per JSON-LD posting; a page without any keeps one row with a null item.
    scripts = F.coalesce(F.col("page.ld_json"), F.array().cast("array<string>"))
    base = parsed.withColumn("__row", F.monotonically_increasing_id())
    items = structured.blocks(base.select("__row", "page.ld_json"), F.col("ld_json")).where(structured.is_posting(F.col("item"))).select("__row", "block", "item")
    rows = base.join(items, "__row", "left").withColumn("page", F.col("page").withField("ld_json", scripts))
    rows = rows.withColumn("__body", F.left(F.col("page.text"), F.lit(200_000)))
    # Most pages have none of the labels: one pattern for all of them goes before the pattern of each.
    rows = rows.withColumn("__labelled", F.when(text.has_inline_labels(F.col("__body")), F.col("__body")))
    body, link = F.col("__body"), F.col(page_url)
    ld = structured.job_posting(F.col("item"))
    micro = _props({"title": "title", "employment_type": "employmentType", "posted_date": "datePosted", "valid_through": "validThrough"}, "page.job_props")
    micro["description"] = text.filled(text.strip_tags(F.try_element_at(F.col("page.job_props"), F.lit("description"))))
    meta = _props({"title": "og:title", "company_logo": "og:image"}, "page.metas")
    meta["description"] = first_wins(*_props({"a": "og:description", "b": "description"}, "page.metas").values())
    labels, extras = _labels("page.pairs")
    person = contact.contact_block(F.col("page.recruiter"))
    people = {"recruiter_name": person["name"], "recruiter_title": person["title"], "recruiter_email": person["email"], "recruiter_phone": person["phone"], "recruiter_linkedin": text.filled(F.regexp_extract(F.col("page.recruiter"), f"(?i)({fixed.LINKEDIN})", 1))}
    last = {"title": F.coalesce(text.filled(F.col("page.h1")), text.clean_title(F.col("page.title"))), "description": F.left(F.col("page.main_text"), F.lit(10_000)), "language": F.col("page.lang")}
    hits = text.dictionary_hits(F.lower(body), list(tech_terms)) if tech_terms else None
    skills = {"tech_stack": text.filled(F.array_join(hits, ", ")), "skills": text.filled(F.array_join(F.slice(hits, 1, 30), ", "))} if hits is not None else {}
    dated = {"valid_through": text.deadline(F.col("page.deadline"))}
    fields = structured.within_page(ld, micro, meta, labels, dated, text.inline_labels(F.col("__labelled")), _sections("page.sections"), people, _heuristics(body), skills, last)
    told = first_wins(ld["description"], micro["description"], meta["description"])
    fields["description"] = text.bound(F.struct(told.alias("told"), fields["description"].alias("any")), lambda d: F.when(F.length(d["told"]) >= 50, d["told"]).otherwise(longest_wins(d["any"], last["description"])))
    fields["qualifications"] = fields["requirements"]
    fields["job_url"] = url.best_job_url(ld["job_url"], F.col("page.canonical"), text.filled(F.try_element_at(F.col("page.metas"), F.lit("og:url"))), link)
    fields["apply_url"] = first_wins(F.when(~url.is_junk(F.coalesce(ld["apply_url"], F.lit(""))), ld["apply_url"]), apply_url(F.col("page.anchors"), link), fields["job_url"])
    fields["source_domain"] = url.authority(link)
    seen = scoring.detection(link, body, F.coalesce(F.array_join(F.transform("page.anchors", lambda a: a["url"]), " "), F.lit("")), F.col("item").isNotNull(), F.size("page.job_props") > 0)
    fields["confidence"] = seen["confidence"].cast("string")
    likely = F.col("item").isNotNull() | scoring.likely_job_page(link, F.col("page.h1"), body) | scoring.looks_like_job_page(link, body)
    rows = rows.where(F.col("page").isNotNull() & likely)
    more = [F.col(f"page.{c}").alias(f"__{c}") for c in ("logo_name", "company_name")]
    out = rows.select(link.alias("url"), *[fields.get(f, F.lit(None).cast("string")).cast("string").alias(f) for f in fixed.JOB_FIELDS], merged_extras(extras).alias("extras"), *more)
    # The company follows from other fields, which are columns by now.
    out = out.withColumn("company", text.company_of_card(F.coalesce("company", text.employer_in(F.col("description"))), F.col("__logo_name"), F.col("title"), F.col("__company_name"))).drop("__logo_name", "__company_name")
    return out.where(first_wins(F.col("title"), F.col("description")).isNotNull())


def detected(parsed: DataFrame, page_url: str = "url", html: str = "html") -> DataFrame:
    """Every page with ``seen`` (see ``scoring.detection``): from its URL, text, markup, JSON-LD and microdata.

    ``parsed`` keeps the markup, as hiring systems are also named in frames and scripts. A page without markup is seen by its URL alone.
    """
    base = parsed.withColumn("__row", F.monotonically_increasing_id())
    items = structured.blocks(base.select("__row", "page.ld_json"), F.col("ld_json")).where(structured.is_posting(F.col("item")))
    rows = base.join(items.select("__row", F.lit(True).alias("__posting")).distinct(), "__row", "left")
    micro = F.coalesce(F.size("page.job_props") > 0, F.lit(False))
    seen = scoring.detection(F.col(page_url), F.coalesce("page.text", F.lit("")), F.coalesce(F.col(html), F.lit("")), F.coalesce("__posting", F.lit(False)), micro)
    return rows.withColumn("seen", seen).drop("__row", "__posting")


def deepened(stubs: DataFrame, details: DataFrame) -> DataFrame:
    """Stubs with the fields of their detail page (URL modulo trailing slash), the longer value of each."""
    right = details.select(url_key(F.col("url")).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fixed.JOB_FIELDS])
    right = first_rows(right, [F.col("__key")], [F.length(F.coalesce("__description", F.lit(""))).cast("int") * -1])
    have = set(stubs.columns)
    joined = stubs.withColumn("__key", url_key(F.col("job_url"))).join(right, "__key", "left")
    own = {f: longest_wins(F.col(f), F.col(f"__{f}")) if f in have else F.col(f"__{f}") for f in fixed.JOB_FIELDS}
    return joined.select(*[c for c in stubs.columns if c not in fixed.JOB_FIELDS], *[v.alias(f) for f, v in own.items()])


def matching(records: DataFrame, filters: Filters) -> DataFrame:
    """Keyword, then location filter; adds ``keywords_matched``. Empty lists filter nothing."""
    own = text.blob(*[F.col(c) for c in ("title", "company", "location", "description")])
    words = list(dict.fromkeys([*filters.include, *filters.sectors]))
    out = records.withColumn("keywords_matched", text.matched_keywords(own, words) if words else F.array().cast("array<string>"))
    if words:
        out = out.where(F.size("keywords_matched") > 0)
    if filters.exclude:
        out = out.where(F.size(text.matched_keywords(own, filters.exclude)) == 0)
    if filters.locations or filters.exclude_locations:
        out = out.where(text.located(text.blob(F.col("location"), F.col("remote_type"), F.col("title")), filters.locations, filters.exclude_locations))
    return out


def unique(records: DataFrame, order: list[str]) -> DataFrame:
    """First record of each identity, in the order of targets and listings."""
    key = fingerprint("dedup", *[F.col(c) for c in ("apply_url", "job_url", "title", "company", "location")])
    return first_rows(records, [key], [F.col(c) for c in order])


def stamped(records: DataFrame, now: Column, source: Column | None = None) -> DataFrame:
    """Identity, time and source; a stamp that is there already stays."""
    at = F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX")
    have = set(records.columns)
    out = records.withColumn("id", fingerprint("row", *[F.col(c) for c in ("apply_url", "job_url", "title", "company", "location")]))
    out = out.withColumn("scraped_at", first_wins(F.col("scraped_at"), at)).withColumn("saved_at", first_wins(F.col("saved_at"), at) if "saved_at" in have else at)
    return out.withColumn("source", source) if source is not None else out


def run(stubs: DataFrame, details: DataFrame, filters: Filters, now: Column) -> DataFrame:
    """Whole job plan: enrich, filter, deduplicate, stamp. ``stubs`` has ``target_position`` and ``position``."""
    return stamped(unique(matching(deepened(stubs, details), filters), ["target_position", "position"]), now)
