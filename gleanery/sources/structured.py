"""Structured data of pages: JSON-LD through VARIANT, application payloads through JSON paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.merge import first_wins
from ..functions.text import clean, filled, strip_tags


def repaired(text: Column) -> Column:
    """VARIANT of a JSON text; trailing commas are removed if it doesn't parse as it is. Null if neither does."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.regexp_replace(text, r",(\s*[}\]])", "$1")))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _one(v: Column, path: str) -> Column:
    """Text of a scalar, or of a list joined by commas; objects give null."""
    many = _get(v, path, "array<string>")
    scalar = _get(v, path)
    return filled(F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.array_join(F.filter(many, lambda x: x != ""), ", ")).when(~F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith("OBJECT"), F.trim(scalar)))


def _either(v: Column, *paths: str) -> Column:
    return F.coalesce(*[_one(v, p) for p in paths])


def blocks(rows: DataFrame, scripts: Column) -> DataFrame:
    """One row per item of the JSON-LD scripts: roots, list items, graph items, and single-key wrappers opened.

    Adds ``block`` (which script) and ``item``. Two levels of nesting are opened, which covers lists of graphs.
    """
    base = rows.select("*", F.posexplode(scripts).alias("block", "__text")).withColumn("__v", repaired(F.col("__text"))).where(F.col("__v").isNotNull())

    def opened(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        wrapper = F.map_values(F.try_variant_get(v, "$", "map<string,variant>"))
        inner = F.get(wrapper, F.lit(0))
        wrapped = (F.size(wrapper) == 1) & F.schema_of_variant(inner).startswith("OBJECT") & (F.try_variant_get(inner, "$['@type']", "variant").isNotNull() | F.try_variant_get(inner, "$['@graph']", "variant").isNotNull())
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return (
            F.when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
            .when(graph.isNotNull(), graph)
            .when(wrapped, F.array(inner))
            .otherwise(F.array(v))
        )

    once = base.withColumn("__a", F.explode(opened(F.col("__v"))))
    twice = once.withColumn("item", F.explode(opened(F.col("__a"))))
    return twice.drop("__text", "__v", "__a")


def types(item: Column) -> Column:
    """Lower-cased ``@type`` values, one or many."""
    many = _get(item, "$['@type']", "array<string>")
    return F.transform(F.coalesce(many, F.array(_get(item, "$['@type']"))), lambda x: F.lower(x))


def is_posting(item: Column) -> Column:
    return F.coalesce(F.array_contains(types(item), "jobposting"), F.lit(False))


def is_business(item: Column) -> Column:
    return F.coalesce(F.exists(types(item), lambda t: t.isin(*fixed.BUSINESS_TYPES) | t.contains("business")), F.lit(False))


def _places(item: Column) -> Column:
    """Addresses of a job, one or many: array of structs."""
    shape = "struct<addressLocality:string,addressRegion:string,addressCountry:variant,postalCode:string>"
    many = F.try_variant_get(item, "$.jobLocation", f"array<struct<address:{shape}>>")
    one = F.try_variant_get(item, "$.jobLocation", f"struct<address:{shape}>")
    return F.filter(F.transform(F.coalesce(many, F.array(one)), lambda p: p["address"]), lambda a: a.isNotNull())


def _country(v: Column) -> Column:
    return F.coalesce(_get(v, "$.name"), _get(v, "$"))


def job_posting(item: Column) -> dict[str, Column]:
    """Job fields of a JobPosting item; null where the item has none."""
    places = _places(item)
    first = F.get(places, F.lit(0))
    line = F.transform(places, lambda a: F.concat_ws(", ", filled(a["addressLocality"]), filled(a["addressRegion"]), filled(_country(a["addressCountry"])), filled(a["postalCode"])))
    place = filled(F.array_join(F.filter(line, lambda x: x != ""), " | "))
    place = F.coalesce(place, _get(item, "$.jobLocation"))
    remote = F.coalesce(_either(item, "$.jobLocationType").rlike("(?i)telecommute|remote"), F.lit(False)) | F.try_variant_get(item, "$.applicantLocationRequirements", "variant").isNotNull()
    months = F.try_variant_get(item, "$.experienceRequirements.monthsOfExperience", "double")
    description = filled(strip_tags(_get(item, "$.description")))
    return {
        "title": _either(item, "$.title", "$.name"),
        "company": _either(item, "$.hiringOrganization.name", "$.hiringOrganization"),
        "company_logo": _either(item, "$.hiringOrganization.logo.url", "$.hiringOrganization.logo"),
        "company_website": _either(item, "$.hiringOrganization.sameAs", "$.hiringOrganization.url"),
        "company_industry": _one(item, "$.industry"),
        "department": _one(item, "$.occupationalCategory"),
        "location": F.coalesce(place, F.when(remote, "Remote")),
        "city": filled(first["addressLocality"]),
        "region": filled(first["addressRegion"]),
        "country": filled(_country(first["addressCountry"])),
        "postal_code": filled(first["postalCode"]),
        "remote_type": F.when(remote, "remote"),
        "employment_type": _one(item, "$.employmentType"),
        "salary_min": _one(item, "$.baseSalary.value.minValue"),
        "salary_max": _either(item, "$.baseSalary.value.maxValue", "$.baseSalary.value.value", "$.baseSalary.value"),
        "salary_currency": _one(item, "$.baseSalary.currency"),
        "salary_period": _one(item, "$.baseSalary.value.unitText"),
        "posted_date": _one(item, "$.datePosted"),
        "valid_through": _one(item, "$.validThrough"),
        "start_date": _one(item, "$.jobStartDate"),
        "language": _one(item, "$.inLanguage"),
        "description": description,
        "education_required": _either(item, "$.educationRequirements.credentialCategory", "$.educationRequirements.name", "$.educationRequirements"),
        "experience_years": F.coalesce(F.floor(months / 12).cast("string"), _either(item, "$.experienceRequirements.name", "$.experienceRequirements")),
        "external_id": _either(item, "$.identifier.value", "$.identifier.name", "$.identifier"),
        "apply_url": _either(item, "$.potentialAction.target.urlTemplate", "$.potentialAction.target.url", "$.potentialAction.target", "$.potentialAction[0].target.urlTemplate", "$.potentialAction[0].target", "$.applicationContact.url", "$.applicationContact.email"),
        "job_url": _one(item, "$.url"),
        "raw_jsonld": F.left(F.to_json(item), F.lit(8000)),
    }


def business(item: Column) -> dict[str, Column]:
    """Business fields of a LocalBusiness-like item."""
    street, city, region, code = (_either(item, f"$.address.{k}", f"$.address[0].{k}") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode"))
    country = _either(item, "$.address.addressCountry.name", "$.address.addressCountry.identifier", "$.address.addressCountry", "$.address[0].addressCountry")
    spec = F.try_variant_get(item, "$.openingHoursSpecification", "array<struct<dayOfWeek:variant,opens:string,closes:string>>")
    days = lambda s: F.coalesce(F.array_join(F.transform(F.try_variant_get(s["dayOfWeek"], "$", "array<string>"), lambda d: F.replace(d, F.lit("https://schema.org/"), F.lit(""))), "/"), _get(s["dayOfWeek"], "$"), F.lit(""))
    hours = F.array_join(F.transform(spec, lambda s: F.concat(days(s), F.lit(": "), F.coalesce(s["opens"], F.lit("")), F.lit("-"), F.coalesce(s["closes"], F.lit("")))), "; ")
    return {
        "name": _either(item, "$.name", "$.legalName"), "category": _one(item, "$['@type']"), "subcategories": _either(item, "$.servesCuisine", "$.category"), "description": _one(item, "$.description"),
        "address": F.coalesce(filled(F.concat_ws(", ", street, city, region, code, country)), _one(item, "$.address")), "street_address": street, "city": city, "region": region, "country": country, "postal_code": code,
        "latitude": _one(item, "$.geo.latitude"), "longitude": _one(item, "$.geo.longitude"), "phone": _either(item, "$.telephone", "$.phone"), "email": _one(item, "$.email"), "website": _either(item, "$.url", "$.sameAs"),
        "social_links": _one(item, "$.sameAs"), "rating": _one(item, "$.aggregateRating.ratingValue"), "review_count": _either(item, "$.aggregateRating.reviewCount", "$.aggregateRating.ratingCount"),
        "price_range": _one(item, "$.priceRange"), "hours": F.coalesce(filled(hours), F.array_join(_get(item, "$.openingHours", "array<string>"), "; "), _one(item, "$.openingHours")), "image": _either(item, "$.image[0]", "$.image"),
        "menu_url": _either(item, "$.hasMenu", "$.menu"), "reservation_url": _either(item, "$.acceptsReservations[0]", "$.acceptsReservations"), "raw_jsonld": F.left(F.to_json(item), F.lit(8000)),
    }


def item_list(rows: DataFrame, item: str = "item") -> DataFrame:
    """Business items of an ItemList: adds ``position`` and ``entry``."""
    lists = rows.where(F.array_contains(types(F.col(item)), "itemlist"))
    entries = F.try_variant_get(F.col(item), "$.itemListElement", "array<struct<item:variant>>")
    out = lists.select("*", F.posexplode(entries).alias("position", "__e")).withColumn("entry", F.col("__e.item")).drop("__e")
    return out.where(is_business(F.col("entry")))


def next_entry(payload: Column) -> dict[str, Column]:
    """Fields of a page payload's job entry."""
    at = lambda path: filled(F.get_json_object(payload, f"$.props.pageProps.jobEntry.{path}"))
    return {
        "title": at("title"), "company": at("company.name"), "description": strip_tags(at("description")), "posted_date": at("startDate"), "valid_through": at("endDate"), "employment_type": at("engagement_type"),
        "company_industry": at("sector"), "apply_url": at("apply.href"), "city": at("locations[0].area.name"), "postal_code": at("locations[0].zipCode"), "department": at("categories[0].name"),
    }


def balanced(text: Column, key: str) -> Column:
    """The JSON object after ``"key":`` in a longer text, by counting braces outside strings; null if it doesn't end.

    A fold over the characters from the key on, so the plan needs no Python.
    """
    start = F.instr(text, F.lit(f'"{key}":{{'))
    tail = F.substring(text, start + len(key) + 3, F.length(text))
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("stop"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["quoted"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        at = s["at"] + 1
        ended = (s["stop"] == 0) & plain & (c == "}") & (depth == 0)
        return F.struct(
            depth.alias("depth"), F.when((c == '"') & ~s["escaped"], plain).otherwise(s["quoted"]).alias("quoted"), ((c == "\\") & ~s["escaped"]).alias("escaped"), at.alias("at"), F.when(ended, at).otherwise(s["stop"]).alias("stop")
        )

    stop = F.aggregate(F.split(tail, ""), state, step, lambda s: s["stop"])
    return F.when((start > 0) & (stop > 0), F.left(tail, stop))


def advert_cards(texts: Column) -> Column:
    """Cards from attribute JSON: array of ``id, title, company, location``."""
    parsed = F.transform(texts, lambda t: F.from_json(t, "advertId string, title string, company string, location string"))
    return F.filter(F.transform(parsed, lambda p: F.struct(p["advertId"].alias("id"), clean(strip_tags(p["title"])).alias("title"), p["company"].alias("company"), p["location"].alias("location"))), lambda c: c["title"] != "")


def within_page(*strategies: dict[str, Column]) -> dict[str, Column]:
    """First strategy with a value wins, field by field."""
    names = dict.fromkeys(n for s in strategies for n in s)
    return {n: first_wins(*[s[n] for s in strategies if n in s]) for n in names}
