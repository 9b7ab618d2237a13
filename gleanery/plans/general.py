"""Business records: listing cards and detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contact, fixed, text, url
from ..functions.merge import business_fingerprint, first_wins, longest_wins
from ..operators.dedup import first_wins as first_rows
from ..sources import structured


def details(parsed: DataFrame) -> DataFrame:
    """A record per page with a name: JSON-LD businesses in order, microdata, page metadata, running text."""
    base = parsed.where(F.col("page").isNotNull())
    base = base.withColumn("page", F.col("page").withField("ld_json", F.coalesce("page.ld_json", F.array().cast("array<string>"))))
    items = structured.blocks(base.select("url", "page.ld_json"), F.col("ld_json")).where(structured.is_business(F.col("item")))
    found = items.select("url", "block", *[c.alias(k) for k, c in structured.business(F.col("item")).items()])
    names = [c for c in found.columns if c not in ("url", "block")]
    # First value of each field over the page's businesses.
    firsts = found.groupBy("url").agg(*[F.min_by(F.struct(F.col(n).alias("v")), F.struct(F.col(n).isNull(), F.col("block"))).alias(n) for n in names])
    rows = base.join(firsts.select("url", *[F.col(f"{n}.v").alias(f"ld_{n}") for n in names]), "url", "left")
    body = F.left(F.col("page.text"), F.lit(50_000))
    meta = lambda k: text.filled(F.try_element_at(F.col("page.metas"), F.lit(k)))
    prop = lambda k: text.filled(F.try_element_at(F.col("page.business_props"), F.lit(k)))
    phone, mail = F.regexp_extract(body, f"({fixed.PAGE_PHONE})", 1), F.regexp_extract(body, f"({fixed.EMAIL})", 1)
    more = {
        "name": [prop("name"), meta("og:title"), F.col("page.h1")],
        "phone": [prop("telephone"), F.when(F.length(contact.digits(phone)) >= 7, phone)],
        "email": [F.when(~mail.rlike(f"(?i){fixed.PAGE_EMAIL_JUNK}"), mail)],
        "description": [prop("description"), meta("og:description"), meta("description")],
        "image": [meta("og:image")],
        "website": [meta("og:url")],
    }
    own = {f: first_wins(*([F.col(f"ld_{f}")] if f in names else []), *more.get(f, []), F.lit("")) for f in fixed.BUSINESS_FIELDS}
    own |= {"source_url": F.col("url"), "source_domain": url.authority(F.col("url"))}
    return rows.select(*[own[f].cast("string").alias(f) for f in fixed.BUSINESS_FIELDS]).where("name is not null")


def cards(parsed: DataFrame) -> DataFrame:
    """Listing cards: businesses of item lists, else the best group of repeated elements with links.

    ``source_listing_url, position, name, source_url`` and the fields an item list has.
    """
    base = parsed.where(F.col("page").isNotNull())
    lists = structured.item_list(structured.blocks(base.select("url", F.coalesce("page.ld_json", F.array().cast("array<string>")).alias("s")), F.col("s")))
    listed = lists.select(F.col("url").alias("source_listing_url"), "position", *[c.alias(k) for k, c in structured.business(F.col("entry")).items()]).withColumn("source_url", F.col("website")).where("name is not null")
    group = F.get(F.sort_array(F.transform(F.filter("page.groups", lambda g: F.size(g["cards"]) >= 2), lambda g: F.struct(F.size(g["cards"]).alias("n"), g["cards"].alias("cards"))), asc=False), F.lit(0))
    loose = base.select("url", F.posexplode(group["cards"]).alias("position", "c")).join(listed.select(F.col("source_listing_url").alias("url")).distinct(), "url", "left_anti")
    loose = loose.select(F.col("url").alias("source_listing_url"), "position", F.col("c.title").alias("name"), F.col("c.url").alias("source_url"), F.col("c.snippet").alias("description")).where("name <> ''")
    both = listed.unionByName(loose, allowMissingColumns=True)
    key = first_wins(F.col("source_url"), F.lower(F.trim("name")))
    return first_rows(both, [F.col("source_listing_url"), key], [F.col("position")])


def run(card_rows: DataFrame, detail_rows: DataFrame, now: Column) -> DataFrame:
    """Cards with the longer values of their detail page, one of each identity, stamped."""
    right = detail_rows.select(F.col("source_url").alias("__url"), *[F.col(f).alias(f"__{f}") for f in fixed.BUSINESS_FIELDS])
    joined = card_rows.join(right, F.col("source_url") == F.col("__url"), "left")
    have = set(card_rows.columns)
    out = joined.select("position", *[longest_wins(*([F.col(f)] if f in have else []), F.col(f"__{f}")).alias(f) for f in fixed.BUSINESS_FIELDS])
    out = out.withColumn("id", business_fingerprint(*[F.col(c) for c in ("source_url", "name", "address", "phone")])).withColumn("scraped_at", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ssXXX"))
    return first_rows(out, [F.col("id")], [F.col("source_listing_url"), F.col("position")]).drop("position")
