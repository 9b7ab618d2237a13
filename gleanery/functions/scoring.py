"""Page predicates and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .url import first_rule, path


def count_hits(text: Column, words) -> Column:
    """How many of some lower-case strings occur."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def block_page(html: Column) -> Column:
    """Empty, a short page with a block text, or a very short error page without structured data."""
    low = F.lower(F.coalesce(html, F.lit("")))
    n = F.length(low)
    short = (n < 5000) & (count_hits(low, fixed.BLOCK_WORDS) > 0)
    error = (n < 1500) & ~F.contains(low, F.lit("<jobposting")) & ~F.contains(low, F.lit("schema.org")) & F.contains(low, F.lit("<title>")) & F.contains(low, F.lit("error"))
    return (low == "") | short | error


def likely_job_page(url: Column, heading: Column, text: Column) -> Column:
    """Generic headings reject; a path token accepts; else two text signals do."""
    generic = F.lower(F.coalesce(heading, F.lit(""))).isin(*fixed.GENERIC_HEADINGS)
    return ~generic & ((count_hits(F.lower(path(url)), fixed.JOB_PATHS) > 0) | (count_hits(F.lower(text), fixed.JOB_SIGNALS) >= 2))


def looks_like_job_page(url: Column, text: Column) -> Column:
    return (count_hits(F.lower(path(url)), fixed.UNIVERSAL_PATHS) > 0) | (count_hits(F.lower(text), fixed.UNIVERSAL_SIGNALS) >= 2)


def hiring_system(html: Column) -> Column:
    """First hiring system named in the first 200,000 characters."""
    return first_rule(F.lower(F.left(html, F.lit(200_000))), fixed.ATS_IN_PAGE)


def detection(url: Column, text: Column, html: Column, has_posting: Column, has_microdata: Column) -> Column:
    """``is_job, confidence, reasons, ats``: a weighted sum capped at 1, a job page from 0.6."""
    hits = F.lit(0)
    for p in fixed.CONFIDENCE_TEXT:
        hits = hits + text.rlike(f"(?i){p}").cast("int")
    on_path, ats = path(url).rlike(f"(?i){fixed.CONFIDENCE_PATH}"), hiring_system(html)
    score = F.when(has_posting, 1.0).otherwise(0.0)
    score = F.when(has_microdata, F.greatest(score, F.lit(0.9))).otherwise(score)
    score = score + F.when(on_path, 0.3).otherwise(0.0) + F.least(F.lit(0.4), hits * 0.08) + F.when(ats.isNotNull(), 0.3).otherwise(0.0)
    reasons = F.array_compact(
        F.array(
            F.when(has_posting, "jsonld:JobPosting"), F.when(has_microdata, "microdata:JobPosting"), F.when(on_path, "url:job-path"),
            F.when(hits > 0, F.concat(F.lit("text:"), hits.cast("string"))), F.concat(F.lit("ats:"), ats),
        )
    )
    total = F.round(score, 6)
    return F.struct((total >= 0.6).alias("is_job"), F.least(F.lit(1.0), total).alias("confidence"), reasons.alias("reasons"), ats.alias("ats"))


def old_detection(url: Column, text: Column, html: Column, has_posting: Column, has_microdata: Column, adverts: Column) -> Column:
    """``is_job, confidence``: the older weighted sum, a job page from 0.7: hosts of aggregators, searches and adverts count too."""
    host, hits = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(0)
    for p in fixed.CONFIDENCE_TEXT:
        hits = hits + text.rlike(f"(?iU){p}").cast("int")
    score = F.when(host.rlike(f"(?i){fixed.OLD_AGGREGATORS}"), 0.7).otherwise(0.0) + F.when(has_posting, 1.0).otherwise(0.0)
    score = F.when(has_microdata, F.greatest(score, F.lit(0.9))).otherwise(score)
    score = score + F.when(path(url).rlike(f"(?i){fixed.OLD_PATH}"), 0.4).when(url.rlike(f"(?i){fixed.OLD_QUERY}"), 0.2).otherwise(0.0)
    score = score + F.when(adverts > 0, 0.5).otherwise(0.0) + F.least(F.lit(0.4), hits * 0.08) + F.when(hiring_system(html).isNotNull() | F.lower(html).contains("workday.com"), 0.3).otherwise(0.0)
    total = F.round(score, 6)
    return F.struct((total >= 0.7).alias("is_job"), F.least(F.lit(1.0), total).alias("confidence"))


def filled_count(fields: list[str]) -> Column:
    """How many of some columns have a value."""
    total = F.lit(0)
    for f in fields:
        total = total + (F.coalesce(F.col(f), F.lit("")) != "").cast("int")
    return total
