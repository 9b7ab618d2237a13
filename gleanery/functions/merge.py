"""Merging candidate values and naming records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import filled, normal
from .url import canonical


def first_wins(*values: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[filled(v) for v in values])


def longest_wins(*values: Column) -> Column:
    """Longest value; among equals the first, null if all are empty."""
    known = [F.coalesce(v, F.lit("")) for v in values]
    return filled(F.reduce(F.array(*known), F.lit(""), lambda own, x: F.when(F.length(x) > F.length(own), x).otherwise(own)))


def merged(df: DataFrame, fields: list[str], passes: list[str], rule=longest_wins) -> DataFrame:
    """One column per field from columns ``<pass>_<field>`` of each pass, in order; absent ones are skipped."""
    have = set(df.columns)
    return df.withColumns({f: rule(*[F.col(f"{p}_{f}") for p in passes if f"{p}_{f}" in have]) for f in fields if any(f"{p}_{f}" in have for p in passes)})


def longest_by_group(df: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """Longest value per field over the rows of a group; the row with the lowest ``order`` wins ties."""
    return df.groupBy(*keys).agg(*[F.max_by(F.col(f), F.struct(F.length(F.coalesce(f, F.lit(""))), -F.col(order))).alias(f) for f in fields])


def merged_extras(*maps: Column) -> Column:
    """Union of string maps; later non-empty values win. Independent of the session's map policy."""
    start = F.expr("map()").cast("map<string,string>")

    def over(own: Column, new: Column) -> Column:
        some = F.map_filter(F.coalesce(new, start), lambda k, v: v.isNotNull() & (v != ""))
        rest = F.map_filter(own, lambda k, v: ~F.array_contains(F.map_keys(some), k))
        return F.map_concat(rest, some)

    out = start
    for m in maps:
        out = over(out, m)
    return out


def fingerprint(kind: str, apply_url: Column, job_url: Column, title: Column, company: Column, location: Column) -> Column:
    """Identity of a job record.

    ``row``: SHA-1 of the lower-cased URL as it is, title, company and location; ``dedup``: SHA-1 over canonical URL (case
    kept) and normalised parts; ``plain``: the row identity unhashed, for exchange with browser stores.
    """
    parts = [F.coalesce(x, F.lit("")) for x in (title, company, location)]
    if kind == "dedup":
        url = F.coalesce(filled(canonical(F.coalesce(apply_url, F.lit("")))), canonical(F.coalesce(job_url, F.lit(""))))
        return F.sha1(F.concat_ws("|", url, *[normal(p) for p in parts]))
    url = F.coalesce(filled(apply_url), job_url, F.lit(""))
    if kind == "plain":
        return normal(F.concat_ws("|", url, *parts))
    if kind == "row":
        return F.sha1(normal(F.concat_ws(" | ", url, *parts)))
    raise ValueError(kind)


def business_fingerprint(source_url: Column, name: Column, address: Column, phone: Column) -> Column:
    return F.sha1(normal(F.concat_ws(" | ", *[F.coalesce(x, F.lit("")) for x in (source_url, name, address, phone)])))
