"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_HEAD = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)"


def authority(url: Column) -> Column:
    """Network location as written: user info, port and case stay; empty for relative URLs."""
    return F.regexp_extract(url, _HEAD, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query_pairs(url: Column) -> Column:
    """``key=value`` items of the query string, in order; blank values stay, empty items go."""
    text = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    return F.filter(F.split(text, "&"), lambda x: x != "")


def _coded(x: Column) -> Column:
    plain = F.coalesce(F.try_url_decode(x), x)
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes; the query is decoded and encoded again."""
    own = F.filter(query_pairs(url), lambda x: ~F.lower(F.coalesce(F.try_url_decode(F.substring_index(x, "=", 1)), x)).isin(*fixed.TRACKING))
    pairs = F.transform(own, lambda x: F.concat(_coded(F.substring_index(x, "=", 1)), F.lit("="), _value(x)))
    query = F.array_join(pairs, "&")
    front = F.regexp_extract(url, r"^[^?#]*", 0)
    return F.regexp_replace(F.concat(front, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")), "/+$", "")


def _value(x: Column) -> Column:
    return _coded(F.regexp_extract(x, r"^[^=]*=?(.*)$", 1))


def country_hint(url: Column) -> Column:
    host = F.lower(authority(url))
    return (
        F.when(host.endswith(".no") | host.contains("nav.no"), "NO")
        .when(host.endswith(".de") | host.contains("arbeitsagentur"), "DE")
        .when(host.endswith(".ch") | host.contains("jobs.ch"), "CH")
        .when(host.endswith(".se"), "SE")
        .when(host.endswith(".dk"), "DK")
        .when(host.endswith(".fi"), "FI")
    )


def is_junk(url: Column) -> Column:
    """Empty, root, or a path that is never a job page."""
    own = path(url)
    return F.coalesce((url == "") | (own == "") | (own == "/") | own.rlike(f"(?i){fixed.NON_JOB_PATH}"), F.lit(True))


def is_sitemap_job(url: Column) -> Column:
    return url.rlike(f"(?i){fixed.SITEMAP_PATH}")


def first_rule(text: Column, rules) -> Column:
    """Name of the first rule whose pattern is found, or null."""
    found = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def adapter(url: Column) -> Column:
    """Source adapter by host, ``generic`` without a match."""
    return F.coalesce(first_rule(F.lower(authority(url)), fixed.ADAPTER_HOSTS), F.lit("generic"))


def discovered(url: Column) -> Column:
    """Hiring system by host, or null."""
    return first_rule(F.lower(authority(url)), fixed.DISCOVERY_HOSTS)


def best_job_url(*candidates: Column) -> Column:
    """First candidate that is not junk, else the last one."""
    kept = F.filter(F.array(*candidates), lambda u: u.isNotNull() & (u != "") & ~is_junk(u))
    return F.coalesce(F.get(kept, F.lit(0)), candidates[-1])


def first_segment(url: Column) -> Column:
    return F.split_part(F.regexp_replace(path(url), "^/+", ""), F.lit("/"), F.lit(1))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def allowed(host: Column, domains: list[str]) -> Column:
    """Host equals a domain or lies below it, ``www.`` and port aside; an empty list allows all."""
    if not domains:
        return F.lit(True)
    bare = F.regexp_replace(F.lower(host), r"^www\.|:\d+$", "")
    hit = F.lit(False)
    for d in domains:
        d = d.lower().removeprefix("www.").split(":")[0]
        hit = hit | (bare == d) | bare.endswith("." + d)
    return hit


def next_page(url: Column, parameter: str, step: int = 1) -> Column:
    """The same URL with its page parameter raised by ``step`` (2 if it has none)."""
    pattern = rf"([?&]{parameter}=)(\d+)"
    number = F.regexp_extract(url, pattern, 2)
    raised = F.concat(F.regexp_extract(url, rf"^(.*[?&]{parameter}=)\d+", 1), (F.try_to_number(number, F.lit("999999999")).cast("long") + step).cast("string"), F.regexp_extract(url, rf"[?&]{parameter}=\d+(.*)$", 1))
    return F.when(number != "", raised).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit(f"{parameter}={1 + step}")))
