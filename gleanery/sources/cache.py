"""Stored responses: freshness, expiry, packed bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import block_page
from ..operators.dedup import last_wins


def fresh(rows: DataFrame, fetched: str, now: Column, ttl_seconds: int) -> DataFrame:
    """Rows fetched no longer than ``ttl_seconds`` before ``now``."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(fetched).cast("timestamp"))
    return rows.where(age <= ttl_seconds * 1_000_000)


def readable(pages: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Fresh pages that are no block pages; ``ttl_seconds`` of 0 keeps any age."""
    kept = fresh(pages, "fetched_at", now, ttl_seconds) if ttl_seconds else pages
    return kept.where(~block_page(F.col("html")))


def stored(old: DataFrame, new: DataFrame, now: Column | None = None, ttl_seconds: int = 0) -> DataFrame:
    """Pages after arriving ones replaced those of their URL; expired ones are dropped if a TTL is given."""
    merged = last_wins(old.unionByName(new), [F.col("url")], [F.col("fetched_at")])
    return fresh(merged, "fetched_at", now, ttl_seconds) if ttl_seconds else merged


def detail_pages(pages: DataFrame, marker: str = "/detail/", least: int = 5000) -> DataFrame:
    """Pages worth salvaging: their URL has ``marker``, their markup some length."""
    return pages.where(F.col("url").contains(marker) & (F.length("html") >= least))
