"""Join-shaped steps: enrichment, salvage, rule dispatch, retry sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.merge import longest_wins


def enrich(stubs: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Every stub, each field the longer of its own and the detail's value (ties: the stub's)."""
    right = details.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return stubs.join(right, key, "left").withColumns({f: longest_wins(F.col(f), F.col(f"__{f}")) for f in fields}).drop(*[f"__{f}" for f in fields])


def url_key(url: Column) -> Column:
    """URL modulo trailing slashes."""
    return F.regexp_replace(url, "/+$", "")


def salvage(stubs: DataFrame, pages: DataFrame, stub_key: Column, page_key: Column, fields: list[str]) -> DataFrame:
    """Full outer: matched stubs are enriched, unmatched pages become rows, unmatched stubs stay.

    ``origin`` says which: ``both``, ``page`` or ``stub``.
    """
    a = stubs.select(stub_key.alias("__key"), *[F.col(f).alias(f"__a_{f}") for f in fields], F.lit(True).alias("__a"))
    b = pages.select(page_key.alias("__key"), *[F.col(f).alias(f"__b_{f}") for f in fields], F.lit(True).alias("__b"))
    origin = F.when(F.col("__a") & F.col("__b"), "both").when(F.col("__b"), "page").otherwise("stub")
    joined = a.join(b, "__key", "full_outer")
    return joined.select(F.col("__key").alias("key"), *[longest_wins(F.col(f"__a_{f}"), F.col(f"__b_{f}")).alias(f) for f in fields], origin.alias("origin"))


def dispatch(rows: DataFrame, rules: list[tuple[str, str]], text: Column, default: str) -> DataFrame:
    """Name of the first rule whose pattern occurs in ``text``. Rules are a driver list, so no join is needed."""
    found = F.lit(default)
    for pattern, name in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return rows.withColumn("rule", found)


def with_selectors(pages: DataFrame, maps: DataFrame, host: str = "host") -> DataFrame:
    """Learned selector maps by host; Spark broadcasts the map table while it is below the session's threshold."""
    return pages.join(maps, host, "left")


def zipped_pairs(rows: DataFrame, labels: str, values: str) -> DataFrame:
    """One row per position that has both a label and a value."""
    pairs = F.filter(F.arrays_zip(F.col(labels), F.col(values)), lambda p: p[labels].isNotNull() & p[values].isNotNull())
    return rows.select("*", F.posexplode(pairs).alias("position", "pair")).select(*rows.columns, "position", F.col(f"pair.{labels}").alias("label"), F.col(f"pair.{values}").alias("value"))


def mapped_labels(pairs: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Field of each label; labels without one keep null and belong to the extras."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return pairs.withColumn("field", F.try_element_at(table, F.col("label")))


def unresolved(runs: DataFrame, failures: DataFrame, key: str = "run_id") -> DataFrame:
    """URLs to try again: distinct unresolved failures of known runs."""
    return failures.where(~F.col("resolved")).join(runs.select(key), key, "left_semi").select(key, "url").distinct()


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return rows.join(seen, key, "left_anti")
