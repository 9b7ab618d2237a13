"""Order-aware deduplication and upserts.

Survivors are chosen by explicit order columns, never by partition order. Where only one row of a group is wanted, an
aggregate with ``min_by``-style ordering is used instead of a window: it combines before the shuffle, so a hot key
doesn't gather its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, key: list[Column], order: list[Column], largest: bool) -> DataFrame:
    names = [f"__k{i}" for i in range(len(key))]
    row, rank = F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)
    best = (F.max_by if largest else F.min_by)(row, rank).alias("__row")
    return df.groupBy(*[k.alias(n) for k, n in zip(key, names, strict=True)]).agg(best).select("__row.*")


def first_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The row that comes first in ``order`` of each key; nulls are a key of their own."""
    return _pick(df, key, order, False)


def last_wins(df: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    return _pick(df, key, order, True)


def upsert(stored: DataFrame, arriving: DataFrame, key: str, order: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Arriving rows replace stored ones of their key whole, except that columns of the user (``keep``) stay.

    Of several arriving rows with a key, the last in ``order`` counts.
    """
    new = last_wins(arriving, [F.col(key)], [F.col(order)])
    if keep:
        old = stored.select(key, *[F.col(c).alias(f"__{c}") for c in keep])
        new = new.join(old, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in keep}).drop(*[f"__{c}" for c in keep])
    return stored.join(new, key, "left_anti").unionByName(new)


def fallback_union(*stages: DataFrame, key: str, at_least: int = 1) -> DataFrame:
    """Rows of the first stage that has ``at_least`` rows for a key; of the last stage if none has."""
    tagged = [s.withColumn("__stage", F.lit(i)) for i, s in enumerate(stages)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    counts = rows.groupBy(key, "__stage").count()
    last = len(stages) - 1
    chosen = counts.where((F.col("count") >= at_least) | (F.col("__stage") == last)).groupBy(key).agg(F.min("__stage").alias("__stage"))
    return rows.join(chosen, [key, "__stage"], "left_semi").drop("__stage")


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids, key, "left_anti")
