"""Searching, sorting and paging stored records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(rows: DataFrame, columns: list[str], text: str = "", where: dict[str, object] | None = None) -> DataFrame:
    """Rows where any column contains ``text`` (ignoring case) and every column of ``where`` equals its value."""
    out = rows
    for column, value in (where or {}).items():
        out = out.where(F.lower(F.col(column)) == value.lower() if isinstance(value, str) else F.col(column) == value)
    low = text.strip().lower()
    if not low:
        return out
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(low))
    return out.where(hit)


def sort_key(column: str) -> list[Column]:
    """Newest first for times, else by lower-cased text; callers add an id to break ties."""
    return [F.col(column).desc()] if column.endswith("_at") else [F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))]


def page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """A window of the ordered rows. Spark keeps ``offset + size`` rows per task, not the whole table."""
    return rows.orderBy(*order).offset(offset).limit(size)


def exported(rows: DataFrame, filtered: DataFrame) -> DataFrame:
    """The filtered rows, or all of them if the filter leaves none."""
    none = filtered.limit(1).agg((F.count(F.lit(1)) == 0).alias("__none"))
    return filtered.unionByName(rows.crossJoin(none).where("__none").drop("__none"))
