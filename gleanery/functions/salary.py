"""Salary ranges in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import bound, clean, filled, folded


def amount(text: Column) -> Column:
    """Digits without thousands separators; one or two decimals are dropped."""
    bare = F.regexp_replace(clean(text), r"[.,]\s*[–—\-]\s*$", "")
    whole = F.regexp_extract(bare, r"^(\d{1,3}(?:[.,'\s]\d{3})*)(?:[.,]\d{1,2})?$", 1)
    return F.regexp_replace(F.when(whole != "", whole).otherwise(bare), r"[.,'\s–—\-]", "")


def salary(text: Column) -> Column:
    """``low, high, currency, period`` of the first range found; nulls without one.

    Period words are read as they always were: a word that holds ``hr`` (so ``Jahr`` too) is an hour, ``mo`` alone a year.
    """
    pattern = (
        rf"(?iu)({fixed.CURRENCY})\s?({fixed.AMOUNT})\s?(?:[.,]–|–|\.-|-|—)?\s?(?:k\b|tausend|thousand)?\s?(?:-|–|—|to|bis|à|a)?\s?"
        rf"{fixed.CURRENCY}?\s?({fixed.AMOUNT})?\s?(?:[.,]–|–|—|\.-)?\s?(per|/|pro|par|al)?\s?{fixed.PERIOD}"
    )

    def read(t: Column) -> Column:
        whole, period = F.regexp_extract(t, pattern, 0), F.lower(F.regexp_extract(t, pattern, 5))
        money = F.lit(None).cast("string")
        for signs, code in reversed((("€|EUR", "EUR"), (r"\$|USD", "USD"), ("£|GBP", "GBP"), (r"CHF|Fr\.", "CHF"), ("SEK", "SEK"))):
            money = F.when(whole.rlike(f"(?i){signs}"), code).otherwise(money)
        unit = F.when(period.rlike("month|monat|mois"), "month").when(period.rlike("hour|hr|stunde|heure|ora"), "hour").when(period != "", "year")
        return F.struct(
            filled(amount(F.regexp_extract(t, pattern, 2))).alias("low"),
            filled(amount(F.regexp_extract(t, pattern, 3))).alias("high"),
            money.alias("currency"),
            unit.alias("period"),
        )

    # Only from the first range on: the other groups are read from that short piece.
    return bound(F.regexp_extract(folded(text), f"(?s){pattern}", 0), read)


def display(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """``low-high currency / period`` as one string; empty without a lower bound."""
    tail = F.concat(F.lit(" "), F.coalesce(currency, F.lit("")), F.lit(" / "), F.coalesce(period, F.lit("")))
    return F.when(filled(low).isNull(), "").otherwise(F.trim(F.concat(F.when(filled(high).isNotNull(), F.concat(low, F.lit("-"), high)).otherwise(low), tail)))


def grade_range(grades: Column) -> Column:
    """``60–80%`` from an array of percentages, ``80%`` if they agree."""
    low, high = F.array_min(grades).cast("string"), F.array_max(grades).cast("string")
    return F.when(low == high, F.concat(low, F.lit("%"))).otherwise(F.concat(low, F.lit("–"), high, F.lit("%")))
