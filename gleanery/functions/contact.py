"""Emails, phones and names of contacts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import clean, filled, folded, ordered_uniq


def emails(text: Column, variant: str = "page") -> Column:
    """All addresses, first of each; junk is dropped by the page's or the miner's list."""
    junk = fixed.PAGE_EMAIL_JUNK if variant == "page" else fixed.MINER_EMAIL_JUNK
    return ordered_uniq(F.filter(F.regexp_extract_all(text, F.lit(f"({fixed.EMAIL})"), F.lit(1)), lambda e: ~e.rlike(f"(?i){junk}")))


def preferred_email(found: Column) -> Column:
    """An address that sounds like recruiting, else the first."""
    return F.coalesce(recruiter_email(found), F.get(found, F.lit(0)))


def recruiter_email(found: Column) -> Column:
    return F.get(F.filter(found, lambda e: e.rlike(f"(?i){fixed.RECRUITING}")), F.lit(0))


def digits(phone: Column) -> Column:
    return F.regexp_replace(phone, r"\D", "")


def page_phone_ok(phone: Column) -> Column:
    n = F.length(digits(phone))
    return n.between(8, 15) & ~phone.rlike(r"^\d{9,12}$") & ~phone.rlike(fixed.DATE_LIKE)


def valid_phone(phone: Column) -> Column:
    """Eight to fifteen digits that are no repetition, sequence, bare number of 9 to 12 digits or date."""
    own = digits(phone)
    return page_phone_ok(F.trim(phone)) & ~own.rlike(r"^(\d)\1+$") & ~own.isin(*fixed.PHONE_SEQUENCES)


def page_phones(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(folded(text), F.lit(f"({fixed.PAGE_PHONE})"), F.lit(1)), lambda p: F.trim(p))
    return ordered_uniq(F.filter(found, page_phone_ok))


def plain_phone(phone: Column) -> Column:
    """Digits, with a leading plus if there was one."""
    return F.regexp_replace(F.trim(phone), r"(?<!^)\+|[^\d+]", "")


def mined_phones(text: Column, country: Column | None = None) -> Column:
    """International or leading-zero numbers, plain and valid; Norwegian ones first where ``country`` is NO."""

    def of(pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(folded(text), F.lit(f"({pattern})"), F.lit(1)), plain_phone)

    general = of(fixed.MINER_PHONE)
    if country is not None:
        local = of(fixed.NORWEGIAN_PHONE)
        general = F.when((country == "NO") & (F.size(local) > 0), local).otherwise(general)
    return ordered_uniq(F.filter(general, valid_phone))


def contact_block(text: Column) -> Column:
    """Name, title, phone and email of a contact section."""
    text = folded(text)
    title, name = fixed.CONTACT_TITLE, fixed.CONTACT_NAME
    pair = rf"{name}\s*[,(–\-|/]\s*{title}"
    honoured = rf"\b{fixed.HONORIFIC}\s+{name}\b"
    called = F.regexp_extract(text, honoured, 2)
    called = F.when(F.regexp_extract(text, honoured, 1).startswith("Dr"), F.concat(F.lit("Dr. "), called)).otherwise(called)
    phone = filled(F.regexp_extract(text, f"({fixed.PAGE_PHONE})", 1))
    return F.struct(
        F.coalesce(filled(clean(F.regexp_extract(text, pair, 1))), filled(called)).alias("name"),
        F.coalesce(filled(clean(F.regexp_extract(text, pair, 2))), filled(clean(F.regexp_extract(text, f"(?iu){fixed.RECRUITER_TITLE}", 1)))).alias("title"),
        F.when(F.length(digits(phone)) >= 7, clean(phone)).alias("phone"),
        F.get(emails(text), F.lit(0)).alias("email"),
    )


def context(text: Column, keyword: str, before: int = 100, after: int = 800) -> Column:
    """Window of text around the first keyword, null without one."""
    at = F.regexp_instr(text, F.lit(f"(?iu){keyword}"))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.lit(before + after)))


def name_role(line: Column) -> Column:
    """Name and role of ``Name Name Role ...``: the name ends where a capitalised word begins like a role, the role at a phone or label."""
    word, low = r"[A-ZÆØÅÄÖÜ][a-zæøåäöüß'\-]+", f"(?iu:{fixed.ROLES})"
    name = F.regexp_extract(line, rf"^((?:(?!{low}){word}\s+)*(?!{low}){word})(?:\s|$)", 1)
    rest = F.trim(F.substring(line, F.length(name) + 1, F.length(line)))
    role = F.regexp_extract(rest, f"(?iu)^(.+?)\\s*{fixed.ROLE_END}", 1)
    return F.struct(filled(name).alias("name"), F.when(name != "", filled(F.left(F.regexp_replace(role, r"^[ ,;:]+|[ ,;:]+$", ""), F.lit(120)))).alias("role"))
