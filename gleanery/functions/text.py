"""Text expressions: white space, keywords, ordered lists, labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

SPACE = r"(?U)\s+"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; Unicode spaces count."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def normal(text: Column) -> Column:
    return clean(F.lower(text))


def filled(value: Column) -> Column:
    """Null for empty strings."""
    return F.nullif(value, F.lit(""))


def bound(value: Column, make) -> Column:
    """``make(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


#: Unicode spaces other than the plain one, and line separators.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u0085"


def folded(text: Column) -> Column:
    """Every Unicode space as a plain one, so that patterns need no Unicode classes, which cost several times as much."""
    return F.translate(text, SPACES, " " * len(SPACES))


def blob(*parts: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def _word(word: str) -> str:
    return rf"(?U)\b{re.escape(word)}\b"


def matches(text: Column, word: str, letters: str | None = None) -> Column:
    """Words of up to three characters match whole, longer ones anywhere. ``text`` is lower-cased already.

    What may not stand beside a whole word are Unicode's word characters, or the class ``letters`` alone. A substring test goes
    before the pattern.
    """
    low = word.strip().lower()
    whole = _word(low) if letters is None else rf"(?<![{letters}]){re.escape(low)}(?![{letters}])"
    there = F.contains(text, F.lit(low))
    return there & text.rlike(whole) if len(low) <= 3 else there


def matched_keywords(text: Column, keywords: list[str], letters: str | None = None) -> Column:
    """Keywords found, in list order."""
    return F.array_compact(F.array(*[F.when(matches(text, k, letters), F.lit(k.strip())) for k in keywords if k and k.strip()]))


def located(text: Column, includes: list[str], excludes: list[str] = (), strict_exclude: bool = False) -> Column:
    """Any include occurs as a word. Excludes reject only if ``strict_exclude``; otherwise an include outweighs them."""

    def any_of(words):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.rlike(_word(w.strip().lower()))
        return hit

    found = any_of(includes) if includes else F.lit(True)
    return found & ~any_of(excludes) if strict_exclude and excludes else found


def ordered_uniq(values: Column) -> Column:
    """First of each value, compared without case; empty values go.

    Values are sorted by (lower case, position), the first of each run stays, and those go back to their order: n log n.
    A column that is used inside a lambda is computed anew for each element, so the sorted array is bound to a variable.
    """
    kept = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    by_value = F.sort_array(F.transform(kept, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("own"))))
    firsts = F.transform(F.array(by_value), lambda s: F.filter(s, lambda x, i: (i == 0) | (x["low"] != F.get(s, i - 1)["low"])))
    back = F.sort_array(F.transform(F.get(firsts, F.lit(0)), lambda x: F.struct(x["at"], x["own"])))
    return F.transform(back, lambda x: x["own"])


def dictionary_hits(text: Column, terms: list[str]) -> Column:
    """Terms bounded by characters other than a-z and 0-9, in dictionary order. ``text`` is lower-cased already.

    A substring test goes before each pattern, so texts without a term cost no regular expression.
    """
    hits = [F.when(F.contains(text, F.lit(t)) & text.rlike(rf"(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)"), F.lit(t)) for t in dict.fromkeys(terms)]
    return F.array_compact(F.array(*hits))


def first_rule(text: Column, rules) -> Column:
    """Name of the first ``(name, pattern)`` found anywhere, ignoring case."""

    def first(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            out = F.when(t.rlike(f"(?iu){pattern}"), name).otherwise(out)
        return out

    return bound(folded(text), first)


def seniority(text: Column) -> Column:
    return first_rule(text, fixed.SENIORITY)


def workplace(text: Column) -> Column:
    return first_rule(text, fixed.WORKPLACE)


def flag(text: Column, name: str) -> Column:
    return F.when(folded(text).rlike(f"(?iu){fixed.FLAGS[name]}"), "yes")


def section_kind(heading: Column) -> Column:
    return first_rule(heading, [(k, rf"\b(?:{p})") for k, p in fixed.SECTION_HEADS.items()])


def education(text: Column) -> Column:
    return filled(clean(F.regexp_extract(folded(text), f"(?iu){fixed.EDUCATION}", 1)))


def experience_years(text: Column) -> Column:
    return bound(folded(text), lambda t: F.coalesce(*[filled(F.regexp_extract(t, rf"(?iu)\b{p}", 1)) for p in fixed.EXPERIENCE]))


def hiring_manager(text: Column) -> Column:
    return filled(clean(F.regexp_extract(folded(text), fixed.MANAGER, 1)))


def clean_title(title: Column) -> Column:
    """Without the names of known sites at either end."""
    return clean(F.regexp_replace(F.regexp_replace(title, fixed.TITLE_SUFFIX, ""), fixed.TITLE_PREFIX, ""))


def postal_city(location: Column) -> Column:
    """``postal_code`` and ``city`` from ``street, 1234 City``; else the part after the last comma."""
    code = filled(F.regexp_extract(location, r"(?U)\b(\d{4})\b", 1))
    city = filled(F.regexp_extract(location, r"(?U)\b\d{4}\s+([A-Za-zÆØÅæøåäöü\-]+)", 1))
    return F.struct(code.alias("postal_code"), F.coalesce(city, F.trim(F.substring_index(location, ",", -1))).alias("city"))


def strip_tags(html: Column) -> Column:
    """Text of a small HTML fragment by expression: tags become spaces, references are decoded."""
    return clean(unescaped(F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")))


def _references() -> tuple[dict[str, str], dict[int, str]]:
    """Named references of HTML, and what numbers of control characters stand for: those of the Windows code page."""
    from html.entities import html5

    old = {n: bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")}, {n: c for n, c in old.items() if c != "\ufffd"}


NAMED, NUMBERED = _references()


def unescaped(text: Column) -> Column:
    """Text with character references decoded: all named ones and numbers, decimal or hexadecimal; others stay as they are.

    Only what follows an ampersand is looked at, so texts without one cost no lookup.
    """
    # One string to search: a map as a constant would be compared entry by entry in every step of planning.
    listed = F.lit("\x00" + "\x00".join(f"{k}\x01{v}" for k, v in NAMED.items()) + "\x00")

    def meaning(name: Column) -> Column:
        key = F.concat(F.lit("\x00"), name, F.lit("\x01"))
        at = F.instr(listed, key)
        return F.when(at > 0, F.substring_index(F.substring(listed, at + F.length(key), F.lit(4)), "\x00", 1))


    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^(#[xX][0-9A-Fa-f]{1,7}|#[0-9]{1,8}|[A-Za-z][A-Za-z0-9]{1,40});", 1)
        number = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 8), 16, 10)).when(name.startswith("#"), F.substring(name, 2, 9)).cast("long")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        sign = F.when(number.isNotNull(), F.when(valid, F.translate(plain, "".join(map(chr, NUMBERED)), "".join(NUMBERED.values()))).otherwise("\ufffd")).when(name != "", meaning(name))
        return F.when(sign.isNotNull(), F.concat(sign, F.substring(piece, F.length(name) + 2, F.length(piece)))).otherwise(F.concat(F.lit("&"), piece))

    def whole(t: Column) -> Column:
        return F.array_join(F.transform(F.split(t, "&"), lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")

    return bound(text, lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t))


def condensed(html: Column, limit: int | None = None) -> Column:
    """Markup without scripts, styles and drawings, collapsed; whole, or cut with a marker."""
    bare = clean(F.regexp_replace(html, r"(?is)<(script|style|noscript|iframe|svg)\b.*?</\1\s*>", ""))
    return bare if limit is None else F.when(F.length(bare) > limit, F.concat(F.left(bare, F.lit(limit)), F.lit(" …"))).otherwise(bare)


def labelled_value(text: Column, label: str, value: str) -> Column:
    """Value after ``label:`` in running text, if it has the form ``value`` (one group)."""
    found = F.trim(F.regexp_extract(folded(text), rf"(?iu)\b{label}\b\s*:?\s*{value}", 1))
    return bound(found, lambda v: F.when((v != "") & (F.length(v) < 100) & ~F.lower(v).isin("none", "null", "n/a"), v))


def employer_in(description: Column) -> Column:
    """Employer named at the start of a description, null if what follows is no name of one to eight words."""
    name = F.rtrim(F.regexp_extract(clean(description), fixed.EMPLOYER, 1), F.lit(",."))
    return bound(name, lambda v: F.when((v != "") & (F.size(F.split(v, " ")) <= 8) & ~v.rlike(f"(?iU){fixed.EMPLOYER_REJECT}"), F.trim(v)))


def has_inline_labels(text: Column) -> Column:
    labels = dict.fromkeys(label for label, _, _ in fixed.INLINE_LABELS)
    return text.rlike(rf"(?iu)\b(?:{'|'.join(labels)})")


def inline_labels(text: Column) -> dict[str, Column]:
    """Fields by labels in running text: of each field the first label whose value has its form and is no label itself."""
    found: dict[str, list[Column]] = {}
    for label, field, value in fixed.INLINE_LABELS:
        own = F.regexp_replace(labelled_value(text, label, value), r"^[ \t:\-—,;]+|[ \t:\-—,;]+$", "")
        found.setdefault(field, []).append(bound(own, lambda v: F.when((v != "") & ~v.rlike(f"(?iU){fixed.LABEL_ALONE}"), v)))
    return {field: F.coalesce(*values) for field, values in found.items()}


def company_of_card(current: Column, logo: Column, title: Column, named: Column) -> Column:
    """Company of a fact-card page: the one found unless it is no company's name, else the logo's text, the title before its dash, the element that names one."""

    def good(name: Column, most: int) -> Column:
        return F.length(name).between(2, most)

    bad = f"(?iU){fixed.NO_COMPANY}"
    prefix = F.trim(F.substring_index(title, " - ", 1))
    return F.coalesce(
        F.when((filled(current).isNotNull()) & ~current.rlike(bad), current),
        F.when(good(clean(logo), 80) & ~logo.rlike(bad), clean(logo)),
        F.when(F.contains(title, F.lit(" - ")) & good(prefix, 60) & ~prefix.rlike(r"\d"), prefix),
        F.when(good(clean(named), 80) & ~named.rlike(bad), clean(named)),
        filled(current),
    )


def deadline(value: Column) -> Column:
    return F.when(clean(value).rlike(fixed.DEADLINE), clean(value))
