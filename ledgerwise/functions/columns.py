"""Column functions: null-safe arithmetic, clamps, names, money, addresses, specialties, keyword severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Peers a fine group needs before its own statistics count.
MIN_PEERS = 10


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a, b, fill: float | None = 0.0) -> Column:
    """a / b; where b is 0 or either is null, fill."""
    out = F.try_divide(_col(a).cast("double"), _col(b).cast("double"))
    return out if fill is None else F.coalesce(out, F.lit(fill))


def clip(c, low: float | None = None, high: float | None = None) -> Column:
    """c within the bounds; a null or NaN stays null."""
    out = F.nanvl(_col(c).cast("double"), F.lit(None).cast("double"))
    value = out
    if low is not None:
        value = F.greatest(value, F.lit(float(low)))
    if high is not None:
        value = F.least(value, F.lit(float(high)))
    return F.when(out.isNotNull(), value)


def display_name(first, last, fallback) -> Column:
    return F.coalesce(F.nullif(F.trim(F.concat_ws(" ", F.trim(_col(first)), F.trim(_col(last)))), F.lit("")), _col(fallback).cast("string"))


def title_case(c) -> Column:
    """Each run of letters with a capital first and small letters after: O'Neil, Mc-Donald, 3M."""
    runs = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substr(r, F.lit(2)))), "")


def money(c) -> Column:
    """$1.25M, $3.4K or $950."""
    c = _col(c).cast("double")
    millions = F.concat(F.lit("$"), F.format_number(F.round(c / 1e6, 2), 2), F.lit("M"))
    thousands = F.concat(F.lit("$"), F.format_number(F.round(c / 1e3, 1), 1), F.lit("K"))
    return F.when(c >= 1e6, millions).when(c >= 1e3, thousands).otherwise(F.concat(F.lit("$"), F.format_number(F.round(c), 0)))


def whole_money(c) -> Column:
    """$1,250,000"""
    return F.concat(F.lit("$"), F.format_number(F.round(_col(c).cast("double")), 0))


def zero_filled(c, width: int = 10) -> Column:
    """Leading zeros up to width; longer values stay whole."""
    c = F.trim(_col(c).cast("string"))
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, "0"))


#: Street words and their short forms. Fixed values.
SUFFIXES = [
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"), ("lane", "ln"), ("court", "ct"),
    ("place", "pl"), ("highway", "hwy"), ("parkway", "pkwy"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
]


def address_key(street, city, state, zip_code) -> Column:
    """street|city|ST|zip5 in one spelling, without the unit; null if fewer than four characters of street are left."""
    s = F.regexp_replace(F.lower(F.trim(_col(street))), r"[.,]", " ")
    s = F.regexp_replace(s, r"\b(suite|ste|unit|apt|apartment|room|rm|floor|fl)\b\.?\s*#?\s*[\w-]+", " ")
    s = F.regexp_replace(s, r"(#|\bno\b)\s*\d[\w-]*", " ")
    for word, short in SUFFIXES:
        s = F.regexp_replace(s, rf"\b{word}\b", short)
    s = F.trim(F.regexp_replace(s, r"\s+", " "))
    town = F.trim(F.regexp_replace(F.lower(F.coalesce(_col(city), F.lit(""))), r"\s+", " "))
    key = F.concat_ws("|", s, town, F.upper(F.trim(F.coalesce(_col(state), F.lit("")))), F.substring(F.regexp_replace(F.coalesce(_col(zip_code), F.lit("")), r"\D", ""), 1, 5))
    return F.when(F.length(s) >= 4, key)


def canonical(value, names: dict[str, str], default: str = "unknown") -> Column:
    """Lower-cased, trimmed and looked up; unlisted values stay, empty ones become the default."""
    v = F.lower(F.trim(F.coalesce(_col(value), F.lit(""))))
    if names:
        table = F.create_map(*(F.lit(x) for kv in sorted(names.items()) for x in kv))
        v = F.coalesce(F.try_element_at(table, v), v)
    return F.when(v == "", F.lit(default)).otherwise(v)


def phrase_found(text, phrase: str, negations: list[str], reach: int = 20) -> Column:
    """Whether phrase occurs with no negation phrase at the end of the `reach` characters before it.

    Each occurrence is judged for itself: the text is cut at the phrase, and all pieces but the last
    are what stands before one.
    """
    pieces = F.split(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(rf"\Q{phrase.lower()}\E"), -1)
    before = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    ends = rf"(?s)({'|'.join(rf'\Q{n.lower()}\E' for n in negations) or '(?!)'})\s*$"
    return F.exists(before, lambda p: ~F.when(F.length(p) > reach, F.substring(p, -reach, reach)).otherwise(p).rlike(ends))


def keyword_severity(text, buckets: list[tuple[str, list[str]]], negations: list[str], default: str = "info", reach: int = 20) -> Column:
    """The first bucket with a phrase that isn't negated."""
    out = F.lit(default)
    for name, phrases in reversed(buckets):
        out = F.when(reduce(lambda a, b: a | b, (phrase_found(text, p, negations, reach) for p in phrases)), name).otherwise(out)
    return out


def matched_phrases(text, buckets: list[tuple[str, list[str]]], negations: list[str], reach: int = 20) -> Column:
    every = [F.when(phrase_found(text, p, negations, reach), F.lit(p)) for _, phrases in buckets for p in phrases]
    return F.filter(F.array(*every), lambda p: p.isNotNull())
