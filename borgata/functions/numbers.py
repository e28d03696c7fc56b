"""Numbers, prices and surfaces written as text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from borgata.functions.text import BLANK_CLASS, first_match, strip, strip_tags, tokens


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def whole_number(c: Column) -> Column:
    """Text of a number without a fraction as BIGINT; anything else NULL.

    Whole numbers never pass through DOUBLE, which holds them only up to 2^53; texts with a point or
    an exponent do, and only as far as DOUBLE is exact.
    """
    text = strip(c)
    d = to_double(text)
    other = F.when((d == F.floor(d)) & (F.abs(d) <= float(1 << 53)), d).try_cast("bigint")
    exact = text.try_cast("decimal(38,9)")
    whole = F.when(exact == F.floor(exact), exact).try_cast("bigint")
    return F.when(F.regexp_like(text, F.lit(r"^[+-]?\d+$")), text.try_cast("bigint")).otherwise(F.coalesce(whole, other))


def first_number(c: Column) -> Column:
    return to_double(first_match(c, r"(\d+\.?\d*)"))


def first_count(c: Column) -> Column:
    return to_long(first_match(c, r"(\d+)"))


def price_token(c: Column) -> Column:
    """Last word without tags, thousands points and decimals: ``€ 1.950`` -> ``1950``."""
    last = F.try_element_at(tokens(strip_tags(c)), F.lit(-1))
    return F.regexp_replace(last, r"(\.|,\d+)", "")


def surface_text(c: Column) -> Column:
    """Text before the first ``m``."""
    return F.substring_index(strip_tags(c), "m", 1)


def surface_first_number(c: Column) -> Column:
    return first_count(c)


def surface_first_token(c: Column) -> Column:
    """First word as a whole number, NULL if it is not one."""
    word = F.get(tokens(c), F.lit(0))
    return F.when(F.regexp_like(word, F.lit(r"^[+-]?\d+$")), word).try_cast("bigint")


# Number shapes.  The narrow one cuts 1.250.000 after its first group.
NARROW_NUMBER = r"\d+(?:[\.,]\d+)?"
FULL_NUMBER = r"\d+(?:\.\d+)*(?:,\d+)?"


def locale_number(c: Column, before: str = "", after: str = "", legacy: bool = False) -> Column:
    """Number in Italian notation between two patterns: ``1.250.000,50`` -> 1250000.5."""
    shape = NARROW_NUMBER if legacy else FULL_NUMBER
    raw = first_match(c, f"{before}({shape}){after}")
    return to_double(F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def market_price(c: Column, legacy: bool = False) -> Column:
    """Marketplace price text; a range gives its first price (NULL in legacy mode)."""
    text = c if legacy else F.regexp_replace(c, f"(?s){BLANK_CLASS}a{BLANK_CLASS}.*", "")
    kept = F.regexp_replace(text, r"[^\d,\.]", "")
    return to_double(F.replace(F.replace(kept, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def stored_price(c: Column) -> Column:
    """Price text of the store: drop the currency sign and the thousands points."""
    bare = F.replace(F.replace(c, F.lit("€"), F.lit("")), F.lit("."), F.lit(""))
    return to_double(strip(bare))


def digit_group(c: Column) -> Column:
    """First run of digits and points as a whole number; NULL when there is none."""
    return to_long(F.replace(first_match(c, r"([\d\.]+)"), F.lit("."), F.lit("")))
