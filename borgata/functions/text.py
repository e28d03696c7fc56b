"""Whitespace, tags, tokens, URLs and display text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The code points the source system counts as white space.  Java's ``\s`` leaves
# out NBSP and the other Unicode blanks, which are common in price texts.
# Single Latin-1 characters share one bit table in a Java class, and the outer range keeps all other
# characters from being tested against each wide blank.
_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WIDE_BLANKS = rf"[\x{{1680}}-\x{{3000}}&&[{_WIDE}]]"
_NARROW_BLANKS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"
BLANK_CLASS = f"[{_NARROW_BLANKS}\\x20{_WIDE_BLANKS}]"
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       "
    "         　"
)
# Texts that stand for a missing value.
MISSING_WORDS = ["nan", "None", "null"]


# A run of blanks other than one plain blank: what collapsing really changes.
_UNEVEN_BLANKS = f"[{_NARROW_BLANKS}{_WIDE_BLANKS}]{BLANK_CLASS}*| {BLANK_CLASS}+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Array functions run interpreted and evaluate a repeated argument each time; a lambda variable
    holds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK_CHARS))


def collapse(c: Column) -> Column:
    """Runs of white space become one blank; both ends trimmed."""
    return F.btrim(F.regexp_replace(c, _UNEVEN_BLANKS, " "), F.lit(" "))


def tokens(c: Column) -> Column:
    """Words between runs of white space; blank text gives an empty array."""
    # Not split(): it compiles a pattern of more than one character anew for every row.
    return F.regexp_extract_all(c, F.lit(f"[^{_NARROW_BLANKS}\\x20{_WIDE}]+"), F.lit(0))


def missing_to_null(c: Column) -> Column:
    for word in MISSING_WORDS:
        c = F.nullif(c, F.lit(word))
    return c


def clean_text(c: Column) -> Column:
    return missing_to_null(collapse(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_tags(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, "<[^>]*>", "")).otherwise(c)


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL (not '') when nothing, or nothing but blank text, matches."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_digits(c: Column) -> Column:
    bare = strip_tags(c)
    return F.coalesce(first_match(bare, r"(\d+)"), bare)


def parse_date_text(c: Column) -> Column:
    bare = strip_tags(c)
    return F.coalesce(first_match(bare, r"\d{1,2}/\d{1,2}/\d{1,4}", 0), bare)


def extract_value(c: Column, pattern: str | None = None) -> Column:
    """Group 1 of ``pattern``, else the first number, else the text itself."""
    found = F.coalesce(first_match(c, r"(\d+)"), c)
    return F.coalesce(first_match(c, pattern), found) if pattern else found


def slug(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("-"))


def zone_key(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("-"), F.lit("_"))


def id_from_url(c: Column) -> Column:
    """Last path segment, trailing slashes ignored."""
    return F.element_at(F.split(F.rtrim(c, F.lit("/")), "/"), -1)


def listing_id(c: Column) -> Column:
    """Last path segment of the address before ``?``."""
    return F.element_at(F.split(F.substring_index(c, "?", 1), "/"), -1)


def absolute_url(c: Column, host: str) -> Column:
    return F.when(c.startswith("http"), c).otherwise(F.concat(F.lit(host), c))


def feature_column_name(feature: str) -> str:
    return "has_" + feature.replace(" ", "_").lower()


def has_feature(c: Column, feature: str) -> Column:
    """1 when ``feature`` is one of the comma separated entries, else 0."""
    entries = F.transform(F.split(c, ","), strip)
    return F.coalesce(F.array_contains(entries, feature), F.lit(False)).cast("int")


def money(c: Column) -> Column:
    return F.concat(F.lit("€ "), F.format_number(c, 2))


def percent(c: Column) -> Column:
    return F.concat(F.format_string("%.2f", c), F.lit("%"))


def keyword_array(c: Column) -> Column:
    """Quoted phrases and single words of a search box text, lower case, without the quotes."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r'"[^"\n]*"|[^\t-\r ]+'), F.lit(0))
    bare = F.transform(
        raw,
        lambda w: F.when(
            (F.length(w) > 2) & w.startswith('"') & w.endswith('"'),
            F.substr(w, F.lit(2), F.length(w) - 2),
        ).otherwise(w),
    )
    return bare


def keywords(text: str) -> list[str]:
    """The same split for a search text known when the job is built."""
    pairs = re.findall(r'"(.*?)"|(\S+)', text.lower())
    return [phrase or word for phrase, word in pairs if phrase or word]
