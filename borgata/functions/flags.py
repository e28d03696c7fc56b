"""Yes/no texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from borgata.functions.text import strip

# Accepted words, compared in lower case.
TRUE_WORDS = ["true", "yes", "y", "t", "sì", "si", "s", "vero", "1", "1.0"]
FALSE_WORDS = ["false", "no", "n", "f", "falso", "0", "0.0"]


def to_flag(c: Column) -> Column:
    """Dictionary match after trim and lower case; unknown words give NULL."""
    known = [(w, True) for w in TRUE_WORDS] + [(w, False) for w in FALSE_WORDS]
    meaning = F.create_map(*[F.lit(part) for pair in known for part in pair])
    return F.try_element_at(meaning, F.lower(strip(c.cast("string"))))


def feature_flag(c: Column, yes: str = "Si", no: str = "No") -> Column:
    """Substring test: contains ``yes`` -> true, contains ``no`` -> false, else NULL."""
    low = F.lower(c)
    return F.when(F.contains(low, F.lit(yes.lower())), True).when(
        F.contains(low, F.lit(no.lower())), False
    )


def detail_flag(c: Column) -> Column:
    """Flag of a detail page field: true on any yes marker, otherwise false."""
    low = F.lower(c)
    # Substrings, then whole words, that mean yes on a detail page.
    parts = ["sì", "si ", "presente", "yes"]
    words = ["si", "true"]
    test = low.isin(words)
    for part in parts:
        test = test | F.contains(low, F.lit(part))
    return test
