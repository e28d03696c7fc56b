"""Floor texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from borgata.functions.numbers import whole_number
from borgata.functions.text import strip, strip_tags

# Store floor words, tested by substring in this order.
STORE_FLOORS = [
    ("piano terra", 0),
    ("terra", 0),
    ("piano rialzato", 0),
    ("rialzato", 0),
    ("seminterrato", -1),
    ("interrato", -1),
    ("terra/rialzato", 0),
    ("ammezzato", 1),
]

# Model floor words; NULL marks a word with no single floor.
MODEL_FLOORS = [
    ("piano terra", 0.0),
    ("seminterrato", 0.0),
    ("interrato (-1)", -1.0),
    ("interrato (-2)", -2.0),
    ("interrato (-3)", -3.0),
    ("piano rialzato", 0.5),
    ("ammezzato", 0.5),
    ("su più livelli", None),
]


def floor_letter(c: Column) -> Column:
    return F.replace(strip_tags(c), F.lit("T"), F.lit("0"))


def floor_store(c: Column) -> Column:
    """First word contained wins.  'seminterrato' and 'interrato' contain 'terra', so they give 0."""
    low = F.lower(c)
    hits = [F.when(F.contains(low, F.lit(w)), F.lit(v).cast("bigint")) for w, v in STORE_FLOORS]
    return F.coalesce(*hits, whole_number(c))


def floor_fetch(c: Column) -> Column:
    digits = F.when(F.regexp_like(c, F.lit(r"^\d+$")), c).try_cast("bigint")
    ground = F.contains(c, F.lit("piano terra")) | F.contains(c, F.lit("piano rialzato"))
    return F.coalesce(digits, F.when(ground, F.lit(0).cast("bigint")))


def normalize_floor(c: Column) -> Column:
    """Exact word, else the highest of all numbers and contained words, else NULL.

    The end of a ``da X a Y`` range needs no branch of its own: a number there is among all
    numbers, and a word there is among the contained words.
    """
    low = strip(F.lower(c))
    exact = F.when(low.isNull(), F.lit(None).cast("double"))
    for word, value in MODEL_FLOORS:
        exact = exact.when(low == word, F.lit(value).cast("double"))
    digits = F.transform(
        F.regexp_extract_all(low, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("double")
    )
    words = F.array(
        *[
            F.when(F.contains(low, F.lit(w)), F.lit(v)).cast("double")
            for w, v in MODEL_FLOORS
            if v is not None
        ]
    )
    return exact.otherwise(F.array_max(F.concat(digits, words)))
