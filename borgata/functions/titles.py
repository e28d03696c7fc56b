"""Composite titles, feature labels, keywords and language of a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from borgata.functions.numbers import to_double
from borgata.functions.text import let, strip


def _after_label(c: Column) -> Column:
    return strip(F.coalesce(F.try_element_at(F.split(c, ":"), F.lit(2)), c))


def _plain_price(c: Column) -> Column:
    bare = F.replace(F.replace(c, F.lit("€"), F.lit("")), F.lit(","), F.lit(""))
    return to_double(F.nullif(strip(bare), F.lit("")))


def split_composite_title(c: Column) -> Column:
    """``title, brand, condition, price, shipping notes`` -> struct; NULL when parts are missing."""
    parts = F.filter(F.transform(F.split(c, ", "), strip), lambda p: p != "")
    brand = _after_label(F.try_element_at(parts, F.lit(-4)))
    shipping = F.try_element_at(parts, F.lit(-1))
    lead = F.greatest(F.size(parts) - 4, F.lit(0))
    title = strip(F.array_join(F.slice(parts, F.lit(1), lead), ","))
    cut = F.instr(shipping, " ")
    whole = F.struct(
        F.when((title == "") & (brand != ""), brand).otherwise(title).alias("title"),
        brand.alias("brand"),
        _after_label(F.try_element_at(parts, F.lit(-3))).alias("condition"),
        _plain_price(F.try_element_at(parts, F.lit(-2))).alias("price"),
        _plain_price(F.substring_index(shipping, " ", 1)).alias("price_with_shipping"),
        F.substr(shipping, cut + 1).alias("notes"),
    )
    return F.when((F.size(parts) >= 4) & (cut > 0), whole)


# Label words in test order, with the field each one names.
LABEL_WORDS = [
    ("locali", ["locale"]),
    ("superficie", ["m²", "mq"]),
    ("bagni", ["bagno"]),
    ("piano", ["piano"]),
    ("ascensore", ["ascensore"]),
    ("balcone", ["balcone"]),
    ("arredato", ["arredato"]),
    ("cantina", ["cantina"]),
    ("terrazzo", ["terrazzo"]),
]


def label_field(low: Column) -> Column:
    """Field named by one feature label in lower case, by the first word it contains."""
    branch = F.when(low == "", F.lit(None).cast("string"))
    for field, words in LABEL_WORDS:
        for word in words:
            branch = branch.when(F.contains(low, F.lit(word)), field)
    return branch


def label_map(labels: Column) -> Column:
    """Struct of one label per field; the last label of a field wins."""
    lowered = F.transform(labels, lambda x: F.struct(F.lower(x).alias("l"), x.alias("v")))
    tagged = F.transform(lowered, lambda e: F.struct(label_field(e["l"]).alias("f"), e["v"].alias("v")))

    def last(entries: Column, field: str) -> Column:
        return F.try_element_at(F.filter(entries, lambda e: e["f"] == field), F.lit(-1))["v"].alias(field)

    return let(
        F.filter(tagged, lambda e: e["f"].isNotNull()),
        lambda entries: F.struct(*[last(entries, field) for field, _ in LABEL_WORDS]),
    )


# Frequent function words of the languages told apart.
STOP_WORDS = {
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "zu", "den", "von", "im", "auf"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "it", "for", "was", "with", "are", "this", "by"],
    "es": ["el", "la", "los", "las", "que", "y", "en", "un", "una", "por", "con", "para", "es", "del"],
    "fr": ["le", "la", "les", "et", "des", "une", "est", "que", "du", "dans", "pour", "qui", "sur", "au"],
    "it": ["il", "lo", "gli", "che", "di", "e", "un", "per", "non", "sono", "con", "della", "nel", "alla"],
}


def language_scores(text: Column) -> Column:
    """Struct of stop-word hits per language, counted inside the row (no shuffle)."""
    every = sorted({w for words in STOP_WORDS.values() for w in words})
    # Words of no list are dropped once, so the lists only meet the few that are left.
    known = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w.isin(every))

    def hits(words: Column, lang: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(STOP_WORDS[lang]))).cast("bigint").alias(lang)

    return let(known, lambda words: F.struct(*[hits(words, lang) for lang in STOP_WORDS]))


def detect_language(scores: dict[str, Column]) -> Column:
    """Language with most hits, first by code on ties, NULL without any hit."""
    best = F.greatest(*scores.values())
    branch = F.when(best <= 0, F.lit(None).cast("string"))
    for lang in sorted(scores):
        branch = branch.when(scores[lang] == best, lang)
    return branch
