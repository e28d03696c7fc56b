"""Language of a text by byte-pair profiles learnt from rows that name theirs.

A profile counts the pairs of neighbouring UTF-8 bytes in all texts of a language.  There are at most
65,536 pairs, so the table of weights is bounded by that times the languages, whatever the corpus,
and goes round as a broadcast.  Texts are exploded into pairs inside their task, meet the weights
there and are added up before the only shuffle, which moves one row of sums per text.

Sums are whole numbers, so the result does not depend on the partitioning.  Pairs that no training
row holds count for nothing; a text without any known pair has no language; equal scores go to the
first code in order.  Rows that share a key are read as one text, a NULL key included.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from borgata.operators.features import levels

#: With 65,536 pairs of 8 bytes a language, some 50 MB at most are sent round.
MAX_LANGUAGES = 100
SCALE = 1000


def byte_pairs(df: DataFrame, text: str, *columns: str) -> DataFrame:
    """(columns, pair) of all pairs of neighbouring bytes; one row without a pair for shorter texts and NULL."""
    rows = df.select(*columns, F.encode(text, "UTF-8").alias("_b"))
    last = F.octet_length("_b") - 1
    places = F.when(last >= 1, F.sequence(F.lit(1), last))
    return rows.select(*columns, "_b", F.explode_outer(places).alias("_i")).select(
        *columns, F.substring("_b", F.col("_i"), F.lit(2)).alias("pair"))


def profiles(labelled: DataFrame, text: str, lang: str, languages: Sequence[str]) -> DataFrame:
    """(pair, w_0, w_1, ...): scaled logarithm of each pair's share in each language, one more than counted."""
    each = byte_pairs(labelled.filter(F.col(lang).isin(list(languages))), text, lang)
    counts = each.filter("pair IS NOT NULL").groupBy("pair").agg(*[F.count_if(F.col(lang) == x).alias(f"c_{i}") for i, x in enumerate(languages)])
    every = Window.partitionBy()  # all 65,536 rows at most

    def weight(i: int) -> Column:
        share = (F.col(f"c_{i}") + 1).cast("double") / (F.sum(f"c_{i}").over(every) + F.count("*").over(every))
        return F.floor(F.lit(SCALE) * F.ln(share)).alias(f"w_{i}")

    return counts.select("pair", *[weight(i) for i in range(len(languages))])


def detect(df: DataFrame, labelled: DataFrame, key: str, text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, detected, lead): the most likely language of every text and by how much it leads the next."""
    found = levels(labelled, lang, MAX_LANGUAGES)
    if not found:
        return df.select(key).distinct().select(
            key, F.lit(None).cast("string").alias("detected"), F.lit(None).cast("bigint").alias("lead"))
    table = F.broadcast(profiles(labelled, text, lang, found))
    sums = byte_pairs(df, text, key).join(table, "pair", "left").groupBy(key).agg(*[F.sum(f"w_{i}").alias(f"s_{i}") for i in range(len(found))])
    # Negated, so that the first in order is the highest score and, on ties, the first code.
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"s_{i}")).alias("s"), F.lit(x).alias("lang")) for i, x in enumerate(found)]))
    known = F.col("s_0").isNotNull()
    return sums.select(key, known.alias("_known"), ranked.alias("_r")).select(
        key, F.when(F.col("_known"), F.col("_r")[0]["lang"]).alias("detected"),
        F.when(F.col("_known"), F.get("_r", F.lit(1))["s"] - F.col("_r")[0]["s"]).alias("lead"))
