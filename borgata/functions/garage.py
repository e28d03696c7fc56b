"""Garage texts such as ``1 in box privato, 2 in parcheggio/garage comune``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words that mark each kind of parking.
BOX = "box privato"
COMMON = ["parcheggio", "garage comune"]


def garage_type(c: Column) -> Column:
    low = F.lower(c)
    common = F.contains(low, F.lit(COMMON[0])) | F.contains(low, F.lit(COMMON[1]))
    return (
        F.when(F.contains(low, F.lit(BOX)), "private box")
        .when(common, "common park")
        .otherwise("no park")
    )


def _places(low: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(low, F.lit(pattern), F.lit(1))
    summed = F.aggregate(
        found, F.lit(0).cast("bigint"), lambda acc, x: acc + F.coalesce(x.try_cast("bigint"), F.lit(0))
    )
    return F.coalesce(summed, F.lit(0).cast("bigint"))


def garage_details(c: Column) -> Column:
    """Struct of primary type and place counts; NULL text counts as no parking."""
    low = F.lower(c)
    box = F.when(F.contains(low, F.lit(BOX)), _places(low, r"(\d+)\s+in\s+box\s+privato")).otherwise(
        F.lit(0).cast("bigint")
    )
    # A text with a matching count always contains the word as well.
    park = _places(low, r"(\d+)\s+in\s+parcheggio")
    primary = F.when(box > 0, "private_box").when(park > 0, "common_park").otherwise("no_park")
    return F.struct(
        primary.alias("primary_type"),
        box.alias("private_box_count"),
        park.alias("common_park_count"),
        (box + park).alias("total_count"),
    )
