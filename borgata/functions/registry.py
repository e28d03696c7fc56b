"""The scalar expressions as temporary SQL functions, for users who write SQL.

Each body is plain SQL, so Catalyst inlines it: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from borgata.functions import text

# Each body says what the Column function of its name says; a test holds the two side by side.
_BLANK = text.BLANK_CLASS.replace("\\", "\\\\")
_STRIP_X = f"regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '')"
_BODIES = {
    "strip_tags(t STRING) RETURNS STRING": "regexp_replace(t, '<[^>]*>', '')",
    "first_number(t STRING) RETURNS DOUBLE":
        r"try_cast(nullif(regexp_extract(t, '(\\d+\\.?\\d*)', 1), '') AS DOUBLE)",
    "listing_id(u STRING) RETURNS STRING": "element_at(split(substring_index(u, '?', 1), '/'), -1)",
    "slug(t STRING) RETURNS STRING": "replace(lower(t), ' ', '-')",
    "garage_type(t STRING) RETURNS STRING":
        "CASE WHEN lower(t) LIKE '%box privato%' THEN 'private box' "
        "WHEN lower(t) LIKE '%parcheggio%' OR lower(t) LIKE '%garage comune%' THEN 'common park' "
        "ELSE 'no park' END",
    "has_feature(t STRING, f STRING) RETURNS INT":
        f"CAST(coalesce(array_contains(transform(split(t, ','), x -> {_STRIP_X}), f), false) AS INT)",
    "haversine_km(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE":
        "12742 * asin(sqrt(CASE WHEN {0} > 1 THEN 1D ELSE {0} END))".format(
            "(pow(sin((radians(c) - radians(a)) / 2), 2) "
            "+ cos(radians(a)) * cos(radians(c)) * pow(sin((radians(d) - radians(b)) / 2), 2))"),
}


def register_sql_functions(spark: SparkSession) -> list[str]:
    names = []
    for signature, body in _BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
        names.append(signature.split("(", 1)[0])
    return names
