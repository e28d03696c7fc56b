"""Store scans, searches and keyword filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.functions import text
from borgata.operators import filters, stats
from borgata.plans.base import listings, query, table, with_listings


@query("filter_order_limit", with_listings("""
SELECT id, contract, typology_name, price_value FROM listings
WHERE contract = 'rent' AND typology_name IN ('Attico', 'Villa')
ORDER BY price_value DESC NULLS LAST, id ASC LIMIT 50"""))
def filter_order_limit(spark, sf):
    df = listings(spark, sf, "id", "contract", "typology_name", "price_value")
    return filters.read_listings(
        df, {"contract": "rent", "typology_name": ["Attico", "Villa"]}, "price_value DESC, id ASC", 50
    )


@query("text_search_any", """
SELECT doc_id, source, lang FROM (SELECT *, concat(source, chr(92), lang) AS place FROM documents)
WHERE text ILIKE '%th_t%' OR place ILIKE '%th_t%' OR text ILIKE '%_1\\E%' ESCAPE '' OR place ILIKE '%_1\\E%' ESCAPE ''""")
def text_search_any(spark, sf):
    """A wildcard, and a text with a backslash."""
    df = table(spark, sf, "documents").withColumn("place", F.concat("source", F.lit("\\"), "lang"))
    found = [filters.contains_text(F.col(c), q) for q in ("th_t", "_1\\E") for c in ("text", "place")]
    return df.filter(found[0] | found[1] | found[2] | found[3]).select("doc_id", "source", "lang")


@query("range_filter", with_listings("""
SELECT id, price_value, rooms FROM listings
WHERE price_value BETWEEN 50000 AND 200000 AND rooms >= 2"""))
def range_filter(spark, sf):
    df = listings(spark, sf, "id", "price_value", "rooms")
    return filters.value_range(df, {"price_value": (50000.0, 200000.0), "rooms": (2, None)})


@query("listing_search", with_listings("""
SELECT id, price_value, rooms, bathrooms, surface_m2 FROM listings
WHERE price_value < 250000 AND rooms >= 2 AND bathrooms >= 1 AND surface_m2 >= 50
AND list_contains(list_transform(string_split(features, ','), lambda x: trim(x)), 'Terrazzo')
AND list_contains(list_transform(string_split(features, ','), lambda x: trim(x)), 'Balcone')
AND list_contains(list_transform(string_split(features, ','), lambda x: trim(x)), 'Ascensore')"""))
def listing_search(spark, sf):
    df = listings(spark, sf, "id", "price_value", "rooms", "bathrooms", "surface_m2", "features")
    df = df.withColumn("features", F.transform(F.split("features", ","), text.strip))
    found = filters.listing_search(
        df, max_price=250000, min_rooms=2, min_baths=1, min_surface=50,
        features=["Terrazzo", "Balcone", "Ascensore"],
    )
    return found.drop("features")


@query("fare_search", """
SELECT event_id, user_id % 12 AS destination_no, value AS price FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'
AND strftime(ts, '%H:%M') BETWEEN '06:30' AND '18:45' AND value <= 40 AND user_id % 12 IN (3)
AND event_type = 'purchase'""")
def fare_search(spark, sf):
    fares = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("departureTime"), F.col("value").alias("price"),
        F.col("event_type").alias("origin"), (F.col("user_id") % 12).alias("destination"),
    )
    found = filters.fare_search(
        fares, origin="purchase", date_from="2024-01-05", date_to="2024-01-20",
        time_from="06:30", time_to="18:45", max_price=40, destination=3,
    )
    return found.select("event_id", F.col("destination").alias("destination_no"), "price")


@query("optional_predicates", """
SELECT doc_id, source, n_chars FROM documents
WHERE text ILIKE '%with%' AND lang IN ('en', 'fr') AND n_chars >= 500""")
def optional_predicates(spark, sf):
    postings = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("status"), F.col("source"), F.col("n_chars").alias("salary")
    )
    found = filters.posting_search(postings, text="with", status=["en", "fr"], salary_min=500)
    return found.select("doc_id", "source", F.col("salary").alias("n_chars"))


@query("drop_nulls", with_listings("""
SELECT id, price_value, rooms, surface_m2 FROM listings
WHERE price_value IS NOT NULL AND surface_m2 IS NOT NULL"""))
def drop_nulls(spark, sf):
    df = listings(spark, sf, "id", "price_value", "rooms", "surface_m2")
    return filters.drop_nulls(df, ["price_value", "surface_m2"])


@query("filter_yield", with_listings("""
SELECT count(*) FILTER (WHERE price_value BETWEEN 50000 AND 200000) AS kept, count(*) AS total,
 round(100.0 * count(*) FILTER (WHERE price_value BETWEEN 50000 AND 200000) / count(*), 4)::DOUBLE AS percent,
 concat(printf('%.2f', 100.0 * count(*) FILTER (WHERE price_value BETWEEN 50000 AND 200000) / count(*)), '%') AS shown
FROM listings"""))
def filter_yield(spark, sf):
    df = listings(spark, sf, "price_value")
    out = stats.filter_yield(df, F.col("price_value").between(50000, 200000))
    return out.select("kept", "total", F.round("percent", 4).alias("percent"), text.percent(F.col("percent")).alias("shown"))


@query("multi_key_sort", """
SELECT p_partkey, p_brand, p_type, p_size FROM part ORDER BY p_brand, p_type, p_size, p_partkey""")
def multi_key_sort(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    return filters.order_by_text(df, "p_brand, p_type, p_size, p_partkey")


@query("keyword_include", """
SELECT doc_id, lang, 'And' AS mode FROM documents
WHERE contains(lower(text), 'of the') AND contains(lower(text), 'with')
UNION ALL
SELECT doc_id, lang, 'Or' FROM documents
WHERE len(list_filter(['of the', 'with'], lambda k: contains(lower(text), k))) > 0""")
def keyword_include(spark, sf):
    asked = '"Of the" with'
    tests = {mode: filters.has_keywords(F.col("text"), asked, mode) for mode in ("And", "Or")}
    return filters.explode_tests(table(spark, sf, "documents"), tests, "mode").select("doc_id", "lang", "mode")


@query("keyword_exclude", """
SELECT doc_id, lang, 'And' AS mode FROM documents
WHERE NOT coalesce(len(list_filter(['les', 'mit der'], lambda k: contains(lower(text), k))) > 0, false)
UNION ALL
SELECT doc_id, lang, 'Or' FROM documents
WHERE NOT coalesce(contains(lower(text), 'les') AND contains(lower(text), 'mit der'), false)""")
def keyword_exclude(spark, sf):
    asked = 'les "mit der"'
    tests = {mode: filters.lacks_keywords(F.col("text"), asked, mode) for mode in ("And", "Or")}
    return filters.explode_tests(table(spark, sf, "documents"), tests, "mode").select("doc_id", "lang", "mode")


@query("keyword_tokens", with_listings(r"""
, asked AS (SELECT id, concat('"', trim(typology_name), ' ', contract, '" ', coalesce(price_text, '-')) AS q FROM listings)
SELECT id, unnest(list_transform(regexp_extract_all(lower(q), '"[^"\n]*"|[^\t-\r ]+'),
 lambda w: CASE WHEN length(w) > 2 AND starts_with(w, '"') AND ends_with(w, '"') THEN substr(w, 2, length(w) - 2) ELSE w END)) AS keyword
FROM asked"""))
def keyword_tokens(spark, sf):
    df = listings(spark, sf, "id", "typology_name", "contract", "price_text")
    asked = F.concat(
        F.lit('"'), F.coalesce("typology_name", F.lit("")), F.lit(" "), "contract", F.lit('" '),
        F.coalesce("price_text", F.lit("-")),
    )
    return df.select("id", F.explode(text.keyword_array(asked)).alias("keyword"))


@query("blocked_page_flags", """
SELECT page_id,
 array_to_string(list_filter(['captcha', 'robot', 'automated', 'blocked', 'denied', 'access forbidden',
  'suspicious', 'unusual activity'], lambda k: contains(lower(html), k)), ',') AS found,
 CAST(contains(lower(html), 'captcha') OR contains(lower(html), 'robot') AS INT) AS short_hit
FROM pages""")
def blocked_page_flags(spark, sf):
    df = table(spark, sf, "pages")
    found = filters.block_words_found(F.col("html"))
    short = filters.block_words_found(F.col("html"), filters.BLOCK_WORDS_SHORT)
    return df.select(
        "page_id", F.array_join(found, ",").alias("found"), (F.size(short) > 0).cast("int").alias("short_hit")
    )
