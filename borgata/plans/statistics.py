"""Counts, descriptive statistics, percentiles, histogram."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.functions import text
from borgata.operators import stats
from borgata.plans.base import listings, query, table, with_listings
from borgata.sources import catalog


@query("count_by_type", with_listings("""
SELECT typology_name, count(*) AS n FROM listings GROUP BY typology_name"""))
def count_by_type(spark, sf):
    return stats.value_counts(listings(spark, sf, "typology_name"), "typology_name")


@query("top_cities", with_listings("""
SELECT city, count(*) AS n FROM listings WHERE city IS NOT NULL GROUP BY city ORDER BY n DESC, city LIMIT 10"""))
def top_cities(spark, sf):
    return stats.top_values(listings(spark, sf, "city"), "city", 10)


@query("avg_price_by_type", with_listings("""
SELECT typology_name, round(avg(TRY_CAST(trim(replace(replace(replace(price_text, '€', ''), '.', ''), chr(160), ' ')) AS DOUBLE)), 4) AS avg_price
FROM listings WHERE price_text NOT LIKE '%/mese%' GROUP BY typology_name"""))
def avg_price_by_type(spark, sf):
    df = stats.average_stored_price(listings(spark, sf, "typology_name", "price_text"), "typology_name", "price_text")
    return df.withColumn("avg_price", F.round("avg_price", 4))


@query("db_stats_total", with_listings("""
, kinds AS (SELECT typology_name, count(*) AS n FROM listings WHERE typology_name IS NOT NULL GROUP BY 1),
 cities AS (SELECT city, count(*) AS n FROM listings WHERE city IS NOT NULL GROUP BY 1 ORDER BY n DESC, city LIMIT 10),
 prices AS (SELECT typology_name, avg(TRY_CAST(trim(replace(replace(replace(price_text, '€', ''), '.', ''), chr(160), ' ')) AS DOUBLE)) AS a
  FROM listings WHERE price_text NOT LIKE '%/mese%' AND typology_name IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM listings) AS total_records,
 (SELECT strftime(max(created_at), '%Y-%m-%d') FROM listings) AS latest_record_date,
 (SELECT count(*) FROM kinds) AS n_types, (SELECT n FROM kinds WHERE typology_name = 'Attico') AS n_attico,
 (SELECT count(*) FROM cities) AS n_top_cities, (SELECT CAST(sum(n) AS BIGINT) FROM cities) AS in_top_cities,
 (SELECT round(a, 4) FROM prices WHERE typology_name = 'Villa') AS avg_villa"""))
def db_stats_total(spark, sf):
    rows = stats.store_summary(listings(spark, sf, "typology_name", "city", "price_text", "created_at"), price="price_text")
    pick = lambda test, c: F.max(F.when(test, F.col(c)))
    total, city, kind = (F.col("section") == x for x in ("total", "city", "type"))
    return rows.agg(
        pick(total, "n").alias("total_records"), F.date_format(pick(total, "latest"), "yyyy-MM-dd").alias("latest_record_date"),
        F.count_if(kind).alias("n_types"), pick(kind & (F.col("name") == "Attico"), "n").alias("n_attico"),
        F.count_if(city).alias("n_top_cities"), F.sum(F.when(city, F.col("n"))).alias("in_top_cities"),
        F.round(pick(kind & (F.col("name") == "Villa"), "average_price"), 4).alias("avg_villa"),
    )


@query("price_favourites", """
WITH e AS (SELECT event_id, value AS price, CASE WHEN event_id % 3 <> 0 THEN user_id % 50 END AS favourites FROM events)
SELECT *, (SELECT round(corr(price, favourites), 8) FROM e) AS correlation FROM e WHERE price IS NOT NULL AND favourites IS NOT NULL""")
def price_favourites(spark, sf):
    likes = F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 50).alias("favourites")
    ev = table(spark, sf, "events").select("event_id", F.col("value").alias("price"), likes)
    return stats.price_favourites(ev).withColumn("correlation", F.round("correlation", 8))


@query("price_stats", with_listings("""
SELECT city, count(price_value) AS n, round(avg(price_value), 4) AS mean, round(median(price_value), 4) AS median,
 min(price_value) AS min, max(price_value) AS max, round(stddev_samp(price_value), 4) AS std,
 concat('€ ', format('{:,.2f}', max(price_value))) AS shown_max
FROM listings GROUP BY city"""))
def price_stats(spark, sf):
    d = stats.describe(listings(spark, sf, "city", "price_value"), "price_value", ["city"])
    return d.select(
        "city", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "min", "max",
        F.round("std", 4).alias("std"), text.money(F.col("max")).alias("shown_max"),
    )


@query("price_percentiles", with_listings("""
SELECT typology_name, """ + ", ".join(
    f"round(quantile_cont(price_value, {p / 100}), 4) AS p{p}" for p in stats.PERCENTILES) + """
FROM listings WHERE price_value IS NOT NULL GROUP BY typology_name"""))
def price_percentiles(spark, sf):
    df = listings(spark, sf, "typology_name", "price_value")
    q = stats.percentiles(df, "price_value", ["typology_name"])
    return q.select("typology_name", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in stats.PERCENTILES])


@query("price_per_m2_stats", with_listings("""
, r AS (SELECT contract, price_value / surface_m2 AS v FROM listings WHERE price_value IS NOT NULL AND surface_m2 IS NOT NULL)
SELECT contract, count(v) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median,
 round(min(v), 4) AS min, round(max(v), 4) AS max, round(stddev_samp(v), 4) AS std FROM r GROUP BY contract"""))
def price_per_m2_stats(spark, sf):
    df = listings(spark, sf, "contract", "price_value", "surface_m2")
    ratio = df.select("contract", stats.per_square_metre(F.col("price_value"), F.col("surface_m2")).alias("v"))
    d = stats.describe(ratio.filter("v IS NOT NULL"), "v", ["contract"])
    return d.select("contract", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max", "std")])


@query("rooms_distribution", with_listings("""
SELECT rooms, count(*) AS n FROM listings WHERE rooms IS NOT NULL GROUP BY rooms ORDER BY rooms"""))
def rooms_distribution(spark, sf):
    return stats.value_counts(listings(spark, sf, "rooms"), "rooms", keep_null=False, order="value")


@query("price_histogram", """
WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 30 AS w FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / w), 29) AS INT) AS bin, count(*) AS n FROM orders, s GROUP BY 1""")
def price_histogram(spark, sf):
    return stats.histogram(table(spark, sf, "orders").select("o_totalprice"), "o_totalprice")


@query("gaussian_overlay", """
WITH s AS (SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m,
 stddev_samp(o_totalprice) AS sd FROM orders),
g AS (SELECT i, lo + (hi - lo) * i / 499 AS x, s.* FROM generate_series(0, 499) t(i), s)
SELECT i, round(x, 4) AS x,
 round(exp(-0.5 * pow((x - m) / sd, 2)) / (sd * sqrt(2 * pi())) * n * (hi - lo) / 30, 4) AS y FROM g""")
def gaussian_overlay(spark, sf):
    g = stats.gaussian_overlay(table(spark, sf, "orders").select("o_totalprice"), "o_totalprice")
    return g.select("i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("sigma_bands", """
WITH s AS (SELECT avg(o_totalprice) AS m, median(o_totalprice) AS md, stddev_samp(o_totalprice) AS sd,
 quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)
SELECT line, round(value, 4) AS value FROM (
 SELECT 'mean' AS line, m AS value FROM s UNION ALL SELECT 'median', md FROM s
 UNION ALL SELECT 'mean-1s', m - sd FROM s UNION ALL SELECT 'mean+1s', m + sd FROM s
 UNION ALL SELECT 'mean+3s', m + 3 * sd FROM s UNION ALL SELECT 'p25', a FROM s UNION ALL SELECT 'p75', b FROM s)""")
def sigma_bands(spark, sf):
    lines = stats.sigma_lines(table(spark, sf, "orders").select("o_totalprice"), "o_totalprice")
    return lines.select("line", F.round("value", 4).alias("value"))


_PROFILED = ["id", "typology_name", "price_value", "price_text", "surface", "rooms", "floor_text", "garage_text",
             "features", "elevator"]


@query("null_profile", with_listings(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS \"rows\" FROM listings"
        for c in _PROFILED)))
def null_profile(spark, sf):
    return stats.null_profile(listings(spark, sf, *_PROFILED)).select("column", "nulls", "rows")


@query("feature_token_counts", with_listings("""
, e AS (SELECT trim(unnest(string_split(features, ','))) AS feature FROM listings)
SELECT feature, count(*) AS n FROM e GROUP BY feature HAVING count(*) >= 100"""))
def feature_token_counts(spark, sf):
    return stats.entry_counts(listings(spark, sf, "features"), "features", 100)


@query("distinct_across_tables", with_listings("""
SELECT province FROM listings WHERE province IS NOT NULL
UNION SELECT concat('S', CAST(s_nationkey % 10 AS STRING)) FROM supplier"""))
def distinct_across_tables(spark, sf):
    suppliers = table(spark, sf, "supplier").selectExpr("concat('S', CAST(s_nationkey % 10 AS STRING)) AS province")
    return catalog.distinct_across([listings(spark, sf, "province"), suppliers, table(spark, sf, "region")])


@query("argmax_metric", """
WITH m AS (SELECT p_type AS model, round(avg(p_retailprice), 4) AS score, count(*) AS n FROM part GROUP BY p_type)
(SELECT 'best' AS pick, model, score FROM m ORDER BY score DESC, model DESC LIMIT 1)
UNION ALL (SELECT 'worst', model, score FROM m ORDER BY score, model LIMIT 1)""")
def argmax_metric(spark, sf):
    m = table(spark, sf, "part").groupBy(F.col("p_type").alias("model")).agg(
        F.round(F.avg("p_retailprice"), 4).alias("score")
    )
    pick = lambda d, n: d.select(F.lit(n).alias("pick"), "model", "score")
    return pick(stats.best_by(m, "model", "score"), "best").unionByName(
        pick(stats.best_by(m, "model", "score", lowest=True), "worst")
    )
