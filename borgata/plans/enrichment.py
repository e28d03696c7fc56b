"""Joins and enrichment: snapshots, lookups, zones, distances, calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.operators import filters, lookup, monitor
from borgata.plans.base import listings, query, table, with_listings
from borgata.sources import readers

_SNAP = """SELECT user_id, event_type, CAST(ts AS DATE) AS day, {pick}(value, event_id) AS price, {edge}(ts) AS at
 FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)"""


@query("price_drop", f"""
WITH old AS ({_SNAP.format(pick='arg_min', edge='min')}), new AS ({_SNAP.format(pick='arg_max', edge='max')})
SELECT user_id, event_type, CAST(day AS STRING) AS day, o.price AS "totalPrice", n.price AS "totalPrice_new",
 strftime(o.at, '%Y-%m-%d %H:%M:%S') AS "queryDatetime", strftime(n.at, '%Y-%m-%d %H:%M:%S') AS "queryDatetime_new"
FROM old o JOIN new n USING (user_id, event_type, day) WHERE n.price < o.price""")
def price_drop(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "ts", "value", "event_id")
    keys = ["user_id", "event_type", "day"]
    snap = lambda pick, edge: ev.groupBy(*keys).agg(
        pick("value", "event_id").alias("totalPrice"), edge("ts").alias("queryDatetime")
    )
    drops = monitor.price_drops(snap(F.min_by, F.min), snap(F.max_by, F.max), keys)
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return drops.select(
        "user_id", "event_type", F.col("day").cast("string").alias("day"), "totalPrice", "totalPrice_new",
        stamp("queryDatetime"), stamp("queryDatetime_new"),
    )


@query("price_history_lag", """
WITH e AS (SELECT event_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE user_id END AS user_id, event_type, value,
 CASE WHEN event_id % 89 = 0 THEN NULL WHEN event_id = 5 THEN TIMESTAMP '1970-01-02 00:00:00' ELSE ts END AS ts FROM events)
SELECT event_id, user_id, event_type, value, lag(value) OVER w AS previous,
 CASE WHEN value < lag(value) OVER w THEN 1 ELSE 0 END AS dropped
FROM e WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts NULLS FIRST, event_id)""")
def price_history_lag(spark, sf):
    """With NULL keys, NULL times and one far outlier among the times."""
    n = F.col("event_id")
    ts = F.when(n % 89 == 0, None).when(n == 5, F.lit("1970-01-02 00:00:00").cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
    ev = table(spark, sf, "events").select(
        "event_id", ts.alias("ts"), F.when(n % 97 != 0, F.col("user_id")).alias("user_id"), "event_type", "value")
    h = monitor.previous_value(ev, ["user_id", "event_type"], ["ts", "event_id"], "value")
    dropped = F.when(F.col("value") < F.col("previous"), 1).otherwise(0)
    return h.select("event_id", "user_id", "event_type", "value", "previous", dropped.alias("dropped"))


def _cities(spark, sf):
    """One city per nation: key ``nation_<n>``, every third with a two-word key, name differing from the key."""
    n = F.col("n_nationkey")
    key = F.when(n % 3 == 0, F.concat(F.lower("n_name"), F.lit(" marina"))).otherwise(F.lower("n_name"))
    return table(spark, sf, "nation").select(
        key.alias("city_key"), F.concat(F.lit("C"), n.cast("string")).alias("city_id"),
        F.concat(F.lit("Citta "), n.cast("string")).alias("city_name"), n.alias("dim_ord"),
    )


_CITIES = """cities AS (SELECT CASE WHEN n_nationkey % 3 = 0 THEN concat(lower(n_name), ' marina') ELSE lower(n_name) END AS city_key,
 concat('C', CAST(n_nationkey AS STRING)) AS city_id, concat('Citta ', CAST(n_nationkey AS STRING)) AS city_name, n_nationkey AS dim_ord FROM nation)"""
_ASKED = """CASE c_custkey % 6 WHEN 0 THEN concat('  Nation_', CAST(c_nationkey AS STRING), ' ') WHEN 1 THEN concat('CITTA ', CAST(c_nationkey AS STRING))
 WHEN 2 THEN concat('porto ', 'marina di nation_', CAST(c_nationkey AS STRING)) WHEN 3 THEN 'mar' WHEN 4 THEN concat('nation_', CAST(c_nationkey AS STRING), '0 zzz') ELSE 'qqq' END"""


@query("city_exact_lookup", f"""
WITH {_CITIES}, q AS (SELECT c_custkey, {_ASKED} AS query FROM customer)
SELECT c_custkey, query, coalesce(k.city_id, n.city_id) AS city_id,
 CASE WHEN k.city_key IS NOT NULL THEN k.city_name ELSE n.city_name END AS city_name
FROM q LEFT JOIN cities k ON trim(lower(query)) = k.city_key LEFT JOIN cities n ON trim(lower(query)) = lower(n.city_name)""")
def city_exact_lookup(spark, sf):
    q = table(spark, sf, "customer").selectExpr("c_custkey", f"{_ASKED} AS query")
    return lookup.exact_lookup(q, _cities(spark, sf))


@query("fuzzy_lookup", f"""
WITH {_CITIES}, q AS (SELECT c_custkey, {_ASKED} AS query FROM customer),
d AS (SELECT DISTINCT trim(lower(query)) AS k FROM q),
p AS (SELECT k, city_key, city_id, city_name, dim_ord,
 CAST(list_sum(flatten(list_transform(string_split(k, ' '), lambda x: list_transform(string_split(city_key, ' '),
  lambda y: CASE WHEN contains(x, y) OR contains(y, x) THEN 1 ELSE 0 END)))) AS BIGINT) AS score FROM d CROSS JOIN cities),
b AS (SELECT * FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, dim_ord) = 1)
SELECT c_custkey, query, city_key, city_id, city_name, score FROM q LEFT JOIN b ON trim(lower(query)) = k""")
def fuzzy_lookup(spark, sf):
    q = table(spark, sf, "customer").selectExpr("c_custkey", f"{_ASKED} AS query")
    return lookup.fuzzy_lookup(q, _cities(spark, sf))


_ZONES = """zones AS (SELECT concat('nation_', CAST(s_nationkey AS STRING)) AS city_key, concat('zona_', CAST(s_suppkey % 8 AS STRING)) AS zone_key,
 min(concat('Z', lpad(CAST(s_suppkey AS STRING), 9, '0'))) AS zone_id FROM supplier GROUP BY 1, 2)"""


def _zones(spark, sf):
    return table(spark, sf, "supplier").groupBy(
        F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string")).alias("city_key"),
        F.concat(F.lit("zona_"), (F.col("s_suppkey") % 8).cast("string")).alias("zone_key"),
    ).agg(F.min(F.concat(F.lit("Z"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).alias("zone_id"))


@query("zone_name_resolve", f"""
WITH {_ZONES}, w AS (SELECT DISTINCT concat('nation_', CAST(c_nationkey AS STRING)) AS city_key, concat('zona_', CAST(c_custkey % 10 AS STRING)) AS zone_key FROM customer)
SELECT w.city_key, w.zone_key, zone_id, CASE WHEN zone_id IS NULL THEN 'unmatched' ELSE 'found' END AS outcome
FROM w LEFT JOIN zones USING (city_key, zone_key)""")
def zone_name_resolve(spark, sf):
    requests = table(spark, sf, "customer").select(
        F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("city_key"),
        F.concat(F.lit("Zona_"), (F.col("c_custkey") % 10).cast("string")).alias("zone_name"),
    )
    found, missing = lookup.resolve_zones(requests, _zones(spark, sf))
    return found.withColumn("outcome", F.lit("found")).unionByName(
        missing.withColumn("outcome", F.lit("unmatched")), allowMissingColumns=True
    )


@query("zone_upsert", f"""
WITH {_ZONES}, e AS (SELECT concat('nation_', CAST(c_nationkey AS STRING)) AS city_key, concat('zona_', CAST(c_custkey % 12 AS STRING)) AS zone_key,
 c_custkey AS seq, c_custkey % 5 AS kind, c_custkey % 7 AS parent FROM customer),
v AS (SELECT city_key, zone_key, arg_min(concat('N', CAST(seq AS STRING)), seq) AS zone_id FROM e WHERE kind <> 4 AND parent <> 6 GROUP BY 1, 2)
SELECT city_key, zone_key, zone_id, 'old' AS origin FROM zones
UNION ALL SELECT city_key, zone_key, v.zone_id, 'new' FROM v ANTI JOIN zones USING (city_key, zone_key)
UNION ALL SELECT DISTINCT v.city_key, concat('/', v.city_key, '/'), 'city', 'new' FROM v ANTI JOIN zones USING (city_key)""")
def zone_upsert(spark, sf):
    k = F.col("c_custkey")
    city = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    parent = lambda kind: F.struct(
        city.alias("id"), F.lit(kind).alias("type"), city.alias("label"), city.alias("keyurl")
    )
    entry = F.struct(
        F.concat(F.lit("N"), k.cast("string")).alias("id"), F.when(k % 5 == 4, 2).otherwise(3).alias("type"),
        F.lit("Zona").alias("label"), F.concat(F.lit("Zona-"), (k % 12).cast("string")).alias("keyurl"),
        F.when(k % 7 == 6, F.array(parent(1))).otherwise(F.array(parent(1), parent(2))).alias("parents"),
    )
    landed = table(spark, sf, "customer").select(F.to_json(F.array(entry)).alias("json"), "c_custkey")
    entries = readers.parse_zone_entries(landed, seq=F.col("c_custkey"))
    zones = _zones(spark, sf)
    cities = zones.select("city_key").distinct()
    new_cities, new_zones = lookup.upsert_zones(entries, cities, zones)
    fresh = new_cities.filter("path IS NOT NULL").select(
        "city_key", F.col("path").alias("zone_key"), F.lit("city").alias("zone_id"), F.lit("new").alias("origin")
    )
    marked = new_zones.select(
        "city_key", "zone_key", "zone_id", F.when(F.col("zone_id").startswith("Z"), "old").otherwise("new").alias("origin")
    )
    return marked.unionByName(fresh)


@query("geo_distance", """
WITH p AS (SELECT n_nationkey AS code, n_nationkey * 7.0 - 80 AS lat, n_nationkey * 13.0 - 160 AS lng FROM nation WHERE n_nationkey <> 24),
l AS (SELECT c_custkey, c_nationkey AS origin, CAST(c_custkey % 25 AS INT) AS destination FROM customer)
SELECT c_custkey, origin, destination, round(2 * 6371 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
 + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2))), 3) AS km
FROM l LEFT JOIN p a ON origin = a.code LEFT JOIN p b ON destination = b.code""")
def geo_distance(spark, sf):
    legs, places = _legs(spark, sf)
    return lookup.leg_distances(legs, places).withColumn("km", F.round("km", 3))


def _legs(spark, sf):
    n = F.col("n_nationkey")
    places = table(spark, sf, "nation").filter(n != 24).select(
        n.alias("iata_code"), F.lit("R").alias("iso_region"), F.lit("X").alias("iso_country"),
        (n * 7.0 - 80).alias("latitude_deg"), (n * 13.0 - 160).alias("longitude_deg"),
    )
    legs = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("origin"), (F.col("c_custkey") % 25).cast("int").alias("destination")
    )
    return legs, readers.airport_dimension(places)


@query("unknown_codes", """
SELECT code, role, count(*) AS legs FROM (SELECT c_nationkey AS code, 'origin' AS role FROM customer
 UNION ALL SELECT CAST(c_custkey % 25 AS INT), 'destination' FROM customer) WHERE code = 24 GROUP BY code, role""")
def unknown_codes(spark, sf):
    return lookup.unknown_places(*_legs(spark, sf))


@query("detail_over_preview", """
SELECT p.o_orderkey AS id, coalesce(CASE WHEN p.o_orderkey % 4 <> 0 THEN d.q END, p.o_totalprice) AS price,
 coalesce(d.f, p.o_orderpriority) AS label, d.n AS lines
FROM orders p LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, min(l_returnflag) AS f, count(*) AS n FROM lineitem GROUP BY 1) d
 ON p.o_orderkey = d.l_orderkey""")
def detail_over_preview(spark, sf):
    preview = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("label")
    )
    detail = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.sum("l_quantity").alias("q"), F.min("l_returnflag").alias("label"), F.count("*").alias("lines")
    ).select("id", F.when(F.col("id") % 4 != 0, F.col("q")).alias("price"), "label", "lines")
    return lookup.detail_over_preview(preview, detail, "id")


@query("dim_map_explode", """
SELECT lower(n_name) AS city_key, concat('C', CAST(n_nationkey AS STRING)) AS city_id, n_name AS city_name,
 concat('/', lower(n_name), '/') AS path, CASE WHEN s_suppkey IS NOT NULL THEN concat('z', CAST(s_suppkey AS STRING)) END AS zone_key,
 CASE WHEN s_suppkey IS NOT NULL THEN concat('Z', CAST(s_suppkey AS STRING)) END AS zone_id, s_name AS zone_name
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""")
def dim_map_explode(spark, sf):
    rows = _dimension_rows(spark, sf)
    city = F.struct(
        F.col("city_id").alias("idComune"), F.col("city_name").alias("name"), "path", "macrozones"
    )
    landed = lookup.rebuild_dimension(rows).select(F.to_json(F.create_map("city_key", city)).alias("json"))
    return lookup.explode_dimension(readers.parse_city_map(landed))


def _dimension_rows(spark, sf):
    nation, supplier = table(spark, sf, "nation"), table(spark, sf, "supplier")
    n, s = F.col("n_nationkey").cast("string"), F.col("s_suppkey").cast("string")
    return nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(
        F.lower("n_name").alias("city_key"), F.concat(F.lit("C"), n).alias("city_id"), F.col("n_name").alias("city_name"),
        F.concat(F.lit("/"), F.lower("n_name"), F.lit("/")).alias("path"),
        F.concat(F.lit("z"), s).alias("zone_key"), F.concat(F.lit("Z"), s).alias("zone_id"), F.col("s_name").alias("zone_name"),
    )


@query("dim_contract_check", """
SELECT count(*) FILTER (WHERE false) AS missing_city_id, count(*) FILTER (WHERE n_nationkey % 5 = 0) AS missing_city_name,
 0::BIGINT AS missing_path, count(*) FILTER (WHERE s_suppkey % 9 = 0) AS missing_zone_id, 0::BIGINT AS missing_zone_name
FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey""")
def dim_contract_check(spark, sf):
    rows = _dimension_rows(spark, sf)
    number = lambda c: F.substr(c, F.lit(2)).cast("int")
    broken = rows.withColumns({
        "city_name": F.when(number(F.col("city_id")) % 5 != 0, F.col("city_name")),
        "zone_id": F.when(number(F.col("zone_id")) % 9 != 0, F.col("zone_id")),
    })
    return lookup.dimension_contract(broken)


@query("min_occurrence_filter", with_listings("""
, a AS (SELECT id, city, typology_name, rooms FROM listings WHERE typology_name IN ('Appartamento', 'Attico')),
b AS (SELECT * FROM a WHERE city IN (SELECT city FROM a GROUP BY city HAVING count(*) >= 30)),
c AS (SELECT * FROM b WHERE rooms IN (SELECT rooms FROM b GROUP BY rooms HAVING count(*) >= 40))
SELECT id, city, typology_name, rooms FROM c"""))
def min_occurrence_filter(spark, sf):
    df = listings(spark, sf, "id", "city", "typology_name", "rooms")
    kept = filters.by_dictionary(df, {"typology_name": ["Appartamento", "Attico"]})
    return lookup.min_occurrence(kept, [("city", 30), ("rooms", 40)])


@query("weekend_calendar", """
WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events),
w AS (SELECT d, d - CAST(isodow(d) - 5 AS INT) + 7 * CAST(i AS INT) AS dep FROM s, generate_series(0, 23) t(i))
SELECT CAST(d AS STRING) AS start_day, CAST(dep AS STRING) AS departure, CAST(dep + 3 AS STRING) AS back FROM w WHERE dep > DATE '2024-02-01'""")
def weekend_calendar(spark, sf):
    starts = table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct()
    trips = monitor.weekend_trips(F.col("d"), F.lit("2024-02-01").cast("date"))
    departures, returns = F.transform(trips, lambda t: t["departure"]), F.transform(trips, lambda t: t["back"])
    pairs = starts.select("d", F.explode(monitor.zip_dates(departures, returns)).alias("t"))
    return pairs.select(
        F.col("d").cast("string").alias("start_day"), F.col("t.departure").cast("string").alias("departure"),
        F.col("t.back").cast("string").alias("back"),
    )
