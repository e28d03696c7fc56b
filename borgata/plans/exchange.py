"""Round trips through files and landed JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F, types as T

from borgata import schemas
from borgata.operators import clean, monitor
from borgata.plans.base import query, table
from borgata.session import scratch_dir
from borgata.sources import documents, readers, writers


@query("csv_roundtrip", """
SELECT doc_id, md5(text) AS digest, lang, source, n_chars FROM documents""")
def csv_roundtrip(spark, sf):
    path = scratch_dir(spark, "csv")
    df = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    # A carriage return would come back as a plain line break, so texts are written without.
    writers.write_csv(df.withColumn("text", F.replace("text", F.lit("\r"), F.lit("\\r"))), path)
    back = readers.read_csv(spark, path, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT", multi_line=True)
    return back.select("doc_id", F.md5(F.replace("text", F.lit("\\r"), F.lit("\r"))).alias("digest"), "lang", "source", "n_chars")


@query("json_roundtrip", """
SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events""")
def json_roundtrip(spark, sf):
    path = scratch_dir(spark, "json")
    writers.write_json(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    back = spark.read.schema("event_id BIGINT, user_id BIGINT, event_type STRING, value DOUBLE, props STRING").json(path)
    return back.select("event_id", "user_id", "event_type", "value", F.from_json("props", "k INT")["k"].alias("k"))


@query("json_root_explode", """
SELECT CAST(p_partkey AS STRING) AS url, p_name AS titolo, CAST(p_size AS STRING) AS superficie FROM part
UNION ALL SELECT CAST(p_partkey AS STRING), concat(p_name, ' bis'), NULL FROM part WHERE p_partkey % 2 = 0""")
def json_root_explode(spark, sf):
    k = F.col("p_partkey")
    record = lambda title, size: F.struct(
        k.cast("string").alias("url"), title.alias("titolo"), size.cast("string").alias("superficie")
    )
    one = record(F.col("p_name"), F.col("p_size"))
    two = record(F.concat("p_name", F.lit(" bis")), F.lit(None))
    json = F.when(k % 2 == 0, F.to_json(F.struct(F.array(one, two).alias("immobili")))).otherwise(F.to_json(F.array(one)))
    landed = table(spark, sf, "part").select(json.alias("json"))
    records = readers.explode_root(landed, F.col("json"), "immobili", T.ArrayType(schemas.AGENT_LISTING))
    return records.select("url", "titolo", "superficie")


_SPLIT_TITLE = "concat(p_name, CASE p_partkey % 4 WHEN 0 THEN ' }, {\"url\": 0' WHEN 1 THEN ' \"{\" \\' WHEN 2 THEN ' è}' ELSE '' END)"


@query("json_documents_split", f"""
SELECT concat('u', CAST(p_partkey AS STRING)) AS url, {_SPLIT_TITLE} AS title, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS surface FROM part""")
def json_documents_split(spark, sf):
    """Parts landed as array documents of a thousand records, with surfaces as numbers and as texts, cut into records again."""
    k = F.col("p_partkey")
    ends = F.when(k % 4 == 0, ' }, {"url": 0').when(k % 4 == 1, ' "{" \\').when(k % 4 == 2, " è}").otherwise("")
    size = F.when(k % 3 != 0, F.col("p_size"))
    shared = [F.concat(F.lit("u"), k.cast("string")).alias("url"), F.concat("p_name", ends).alias("title"), F.lit(None).alias("none")]
    record = F.when(k % 2 == 0, F.to_json(F.struct(*shared, F.struct(size.alias("value")).alias("surface")))).otherwise(
        F.to_json(F.struct(*shared, F.struct(size.cast("string").alias("value")).alias("surface"))))
    listed = table(spark, sf, "part").groupBy(F.floor(k / 1000).alias("document")).agg(F.collect_list(record).alias("records"))
    path = scratch_dir(spark, "documents")
    listed.select(F.concat(F.lit('{"immobili": ['), F.array_join("records", ",\n "), F.lit("]}"))).write.text(path)
    records = documents.split_records(spark, path, "immobili")
    field = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind)
    return records.select(
        field("url", "string").alias("url"), field("title", "string").alias("title"), field("surface.value", "int").alias("surface"))


def _event_pages(spark, sf):
    """Result pages of 100 events."""
    page = F.floor(F.col("event_id") / 100)
    return table(spark, sf, "events").groupBy((page + 1).alias("page")).agg(
        F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("results")
    )


@query("paged_results_explode", """
WITH e AS (SELECT *, CAST(floor(event_id / 100) AS BIGINT) + 1 AS page FROM events), m AS (SELECT max(page) AS last FROM e)
SELECT page, CAST(event_id % 100 AS INT) AS pos, event_id, value FROM e, m WHERE page >= 2 AND page < greatest(last - 1, 3)""")
def paged_results_explode(spark, sf):
    pages = _event_pages(spark, sf)
    last = table(spark, sf, "events").agg(F.floor(F.max("event_id") / 100) + 1).scalar()
    landed = pages.withColumn("maxPages", last).withColumn(
        "status", F.when(F.col("page") == F.greatest(F.col("maxPages") - 1, F.lit(3)), 403).otherwise(200)
    )
    found = readers.paged_results(landed, start_page=2)
    return found.select("page", "pos", "result.event_id", "result.value")


@query("paged_until_last", """
WITH e AS (SELECT *, CAST(floor(event_id / 100) AS BIGINT) AS page FROM events), m AS (SELECT min(page) AS stop FROM e WHERE page >= (SELECT max(page) FROM e) - 1)
SELECT page, event_id, value FROM e, m WHERE page <= stop""")
def paged_until_last(spark, sf):
    pages = _event_pages(spark, sf).select((F.col("page") - 1).alias("page"), F.col("results").alias("content"))
    end = table(spark, sf, "events").agg(F.floor(F.max("event_id") / 100)).scalar()
    landed = pages.withColumn("_end", end).withColumn("last", F.col("page") >= F.col("_end") - 1)
    found = readers.paged_until_last(landed)
    return found.select("page", "entry.event_id", "entry.value")


def _leg(user, kind, when, price, number):
    place = lambda code, name: F.struct(
        code.alias("iataCode"), name.alias("name"), F.lit("Italia").alias("countryName")
    )
    return F.struct(
        place(F.concat(F.lit("A"), user), F.concat(F.lit("Citta "), user)).alias("departureAirport"),
        place(F.upper(kind), kind).alias("arrivalAirport"),
        F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss").alias("departureDate"),
        F.concat(F.lit("FR"), number).alias("flightNumber"),
        F.struct(price.alias("value"), F.lit("EUR").alias("currencyCode")).alias("price"),
    )


def _fare_answers(spark, sf):
    """One landed answer per event; every seventh has no fares, every eleventh an unreadable date."""
    ev = table(spark, sf, "events")
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    out = _leg(user, F.col("event_type"), F.col("ts"), F.col("value"), k.cast("string"))
    back = _leg(user, F.col("event_type"), F.date_add("ts", 3).cast("timestamp"), F.col("value") + 10, (k + 1).cast("string"))
    fares = F.when(k % 7 == 0, F.array()).otherwise(F.array(F.struct(out.alias("outbound"), back.alias("inbound"))))
    json = F.to_json(F.struct(fares.alias("fares")))
    broken = F.regexp_replace(json, r'"departureDate":"[^"]*"', '"departureDate":"presto"')
    return ev.select("event_id", F.when(k % 11 == 0, broken).otherwise(json).alias("json"))


@query("fares_flatten", """
SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS departure, concat('FR ', CAST(event_id AS STRING)) AS flight,
 value AS price, 'EUR' AS currency, concat('A', CAST(user_id AS STRING)) AS origin, concat('Citta ', CAST(user_id AS STRING), ', Italia') AS origin_full,
 upper(event_type) AS destination, concat(event_type, ', Italia') AS destination_full, 0 AS currency_mismatch FROM events WHERE event_id % 7 <> 0""")
def fares_flatten(spark, sf):
    legs = readers.parse_fares(_fare_answers(spark, sf)).select("event_id", monitor.parse_leg(F.col("outbound")).alias("l"))
    return legs.select(
        "event_id", F.date_format("l.departureTime", "yyyy-MM-dd HH:mm:ss").alias("departure"),
        F.col("l.flightNumber").alias("flight"), "l.price", "l.currency", "l.origin", F.col("l.originFull").alias("origin_full"),
        "l.destination", F.col("l.destinationFull").alias("destination_full"),
        (F.col("l.currency") != "EUR").cast("int").alias("currency_mismatch"),
    )


@query("trip_flatten", """
SELECT event_id, round(value + (value + 10), 2) AS "totalPrice", concat('FR ', CAST(event_id AS STRING)) AS "outbound_flightNumber",
 concat('FR ', CAST(event_id + 1 AS STRING)) AS "inbound_flightNumber", value AS outbound_price, value + 10 AS inbound_price,
 concat('A', CAST(user_id AS STRING)) AS outbound_origin, upper(event_type) AS inbound_destination,
 CASE WHEN event_id % 11 <> 0 THEN strftime(CAST(ts AS DATE) + 3, '%Y-%m-%d') END AS inbound_day, '2024-02-01' AS query_day
FROM events WHERE event_id % 7 <> 0""")
def trip_flatten(spark, sf):
    trips = monitor.flatten_trips(readers.parse_fares(_fare_answers(spark, sf)), F.lit("2024-02-01").cast("timestamp"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return trips.select(
        "event_id", "totalPrice", "outbound_flightNumber", "inbound_flightNumber", "outbound_price", "inbound_price",
        "outbound_origin", "inbound_destination", day("inbound_departureTime").alias("inbound_day"),
        day("queryDatetime").alias("query_day"),
    )


@query("multi_source_union", """
SELECT p_name AS "Title", p_retailprice AS "Price", p_size AS "Favorites", NULL::STRING AS "Seller", 'a' AS source FROM part
UNION ALL SELECT NULL, s_acctbal, NULL, s_name, 'b' FROM supplier""")
def multi_source_union(spark, sf):
    a = table(spark, sf, "part").select(
        F.col("p_name").alias("Titolo"), F.col("p_retailprice").alias("Prezzo"), F.col("p_size").alias("Preferiti"), F.lit("a").alias("source"))
    b = table(spark, sf, "supplier").select(F.col("s_name").alias("Seller"), F.col("s_acctbal").alias("Price"), F.lit("b").alias("source"))
    return readers.union_sources([clean.rename_canonical(a), b])


@query("envelope_metadata", """
SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS "count", 'suppliers' AS spider, '2024-01-01T00:00:00' AS "timestamp" FROM supplier""")
def envelope_metadata(spark, sf):
    path = scratch_dir(spark, "envelope")
    writers.write_envelope(table(spark, sf, "supplier").select("s_suppkey", "s_name"), path, "suppliers", "2024-01-01T00:00:00")
    meta = spark.read.schema("timestamp STRING, spider STRING, count BIGINT").json(f"{path}/_metadata")
    one = meta.select(F.struct("timestamp", "spider", "count").alias("m")).scalar()
    items = spark.read.schema("s_suppkey BIGINT, s_name STRING").json(f"{path}/items")
    return items.withColumn("_m", one).select("s_suppkey", "s_name", "_m.count", "_m.spider", "_m.timestamp")


@query("partitioned_write", """
SELECT o_orderkey, o_totalprice, concat('P', CAST(o_custkey % 9 AS STRING)) AS province FROM orders""")
def partitioned_write(spark, sf):
    path = scratch_dir(spark, "provinces")
    df = table(spark, sf, "orders").select(
        "o_orderkey", "o_totalprice", F.concat(F.lit("P"), (F.col("o_custkey") % 9).cast("string")).alias("province"))
    writers.write_partitioned(df, path, ["province"])
    return spark.read.schema("o_orderkey BIGINT, o_totalprice DOUBLE, province STRING").parquet(path)


@query("load_report", """
WITH r AS (SELECT o_orderpriority AS file, o_orderkey, CASE WHEN o_totalprice < 60000 THEN concat('price ', CAST(o_orderkey AS STRING)) END AS err FROM orders),
e AS (SELECT file, string_agg(err, ';' ORDER BY o_orderkey) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY o_orderkey) AS rn FROM r WHERE err IS NOT NULL) WHERE rn <= 10 GROUP BY file)
SELECT file, count(*) AS total, count(*) FILTER (WHERE err IS NULL) AS successful, count(err) AS failed, coalesce(any_value(errors), '') AS errors
FROM r LEFT JOIN e USING (file) GROUP BY file""")
def load_report(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("file"), "o_orderkey",
        F.when(F.col("o_totalprice") < 60000, F.concat(F.lit("price "), F.col("o_orderkey").cast("string"))).alias("err"))
    return writers.load_report(rows, "file", "err", "o_orderkey").withColumn("errors", F.array_join("errors", ";"))


@query("load_totals", """
SELECT count(DISTINCT o_orderpriority) AS files, count(*) AS total, count(*) FILTER (WHERE o_totalprice >= 60000) AS successful,
 count(*) FILTER (WHERE o_totalprice < 60000) AS failed, round(100.0 * count(*) FILTER (WHERE o_totalprice >= 60000) / count(*), 6) AS percent FROM orders""")
def load_totals(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("file"), "o_orderkey", F.when(F.col("o_totalprice") < 60000, "price").alias("err"))
    return writers.load_totals(writers.load_report(rows, "file", "err", "o_orderkey")).withColumn("percent", F.round("percent", 6))


@query("load_durations", """
SELECT event_type AS file, count(*) AS total, count(*) FILTER (WHERE value >= 5) AS successful, count(*) FILTER (WHERE value < 5) AS failed,
 round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS seconds FROM events GROUP BY event_type""")
def load_durations(spark, sf):
    """Load report with the time from each file's first row to its last."""
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("file"), "event_id", "ts", F.when(F.col("value") < 5, "value").alias("err"))
    report = writers.load_report(rows, "file", "err", "event_id", stamp="ts")
    return report.select("file", "total", "successful", "failed", F.round("seconds", 3).alias("seconds"))


@query("validate_quarantine", """
SELECT event_id, CASE WHEN event_id % 10 NOT IN (0, 1) THEN CAST(json_extract(props, '$.k') AS INT) END AS k,
 CASE event_id % 10 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'missing k' END AS reason FROM events""")
def validate_quarantine(spark, sf):
    k = F.col("event_id")
    landed = table(spark, sf, "events").select(
        k, F.when(k % 10 == 0, '{"k": ').when(k % 10 == 1, '{"z": 1}').otherwise(F.col("props")).alias("json"))
    valid, rejected = readers.validate(landed, "json", "k INT", ["k"])
    return valid.unionByName(rejected.select("event_id", "reason"), allowMissingColumns=True)


@query("zone_entry_types", """
SELECT c_custkey, c_custkey AS document, 0 AS place FROM customer WHERE c_custkey % 3 <> 0""")
def zone_entry_types(spark, sf):
    k = F.col("c_custkey")
    entry = F.to_json(F.array(F.struct(k.cast("string").alias("id"), F.lit(3).alias("type"))))
    landed = table(spark, sf, "customer").select(k, F.when(k % 3 == 0, '{"error": "none"}').otherwise(entry).alias("json"))
    entries = readers.parse_zone_entries(landed, seq=k)
    return entries.select(F.col("id").cast("bigint").alias("c_custkey"), "ingest_seq.document", "ingest_seq.place")


@query("batch_fan_out", """
SELECT sink, o_orderstatus, count(*) AS n FROM orders, (VALUES ('parquet'), ('json')) AS s(sink) GROUP BY sink, o_orderstatus""")
def batch_fan_out(spark, sf):
    """One frame to two sinks and one that fails, which stops neither."""
    base = scratch_dir(spark, "sinks")

    def broken(df):
        raise RuntimeError("down")

    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    outcome = writers.fan_out(df, {
        "parquet": lambda d: d.write.parquet(f"{base}/parquet"), "broken": broken, "json": lambda d: d.write.json(f"{base}/json")})
    done = [name for name, state in outcome.items() if state == "ok"]
    back = [spark.read.schema(df.schema).format(n).load(f"{base}/{n}").groupBy(F.lit(n).alias("sink"), "o_orderstatus").agg(F.count("*").alias("n"))
            for n in done]
    return reduce(lambda a, b: a.unionByName(b), back)
