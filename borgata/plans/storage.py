"""Store maintenance on orders split into an existing set and a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.functions import text
from borgata.operators import store
from borgata.plans.base import query, table
from borgata.session import scratch_dir
from borgata.sources.keyed import KeyedTable

# Existing: two of three orders.  Batch: every second order plus corrections of every tenth, with
# NULLs, repeated keys and rows without a key.
_SQL = """ex AS (SELECT o_orderkey AS url, o_totalprice AS price, o_orderpriority AS label, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
ba AS (SELECT CASE WHEN o_orderkey % 50 = 2 THEN NULL ELSE o_orderkey END AS url, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_totalprice - 5 END AS price,
  CASE WHEN o_orderkey % 4 = 0 THEN 'batch' END AS label, 'x' AS extra, o_orderkey * 2 AS ingest_seq FROM orders WHERE o_orderkey % 2 = 0
 UNION ALL SELECT o_orderkey, NULL, concat('fix ', CAST(o_orderkey AS STRING)), 'y', o_orderkey * 2 + 1 FROM orders WHERE o_orderkey % 10 = 0)"""


def _existing(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderkey") % 3 != 0).select(
        F.col("o_orderkey").alias("url"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("label"),
        F.col("o_orderstatus").alias("status"),
    )


def _batch(spark, sf):
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    main = orders.filter(k % 2 == 0).select(
        F.when(k % 50 != 2, k).alias("url"), F.when(k % 8 != 0, F.col("o_totalprice") - 5).alias("price"),
        F.when(k % 4 == 0, "batch").alias("label"), F.lit("x").alias("extra"), (k * 2).alias("ingest_seq"),
    )
    fixes = orders.filter(k % 10 == 0).select(
        k.alias("url"), F.lit(None).cast("double").alias("price"), F.concat(F.lit("fix "), k.cast("string")).alias("label"),
        F.lit("y").alias("extra"), (k * 2 + 1).alias("ingest_seq"),
    )
    return main.unionByName(fixes)


_UPSERTED = f"""
WITH {_SQL}, nb AS (SELECT DISTINCT url, last_value(price IGNORE NULLS) OVER w AS price, last_value(label IGNORE NULLS) OVER w AS label FROM ba WHERE url IS NOT NULL
 WINDOW w AS (PARTITION BY url ORDER BY ingest_seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT coalesce(ex.url, nb.url) AS url, coalesce(nb.price, ex.price) AS price, coalesce(nb.label, ex.label) AS label, status
FROM ex FULL OUTER JOIN nb ON ex.url = nb.url"""


@query("upsert_replace", _UPSERTED)
def upsert_replace(spark, sf):
    return store.upsert(_existing(spark, sf), _batch(spark, sf))


@query("upsert_bucketed", _UPSERTED)
def upsert_bucketed(spark, sf):
    """The same batch merged into a bucketed table, written as its next version and read again."""
    kept = KeyedTable(spark, scratch_dir(spark, "keyed-store"), "url", buckets=8)
    kept.replace(_existing(spark, sf))
    kept.upsert(_batch(spark, sf))
    return kept.read()


@query("insert_if_absent", f"""
WITH {_SQL} SELECT url, price, label, status FROM ex UNION ALL
SELECT url, price, label, NULL FROM ba WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM ex)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY ingest_seq) = 1""")
def insert_if_absent(spark, sf):
    return store.upsert(_existing(spark, sf), _batch(spark, sf), replace_existing=False)


@query("upsert_counts", f"""
WITH {_SQL}, n AS (SELECT url, count(*) AS c FROM ba WHERE url IS NOT NULL GROUP BY url)
SELECT count(*) FILTER (WHERE ex.url IS NULL) AS new_records,
 CAST(sum(CASE WHEN ex.url IS NULL THEN c - 1 ELSE c END) AS BIGINT) AS updated_records FROM n LEFT JOIN ex ON n.url = ex.url""")
def upsert_counts(spark, sf):
    return store.upsert_counts(_existing(spark, sf), _batch(spark, sf))


_DOC = """ex AS (SELECT concat('u', CAST(o_orderkey AS STRING)) AS id, concat('c', CAST(o_custkey % 7 AS STRING)) AS city, o_totalprice AS price FROM orders WHERE o_orderkey % 3 <> 0),
ba AS (SELECT CASE WHEN o_orderkey % 20 = 0 THEN sha256(concat('o', CAST(o_orderkey AS STRING))) ELSE concat('u', CAST(o_orderkey AS STRING)) END AS id,
 CASE WHEN o_orderkey % 12 = 0 THEN 'unknown' ELSE concat('c', CAST(o_custkey % 7 AS STRING)) END AS city,
 CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice + 1 END AS price FROM orders WHERE o_orderkey % 2 = 0)"""


@query("doc_upsert", f"""
WITH {_DOC} SELECT id, city, price FROM ba UNION ALL SELECT id, city, price FROM ex ANTI JOIN ba USING (id, city)""")
def doc_upsert(spark, sf):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("u"), k.cast("string"))
    city = F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))
    orders = table(spark, sf, "orders")
    existing = orders.filter(k % 3 != 0).select(name.alias("id"), city.alias("city"), F.col("o_totalprice").alias("price"))
    uuid = F.when(k % 20 == 0, "").otherwise(name)
    batch = orders.filter(k % 2 == 0).select(
        store.document_id(uuid, F.concat(F.lit("o"), k.cast("string"))).alias("id"),
        F.coalesce(F.when(k % 12 != 0, city), F.lit("unknown")).alias("city"),
        F.when(k % 6 != 0, F.col("o_totalprice") + 1).alias("price"), k.alias("ingest_seq"),
    )
    return store.upsert_documents(existing, batch)


@query("delete_by_key", f"""
WITH {_SQL} SELECT url, price, label, status, (SELECT count(*) FROM ex WHERE url % 4 = 1) AS deleted FROM ex WHERE url % 4 <> 1""")
def delete_by_key(spark, sf):
    existing = _existing(spark, sf)
    doomed = table(spark, sf, "orders").filter(F.col("o_orderkey") % 4 == 1).select(F.col("o_orderkey").alias("url"))
    return store.delete_keys(existing, doomed).withColumn("deleted", store.delete_count(existing, doomed).scalar())


@query("dedup_keep_first", """
SELECT l_orderkey, l_linenumber, l_suppkey, link FROM (
 SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN l_orderkey % 40 = 0 THEN NULL ELSE concat('https://m.test/itm/', CAST(l_orderkey AS STRING), '?hash=', CAST(l_linenumber AS STRING)) END AS link,
 row_number() OVER (PARTITION BY CASE WHEN l_orderkey % 40 = 0 THEN NULL ELSE l_orderkey END ORDER BY l_partkey, l_suppkey, l_linenumber, l_orderkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_keep_first(spark, sf):
    k = F.col("l_orderkey")
    link = F.when(k % 40 != 0, F.concat(
        F.lit("https://m.test/itm/"), k.cast("string"), F.lit("?hash="), F.col("l_linenumber").cast("string")))
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", link.alias("link"),
        F.struct("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey", "l_extendedprice").alias("ingest_seq"),
    )
    return store.keep_first(df, [text.listing_id(F.col("link"))]).drop("ingest_seq")


@query("dedup_against_seen", """
WITH i AS (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS id, value FROM events),
k AS (SELECT * FROM i WHERE id IS NOT NULL AND id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id) = 1)
SELECT event_id, id, value FROM k UNION ALL SELECT event_id, id, value FROM i WHERE id IS NULL""")
def dedup_against_seen(spark, sf):
    items = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "error", F.col("user_id")).alias("id"), "value",
    )
    seen = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return store.dedup_against_seen(items, seen, seq="event_id")


_SEEN = """
SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION SELECT user_id FROM events WHERE event_type <> 'error'"""


@query("seen_ids_union", _SEEN)
def seen_ids_union(spark, sf):
    items = table(spark, sf, "events").select(F.when(F.col("event_type") != "error", F.col("user_id")).alias("id"))
    seen = table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    return store.seen_union(seen, items)


@query("seen_ids_bucketed", _SEEN)
def seen_ids_bucketed(spark, sf):
    """Seen ids in a bucketed table; each run's ids are merged in."""
    items = table(spark, sf, "events").select(
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("id"), "event_type")
    seen = KeyedTable(spark, scratch_dir(spark, "keyed-seen"), "id", buckets=8)
    seen.replace(table(spark, sf, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("id")).distinct())
    for run in ("event_type < 'm'", "event_type >= 'm'"):
        seen.add_keys(items.filter(run))
    return seen.read()
