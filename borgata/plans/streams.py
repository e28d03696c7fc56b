"""Streaming jobs over events that land in three portions, next to their batch result.

The portions interleave in time, so most rows of the later ones are late.  Every job is stopped after
each portion and started again on its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.plans.base import query, table
from borgata.session import scratch_dir
from borgata.streaming import jobs

PORTIONS = 3


def _in_portions(spark, sf, base, start):
    """Land the events portion by portion and run the job that ``start`` makes of the stream to its end."""
    events = table(spark, sf, "events")
    for k in range(PORTIONS):
        events.filter(F.col("event_id") % PORTIONS == k).write.parquet(f"{base}/landed/{k}")
        start(jobs.source(spark, f"{base}/landed/*", events.schema)).awaitTermination()


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    base = scratch_dir(spark, "dedup")
    _in_portions(spark, sf, base, lambda ev: jobs.append(
        jobs.dedup(ev.select("user_id", "event_type"), ["user_id", "event_type"]), f"{base}/out", f"{base}/checkpoint"))
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{base}/out")


@query("stream_price_drop", f"""
WITH e AS (SELECT *, event_id % {PORTIONS} AS portion FROM events),
n AS (SELECT user_id, event_type, portion, max(struct_pack(a := ts, b := event_id, v := value)) AS newest FROM e GROUP BY ALL),
s AS (SELECT user_id, event_type, portion, max(newest) OVER (PARTITION BY user_id, event_type ORDER BY portion
 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING).v AS seen FROM n),
p AS (SELECT event_id, user_id, event_type, portion, value, ts, row_number() OVER w AS rn, lag(value) OVER w AS before
 FROM e WINDOW w AS (PARTITION BY user_id, event_type, portion ORDER BY ts, event_id))
SELECT event_id, user_id, event_type, value, CASE WHEN rn = 1 THEN seen ELSE before END AS previous
FROM p JOIN s USING (user_id, event_type, portion) WHERE value < CASE WHEN rn = 1 THEN seen ELSE before END""")
def stream_price_drop(spark, sf):
    base = scratch_dir(spark, "drops")
    _in_portions(spark, sf, base, lambda ev: jobs.price_drops(
        ev.select("event_id", "ts", "user_id", "event_type", "value"), f"{base}/alerts", f"{base}/state",
        f"{base}/checkpoint", ["user_id", "event_type"], ["ts", "event_id"], "value"))
    return spark.read.parquet(f"{base}/alerts").select("event_id", "user_id", "event_type", "value", "previous")


@query("stream_upsert", """
SELECT user_id, arg_max(value, event_id) FILTER (WHERE event_id % 4 <> 0) AS value, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_upsert(spark, sf):
    base = scratch_dir(spark, "upsert")
    value = F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("value")
    _in_portions(spark, sf, base, lambda ev: jobs.upsert(
        ev.select("user_id", value, "event_type", "event_id"), f"{base}/log", f"{base}/checkpoint", "user_id", "event_id"))
    return jobs.upserted(spark, f"{base}/log", "user_id").select("user_id", "value", "event_type")


@query("stream_fan_out", """
SELECT 'rows' AS sink, event_type, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'users', event_type, count(DISTINCT (user_id, event_id % 3)) FROM events GROUP BY event_type""")
def stream_fan_out(spark, sf):
    """One stream to two sinks: all rows, and the distinct users of each micro-batch."""
    base = scratch_dir(spark, "fan-out")
    sinks = {
        "rows": lambda df, n: df.write.mode("overwrite").parquet(f"{base}/rows/batch={n}"),
        "users": lambda df, n: df.distinct().write.mode("overwrite").parquet(f"{base}/users/batch={n}"),
    }
    _in_portions(spark, sf, base, lambda ev: jobs.fan_out(ev.select("user_id", "event_type"), sinks, f"{base}/checkpoint"))
    read = [spark.read.parquet(f"{base}/{name}").groupBy(F.lit(name).alias("sink"), "event_type").agg(F.count("*").alias("n"))
            for name in sinks]
    return read[0].unionByName(read[1])


@query("stream_append_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_append_counts(spark, sf):
    base = scratch_dir(spark, "counts")
    _in_portions(spark, sf, base, lambda ev: jobs.counts(
        ev.select("event_type"), ["event_type"], f"{base}/out", f"{base}/checkpoint"))
    return jobs.latest_counts(spark, f"{base}/out", ["event_type"])
