"""Streams over several micro-batches and restarts give the batch result."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from borgata.operators.monitor import previous_value
from borgata.streaming import jobs

SCHEMA = "id long, k string, ts timestamp, v double"


@pytest.fixture
def landing(spark, tmp_path):
    """Folder with three small files; a later call of the returned function lands another."""
    folder = tmp_path / "landing"
    rows = [(i, "hot" if i % 3 else f"k{i % 4}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), None if i % 7 == 0 else float(i * 37 % 101)) for i in range(80)]

    def land(lo, hi):
        spark.createDataFrame(rows[lo:hi], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    for lo in (0, 20, 40):
        land(lo, lo + 20)
    return folder, land


def stream(spark, folder):
    return jobs.source(spark, str(folder), spark.read.parquet(str(folder)).schema, files_per_batch=1)


def test_dedup_and_resume(spark, landing, tmp_path):
    folder, land = landing
    run = lambda: jobs.append(jobs.dedup(stream(spark, folder).select("k"), ["k"]), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    run()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["hot", "k0", "k1", "k2", "k3"]
    land(60, 80)
    run()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_dedup_with_watermark(spark, landing, tmp_path):
    folder, _ = landing
    unique = jobs.dedup(stream(spark, folder), ["id"], "ts", "1 hour")
    jobs.append(unique.select("id"), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 60


def test_counts_over_batches(spark, landing, tmp_path):
    folder, land = landing
    run = lambda: jobs.counts(stream(spark, folder), ["k"], str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    run()
    land(60, 80)
    run()
    got = {r["k"]: r["n"] for r in jobs.latest_counts(spark, str(tmp_path / "o"), ["k"]).collect()}
    want = {r["k"]: r["count"] for r in spark.read.parquet(str(folder)).groupBy("k").count().collect()}
    assert got == want


def test_upsert_over_batches(spark, landing, tmp_path):
    folder, land = landing
    run = lambda: jobs.upsert(stream(spark, folder), str(tmp_path / "log"), str(tmp_path / "c"), "k", "id").awaitTermination()
    run()
    land(60, 80)
    run()
    rows = spark.read.parquet(str(folder)).collect()
    want = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        want[r["k"]] = r["v"] if r["v"] is not None else want.get(r["k"])
    for df in (jobs.upserted(spark, str(tmp_path / "log"), "k"),):
        assert {r["k"]: r["v"] for r in df.collect()} == want
    jobs.compact(spark, str(tmp_path / "log"), str(tmp_path / "log2"), "k")
    assert {r["k"]: r["v"] for r in jobs.upserted(spark, str(tmp_path / "log2"), "k").collect()} == want


def test_price_drops_over_batches(spark, landing, tmp_path):
    folder, land = landing

    def run():
        jobs.price_drops(stream(spark, folder).filter("v IS NOT NULL"), str(tmp_path / "alerts"), str(tmp_path / "state"),
                         str(tmp_path / "c"), ["k"], ["ts", "id"], "v").awaitTermination()

    run()
    land(60, 80)
    run()
    got = {r["id"] for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    whole = previous_value(spark.read.parquet(str(folder)).filter("v IS NOT NULL"), ["k"], ["ts", "id"], "v")
    assert got == {r["id"] for r in whole.filter(F.col("v") < F.col("previous")).collect()} and got


def test_late_rows(spark, tmp_path):
    """A late batch: its lower seq does not win the upsert, its cheaper price is reported."""
    schema = "k string, at int, v double"

    def batch(number, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{number}"))
        source = lambda: jobs.source(spark, str(tmp_path / "in/*"), spark.createDataFrame([], schema).schema)
        jobs.upsert(source(), str(tmp_path / "log"), str(tmp_path / "c1"), "k", "at").awaitTermination()
        jobs.price_drops(source(), str(tmp_path / "alerts"), str(tmp_path / "state"), str(tmp_path / "c2"), ["k"], ["at"], "v",
                         slots=4).awaitTermination()

    batch(0, [("a", 10, 5.0), ("a", 30, 4.0), ("b", 30, 9.0), (None, 1, 8.0)])
    batch(1, [("a", 20, 3.0), ("c", 1, 1.0), (None, 2, 7.0)])
    batch(2, [("a", 40, 3.5), ("b", 20, 9.5)])
    assert {r["k"]: r["v"] for r in jobs.upserted(spark, str(tmp_path / "log"), "k").collect()} == {"a": 3.5, "b": 9.0, "c": 1.0}
    alerts = {(r["k"], r["at"], r["v"], r["previous"]) for r in spark.read.parquet(str(tmp_path / "alerts")).collect()}
    assert alerts == {("a", 30, 4.0, 5.0), ("a", 20, 3.0, 4.0), (None, 2, 7.0, 8.0), ("a", 40, 3.5, 4.0)}


def test_fan_out(spark, landing, tmp_path):
    folder, _ = landing

    def broken(df, n):
        raise RuntimeError("down")

    def good(df, n):
        df.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={n}"))

    jobs.fan_out(stream(spark, folder), {"a": broken, "b": good}, str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60
