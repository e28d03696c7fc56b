"""Sources, sinks, catalog, reports."""

import json

import pytest
from pyspark.sql import functions as F

from borgata import session
from borgata.sources import catalog, readers, writers


def test_csv_round_trip_and_bad_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c\nd'), (2, None), (3, "è")], "id int, t string").coalesce(1)
    path = str(tmp_path / "csv")
    assert writers.export_csv(df, path)
    back = readers.read_csv(spark, path, "id INT, t STRING", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert not writers.export_csv(df.filter("id > 9"), str(tmp_path / "none"))
    (tmp_path / "bad.csv").write_text("id,t\n1,a\nx,b\n")
    rows = readers.read_csv(spark, str(tmp_path / "bad.csv"), "id INT, t STRING", keep_bad=True).collect()
    assert [(r["id"], r["_corrupt_record"]) for r in rows] == [(1, None), (None, "x,b")]


def test_many_files_and_unions(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"ads_savona_{n}.csv").write_text(f"id,t\n{n},a\n")
    paths = [str(tmp_path / f"ads_savona_{n}.csv") for n in (1, 2)]
    assert readers.read_csv(spark, paths, "id INT, t STRING", multi_line=True).count() == 2
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([("q",)], "y string")
    assert [tuple(r) for r in readers.union_sources([a, b]).collect()] == [(1, None), (None, "q")]


def test_file_names(spark):
    df = spark.createDataFrame([("/l/ads_savona_rent.csv",), ("/l/export.csv",)], "p string").coalesce(1)
    got = [tuple(r[0]) for r in df.select(readers.file_name_parts(F.col("p"))).collect()]
    assert got == [("savona", "rent"), ("unknown", "unknown")]
    assert df.limit(1).select(readers.container_name(F.col("p"))).first()[0] == "savona_rent"
    with pytest.raises(Exception, match="no container name"):
        df.select(readers.container_name(F.col("p"))).collect()
    assert writers.export_name("savona", "rent") == "ads_savona_rent"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page int, status int, maxPages int, results array<string>")


def test_pages_stop_before_the_first_failure(spark):
    df = pages(spark, [(1, 200, 9, ["a"]), (2, 200, 9, ["b", "c"]), (3, 500, None, None), (4, 200, 9, ["d"])])
    got = lambda d: sorted((r["page"], r["pos"], r["result"]) for r in d.collect())
    assert got(readers.paged_results(df)) == [(1, 0, "a"), (2, 0, "b"), (2, 1, "c")]
    assert got(readers.paged_results(df, start_page=2, max_pages=2)) == [(2, 0, "b"), (2, 1, "c")]
    assert got(readers.paged_results(df, start_page=4)) == [(4, 0, "d")]
    short = pages(spark, [(1, 200, 1, ["a"]), (2, 200, 1, ["b"])])
    assert got(readers.paged_results(short)) == [(1, 0, "a")]


def test_pages_until_last(spark):
    df = spark.createDataFrame([(0, False, ["a"]), (1, True, ["b"]), (2, True, ["c"])], "page int, last boolean, content array<string>")
    assert sorted(r["entry"] for r in readers.paged_until_last(df).collect()) == ["a", "b"]
    assert readers.paged_until_last(df.filter("page = 0")).count() == 1


def test_validation(spark):
    df = spark.createDataFrame([(1, '{"id": 5, "url": "u"}'), (2, '{"id": 5}'), (3, "{bad"), (4, '{"id": "x", "url": "u"}'), (5, None)], "n int, json string")
    valid, rejected = readers.validate(df, "json", "id BIGINT, url STRING", ["id", "url"])
    assert [tuple(r) for r in valid.collect()] == [(1, 5, "u")]
    assert {r["n"]: r["reason"] for r in rejected.collect()} == {2: "missing url", 3: "unreadable", 4: "unreadable", 5: "unreadable"}


def test_seen_state(spark, tmp_path):
    assert readers.seen_ids(spark, str(tmp_path / "none")).count() == 0
    spark.createDataFrame([("a",)], "id string").write.parquet(str(tmp_path / "seen"))
    assert readers.seen_ids(spark, str(tmp_path / "seen")).first()["id"] == "a"


def test_airports_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("iata_code,iso_region,iso_country,latitude_deg,longitude_deg\nGOA,IT-42,IT,44.4,8.8\n")
    assert tuple(readers.read_airports(spark, str(tmp_path / "a.csv")).first()) == ("GOA", 44.4, 8.8, "IT-42,IT")


def test_json_and_envelope(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "id int, t string").coalesce(1)
    writers.write_json(df, str(tmp_path / "j"))
    lines = [json.loads(x) for f in (tmp_path / "j").glob("*.json") for x in f.read_text().splitlines()]
    assert lines == [{"id": 1, "t": None}, {"id": 2, "t": "b"}]
    writers.write_envelope(df, str(tmp_path / "e"), "src", "2024")
    assert spark.read.json(str(tmp_path / "e/_metadata")).first()["count"] == 2
    assert spark.read.json(str(tmp_path / "e/items")).count() == 2
    assert writers.metadata(df, "s", "t").first()["count"] == 2


def test_partition_overwrite_touches_only_its_folders(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "id int, city string"
    writers.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], schema), path, ["city"])
    writers.write_partitioned(spark.createDataFrame([(3, "a")], schema), path, ["city"])
    assert sorted((r["id"], r["city"]) for r in spark.read.parquet(path).collect()) == [(2, "b"), (3, "a")]


def test_tables_and_catalog(spark):
    df = spark.createDataFrame([(1, "GE"), (2, None)], "id int, province string")
    writers.write_table(df, "ads_savona", "replace")
    writers.write_table(df, "ads_savona", "append")
    assert spark.table("ads_savona").count() == 4
    with pytest.raises(Exception):
        writers.write_table(df, "ads_savona", "fail")
    with pytest.raises(ValueError):
        writers.write_table(df, "ads_savona", "other")
    writers.write_table(spark.createDataFrame([(1,)], "x int"), "plain", "replace")
    assert "ads_savona" in catalog.split_tables(spark) and "plain" not in catalog.split_tables(spark)
    assert [r[0] for r in catalog.provinces(spark).collect()] == ["GE"]
    assert [r[0] for r in catalog.provinces(spark, table="ads_savona").collect()] == ["GE"]
    with pytest.raises(ValueError):
        catalog.provinces(spark, table="plain")
    writers.create_listing_table(spark, "listings_store")
    assert len(spark.table("listings_store").columns) == 59
    for t in ("ads_savona", "plain", "listings_store"):
        spark.sql(f"DROP TABLE {t}")


def test_versions(spark, tmp_path):
    path = str(tmp_path / "v")
    assert writers.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        writers.read_version(spark, path)
    assert writers.write_version(spark.range(1), path) == 1
    # The new version may read the one before it.
    assert writers.write_version(writers.read_version(spark, path).union(spark.range(1)), path) == 2
    (tmp_path / "v" / "v=3").mkdir()
    assert writers.versions(spark, path) == [1, 2]
    assert writers.read_version(spark, path).count() == 2 and writers.read_version(spark, path, 1).count() == 1


def test_times_of_changed_rows_only(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "2024-01-01", True), (2, "2024-01-01", "2024-01-01", False), (3, None, None, False)],
                               "id int, created_at string, updated_at string, changed boolean").coalesce(1)
    out = writers.stamp_times(df, F.lit("now"), F.col("changed")).collect()
    assert [(r["created_at"], r["updated_at"]) for r in out] == [("2024-01-01", "now"), ("2024-01-01", "2024-01-01"), ("now", "now")]


def test_fan_out_isolates_failures(spark, tmp_path):
    def broken(_):
        raise RuntimeError("sink down")

    out = writers.fan_out(spark.range(3), {"bad": broken, "csv": lambda d: writers.write_csv(d, str(tmp_path / "o"))})
    assert out == {"bad": "failed: sink down", "csv": "ok"}


def test_load_report(spark):
    rows = [("hot", i, f"e{i}" if i % 2 else None) for i in range(100)] + [("ok", 200, None)]
    r = {x["file"]: x for x in writers.load_report(spark.createDataFrame(rows, "file string, n long, err string"), "file", "err", "n").collect()}
    assert (r["hot"]["total"], r["hot"]["successful"], r["hot"]["failed"]) == (100, 50, 50)
    assert r["hot"]["errors"] == [f"e{i}" for i in range(1, 20, 2)] and r["ok"]["errors"] == []


def test_collected_sets(spark):
    c, calls = catalog.Collected(), []
    make = lambda: calls.append(1) or spark.range(2)
    assert c.get_or_compute("q", "a", make).count() == 2 and c.get_or_compute("q", "a", make).count() == 2
    assert len(calls) == 1 and c.has("q", "a") and not c.has("q", "b") and c.get("z", "a") is None
    c.clear("q", "a")
    assert not c.has("q", "a")


def test_scratch_folder_follows_the_session(spark, monkeypatch):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = session.scratch_dir(spark, "x"), session.scratch_dir(spark, "x")
    assert one.startswith(base) and one != two


def test_json_or_text_and_result_lists(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("plain words",)], "t string").coalesce(1)
    got = [r[0] for r in df.select(readers.json_or_text(F.col("t"), "a INT")).collect()]
    assert got[0]["value"]["a"] == 1 and got[0]["raw"] is None and got[1]["raw"] == "plain words"
    lists = spark.createDataFrame([('{"list": {"items": [{"n": 1}]}}',), ('{"list": "none"}',), ("{}",)], "t string").coalesce(1)
    assert [len(r[0]) for r in lists.select(readers.result_list(F.col("t"), "STRUCT<n: INT>")).collect()] == [1, 0, 0]


def test_rewrite_sorted(spark, tmp_path):
    path = str(tmp_path / "s")
    writers.write_version(spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "via string, piano int").repartition(3), path)
    assert writers.rewrite_sorted(spark, path, "via", "piano") == 2
    assert [tuple(r) for r in writers.read_version(spark, path).coalesce(1).collect()] == [("a", 1), ("a", 2), ("b", 1)]


def test_shuffle_sizing():
    assert session.shuffle_partitions(10) == 200
    assert session.shuffle_partitions(100 * 1024**4) == 524_288


def test_partitioned_document_upsert(spark, tmp_path):
    path, schema = str(tmp_path / "docs"), "id string, price double, city string, ingest_seq long"
    writers.upsert_partitioned(spark.createDataFrame([("a", 1.0, "x", 1), ("b", 2.0, "y", 2)], schema), path)
    untouched = {p.name for p in (tmp_path / "docs/city=y").glob("*.parquet")}
    writers.upsert_partitioned(spark.createDataFrame([("a", None, "x", 1), ("c", 3.0, "x", 2), ("a", 9.0, "x", 3)], schema), path)
    got = sorted((r["id"], r["price"], r["city"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 9.0, "x"), ("b", 2.0, "y"), ("c", 3.0, "x")]
    assert {p.name for p in (tmp_path / "docs/city=y").glob("*.parquet")} == untouched


def test_load_report_seconds(table):
    from borgata.sources import writers

    rows = table([("a", 1, "2024-01-01 00:00:00", None), ("a", 2, "2024-01-01 00:01:00.5", "bad"), ("a", 3, None, None),
                  ("b", 4, "2024-01-01 00:00:00", None), ("c", 5, None, "worse")], "f string, i int, at string, err string")
    got = {r["f"]: (r["failed"], r["seconds"]) for r in writers.load_report(rows, "f", "err", "i", stamp="at").collect()}
    assert got == {"a": (1, 60.5), "b": (0, 0.0), "c": (1, None)}
    assert "seconds" not in writers.load_report(rows, "f", "err", "i").columns
