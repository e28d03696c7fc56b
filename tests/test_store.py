"""The keyed store: results of a row-by-row loader, stability, idempotence."""

import random

import pytest
from pyspark.sql import functions as F

from borgata.operators import store
from borgata.sources.keyed import KeyedTable

STORE = "url string, price double, label string, status string"
BATCH = "url string, price double, label string, extra string, ingest_seq long"


def row_by_row(existing, batch, replace):
    """What a sequential loader does, as the truth to compare with."""
    table = {r[0]: list(r) for r in existing}
    new = updated = 0
    for url, price, label, _, _ in sorted(batch, key=lambda r: r[4]):
        if url is None:
            continue
        if url in table:
            if replace:
                old = table[url]
                table[url] = [url, old[1] if price is None else price, old[2] if label is None else label, old[3]]
                updated += 1
        else:
            table[url] = [url, price, label, None]
            new += 1
    return sorted(tuple(r) for r in table.values()), new, updated


def case(seed):
    r = random.Random(seed)
    existing = [(f"u{i}", float(i), "old", "s") for i in range(40)]
    batch = []
    for i in range(200):
        # One key holds a third of the batch.
        key = "u7" if i % 3 == 0 else r.choice([None, *[f"u{n}" for n in range(30, 80)]])
        batch.append((key, r.choice([None, float(r.randrange(1000))]), r.choice([None, f"l{i}"]), "x", i))
    return existing, batch


@pytest.mark.parametrize("replace", [True, False])
@pytest.mark.parametrize("parts", [1, 7])
def test_upsert_equals_row_by_row(spark, replace, parts):
    existing, batch = case(1)
    want, new, updated = row_by_row(existing, batch, replace)
    s, b = spark.createDataFrame(existing, STORE), spark.createDataFrame(batch, BATCH).repartition(parts)
    got = sorted((tuple(r) for r in store.upsert(s, b, replace_existing=replace).collect()))
    assert got == want
    assert tuple(store.upsert_counts(s, b, replace_existing=replace).first()) == (new, updated)


def test_upsert_is_idempotent(spark):
    existing, batch = case(2)
    s, b = spark.createDataFrame(existing, STORE), spark.createDataFrame(batch, BATCH)
    once = store.upsert(s, b)
    assert sorted(once.collect()) == sorted(store.upsert(once, b).collect())


def test_keep_first_is_stable(spark):
    rows = [(None if i % 5 == 0 else "hot" if i % 3 == 0 else f"k{i % 11}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ingest_seq long")
    want = {}
    for k, i in rows:
        want.setdefault(k, i)
    for parts in (1, 7, 50):
        got = {r["k"]: r["ingest_seq"] for r in store.keep_first(df.repartition(parts), ["k"]).collect()}
        assert got == want
    assert store.keep_first(df, [F.lower("k")]).columns == ["k", "ingest_seq"]


def test_document_upsert(spark):
    old = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0)], "id string, city string, price double")
    new = spark.createDataFrame([("a", "x", None, 1), ("a", "y", 5.0, 2), ("b", "x", 7.0, 3), ("b", "x", 8.0, 4)],
                                "id string, city string, price double, ingest_seq long")
    assert sorted(map(tuple, store.upsert_documents(old, new).collect()), key=repr) == sorted(
        [("a", "x", None), ("a", "y", 5.0), ("b", "x", 8.0)], key=repr)
    ids = spark.createDataFrame([("", "r1"), (None, "r1"), ("u", "r1")], "uuid string, r string").coalesce(1)
    got = [r[0] for r in ids.select(store.document_id(F.col("uuid"), F.col("r"))).collect()]
    assert got[0] == got[1] and len(got[0]) == 64 and got[2] == "u"


def test_delete(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "url string, v int")
    d = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "url string")
    assert sorted(r["v"] for r in store.delete_keys(s, d).collect()) == [2, 3]
    assert store.delete_count(s, d).first()["deleted"] == 1


def test_dedup_against_seen(spark):
    items = spark.createDataFrame([("1", 0), ("2", 1), ("2", 2), (None, 3), ("", 4), (None, 5)], "id string, ingest_seq long")
    seen = spark.createDataFrame([("1",), ("9",)], "id string")
    got = sorted(r["ingest_seq"] for r in store.dedup_against_seen(items, seen).collect())
    assert got == [1, 3, 4, 5]
    assert sorted(r[0] for r in store.seen_union(seen, items).collect()) == ["1", "2", "9"]


def test_small_batch_leaves_the_store_unshuffled(spark, executed, tmp_path):
    """With a batch below the broadcast threshold the store side is scanned, not shuffled."""
    spark.range(2000).select(F.col("id").cast("string").alias("url"), F.lit(1.0).alias("price")).write.parquet(str(tmp_path / "s"))
    spark.createDataFrame([("5", 2.0, 1)], "url string, price double, ingest_seq long").write.parquet(str(tmp_path / "b"))
    plan = executed(store.upsert(spark.read.parquet(str(tmp_path / "s")), spark.read.parquet(str(tmp_path / "b"))))
    final = plan.split("== Initial Plan")[0]
    assert "LeftOuter, BuildRight" in final and "SortMergeJoin" not in final and "Python" not in final


@pytest.mark.parametrize("replace", [True, False])
def test_bucketed_upsert_equals_row_by_row(spark, replace, tmp_path):
    rng = random.Random(11)
    keyed = KeyedTable(spark, str(tmp_path / "store"), "url", 3)
    existing = [(f"u{i}", float(i), None if i % 4 == 0 else "old", "s") for i in range(12)]
    keyed.replace(spark.createDataFrame(existing, STORE))
    for portion in range(2):
        batch = [(rng.choice(["u1", "u4", "u30", "u31", None]), rng.choice([None, 7.5]), rng.choice([None, "n"]), "x", portion * 20 + i)
                 for i in range(20)]
        keyed.upsert(spark.createDataFrame(batch, BATCH).repartition(4), replace)
        existing, _, _ = row_by_row(existing, batch, replace)
        assert sorted(map(tuple, keyed.read().collect())) == existing
    keyed.upsert(spark.createDataFrame([], BATCH), replace)
    assert sorted(map(tuple, keyed.read().collect())) == existing and len(keyed.read(1).collect()) == 12


def test_bucketed_store_is_never_shuffled(spark, executed, tmp_path):
    """Also for a batch that is not broadcast: no exchange on the table's side, none to write it."""
    keyed = KeyedTable(spark, str(tmp_path / "store"), "url", 4)
    keyed.replace(spark.range(5000).selectExpr("concat('u', id) AS url", "1.0D AS price", "'a' AS label", "'s' AS status"))
    batch = spark.range(4000).selectExpr("concat('u', id * 2) AS url", "2.0D AS price", "'b' AS label", "'x' AS extra", "id AS ingest_seq")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        plan = executed(keyed.merged(batch)).split("== Initial Plan ==")[0]
        side = plan[plan.index("SortMergeJoin"):]
        scan = next(line for line in side.splitlines() if "keyed_" in line)
        above = side.splitlines()[1:side.splitlines().index(scan)]
        assert "Bucketed: true" in plan and "FullOuter" in plan and not any("Exchange" in x or "Sort " in x for x in above)
        assert plan.count("Range (") == 1  # the batch is collapsed once
        keyed.upsert(batch)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    files = [f for f in (tmp_path / "store" / "v=2").iterdir() if f.suffix == ".parquet"]
    assert len(files) == 4  # one a bucket: written where the buckets were joined
    assert keyed.read().filter("price = 2").count() == 4000 and keyed.read().count() == 6500


def test_bucketed_table_of_another_session(spark, tmp_path):
    keyed = KeyedTable(spark, str(tmp_path / "seen"), "id", 2)
    with pytest.raises(FileNotFoundError):
        keyed.read()
    keyed.replace(spark.createDataFrame([("a",), ("b",)], "id string"))
    spark.sql(f"DROP TABLE {keyed._name(1)}")  # as if never registered here
    (tmp_path / "seen" / "v=2").mkdir()  # a write that died
    items = spark.createDataFrame([("b", 1), ("c", 2), ("c", 3), ("", 4), (None, 5)], "id string, ingest_seq long")
    got = keyed.unseen(items).collect()
    assert sorted((r["id"] or "", r["ingest_seq"]) for r in got) == [("", 4), ("", 5), ("c", 2)]
    assert keyed.add_keys(items) == 3
    assert sorted(r["id"] for r in keyed.read().collect()) == ["a", "b", "c"]
