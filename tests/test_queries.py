"""Filters, statistics and percentiles."""

import statistics

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from borgata.operators import filters, quantiles, stats


@pytest.fixture(scope="module")
def ads(spark):
    rows = [(1, "rent", "Savona", 500.0, "mare"), (2, "sale", "Genova", None, "monte"), (3, "rent", None, 700.0, None),
            (4, "sale", "Savona", 500.0, "MARE e box"), (5, None, "Genova", 900.0, "100% mare")]
    return spark.createDataFrame(rows, "id int, contract string, city string, price double, text string").coalesce(1)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_read_listings(ads):
    assert ids(filters.read_listings(ads, {"contract": "rent"}, "id")) == [1, 3]
    assert ids(filters.read_listings(ads, {"city": ["Savona", "Genova"], "contract": "sale"}, "id DESC", 1)) == [4]
    assert ids(filters.read_listings(ads, {"contract": None}, "id")) == []
    assert ids(filters.read_listings(ads, None, "price, id")) == [2, 1, 4, 3, 5]
    assert ids(filters.read_listings(ads, None, "price DESC, id")) == [5, 3, 1, 4, 2]
    assert len(ids(filters.read_listings(ads, None, None))) == 5
    for bad in ({"nope": 1},):
        with pytest.raises(ValueError):
            filters.by_dictionary(ads, bad)
    for bad in ("id; DROP", "id UP", "nope"):
        with pytest.raises(ValueError):
            filters.order_by_text(ads, bad)


def test_text_search(ads):
    assert sorted(ids(filters.search_text(ads, "MARE", ["text", "city"]))) == [1, 4, 5]
    assert sorted(ids(filters.search_text(ads, "m_re", ["text"]))) == [1, 4, 5]
    assert sorted(ids(filters.search_text(ads, "savona", ["text", "city"]))) == [1, 4]
    with pytest.raises(ValueError):
        filters.search_text(ads, "x", ["zone"])


def test_ranges_and_nulls(ads):
    assert ids(filters.value_range(ads, {"price": (500, 700)})) == [1, 3, 4]
    assert ids(filters.value_range(ads, {"price": (None, None)})) == [1, 3, 4, 5]
    assert ids(filters.drop_nulls(ads)) == [1, 4]
    assert ids(filters.drop_nulls(ads, ["city"])) == [1, 2, 4, 5]


@pytest.mark.parametrize("mode, kept, dropped", [("And", [4], [2, 3]), ("Or", [1, 4, 5], [1, 2, 3, 5])])
def test_keywords(ads, mode, kept, dropped):
    assert ids(filters.keyword_include(ads, "text", "mare box", mode)) == kept
    assert ids(filters.keyword_exclude(ads, "text", "mare box", mode)) == dropped


def test_empty_keywords_keep_all(ads):
    assert len(ids(filters.keyword_include(ads, "text", " "))) == 5
    assert len(ids(filters.keyword_exclude(ads, "text", ""))) == 5


def test_parametric_searches(spark):
    homes = spark.createDataFrame([(1, 100.0, 2, 1, 60, ["a", "b"]), (2, 100.0, 2, 1, 60, ["a"]), (3, None, 2, 1, 60, None)],
                                  "id int, price_value double, rooms int, bathrooms int, surface_m2 int, features array<string>").coalesce(1)
    assert ids(filters.listing_search(homes)) == [1, 2, 3]
    assert ids(filters.listing_search(homes, max_price=200, min_surface=50, features=["a", "b"])) == [1]
    posts = spark.createDataFrame([(1, "Infermiere", "OPEN", "8", "2024-03-01", 1000.0), (2, "Medico", "CLOSED", "8", "2024-04-01", 2000.0)],
                                  "id int, text string, status string, regioneId string, date string, salary double").coalesce(1)
    posts = posts.withColumn("date", F.to_date("date"))
    assert ids(filters.posting_search(posts)) == [1]
    assert ids(filters.posting_search(posts, status=None, regione_id="8")) == [1, 2]
    assert ids(filters.posting_search(posts, status=["CLOSED"], date_from="2024-03-15", salary_max=2000)) == [2]
    assert ids(filters.posting_search(posts, text="infer")) == [1]
    fares = spark.createDataFrame([(1, "2024-01-05 06:00:00", 10.0, "GOA"), (2, "2024-01-06 23:59:30", 90.0, "STN")],
                                  "id int, departureTime string, price double, origin string").coalesce(1)
    fares = fares.withColumn("departureTime", F.to_timestamp("departureTime"))
    assert ids(filters.fare_search(fares, date_from="2024-01-05", date_to="2024-01-06")) == [1, 2]
    assert ids(filters.fare_search(fares, date_to="2024-01-05", time_from="05:00", origin="GOA")) == [1]
    assert ids(filters.fare_search(fares, max_price=50, time_from="07:00")) == []


def test_block_words(spark):
    df = spark.createDataFrame([("Please solve the CAPTCHA, access forbidden",), ("ok",), (None,)], "h string").coalesce(1)
    assert [r[0] for r in df.select(filters.block_words_found(F.col("h"))).collect()] == [["captcha", "access forbidden"], [], []]


NUMBERS = st.one_of(st.integers(-50, 50).map(float), st.floats(-1e9, 1e9), st.sampled_from([0.0, 1e-300, -1e-300, 1e300]))


@settings(max_examples=6, deadline=None)
@given(st.lists(NUMBERS, min_size=1, max_size=60))
def test_percentiles_are_exact(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    got = {r["fraction"]: r["value"] for r in quantiles.exact_percentiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for p, g in got.items():
        assert g == pytest.approx(float(np.percentile(values, p * 100)), rel=1e-12, abs=1e-290)


def test_percentiles_per_group_with_null_keys(spark):
    rows = [("a", float(i)) for i in range(101)] + [(None, 5.0), (None, 7.0), ("b", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {r["k"]: (r["p50"], r["p99"]) for r in stats.percentiles(df, "v", ["k"], [50, 99]).collect()}
    assert got["a"] == (50.0, 99.0)
    assert got[None] == (6.0, pytest.approx(6.98))
    assert "b" not in got


def test_percentile_with_one_hot_value(spark):
    """A value that holds most rows is one counted row after the first pass."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, 1000.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = quantiles.wide_percentiles(df, "v", {"m": 0.5, "q": 0.9}).first()
    values = [1000.0 if i % 3 else float(i) for i in range(3000)]
    assert got["m"] == np.percentile(values, 50) and got["q"] == pytest.approx(np.percentile(values, 90))


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_percentile_ranks_over_ranges(spark, parts):
    """Ranks add up over any number of ranges, with NULL groups, ties and both zeros."""
    values = [((i * 7919) % 500) / 4 - 30 for i in range(900)] + [0.0, -0.0]
    rows = [(k, v) for k in ("a", None) for v in values] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["_k0"]: r for r in quantiles._placed(df, "v", fractions, ["k"], accuracy=10, parts=parts).collect()}
    assert set(got) == {"a", None, "one"} and got["a"]["n"] == 902 and got["one"]["_a2"] == 3.0
    for k in ("a", None):
        for i, p in enumerate(fractions):
            value = got[k][f"_a{i}"] + (got[k][f"_z{i}"] - got[k][f"_a{i}"]) * got[k][f"_w{i}"]
            assert value == pytest.approx(np.percentile(values, p * 100), abs=1e-12)


def test_a_bracket_of_a_million_values_is_shared_out(spark):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    out = quantiles._placed(df, "v", [0.5], [], accuracy=6, parts=16)  # one bracket around everything
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_range#" in line for line in windows)
    path = out.inputFiles()[0].rsplit("/", 1)[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_range").count().collect()]
    assert sum(sizes) == 1_000_000 and len(sizes) == 16 and max(sizes) < 3 * 1_000_000 / 16
    row, values = out.first(), np.arange(1_000_000) * 7919 % 1_000_003
    assert row["_a0"] + (row["_z0"] - row["_a0"]) * row["_w0"] == np.percentile(values, 50)


def test_describe(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 6.0), (None, 3.0), ("b", None)], "k string, v double")
    got = {r["k"]: r for r in stats.describe(df, "v", ["k"]).collect()}
    assert got["a"]["median"] == 2.0 and got["a"]["mean"] == 3.0
    assert got["a"]["std"] == pytest.approx(statistics.stdev([1, 2, 6]))
    assert got[None]["median"] == 3.0 and got[None]["std"] is None and "b" not in got
    assert stats.describe(df, "v").first()["median"] == 2.5


def test_spread_of_large_values_does_not_cancel(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id") % 7).alias("v"))
    assert stats.describe(df, "v").first()["std"] == pytest.approx(statistics.stdev([i % 7 for i in range(1000)]), rel=1e-9)


def test_counts_and_top(ads):
    assert [tuple(r) for r in stats.value_counts(ads, "city").collect()] == [("Genova", 2), ("Savona", 2), (None, 1)]
    assert [tuple(r) for r in stats.value_counts(ads, "city", keep_null=False, order="value").collect()] == [("Genova", 2), ("Savona", 2)]
    assert stats.top_values(ads, "city", 1).collect()[0]["city"] == "Genova"


def test_store_summary(spark):
    df = spark.createDataFrame([("Attico", "Savona", "€ 1.000", "2024-01-01"), ("Attico", None, "€ 500/mese", "2024-02-01"), (None, "Savona", None, None)],
                               "typology_name string, city string, price_formatted string, created_at string")
    got = {(r["section"], r["name"]): (r["n"], r["average_price"], r["latest"]) for r in stats.store_summary(df).collect()}
    assert got == {("total", None): (3, None, "2024-02-01"), ("type", "Attico"): (2, 1000.0, None), ("city", "Savona"): (2, None, None)}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 29, 30, 30]] + [(None,)], "v double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, "v").collect()} == {0: 1, 1: 1, 29: 3}
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [tuple(r) for r in stats.histogram(same, "v").collect()] == [(0, 2)]


def test_overlay_and_lines(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    g = stats.gaussian_overlay(df, "v").orderBy("i").collect()
    assert len(g) == 500 and g[0]["x"] == 1.0 and g[-1]["x"] == pytest.approx(100.0)
    sd = statistics.stdev(range(1, 101))
    assert max(r["y"] for r in g) == pytest.approx(100 * 99 / 30 / (sd * (2 * np.pi) ** 0.5), rel=1e-4)
    lines = {r["line"]: r["value"] for r in stats.sigma_lines(df, "v").collect()}
    assert lines["median"] == 50.5 and lines["mean+3s"] == pytest.approx(50.5 + 3 * sd) and lines["p25"] == 25.75


def test_profile_and_yield(ads):
    top = stats.null_profile(ads).collect()
    assert [tuple(r) for r in top[:2]] == [("city", "string", 1, 5), ("contract", "string", 1, 5)]
    y = stats.filter_yield(ads, F.col("price") > 600).first()
    assert tuple(y) == (2, 5, 40.0)
    assert stats.best_by(ads.filter("price IS NOT NULL"), "id", "price").first()["id"] == 5
    assert stats.best_by(ads.filter("price IS NOT NULL"), "id", "price", lowest=True).first()["id"] == 1


def test_entry_counts(spark):
    df = spark.createDataFrame([("a, b",), ("b ,c",), (None,)], "f string")
    assert {tuple(r) for r in stats.entry_counts(df, "f").collect()} == {("a", 1), ("b", 2), ("c", 1)}
    assert [tuple(r) for r in stats.entry_counts(df, "f", 2).collect()] == [("b", 2)]


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "captcha", 200), (2, "fine", 403), (3, "fine", 200), (4, None, None)], "id int, html string, status int").coalesce(1)
    good, bad = filters.split_blocked(df)
    assert ids(good) == [2, 3] and ids(bad) == [1, 4]
    good, bad = filters.split_blocked(df, status="status")
    assert ids(good) == [1, 3] and ids(bad) == [2, 4]
