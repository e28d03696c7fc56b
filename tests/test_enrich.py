"""Lookups, zones, distance, snapshots, calendar."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from borgata.operators import lookup, monitor
from borgata.sources import readers

CITY_MAP = {
    "brugo": {"idComune": "A1", "name": "Brugo", "path": "/brugo/",
              "macrozones": {"rive": {"id": "Z1", "name": "Rive"}, "colle": {"id": "Z2", "name": "Colle"}}},
    "pian_torre": {"idComune": "A2", "name": "Pian Torre", "path": "/pian-torre/", "macrozones": {"rive": {"id": "Z3", "name": "Rive"}}},
    "sola": {"idComune": "A3", "name": "Sola", "path": "/sola/", "macrozones": {}},
}


@pytest.fixture(scope="module")
def rows(spark):
    landed = spark.createDataFrame([(json.dumps(CITY_MAP),), ("not json",)], "json string")
    return lookup.explode_dimension(readers.parse_city_map(landed))


def test_dimension_round_trip(rows):
    assert rows.count() == 4
    assert {(r["city_key"], r["zone_key"]) for r in rows.collect()} == {
        ("brugo", "rive"), ("brugo", "colle"), ("pian_torre", "rive"), ("sola", None)}
    back = {r["city_key"]: r["macrozones"] for r in lookup.rebuild_dimension(rows).collect()}
    assert set(back["brugo"]) == {"rive", "colle"} and back["brugo"]["colle"]["name"] == "Colle"
    assert set(lookup.dimension_contract(rows).first()) == {0}


def test_zone_names(spark, rows):
    asked = spark.createDataFrame([("Brugo", "RIVE"), ("brugo", "rive"), ("brugo", "porto"), ("nessuna", "rive")], "city_key string, zone_name string")
    found, missing = lookup.resolve_zones(asked, rows)
    assert [tuple(r) for r in found.collect()] == [("brugo", "rive", "Z1")]
    assert sorted(tuple(r) for r in missing.collect()) == [("brugo", "porto"), ("nessuna", "rive")]


def test_zone_upsert(spark, rows):
    def entry(i, kind, key, parents):
        return {"id": i, "type": kind, "label": "L" + i, "keyurl": key, "parents": parents}

    savona = [{"id": "9", "type": 1, "label": "SV", "keyurl": "sv"}, {"id": "77", "type": 2, "label": "Savona", "keyurl": "Savona"}]
    brugo = [{"id": "A1", "type": 2, "label": "Brugo", "keyurl": "Brugo"}]
    docs = [json.dumps([entry("1", 3, "Zona-Mare", savona), entry("2", 3, "zona-mare", savona), entry("3", 2, "x", savona),
                        entry("4", 3, "Rive", brugo), entry("5", 3, "Nuova", brugo), entry("", 3, "y", savona), entry("7", 3, "z", savona[:1])]),
            json.dumps({"error": 1})]
    landed = spark.createDataFrame([(d,) for d in docs], "json string")
    entries = readers.parse_zone_entries(landed)
    cities, zones = lookup.upsert_zones(entries, rows.select("city_key", "city_id", "city_name", "path").distinct(),
                                        rows.filter("zone_key IS NOT NULL").select("city_key", "zone_key", "zone_id", "zone_name"))
    assert {r["city_key"]: r["path"] for r in cities.collect()}["savona"] == "/savona/"
    got = {(r["city_key"], r["zone_key"]): r["zone_id"] for r in zones.collect()}
    assert got[("savona", "zona_mare")] == "1" and got[("brugo", "rive")] == "Z1" and got[("brugo", "nuova")] == "5"
    assert len(got) == 5


@pytest.fixture(scope="module")
def cities(spark):
    return spark.createDataFrame([("genova", "6846", "Genova", 0), ("vado ligure", "7051", "Vado Ligure", 1), ("finale ligure", "70", "Finale", 2)],
                                 "city_key string, city_id string, city_name string, dim_ord int")


def test_exact_lookup(spark, cities):
    q = spark.createDataFrame([(" GENOVA ",), ("Finale",), ("roma",), (None,)], "query string").coalesce(1)
    assert sorted((r["query"], r["city_id"]) for r in lookup.exact_lookup(q, cities).collect() if r["query"]) == [
        (" GENOVA ", "6846"), ("Finale", "70"), ("roma", None)]


def brute_force(query, cities):
    best, score = None, 0
    for key, *_ in cities:
        s = sum(1 for a in query.lower().strip().split() for b in key.split() if a in b or b in a)
        if s > score:
            best, score = key, s
    return best, score or None


def test_fuzzy_lookup_against_brute_force(spark, cities):
    words = ["ligure", "gen", "vado ligure", "a a", "finale ligure sud", "genovaa", "zzz", "e", "Ligure finale", "vad lig", "  ", "x genova genova"]
    known = [tuple(r) for r in cities.orderBy("dim_ord").collect()]
    # One query holds most rows.
    asked = [(i, "ligure") for i in range(100, 200)] + list(enumerate(words))
    got = {r["i"]: (r["city_key"], r["score"]) for r in lookup.fuzzy_lookup(spark.createDataFrame(asked, "i int, query string"), cities).collect()}
    assert len(got) == len(asked)
    for i, w in asked:
        assert got[i] == brute_force(w, known), w


def test_fuzzy_lookup_has_no_cross_join(spark, cities, executed):
    plan = executed(lookup.fuzzy_lookup(spark.createDataFrame([("gen",)], "query string"), cities))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_distances(spark):
    raw = spark.createDataFrame([("GOA", "IT-42", "IT", 44.41, 8.83), ("STN", "GB-ENG", "GB", 51.88, 0.235)],
                                "iata_code string, iso_region string, iso_country string, latitude_deg double, longitude_deg double")
    places = readers.airport_dimension(raw)
    assert places.filter("code = 'GOA'").first()["location"] == "IT-42,IT"
    legs = spark.createDataFrame([("GOA", "STN"), ("GOA", "???")], "origin string, destination string").coalesce(1)
    near, none = lookup.leg_distances(legs, places).collect()
    assert near["km"] == pytest.approx(1044, abs=10) and none["km"] is None


def test_detail_over_preview(spark):
    p = spark.createDataFrame([("a", 1, "p"), ("b", 2, "p")], "url string, price int, label string")
    d = spark.createDataFrame([("a", None, "d", True)], "url string, price int, label string, lift boolean")
    assert sorted(tuple(r) for r in lookup.detail_over_preview(p, d).collect()) == [("a", 1, "d", True), ("b", 2, "p", None)]


def test_min_occurrence_cascades(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] * 2 + [("b", "x")] * 2 + [(None, "x")] * 5
    df = spark.createDataFrame(rows, "city string, zone string")
    # City b goes first, which leaves zone x with 3 of its rows.
    assert sorted(tuple(r) for r in lookup.min_occurrence(df, [("city", 3), ("zone", 3)]).collect()) == [("a", "x")] * 3
    assert lookup.min_occurrence(df, [("zone", 3), ("city", 3)]).count() == 3


def test_snapshots(spark):
    schema = "totalPrice double, k string, queryDatetime string"
    old = spark.createDataFrame([(10.0, "a", "t0"), (10.0, "b", "t0"), (10.0, "c", "t0")], schema)
    new = spark.createDataFrame([(9.0, "a", "t1"), (10.0, "b", "t1"), (12.0, "c", "t1"), (1.0, "d", "t1")], schema)
    drops = monitor.price_drops(old, new, ["k"])
    assert drops.columns == ["totalPrice", "totalPrice_new", "k", "queryDatetime", "queryDatetime_new"]
    assert [tuple(r) for r in drops.collect()] == [(10.0, 9.0, "a", "t0", "t1")]


@pytest.mark.parametrize("parts", [1, 2, 40, None])
def test_previous_value_however_it_is_cut(spark, parts):
    """The plain lag: hot key, NULL keys, NULL values, NULL and far outlying order values, a burst of equal times."""
    start = dt.datetime(2024, 1, 1)
    when = lambda i: None if i % 50 == 7 else dt.datetime(1970, 1, 2) if i == 11 else start + dt.timedelta(seconds=(i * i) % 977 // 5)
    rows = [("hot" if i % 3 else None if i % 5 == 0 else f"k{i % 5}", when(i), i, None if i % 13 == 0 else float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n int, v double")
    got = {r["n"]: r["previous"] for r in monitor.previous_value(df, ["k"], ["ts", "n"], "v", parts=parts).collect()}
    last, want = {}, {}
    for k, t, n, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or start, r[2])):
        want[n] = last.get(k)
        last[k] = v
    assert got == want


def test_weekend_trips(spark):
    day = lambda s: F.lit(s).cast("date")
    trips = spark.range(1).select(monitor.weekend_trips(day("2024-05-15"), day("2024-05-24"), 4).alias("t")).first()["t"]
    assert [(str(t["departure"]), str(t["back"])) for t in trips] == [("2024-05-31", "2024-06-03"), ("2024-06-07", "2024-06-10")]
    sunday = spark.range(1).select(monitor.weekend_trips(day("2024-05-19"), day("2024-01-01"), 1).alias("t")).first()["t"]
    assert str(sunday[0]["departure"]) == "2024-05-17"


def test_zip_dates(spark):
    df = spark.createDataFrame([([1, 2], [3, 4])], "a array<int>, b array<int>")
    assert [tuple(x) for x in df.select(monitor.zip_dates(F.col("a"), F.col("b")).alias("z")).first()["z"]] == [(1, 3), (2, 4)]
    for a, b in (([1], [1, 2]), (None, [1])):
        bad = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
        with pytest.raises(Exception, match="equal numbers"):
            bad.select(monitor.zip_dates(F.col("a"), F.col("b"))).collect()


def test_trips(spark):
    leg = lambda o, d, when, n, p: {"departureAirport": {"iataCode": o, "name": o.title(), "countryName": "Italia"},
                                    "arrivalAirport": {"iataCode": d, "name": d.title(), "countryName": "UK"}, "departureDate": when,
                                    "flightNumber": n, "price": {"value": p, "currencyCode": "EUR"}}
    answers = [{"fares": [{"outbound": leg("GOA", "STN", "2024-05-31T06:30:00", "FR1234", 10.005), "inbound": leg("STN", "GOA", "presto", "FR99", 20.0)}]}, {"fares": []}]
    fares = readers.parse_fares(spark.createDataFrame([(json.dumps(a),) for a in answers], "json string"))
    r = monitor.flatten_trips(fares, F.lit("2024-05-01").cast("timestamp")).collect()
    assert len(r) == 1
    assert r[0]["outbound_flightNumber"] == "FR 1234" and r[0]["outbound_originFull"] == "Goa, Italia"
    assert r[0]["outbound_departureTime"] == dt.datetime(2024, 5, 31, 6, 30) and r[0]["inbound_departureTime"] is None
    assert r[0]["totalPrice"] == pytest.approx(30.0, abs=0.011)


def test_common_words_cost_a_query_one_row(spark):
    """2,000 queries with a word that fits all of 500 cities: rows in proportion to the answers."""
    names = [f"santa{chr(97 + i % 26)}{chr(97 + i // 26)} marina" for i in range(500)]
    cities = spark.createDataFrame([(n, i, n.title(), i) for i, n in enumerate(names)], "city_key string, city_id long, city_name string, dim_ord long")
    words = lookup.fuzzy_scores(spark.createDataFrame([(f"a q{i}q",) for i in range(2000)], "query string"), cities)
    assert {(r["city_key"], r["score"], r["n"]) for r in words.groupBy("city_key", "score").agg(F.count("*").alias("n")).collect()} == {(names[0], 2, 2000)}
    seen = []
    kept = lookup._candidates
    try:
        lookup._candidates = lambda w, s: (seen.append(kept(w, s)), seen[-1])[1]
        asked = [f"a {names[i % 500].split()[0]}" for i in range(500)]
        got = {r["_q"]: r["city_key"] for r in lookup.fuzzy_scores(spark.createDataFrame([(q,) for q in asked], "query string"), cities).collect()}
    finally:
        lookup._candidates = kept
    assert got == {q: q[2:] + " marina" for q in asked}
    assert seen[0].count() <= 1000


def test_fuzzy_lookup_of_random_words(spark):
    import random

    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abc", weights=[5, 2, 1], k=rng.randint(1, 4)))
    keys = sorted({" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(80)}, key=lambda x: rng.random())
    cities = spark.createDataFrame([(k, i, k, i) for i, k in enumerate(keys)], "city_key string, city_id long, city_name string, dim_ord long")
    asked = [" ".join(word() if rng.random() < 0.9 else "zz" for _ in range(rng.randint(0, 5))) for _ in range(300)]
    got = {r["i"]: (r["city_key"], r["score"]) for r in lookup.fuzzy_lookup(spark.createDataFrame(list(enumerate(asked)), "i int, query string"), cities).collect()}
    assert got == {i: brute_force(q, [(k,) for k in keys]) for i, q in enumerate(asked)}
