"""Cleaning operators, with a small golden listing document."""

import json

from pyspark.sql import Row, functions as F

from borgata import schemas
from borgata.operators import clean
from borgata.sources import readers


#: Column -> landed text and the typed value it must give.
ADS = {
    "id": [("70", 70), ("9007199254740993", 9007199254740993), ("x7", None), (None, None)],
    "title": [("\xa0Rustico \t con  orto", "Rustico con orto"), ("nan", None), ("", ""), ("nanna", "nanna")],
    "isNew": [("vero", True), ("F", False), ("maybe", None), (None, None)],
    "luxury": [("1.0", True), ("0.0", False), ("Y", True), ("", None)],
    "price_value": [("12e3", 12000.0), ("-1", -1.0), ("trattativa", None), ("1.5", 1.5)],
    "surface": [("ca. 64,5 mq", 64), ("m²", None), ("7", 7), (None, None)],
    "floor_number": [("piano rialzato", 0), ("AMMEZZATO", 1), (" 11 ", 11), ("mansarda", None)],
    "elevator": [("FALSO", False), ("si", True), ("2", None), (None, None)],
    "url": [(" https://e.test/z ", "https://e.test/z"), ("None", None), ("e.test", "e.test"), (None, None)],
    "created_at": [("2023-02-30", None), ("2023-03-01 23:59:59", 23), ("domani", None), (None, None)],
}


def test_coerce_types(spark):
    landed = list(zip(*[[text for text, _ in cells] for cells in ADS.values()]))
    df = spark.createDataFrame(landed, ", ".join(f"{c} string" for c in ADS)).coalesce(1)
    out = clean.coerce_types(df)
    rows = out.collect()
    for column, cells in ADS.items():
        got = [r["surface_m2" if column == "surface" else column] for r in rows]
        if column == "created_at":
            got = [t and t.hour for t in got]
        assert got == [value for _, value in cells], column
    assert dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["elevator"] == "boolean"


def test_typed_columns_pass_through(spark):
    df = spark.createDataFrame([(1, 2.5, True)], "id int, price_value double, elevator boolean")
    assert clean.coerce_types(df).first() == Row(id=1, price_value=2.5, elevator=True)


def test_clean_on_read(spark):
    df = spark.createDataFrame([(" a ", "None", "2024-01-02")], "title string, city string, created_at string")
    row = clean.clean_on_read(df).first()
    assert row["title"] == "a" and row["city"] is None and row["created_at"].day == 2


# Excerpt of an agent document and the cleaned cells it must give.
DOCUMENT = {
    "immobili": [
        {"url": "https://e.test/1/", "titolo": "Monolocale via  Nizza", "descrizione": "rif: 1\nAffittasi\n\nzona mare ",
         "piano": "4", "locali": "1", "bagni": "1", "superficie": "50 m²", "prezzo": "€ 650/mese", "cauzione": "€ 1.950",
         "climatizzazione": "null"},
        {"url": "https://e.test/2/", "titolo": " Quadrilocale", "descrizione": None, "piano": "Piano rialzato", "locali": "4",
         "bagni": "2", "superficie": "40 m² | commerciale 40 m²", "prezzo": "€ 1.000/mese"},
        {"url": "https://e.test/3/", "titolo": "Trilocale", "descrizione": "x", "piano": "Piano rialzato, 25", "prezzo": None},
    ]
}


def test_golden_listing(spark, tmp_path):
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(DOCUMENT, indent=1))
    rows = clean.clean_listing(readers.read_documents(spark, str(path), schemas.AGENT_LISTING)).collect()
    assert [r["prezzo"] for r in rows] == [650, 1000, None]
    assert [r["superficie"] for r in rows] == [50, 40, None]
    assert [r["piano"] for r in rows] == [4, None, 25]
    assert [r["piano_raw"] for r in rows] == ["4", "Piano rialzato", "Piano rialzato, 25"]
    assert [r["titolo"] for r in rows] == ["Monolocale via Nizza", "Quadrilocale", "Trilocale"]
    assert rows[0]["descrizione"] == "rif: 1 Affittasi zona mare" and rows[1]["descrizione"] is None
    assert rows[0]["cauzione"] == "€ 1.950" and rows[0]["climatizzazione"] == "null"
    bare = tmp_path / "bare.json"
    bare.write_text(json.dumps(DOCUMENT["immobili"][:2]))
    assert readers.read_documents(spark, str(bare), schemas.AGENT_LISTING).count() == 2


def test_null_normalize_and_raw_json(spark):
    df = spark.createDataFrame([("", float("nan"), 1), ("a", 2.0, None)], "s string, d double, i int")
    assert [tuple(r) for r in clean.null_normalize(df).collect()] == [(None, None, 1), ("a", 2.0, None)]
    with_json = clean.add_raw_json(spark.createDataFrame([(1, "à")], "a int, b string"))
    assert with_json.first()["raw_data"] == '{"a":1,"b":"à"}'
    assert clean.add_raw_json(with_json).columns == with_json.columns


def test_flatten_ads(spark):
    ads = [
        {"realEstate": {"id": 1, "uuid": "u", "title": "t", "typology": {"name": "Attico"}, "price": {"value": 5, "visible": True},
                        "advertiser": {"agency": {"displayName": "Ag"}},
                        "properties": [{"surface": "80 m²", "ga4features": ["a", "b"], "location": {"city": "Savona", "nation": {"name": "Italia"}},
                                        "floor": {"value": "3"}, "photo": {"id": 7, "urls": {"small": "s"}}, "views": [{"name": "mare"}, {"id": 2}]},
                                       {"surface": "other"}]}, "seo": {"url": "https://e.test/1"}, "idGeoHash": "u0"},
        {"realEstate": {"id": 2, "properties": []}, "seo": {"url": "https://e.test/2"}},
        {"realEstate": {"id": 3, "properties": [{"ga4features": None}]}},
        {"seo": {"url": "https://e.test/4"}},
    ]
    landed = spark.createDataFrame([(json.dumps(a),) for a in ads], "j string").coalesce(1)
    nested = landed.select(F.from_json("j", schemas.NESTED_AD).alias("a")).select("a.*")
    flat = clean.flatten_ads(nested)
    rows = flat.collect()
    assert [r["id"] for r in rows] == [1, 2, 3]
    assert rows[0]["ga4features"] == "a, b" and rows[0]["views"] == "mare, " and rows[0]["nation"] == "Italia"
    assert rows[0]["photo_url_small"] == "s" and rows[0]["agency_name"] == "Ag" and rows[0]["surface"] == "80 m²"
    assert rows[1]["surface"] is None and rows[2]["ga4features"] is None
    assert flat.columns[:5] == ["id", "uuid", "title", "url", "geoHash"]
    assert flat.columns.index("price_value") < flat.columns.index("surface") < flat.columns.index("agency_id")


def test_column_helpers(spark):
    assert clean.ordered_columns(["zzz", "photo_b", "agency_a", "price_x", "id"]) == ["id", "price_x", "agency_a", "photo_b", "zzz"]
    df = spark.createDataFrame([(1, "m")], "surface int, macrozone string")
    assert clean.select_existing(df, ["surface", "zone", "none"], {"zone": "macrozone"}).columns == ["surface", "zone"]
    spread = clean.spread_struct(df.select(F.lit(1).alias("k"), F.struct("surface", "macrozone").alias("s")), "s")
    assert spread.columns == ["k", "Surface", "Macrozone"]


def test_details_and_processors(spark):
    df = spark.createDataFrame(
        [("€\xa01.250.000", "95,5 m²", "Sì", "3 locali", "classe a4", "nel 1970", [" a ", "", None, "b"], [" x ", "y"])],
        "prezzo string, superficie string, ascensore string, locali string, classe_energetica string, anno_costruzione string, "
        "altre_caratteristiche array<string>, descrizione array<string>",
    )
    r = clean.normalize_details(df).first()
    assert (r["prezzo"], r["superficie"], r["ascensore"], r["locali"], r["classe_energetica"], r["anno_costruzione"]) == (
        1250000.0, 95.5, True, 3, "A4", 1970)
    assert r["altre_caratteristiche"] == ["a", "b"] and r["descrizione"] == "x y"
    assert clean.normalize_details(df, legacy=True).first()["prezzo"] == 1250.0
    multi = spark.createDataFrame([(["<b>€ 1.950</b>", "€ 650/mese"], [None, "", "2"], None, ["x", "y 3"])],
                                  "prezzo array<string>, bagni array<string>, posti_auto array<string>, numero_piani array<string>")
    assert tuple(clean.process_fields(multi).first()) == ("1950 650/mese", "2", "", "x")
    lat, lng = clean.script_coordinates(F.col("s"))
    script = spark.createDataFrame([('x = {"lat": 44.3, "lng": 8.4}',), ('{"lat": 44.3}',)], "s string").coalesce(1)
    assert [tuple(r) for r in script.select(lat, lng).collect()] == [(44.3, 8.4), (None, None)]
    labels = spark.createDataFrame([(1, ["1 locale"])], "id int, labels array<string>")
    assert clean.preview_labels(labels).first()["locali"] == "1 locale"
    assert clean.rename_canonical(spark.createDataFrame([(1,)], "Prezzo int")).columns == ["Price"]
