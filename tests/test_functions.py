import math
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from borgata.functions import flags, floors, garage, geo, numbers, registry, text, titles

NBSP = "\xa0"


def cases(fn, *pairs):
    return pytest.param(fn, [p[0] for p in pairs], [p[1] for p in pairs])


@pytest.mark.parametrize("fn, given_, expected", [
    cases(text.strip, (f"{NBSP} a b\t", "a b"), ("", ""), (None, None), ("  x　", "x")),
    cases(text.collapse, (f" a {NBSP} \n b ", "a b"), ("a b", "a b"), ("a\nb", "a b"), (None, None)),
    cases(text.clean_text, (" null ", None), ("nan", None), ("None", None), ("nano", "nano"), (None, None)),
    cases(text.strip_tags, ("<b>a</b> c", "a c"), ("1 < 2", "1 < 2"), ("plain", "plain"), (None, None)),
    cases(text.tokens, (f"a{NBSP}b  c", ["a", "b", "c"]), ("  ", []), ("", []), (None, None)),
    cases(text.parse_digits, ("<i>piani 3 di 5</i>", "3"), ("nessuno", "nessuno"), (None, None)),
    cases(text.parse_date_text, ("dal <b>1/12/2024</b>", "1/12/2024"), ("subito", "subito")),
    cases(lambda c: text.extract_value(c, r"(\d+) locali"), ("2 bagni 3 locali", "3"), ("2 bagni", "2"), ("x", "x"), (None, None)),
    cases(text.slug, ("Vado Ligure", "vado-ligure")),
    cases(text.zone_key, ("Centro-Storico", "centro_storico")),
    cases(text.id_from_url, ("https://h/annunci/12/", "12"), ("https://h/annunci/12", "12")),
    cases(text.listing_id, ("https://h/itm/12?hash=a/b", "12"), ("https://h/itm/12", "12"), (None, None)),
    cases(lambda c: text.absolute_url(c, "https://h"), ("/a", "https://h/a"), ("http://x/a", "http://x/a")),
    cases(lambda c: text.has_feature(c, "Balcone"), ("Cantina, Balcone ", 1), ("Balconea", 0), (None, 0)),
    cases(text.keyword_array, ('"Vista Mare" box', ["vista mare", "box"]), ('un "due', ["un", '"due'])),
    cases(lambda c: text.money(c.cast("double")), ("1234.5", "€ 1,234.50")),
    cases(lambda c: text.percent(c.cast("double")), ("12.345", "12.35%"), ("5", "5.00%")),
    cases(numbers.whole_number, ("3", 3), (" 4 ", 4), ("2.0", 2), ("2.5", None), ("x", None), (None, None)),
    cases(numbers.first_number, ("95.5 m²", 95.5), ("a", None), ("10.", 10.0)),
    cases(numbers.price_token, ("€ 1.950", "1950"), ("€ 650/mese", "650/mese"), (f"€{NBSP}1.950,50", "1950"), ("", None)),
    cases(numbers.surface_text, ("80 m²", "80 "), ("80", "80")),
    cases(numbers.surface_first_number, ("circa 95 m²", 95), ("n/d", None)),
    cases(numbers.surface_first_token, ("95 m²", 95), ("circa 95", None), ("95,5 m²", None), (f"40{NBSP}m²", 40)),
    cases(numbers.locale_number, ("€ 1.250.000,50", 1250000.5), ("1.950", 1950.0), ("12,5", 12.5), ("x", None)),
    cases(lambda c: numbers.locale_number(c, legacy=True), ("€ 1.250.000", 1250.0), ("1.950", 1950.0), ("1,5", 1.5)),
    cases(numbers.market_price, ("EUR 1.234,56", 1234.56), ("10,00 a 20,00", 10.0), ("$10.99", 1099.0), ("EUR 5", 5.0), ("gratis", None)),
    cases(lambda c: numbers.market_price(c, legacy=True), ("10,00 a 20,00", None), ("$10.99", 1099.0), ("EUR 5", 5.0)),
    cases(numbers.stored_price, ("€ 250.000", 250000.0), ("trattativa", None), ("€ 1.000,5", None)),
    cases(numbers.digit_group, ("€ 1.000/mese", 1000), ("Piano rialzato", None), ("Piano rialzato, 25", 25), (".", None)),
    cases(flags.to_flag, ("Sì", True), ("S", True), (" no ", False), ("1", True), ("0.0", False), ("forse", None), (None, None)),
    cases(flags.feature_flag, ("Si, presente", True), ("autonomo", False), ("ok", None), (None, None)),
    cases(flags.detail_flag, ("Sì", True), ("Presente", True), ("si", True), ("no", False), (None, None)),
    cases(floors.floor_letter, ("<b>T</b>", "0"), ("3", "3")),
    cases(floors.floor_store, ("2", 2), ("Piano Terra", 0), ("interrato", 0), ("seminterrato", 0), ("ammezzato", 1), ("attico", None), (None, None)),
    cases(floors.floor_fetch, ("2", 2), ("piano rialzato", 0), ("Piano terra", None), ("-1", None), (None, None)),
    cases(floors.normalize_floor, ("3", 3.0), ("piano terra", 0.0), ("da 2 a 5", 5.0), ("seminterrato, 2", 2.0),
          ("interrato (-1)", -1.0), ("Ammezzato", 0.5), ("su più livelli", None), ("ultimo", None), (None, None),
          ("da seminterrato a piano terra", 0.0), ("interrato (-2), 1", 2.0)),
    cases(garage.garage_type, ("1 in Box Privato", "private box"), ("garage comune", "common park"), ("no", "no park"), (None, "no park")),
    cases(lambda c: F.to_json(garage.garage_details(c)),
          ("1 in box privato, 2 in parcheggio/garage comune", '{"primary_type":"private_box","private_box_count":1,"common_park_count":2,"total_count":3}'),
          ("box privato", '{"primary_type":"no_park","private_box_count":0,"common_park_count":0,"total_count":0}'),
          (None, '{"primary_type":"no_park","private_box_count":0,"common_park_count":0,"total_count":0}')),
])
def test_scalar(apply, fn, given_, expected):
    assert apply(fn, given_) == expected


def test_keyword_text_split():
    assert text.keywords('Casa "Vista Mare"  box') == ["casa", "vista mare", "box"]
    assert text.keywords("") == []


def test_composite_title(apply):
    got = apply(titles.split_composite_title, [
        "Giacca, blu, brand: Zara, condizioni: Buone, €10.00, €12.50 Protezione inclusa",
        "brand: Zara, condizioni: Buone, €10.00, €12.50 Protezione",
        "Giacca, Zara, Buone, 12,50 €, €9.00 x y",
        "Giacca, Zara, Buone, €5.00",
        "Giacca, Zara, Buone, n.d., €5.00 x",
        "Giacca, Zara",
        None,
    ])
    assert tuple(got[0]) == ("Giacca,blu", "Zara", "Buone", 10.0, 12.5, "Protezione inclusa")
    assert tuple(got[1]) == ("Zara", "Zara", "Buone", 10.0, 12.5, "Protezione")
    assert tuple(got[2]) == ("Giacca", "Zara", "Buone", 1250.0, 9.0, "x y")
    assert got[3] is None
    assert got[4]["price"] is None and got[4]["notes"] == "x"
    assert got[5] is None and got[6] is None


def test_label_map_last_label_wins(apply):
    got = apply(titles.label_map, [["1 locale", "80 m²", "80 MQ", "", None, "Balcone e terrazzo", "3 locali"]], "array<string>")[0]
    assert got["locali"] == "1 locale" and got["superficie"] == "80 MQ"
    assert got["balcone"] == "Balcone e terrazzo" and got["terrazzo"] is None


def test_language(spark):
    df = spark.createDataFrame([("the cat and the dog",), ("le chat et les chiens du roi",), ("xyzzy",)], "t string")
    s = df.select(titles.language_scores(F.col("t")).alias("h"))
    cols = {x: F.col(f"h.{x}") for x in titles.STOP_WORDS}
    assert [r[0] for r in s.select(titles.detect_language(cols)).collect()] == ["en", "fr", None]


def test_haversine(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(44.41), F.lit(8.93), F.lit(45.46), F.lit(9.19)).alias("d"),
        geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("far"),
        geo.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("none"),
    ).first()
    assert row["d"] == pytest.approx(118.5, abs=0.5)
    assert row["far"] == pytest.approx(math.pi * 6371)
    assert row["none"] is None


def test_sql_functions(spark):
    assert "slug" in registry.register_sql_functions(spark)
    row = spark.sql(
        "SELECT strip_tags('<b>a</b>'), first_number('95.5 m'), listing_id('h/itm/3?x'), slug('A b'), "
        "garage_type('1 in box privato'), has_feature('a, b', 'b'), haversine_km(0D, 0D, 0D, 1D), first_number('x')"
    ).first()
    assert list(row)[:6] == ["a", 95.5, "3", "a-b", "private box", 1]
    assert row[6] == pytest.approx(111.19, abs=0.01) and row[7] is None
    plan = spark.sql("SELECT slug(s) FROM VALUES ('A b') t(s)")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_sql_functions_say_what_the_columns_say(spark):
    registry.register_sql_functions(spark)
    words = ["a, Balcone", "a,\xa0Balcone ", "Balcone", "<b>1 in box privato</b>", "2 in Parcheggio", "x 95.5 <", "h/itm/3?x", "A b", "", None]
    df = spark.createDataFrame([(w, float(i * 37 % 90), float(i * 53 % 180)) for i, w in enumerate(words)], "t string, a double, b double")
    t, a, b = F.col("t"), F.col("a"), F.col("b")
    pairs = {
        "strip_tags(t)": text.strip_tags(t), "first_number(t)": numbers.first_number(t), "listing_id(t)": text.listing_id(t),
        "slug(t)": text.slug(t), "garage_type(t)": garage.garage_type(t), "has_feature(t, 'Balcone')": text.has_feature(t, "Balcone"),
        "haversine_km(a, b, -a, b - 180)": geo.haversine_km(a, b, -a, b - 180),
    }
    for sql, column in pairs.items():
        for row in df.select(F.expr(sql).alias("x"), column.alias("y")).collect():
            assert row["x"] == (pytest.approx(row["y"]) if isinstance(row["y"], float) else row["y"]), (sql, row)


def test_whole_numbers_keep_all_digits(apply):
    texts = ["9007199254740993", " -9223372036854775808 ", "9223372036854775808", "12.0", "12.5", "1e3", "9007199254740993.0", "x", "", None]
    assert apply(numbers.whole_number, texts) == [9007199254740993, -9223372036854775808, None, 12, None, 1000, 9007199254740993, None, None, None]


BLANK_OR_TEXT = st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x1f\x85\xa0       　€1", max_size=25)


@settings(max_examples=15, deadline=None)
@given(st.lists(BLANK_OR_TEXT, min_size=1, max_size=40))
def test_blanks_follow_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").coalesce(1).orderBy("i")
    got = df.select(text.collapse(F.col("x")), text.strip(F.col("x")), text.tokens(F.col("x"))).collect()
    for v, r in zip(values, got):
        assert r[0] == re.sub(r"\s+", " ", v).strip()
        assert r[1] == v.strip()
        assert r[2] == v.split()
