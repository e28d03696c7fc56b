"""Cleaning, typing and reshaping of records."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata import schemas
from borgata.functions import text
from borgata.operators import clean, extract
from borgata.plans.base import SQL_BLANK, listings, query, sql_collapse, sql_strip, table, with_listings
from borgata.sources import readers


@query("coerce_types", with_listings(r"""
SELECT id, CASE WHEN id % 4 <> 0 THEN rooms + 9007199254740993 END AS rooms,
 CASE WHEN id % 3 = 0 THEN NULL ELSE price_value END AS price_value,
 CASE WHEN lower(trim(elevator)) IN ('true','yes','y','t','sì','si','s','vero','1','1.0') THEN true
  WHEN lower(trim(elevator)) IN ('false','no','n','f','falso','0','0.0') THEN false END AS elevator,
 CASE WHEN lower(floor_text) LIKE '%terra%' OR lower(floor_text) LIKE '%rialzato%' THEN 0
  WHEN lower(floor_text) LIKE '%ammezzato%' THEN 1 ELSE TRY_CAST(trim(floor_text) AS BIGINT) END AS floor_number,
 TRY_CAST(nullif(regexp_extract(surface, '\d+'), '') AS BIGINT) AS surface_m2,
 CASE WHEN id % 5 = 0 THEN NULL ELSE strftime(created_at, '%Y-%m-%d') END AS created_day FROM listings"""))
def coerce_types(spark, sf):
    df = listings(spark, sf, "id", "rooms", "price_value", "elevator", "floor_text", "surface", "created_at")
    dirty = df.select(
        "id", F.when(F.col("id") % 4 == 0, "n/d").otherwise((F.col("rooms") + 9007199254740993).cast("string")).alias("rooms"),
        F.when(F.col("id") % 3 == 0, "su richiesta").otherwise(F.col("price_value").cast("string")).alias("price_value"),
        "elevator", F.col("floor_text").alias("floor_number"), "surface",
        F.when(F.col("id") % 5 == 0, "ieri").otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
    )
    typed = clean.coerce_types(dirty)
    return typed.select("id", "rooms", "price_value", "elevator", "floor_number", "surface_m2",
                        F.date_format("created_at", "yyyy-MM-dd").alias("created_day"))


@query("clean_text", rf"""
WITH c AS (SELECT doc_id, {sql_collapse("concat(' ', CASE WHEN doc_id % 50 = 0 THEN 'null' ELSE text END, chr(160))")} AS t FROM documents)
SELECT doc_id, md5(CASE WHEN t IN ('nan', 'None', 'null') THEN NULL ELSE t END) AS digest,
 CASE WHEN t IN ('nan', 'None', 'null') THEN NULL ELSE length(t) END AS n FROM c""")
def clean_text(spark, sf):
    dirty = F.concat(
        F.lit(" "), F.when(F.col("doc_id") % 50 == 0, "null").otherwise(F.col("text")), F.lit("\xa0")
    )
    c = table(spark, sf, "documents").select("doc_id", text.clean_text(dirty).alias("t"))
    return c.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query("null_normalize", """
SELECT l_orderkey, l_linenumber, nullif(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE l_returnflag END, '') AS flag,
 CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount END AS discount FROM lineitem""")
def null_normalize(spark, sf):
    dirty = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_linenumber") % 3 == 0, "").otherwise(F.col("l_returnflag")).alias("flag"),
        F.when(F.col("l_linenumber") % 4 == 0, float("nan")).otherwise(F.col("l_discount")).alias("discount"),
    )
    return clean.null_normalize(dirty)


@query("row_to_json", """
SELECT p_partkey, p_name, p_size, concat('{"p_partkey":', CAST(p_partkey AS STRING), ',"p_name":"', p_name, '","p_size":', CAST(p_size AS STRING), '}') AS raw_data
FROM part""")
def row_to_json(spark, sf):
    return clean.add_raw_json(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))


@query("rename_canonical", """
SELECT p_name AS "Title", p_retailprice AS "Price", p_partkey AS "Link", p_size AS "Favorites", p_type AS "Condition" FROM part""")
def rename_canonical(spark, sf):
    return clean.rename_canonical(
        table(spark, sf, "part").select(
            F.col("p_name").alias("Titolo"), F.col("p_retailprice").alias("Prezzo"), F.col("p_partkey").alias("Link"),
            F.col("p_size").alias("Preferiti"), F.col("p_type").alias("Condizione"),
        )
    )


def _group(c: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract({c}, '[\\d\\.]+'), ''), '.', '') AS BIGINT)"


@query("clean_listing", with_listings(rf"""
SELECT id, {sql_collapse('title')} AS titolo, {_group('price_text')} AS prezzo, {sql_strip('price_text')} AS prezzo_raw,
 {_group('surface')} AS superficie, surface AS superficie_raw, {_group('floor_text')} AS piano, trim(floor_text) AS piano_raw,
 trim(elevator) AS ascensore FROM listings"""))
def clean_listing(spark, sf):
    df = listings(spark, sf, "id", "title", "price_text", "surface", "floor_text", "elevator")
    return clean.clean_listing(
        df.withColumnsRenamed({"title": "titolo", "price_text": "prezzo", "surface": "superficie",
                               "floor_text": "piano", "elevator": "ascensore"})
    )


def _locale(c: str, before: str = "", after: str = "", shape: str = r"\d+(?:\.\d+)*(?:,\d+)?") -> str:
    plain = f"regexp_replace({c}, '{SQL_BLANK}', ' ', 'g')"
    return f"TRY_CAST(replace(replace(nullif(regexp_extract({plain}, '{before}({shape}){after}', 1), ''), '.', ''), ',', '.') AS DOUBLE)"


_DETAIL = {
    "prezzo": "price_text",
    "superficie": "surface",
    "cauzione": "CASE WHEN id % 2 = 0 THEN concat('€ 1.', CAST(100 + id % 900 AS STRING), '.000,50') END",
    "locali": "concat(CAST(1 + id % 6 AS STRING), ' locali')",
    "ascensore": "elevator",
    "classe_energetica": "CASE id % 3 WHEN 0 THEN 'classe a4 - 12 kWh' WHEN 1 THEN 'Classe\xa0G' ELSE 'esente' END",
    "anno_costruzione": "concat('circa ', CAST(1900 + id % 120 AS STRING))",
    "descrizione": "concat('  ', title, ' ')",
}


@query("detail_normalize", with_listings(rf"""
, d AS (SELECT id, {", ".join(f"{e} AS {n}" for n, e in _DETAIL.items())} FROM listings)
SELECT id, {_locale('prezzo', '€? *')} AS prezzo, {_locale('prezzo', '€? *', '', r'\d+(?:[\.,]\d+)?')} AS prezzo_legacy,
 {_locale('superficie', '', ' *m²?')} AS superficie, {_locale('cauzione', '€? *')} AS cauzione,
 {_locale('cauzione', '€? *', '', r'\d+(?:[\.,]\d+)?')} AS cauzione_legacy,
 TRY_CAST(regexp_extract(locali, '\d+') AS BIGINT) AS locali,
 contains(lower(ascensore), 'sì') OR contains(lower(ascensore), 'si ') OR contains(lower(ascensore), 'presente')
  OR contains(lower(ascensore), 'yes') OR lower(ascensore) IN ('si', 'true') AS ascensore,
 CASE id % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'G' ELSE 'esente' END AS classe_energetica, 1900 + id % 120 AS anno_costruzione,
 {sql_strip('descrizione')} AS descrizione FROM d"""))
def detail_normalize(spark, sf):
    df = listings(spark, sf, "id", "price_text", "surface", "elevator", "title")
    raw = df.selectExpr("id", *[f"{e} AS {n}" for n, e in _DETAIL.items()])
    raw = raw.withColumns({"prezzo_l": F.col("prezzo"), "cauzione_l": F.col("cauzione")})
    legacy = clean.normalize_details(
        raw.select("id", F.col("prezzo_l").alias("prezzo"), F.col("cauzione_l").alias("cauzione"), F.struct(*raw.columns).alias("_r")),
        legacy=True,
    )
    back = legacy.select(F.col("prezzo").alias("prezzo_legacy"), F.col("cauzione").alias("cauzione_legacy"), "_r.*")
    return clean.normalize_details(back).drop("prezzo_l", "cauzione_l")


@query("multivalue_take_first", r"""
WITH m AS (SELECT o_orderkey AS id, [NULL, '', concat('<b>', o_orderpriority, '</b>'), 'x'] AS bagni,
 [concat('<i>€ ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ',00</i>'), '€ 1.500/mese'] AS prezzo FROM orders)
SELECT id, regexp_replace(bagni[3], '<[^>]*>', '', 'g') AS bagni,
 concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ' 1500/mese') AS prezzo,
 concat(CAST(o_orderkey % 90 AS STRING), ' ', ' ') AS superficie, strftime(o_orderdate, '%d/%m/%Y') AS data
FROM m JOIN orders ON id = o_orderkey""")
def multivalue_take_first(spark, sf):
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.array(F.lit(None), F.lit(""), F.concat(F.lit("<b>"), "o_orderpriority", F.lit("</b>")), F.lit("x")).alias("bagni"),
        F.array(
            F.concat(F.lit("<i>€ "), F.floor("o_totalprice").cast("string"), F.lit(",00</i>")), F.lit("€ 1.500/mese")
        ).alias("prezzo"),
        F.array(F.concat((F.col("o_orderkey") % 90).cast("string"), F.lit(" m²")), F.lit("m")).alias("superficie"),
        F.array(F.concat(F.lit("dal "), F.date_format("o_orderdate", "dd/MM/yyyy"))).alias("data"),
    )
    return clean.process_fields(df)


@query("filename_partition_cols", with_listings("""
SELECT id, CASE WHEN id % 6 = 0 THEN 'unknown' ELSE lower(city) END AS city,
 CASE WHEN id % 6 = 0 THEN 'unknown' ELSE contract END AS contract,
 CASE WHEN id % 6 <> 0 THEN concat(lower(city), '_', contract) END AS container FROM listings"""))
def filename_partition_cols(spark, sf):
    # City names of the tables hold "_", which separates parts of a file name.
    df = listings(spark, sf, "id", "city", "contract").withColumn("city", F.lower("city"))
    path = F.concat(
        F.lit("/landing/"), F.when(F.col("id") % 6 == 0, "export").otherwise("ads"), F.lit("_"),
        F.replace("city", F.lit("_"), F.lit("")), F.lit("_"), "contract", F.lit(".csv"),
    )
    parts = df.select("id", "city", readers.file_name_parts(path).alias("p"), path.alias("path"))
    named = F.when(F.col("p.city") != "unknown", readers.container_name(F.col("path")))
    back = lambda c: F.regexp_replace(c, "^nation", "nation_")
    return parts.select(
        "id", back(F.col("p.city")).alias("city"), F.col("p.contract").alias("contract"), back(named).alias("container")
    )


@query("flatten_nested_ad", with_listings("""
SELECT id, concat('u', CAST(id AS STRING)) AS uuid, concat('https://ex.test/', CAST(id AS STRING)) AS url, typology_name,
 CAST(floor(price_value) AS BIGINT) AS price_value, CASE WHEN id % 4 <> 0 THEN surface END AS surface,
 CASE WHEN id % 4 <> 0 THEN CAST(rooms AS STRING) END AS rooms,
 CASE WHEN id % 4 <> 0 AND features IS NOT NULL THEN concat(contract, ', ', features) END AS ga4features,
 CASE WHEN id % 4 <> 0 AND id % 3 <> 0 THEN concat('mare, ', contract) END AS views,
 CASE WHEN id % 4 <> 0 THEN floor_text END AS floor, CAST(id % 40 AS INT) AS agency_id
FROM listings WHERE id % 10 <> 0"""))
def flatten_nested_ad(spark, sf):
    df = listings(spark, sf, "id", "typology_name", "price_value", "surface", "rooms", "features", "floor_text", "contract")
    k = F.col("id")
    home = F.struct(
        F.col("surface"), F.col("rooms").cast("string").alias("rooms"),
        F.when(F.col("features").isNotNull(), F.array("contract", "features")).alias("ga4features"),
        F.struct(F.col("floor_text").alias("value")).alias("floor"),
        F.when(k % 3 == 0, F.array()).otherwise(
            F.array(F.struct(F.lit("mare").alias("name")), F.struct(F.col("contract").alias("name")))
        ).alias("views"),
    )
    ad = F.struct(
        F.when(k % 10 != 0, F.struct(
            k.alias("id"), F.concat(F.lit("u"), k.cast("string")).alias("uuid"),
            F.struct(F.col("typology_name").alias("name")).alias("typology"),
            F.struct(F.floor("price_value").alias("value")).alias("price"),
            F.struct(F.struct((k % 40).cast("int").alias("id")).alias("agency")).alias("advertiser"),
            F.when(k % 4 != 0, F.array(home, home)).otherwise(F.array()).alias("properties"),
        )).alias("realEstate"),
        F.struct(F.concat(F.lit("https://ex.test/"), k.cast("string")).alias("url")).alias("seo"),
    )
    landed = df.select(F.to_json(ad).alias("json"))
    nested = landed.select(F.from_json("json", schemas.NESTED_AD).alias("a")).select("a.*")
    return clean.flatten_ads(nested).select(
        "id", "uuid", "url", "typology_name", "price_value", "surface", "rooms", "ga4features", "views", "floor", "agency_id"
    )


@query("features_spread", with_listings("""
SELECT id, concat('Casa ', CAST(id AS STRING)) AS titolo, CASE WHEN rooms IS NOT NULL THEN concat(CAST(rooms AS STRING), ' locali') END AS "Locali",
 surface AS "Superficie", CAST(bathrooms AS STRING) AS "Bagni", trim(floor_text) AS "Piano",
 CASE WHEN id % 3 = 0 THEN 'N/D' ELSE concat('https://casa.test/a/', CAST(id AS STRING)) END AS link FROM listings"""))
def features_spread(spark, sf):
    df = listings(spark, sf, "id", "rooms", "surface", "bathrooms", "floor_text")
    part = lambda cls, c: F.when(c.isNotNull(), F.concat(F.lit(f'<div class="feature-{cls}"><span>'), c, F.lit("</span></div>")))
    html = F.concat_ws(
        "", F.lit('<main><article class="srp-card"><h3>Casa '), F.col("id").cast("string"), F.lit("</h3>"),
        part("rooms", F.concat(F.col("rooms").cast("string"), F.lit(" locali"))), part("surface", F.col("surface")),
        part("bathrooms", F.col("bathrooms").cast("string")), part("floor", F.col("floor_text")),
        F.when(F.col("id") % 3 != 0, F.concat(
            F.lit('<a class="card-link" href="'), F.when(F.col("id") % 2 == 0, "https://casa.test").otherwise(""),
            F.lit("/a/"), F.col("id").cast("string"), F.lit('">vedi</a>'))),
        F.lit("</article></main>"),
    )
    cards = extract.second_portal_cards(df.select("id", html.alias("html")), "https://casa.test")
    return clean.spread_struct(cards, "caratteristiche").drop("pos", "prezzo", "indirizzo", "agenzia")


# Units that the number patterns of a detail page look for, as they are written there.
_UNITS = {r"\s*m²?": " m²", r"\s*€/m²": " €/m²", r"\s*kWh/m²": " kWh/m²", r"\s*metri": " metri", "": ""}
_K = "o_orderkey"
_DETAIL_FIELDS = [
    *[(f, f"concat('{'€ ' if before else ''}1.', lpad(CAST(({_K} + {i}) % 1000 AS STRING), 3, '0'), ',5{_UNITS[after]}')",
       f"CAST(1000.5 + ({_K} + {i}) % 1000 AS DOUBLE)") for i, (f, (before, after)) in enumerate(clean.DETAIL_NUMBERS.items())],
    *[(f, f"concat('n. ', CAST(({_K} + {i}) % 9 AS STRING), ' / 77')", f"({_K} + {i}) % 9") for i, f in enumerate(clean.DETAIL_COUNTS)],
    *[(f, f"CASE ({_K} + {i}) % 4 WHEN 0 THEN 'Sì' WHEN 1 THEN 'No' WHEN 2 THEN 'assente' END",
       f"CASE ({_K} + {i}) % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END") for i, f in enumerate(clean.DETAIL_FLAGS)],
]


@query("detail_all_fields", f"SELECT {_K} AS id, {', '.join(f'{sql} AS {f}' for f, _, sql in _DETAIL_FIELDS)} FROM orders")
def detail_all_fields(spark, sf):
    """Every number, count and flag field of a detail page."""
    df = table(spark, sf, "orders").selectExpr(f"{_K} AS id", *[f"{text} AS {f}" for f, text, _ in _DETAIL_FIELDS])
    return clean.normalize_details(df)


@query("detail_lists", f"""
SELECT {_K} AS id, concat_ws('|', 'a', o_orderpriority, CASE WHEN {_K} % 2 = 0 THEN 'b' END) AS features, concat('x ', o_orderstatus) AS descrizione,
 CASE WHEN {_K} % 3 <> 0 THEN 44 + ({_K} % 100) / 128.0 END AS lat, CASE WHEN {_K} % 3 <> 0 THEN CAST(8.25 AS DOUBLE) END AS lng FROM orders""")
def detail_lists(spark, sf):
    """List cleanup, description of several parts, coordinates of a script."""
    k = F.col(_K)
    script = F.concat(F.lit('m({"lat": '), (44 + (k % 100) / 128.0).cast("string"), F.when(k % 3 != 0, ', "lng": 8.25})').otherwise("})"))
    df = table(spark, sf, "orders").select(
        k.alias("id"), F.array(F.lit(" a "), F.lit(""), "o_orderpriority", F.when(k % 2 == 0, "\xa0b")).alias("altre_caratteristiche"),
        F.array(F.lit(" x"), F.lit("  "), "o_orderstatus").alias("descrizione"), script.alias("script"))
    lat, lng = clean.script_coordinates(F.col("script"))
    typed = clean.normalize_details(df)
    return typed.select("id", F.array_join("altre_caratteristiche", "|").alias("features"), "descrizione", lat.alias("lat"), lng.alias("lng"))
