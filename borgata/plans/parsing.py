"""Scalar parsers on derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.functions import flags, floors, garage, numbers, text, titles
from borgata.operators import language
from borgata.plans.base import SQL_BLANK, listings, query, sql_strip, table, with_listings


def _num(expr: str) -> str:
    return f"TRY_CAST(nullif({expr}, '') AS BIGINT)"


@query("strip_tags", r"""
SELECT page_id, md5(regexp_replace(html, '<[^>]*>', '', 'g')) AS digest,
 length(regexp_replace(html, '<[^>]*>', '', 'g')) AS n FROM pages""")
def strip_tags(spark, sf):
    bare = text.strip_tags(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.md5(bare).alias("digest"), F.length(bare).cast("bigint").alias("n"))


@query("parse_price_token", with_listings(rf"""
SELECT id, regexp_replace(list_extract(list_filter(regexp_split_to_array({sql_strip("regexp_replace(concat('<b>', price_text, '</b>'), '<[^>]*>', '', 'g')")}, '{SQL_BLANK}+'), lambda x: x <> ''), -1), '\.|,\d+', '', 'g') AS token
FROM listings WHERE price_text IS NOT NULL"""))
def parse_price_token(spark, sf):
    df = listings(spark, sf, "id", "price_text").filter("price_text IS NOT NULL")
    return df.select("id", numbers.price_token(F.concat(F.lit("<b>"), "price_text", F.lit("</b>"))).alias("token"))


@query("parse_surface", with_listings(rf"""
SELECT id, split_part(surface, 'm', 1) AS before_m,
 {_num(r"regexp_extract(surface, '\d+')")} AS first_number,
 CASE WHEN regexp_full_match(split_part(surface, ' ', 1), '\d+') THEN CAST(split_part(surface, ' ', 1) AS BIGINT) END AS first_token
FROM listings"""))
def parse_surface(spark, sf):
    s = F.col("surface")
    return listings(spark, sf, "id", "surface").select(
        "id", numbers.surface_text(s).alias("before_m"), numbers.surface_first_number(s).alias("first_number"),
        numbers.surface_first_token(s).alias("first_token"),
    )


@query("floor_variants", with_listings(rf"""
SELECT id, replace(floor_text, 'T', '0') AS letter,
 CASE WHEN lower(floor_text) LIKE '%terra%' OR lower(floor_text) LIKE '%rialzato%' THEN 0
  WHEN lower(floor_text) LIKE '%ammezzato%' THEN 1 ELSE TRY_CAST(trim(floor_text) AS BIGINT) END AS stored,
 CASE WHEN regexp_full_match(floor_text, '\d+') THEN CAST(floor_text AS BIGINT)
  WHEN floor_text LIKE '%piano terra%' OR floor_text LIKE '%piano rialzato%' THEN 0 END AS fetched
FROM listings"""))
def floor_variants(spark, sf):
    f = F.col("floor_text")
    return listings(spark, sf, "id", "floor_text").select(
        "id", floors.floor_letter(f).alias("letter"), floors.floor_store(f).alias("stored"),
        floors.floor_fetch(f).alias("fetched"),
    )


@query("normalize_floor", with_listings(r"""
, t AS (SELECT id, trim(lower(floor_text)) AS f FROM listings),
n AS (SELECT id, f, list_transform(regexp_extract_all(f, '\d+'), lambda x: CAST(x AS DOUBLE)) AS digits,
 [CASE WHEN contains(f, 'piano terra') THEN 0.0::DOUBLE END, CASE WHEN contains(f, 'seminterrato') THEN 0.0::DOUBLE END,
  CASE WHEN contains(f, 'interrato (-1)') THEN -1.0::DOUBLE END, CASE WHEN contains(f, 'interrato (-2)') THEN -2.0::DOUBLE END,
  CASE WHEN contains(f, 'interrato (-3)') THEN -3.0::DOUBLE END,
  CASE WHEN contains(f, 'piano rialzato') OR contains(f, 'ammezzato') THEN 0.5::DOUBLE END] AS words FROM t)
SELECT id, CASE f WHEN 'piano terra' THEN 0.0::DOUBLE WHEN 'seminterrato' THEN 0.0::DOUBLE WHEN 'interrato (-1)' THEN -1.0::DOUBLE
 WHEN 'interrato (-2)' THEN -2.0::DOUBLE WHEN 'interrato (-3)' THEN -3.0::DOUBLE WHEN 'piano rialzato' THEN 0.5::DOUBLE
 WHEN 'ammezzato' THEN 0.5::DOUBLE WHEN 'su più livelli' THEN NULL ELSE list_max(list_concat(digits, words)) END AS floor FROM n"""))
def normalize_floor(spark, sf):
    return listings(spark, sf, "id", "floor_text").select("id", floors.normalize_floor(F.col("floor_text")).alias("floor"))


@query("garage_features", with_listings(r"""
, c AS (SELECT id, lower(garage_text) AS g,
 coalesce(list_sum(list_transform(regexp_extract_all(lower(garage_text), '(\d+)\s+in\s+box\s+privato', 1), lambda x: CAST(x AS BIGINT))), 0)::BIGINT AS box,
 coalesce(list_sum(list_transform(regexp_extract_all(lower(garage_text), '(\d+)\s+in\s+parcheggio', 1), lambda x: CAST(x AS BIGINT))), 0)::BIGINT AS park FROM listings)
SELECT id, CASE WHEN contains(g, 'box privato') THEN 'private box'
  WHEN contains(g, 'parcheggio') OR contains(g, 'garage comune') THEN 'common park' ELSE 'no park' END AS garage_type,
 CASE WHEN box > 0 THEN 'private_box' WHEN park > 0 THEN 'common_park' ELSE 'no_park' END AS primary_type,
 box AS private_box_count, park AS common_park_count, box + park AS total_count FROM c"""))
def garage_features(spark, sf):
    g = F.col("garage_text")
    df = listings(spark, sf, "id", "garage_text")
    return df.select("id", garage.garage_type(g).alias("garage_type"), garage.garage_details(g).alias("d")).select(
        "id", "garage_type", "d.*"
    )


@query("coerce_bool", with_listings("""
SELECT id, CASE WHEN lower(trim(elevator)) IN ('true','yes','y','t','sì','si','s','vero','1','1.0') THEN true
 WHEN lower(trim(elevator)) IN ('false','no','n','f','falso','0','0.0') THEN false END AS flag,
 CASE WHEN contains(lower(elevator), 'si') THEN true WHEN contains(lower(elevator), 'no') THEN false END AS by_text,
 contains(lower(elevator), 'sì') OR contains(lower(elevator), 'si ') OR contains(lower(elevator), 'presente')
  OR contains(lower(elevator), 'yes') OR lower(elevator) IN ('si', 'true') AS detail FROM listings"""))
def coerce_bool(spark, sf):
    e = F.col("elevator")
    return listings(spark, sf, "id", "elevator").select(
        "id", flags.to_flag(e).alias("flag"), flags.feature_flag(e).alias("by_text"), flags.detail_flag(e).alias("detail")
    )


@query("extract_value", with_listings(r"""
SELECT id, coalesce(nullif(regexp_extract(garage_text, '(\d+) in parcheggio', 1), ''), nullif(regexp_extract(garage_text, '\d+'), ''), garage_text) AS value,
 TRY_CAST(nullif(regexp_extract(surface, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS number FROM listings"""))
def extract_value(spark, sf):
    return listings(spark, sf, "id", "garage_text", "surface").select(
        "id", text.extract_value(F.col("garage_text"), r"(\d+) in parcheggio").alias("value"),
        numbers.first_number(F.col("surface")).alias("number"),
    )


@query("parse_date_digits", r"""
WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN concat('<i>dal ', strftime(o_orderdate, '%d/%m/%Y'), '</i>')
 WHEN 1 THEN '<b>subito</b>' ELSE o_orderpriority END AS txt FROM orders)
SELECT id, coalesce(nullif(regexp_extract(regexp_replace(txt, '<[^>]*>', '', 'g'), '\d{1,2}/\d{1,2}/\d{1,4}'), ''), regexp_replace(txt, '<[^>]*>', '', 'g')) AS day,
 coalesce(nullif(regexp_extract(regexp_replace(txt, '<[^>]*>', '', 'g'), '\d+'), ''), regexp_replace(txt, '<[^>]*>', '', 'g')) AS digits FROM t""")
def parse_date_digits(spark, sf):
    k = F.col("o_orderkey")
    txt = (
        F.when(k % 3 == 0, F.concat(F.lit("<i>dal "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit("</i>")))
        .when(k % 3 == 1, "<b>subito</b>").otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select(
        k.alias("id"), text.parse_date_text(txt).alias("day"), text.parse_digits(txt).alias("digits")
    )


_MARKET_TEXT = """CASE p_partkey % 5 WHEN 0 THEN concat('EUR ', CAST(p_size AS STRING), '.234,56')
 WHEN 1 THEN concat(CAST(p_size AS STRING), ',00 a ', CAST(p_size + 10 AS STRING), ',00') WHEN 2 THEN concat('$', CAST(p_size AS STRING), '.99')
 WHEN 3 THEN concat('EUR\xa0', CAST(p_size AS STRING)) ELSE 'gratis' END"""


@query("clean_market_price", rf"""
WITH t AS (SELECT p_partkey, p_size, {_MARKET_TEXT} AS txt FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 + 234.56::DOUBLE WHEN 1 THEN p_size::DOUBLE
 WHEN 2 THEN (p_size * 100 + 99)::DOUBLE WHEN 3 THEN p_size::DOUBLE END AS price,
 TRY_CAST(replace(replace(regexp_replace(txt, '[^0-9,.]', '', 'g'), '.', ''), ',', '.') AS DOUBLE) AS legacy FROM t""")
def clean_market_price(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", f"{_MARKET_TEXT} AS txt")
    t = F.col("txt")
    return df.select("p_partkey", numbers.market_price(t).alias("price"), numbers.market_price(t, legacy=True).alias("legacy"))


_TITLE = """CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ', new, brand: ', p_brand, ', condizioni: ', p_type, ', €', CAST(p_size AS STRING), '.50, €', CAST(p_size + 2 AS STRING), '.25 Protezione acquisti')
 WHEN 1 THEN concat('brand: ', p_brand, ', condizioni: ', p_type, ', €', CAST(p_size AS STRING), '.00, €', CAST(p_size + 1 AS STRING), '.00 incl.')
 WHEN 2 THEN concat(p_name, ', ', p_brand, ', ', p_type, ', ', CAST(p_size AS STRING), ',50 €, 9.00€ incl. spese')
 WHEN 3 THEN concat(p_name, ', ', p_brand) ELSE concat(p_name, ', ', p_brand, ', ', p_type, ', n.d., €3.00') END"""


@query("composite_title_split", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ',new') WHEN 1 THEN p_brand ELSE p_name END AS title,
 p_brand AS brand, p_type AS condition,
 CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5::DOUBLE WHEN 1 THEN p_size::DOUBLE ELSE (p_size * 100 + 50)::DOUBLE END AS price,
 CASE p_partkey % 5 WHEN 0 THEN p_size + 2.25::DOUBLE WHEN 1 THEN (p_size + 1)::DOUBLE ELSE 9.0::DOUBLE END AS price_with_shipping,
 CASE p_partkey % 5 WHEN 0 THEN 'Protezione acquisti' WHEN 1 THEN 'incl.' ELSE 'incl. spese' END AS notes
FROM part WHERE p_partkey % 5 < 3""")
def composite_title_split(spark, sf):
    df = table(spark, sf, "part").selectExpr("p_partkey", f"{_TITLE} AS txt")
    parsed = df.select("p_partkey", titles.split_composite_title(F.col("txt")).alias("s"))
    return parsed.filter("s IS NOT NULL").select("p_partkey", "s.*")


@query("url_normalize", with_listings(r"""
SELECT id, regexp_replace(regexp_extract(url, '/annunci/[^?]*'), '^', 'https://ex.test') AS absolute,
 CAST(id AS STRING) AS id_from_url, concat('?q=', CAST(id % 7 AS STRING)) AS raw_segment FROM listings"""))
def url_normalize(spark, sf):
    df = listings(spark, sf, "id", "url")
    path = F.substring_index(F.replace(F.col("url"), F.lit("https://ex.test"), F.lit("")), "?", 1)
    return df.select(
        "id", text.absolute_url(path, "https://ex.test").alias("absolute"), text.id_from_url(path).alias("id_from_url"),
        text.id_from_url(F.col("url")).alias("raw_segment"),
    )


@query("page_listing_id", r"""
SELECT page_id, regexp_extract(split_part(url, '?', 1), '[^/]*$') AS listing_id,
 regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$') AS last_segment FROM pages""")
def page_listing_id(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", text.listing_id(u).alias("listing_id"), text.id_from_url(u).alias("last_segment")
    )


@query("slugify", """
SELECT p_partkey, replace(lower(concat(p_name, ' ', p_brand)), ' ', '-') AS slug,
 regexp_replace(lower(concat(p_type, '-', p_brand)), '-', '_', 'g') AS zone_key FROM part""")
def slugify(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", text.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"),
        text.zone_key(F.concat_ws("-", "p_type", "p_brand")).alias("zone_key"),
    )


_LABELS = """array(concat(CAST(1 + o_orderkey % 6 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN ' locale' ELSE ' locali' END),
 concat(CAST(20 + o_orderkey % 130 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' m²' ELSE ' MQ' END), CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '1 bagno' END,
 concat('Piano ', CAST(o_orderkey % 4 AS STRING)), 'Ascensore', CASE WHEN o_orderkey % 7 = 0 THEN 'piano rialzato' END, 'Balcone e terrazzo')"""


@query("feature_label_map", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat(CAST(1 + o_orderkey % 6 AS STRING), ' locale') END AS locali,
 concat(CAST(20 + o_orderkey % 130 AS STRING), CASE WHEN o_orderkey % 3 = 0 THEN ' m²' ELSE ' MQ' END) AS superficie,
 CASE WHEN o_orderkey % 5 <> 0 THEN '1 bagno' END AS bagni,
 CASE WHEN o_orderkey % 7 = 0 THEN 'piano rialzato' ELSE concat('Piano ', CAST(o_orderkey % 4 AS STRING)) END AS piano,
 'Ascensore' AS ascensore, 'Balcone e terrazzo' AS balcone, CAST(NULL AS STRING) AS arredato,
 CAST(NULL AS STRING) AS cantina, CAST(NULL AS STRING) AS terrazzo FROM orders""")
def feature_label_map(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_LABELS} AS labels")
    return df.select("id", titles.label_map(F.col("labels")).alias("m")).select("id", "m.*")


def _hits(lang: str) -> str:
    words = ", ".join(f"'{w}'" for w in titles.STOP_WORDS[lang])
    return f"len(list_filter(w, lambda x: x IN ({words})))"


_LANGS = sorted(titles.STOP_WORDS)
_BEST = "greatest(" + ", ".join(f"h_{x}" for x in _LANGS) + ")"


@query("detect_language", rf"""
WITH t AS (SELECT doc_id, lang, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents),
s AS (SELECT doc_id, lang, {", ".join(f"{_hits(x)} AS h_{x}" for x in _LANGS)} FROM t)
SELECT doc_id, lang, CASE WHEN {_BEST} = 0 THEN NULL {" ".join(f"WHEN h_{x} = {_BEST} THEN '{x}'" for x in _LANGS)} END AS detected,
 {_BEST} AS hits FROM s""")
def detect_language(spark, sf):
    scored = table(spark, sf, "documents").select(
        "doc_id", "lang", titles.language_scores(F.col("text")).alias("h")
    )
    cols = {x: F.col(f"h.{x}") for x in titles.STOP_WORDS}
    return scored.select(
        "doc_id", "lang", titles.detect_language(cols).alias("detected"), F.greatest(*cols.values()).alias("hits")
    )


_PROFILED = """
d AS (SELECT doc_id, lang, doc_id % 5 = 0 AS held_out, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, substr(h, 2 * i + 1, 4) AS pair FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 1)) AS i FROM d)),
t AS (SELECT doc_id, pair, count(*) AS tf FROM g GROUP BY ALL),
c AS (SELECT lang, pair, sum(tf) AS c FROM t JOIN d USING (doc_id) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
l AS (SELECT lang, sum(c) AS n FROM c GROUP BY ALL), p AS (SELECT DISTINCT pair FROM c), v AS (SELECT count(*) AS v FROM p),
w AS (SELECT p.pair, l.lang AS code, CAST(floor(1000 * ln(CAST(coalesce(c, 0) + 1 AS DOUBLE) / (n + v))) AS BIGINT) AS w
 FROM p CROSS JOIN l CROSS JOIN v LEFT JOIN c ON c.pair = p.pair AND c.lang = l.lang),
s AS (SELECT doc_id, code, sum(tf * w) AS s FROM t JOIN w USING (pair) GROUP BY ALL),
b AS (SELECT doc_id, code, s, lead(s) OVER o AS next FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY s DESC, code) QUALIFY row_number() OVER o = 1),
f AS (SELECT d.doc_id, lang, held_out, code AS detected, CAST(s - next AS BIGINT) AS lead FROM d LEFT JOIN b USING (doc_id))"""


def _profiled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text", (F.col("doc_id") % 5 == 0).alias("held_out"))
    found = language.detect(docs, docs.filter(~F.col("held_out")), "doc_id")
    return docs.select("doc_id", "lang", "held_out").join(found, "doc_id")


@query("language_profiles", f"WITH {_PROFILED.strip()} SELECT * FROM f")
def language_profiles(spark, sf):
    """Language by byte-pair profiles learnt from four of five documents."""
    return _profiled(spark, sf)


@query("language_accuracy", rf"""
WITH {_PROFILED.strip()},
u AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM documents),
x AS (SELECT doc_id, {", ".join(f"{_hits(x)} AS h_{x}" for x in _LANGS)} FROM u),
y AS (SELECT doc_id, CASE WHEN {_BEST} = 0 THEN NULL {" ".join(f"WHEN h_{x} = {_BEST} THEN '{x}'" for x in _LANGS)} END AS voted FROM x)
SELECT held_out, count(*) AS n, count(*) FILTER (WHERE detected = lang) AS by_profile, count(*) FILTER (WHERE voted = lang) AS by_stop_words
FROM f JOIN y USING (doc_id) GROUP BY held_out""")
def language_accuracy(spark, sf):
    """Documents whose language the profiles and the stop-word vote find, among those learnt from and the others."""
    voted = detect_language(spark, sf).select("doc_id", F.col("detected").alias("voted"))
    both = _profiled(spark, sf).join(voted, "doc_id")
    return both.groupBy("held_out").agg(
        F.count("*").alias("n"), F.count_if(F.col("detected") == F.col("lang")).alias("by_profile"),
        F.count_if(F.col("voted") == F.col("lang")).alias("by_stop_words"))
