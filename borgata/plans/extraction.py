"""Page jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from borgata.functions.text import absolute_url
from borgata.operators import extract
from borgata.operators.extract import Rule
from borgata.plans.base import listings, query, spread, sql_strip, table, with_listings

RULES = [
    Rule("single", r"(?s)<h1>(.*?)</h1>", "title"),
    Rule("single", r"(?s)<footer>(.*?)</footer>", "foot", manual_key="footer"),
    Rule("multiple", r"(?s)<li>(.*?)</li>", "link", value_pattern=r'(?s)<a href="[^"]*">(.*?)</a>'),
    Rule("multiple", r"(?s)<p>(.*?)</p>", "para"),
    Rule("multiple", r"(?s)<div (.*?)</div>", "block", value_pattern=r"(?s)>(.*)", key_pattern=r'class="([^"]*)"'),
    Rule("next_button", r'rel="next"', "next"),
]

_BARE = r"regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"


def _text(c: str) -> str:
    out = f"regexp_replace({c}, '<[^>]*>', '', 'g')"
    for entity, char in extract.ENTITIES:
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    return sql_strip(out)


# A paragraph ends where it says so, or where the next begins.
_PARAGRAPHS = r"list_transform(string_split(h, '<p>')[2:], lambda t: regexp_extract(t, '(?s)^(.*?)(?:</?p[\s/>]|$)', 1))"


def _list(name: str, found: str, value: str) -> str:
    return (f"{name} AS (SELECT page_id, unnest({found}) AS x, generate_subscripts({found}, 1) - 1 AS i FROM b), "
            f"{name}v AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, {_text(value)} AS v FROM {name} WHERE {value} IS NOT NULL)")


_RECORDS = rf"""
WITH b AS (SELECT page_id, {_BARE} AS h FROM pages),
s AS (SELECT page_id, CASE WHEN regexp_matches(h, '(?s)<h1>(.*?)</h1>') THEN {_text("regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1)")} END AS title,
 CASE WHEN regexp_matches(h, '(?s)<footer>(.*?)</footer>') THEN {_text("regexp_extract(h, '(?s)<footer>(.*?)</footer>', 1)")} END AS footer FROM b),
{_list("li", "regexp_extract_all(h, '(?s)<li>(.*?)</li>', 1)", "CASE WHEN regexp_matches(x, '(?s)<a href=\"[^\"]*\">(.*?)</a>') THEN regexp_extract(x, '(?s)<a href=\"[^\"]*\">(.*?)</a>', 1) END")},
{_list("pa", _PARAGRAPHS, "x")},
{_list("di", "regexp_extract_all(h, '(?s)<div (.*?)</div>', 1)", "CASE WHEN regexp_matches(x, '(?s)>(.*)') THEN regexp_extract(x, '(?s)>(.*)', 1) END")},
k AS (SELECT page_id, pos FROM liv UNION SELECT page_id, pos FROM pav UNION SELECT page_id, pos FROM div),
a AS (SELECT page_id, pos FROM k UNION ALL SELECT page_id, 0 FROM s WHERE page_id NOT IN (SELECT page_id FROM k) AND coalesce(title, footer) IS NOT NULL),
r AS (SELECT page_id, CAST(pos AS INT) AS pos, title, md5(footer) AS footer, liv.v AS link, md5(pav.v) AS para, div.v AS ad
 FROM a LEFT JOIN s USING (page_id) LEFT JOIN liv USING (page_id, pos) LEFT JOIN pav USING (page_id, pos) LEFT JOIN div USING (page_id, pos))
SELECT * FROM r"""


def _records(spark, sf):
    found = extract.extract_records(table(spark, sf, "pages").select("page_id", "html"), RULES)
    r = F.col("record")
    return found.select("page_id", "pos", r["title"].alias("title"), F.md5(r["footer"]).alias("footer"),
                        r["link"].alias("link"), F.md5(r["para"]).alias("para"), r["ad"].alias("ad"))


@query("rule_extract", _RECORDS)
def rule_extract(spark, sf):
    return _records(spark, sf)


@query("rule_preview", _RECORDS + " ORDER BY page_id, pos LIMIT 5")
def rule_preview(spark, sf):
    return extract.preview(_records(spark, sf), ["page_id", "pos"])


@query("html_card_extract", r"""
WITH c AS (SELECT p_partkey, 1 AS pos, p_name AS "Title", p_type AS "Subtitle", p_size * 1000 + 50.5::DOUBLE AS "Price", 'N/A' AS "Seller", concat('/itm/', CAST(p_partkey AS STRING)) AS "Link" FROM part
UNION ALL SELECT p_partkey, 3, concat(p_name, ' & co'), '', p_size::DOUBLE, p_brand, concat('/x?', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, CAST(pos AS INT) AS pos, "Title", "Subtitle", "Price", "Seller", "Link" FROM c""")
def html_card_extract(spark, sf):
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    card = lambda *parts: F.concat(F.lit('<li class="s-item s-item--large"><ul><li>new</li><li>blue</li></ul>'), *parts, F.lit("</li>"))
    tag = lambda name, cls, c: F.concat(F.lit(f'<{name} class="s-item__{cls}">'), c, F.lit(f"</{name}>"))
    link = lambda c: F.concat(F.lit('<a class="s-item__link" href="'), c, F.lit('">vai</a>'))
    html = F.concat(
        F.lit("<html><script>var s='<li class=\"s-item\">x</li>';</script><ul>"),
        card(tag("div", "title", F.lit("Shop on eBay")), tag("span", "price", F.lit("EUR 20,00")), link(F.lit("/promo"))),
        card(tag("div", "title", F.concat(F.lit(" <div><b>"), "p_name", F.lit("</b></div> -- Spedizione GRATUITA"))), tag("div", "subtitle", F.col("p_type")),
             tag("span", "price", F.concat(F.lit("EUR "), size, F.lit(".050,50"))), link(F.concat(F.lit("/itm/"), key))),
        card(tag("div", "title", F.lit("senza prezzo")), link(F.lit("/none"))),
        F.when(F.col("p_partkey") % 2 == 0, card(
            tag("div", "title", F.concat("p_name", F.lit(" &amp; co"))), tag("span", "price", F.concat(size, F.lit(",00 a 99,00"))),
            tag("span", "seller-info-text", F.col("p_brand")), link(F.concat(F.lit("/x?"), key)))).otherwise(""),
        F.lit("</ul></html>"),
    )
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    return extract.market_cards(spread(parts).select("p_partkey", html.alias("html")))


@query("listing_cards", with_listings("""
SELECT id, trim(regexp_replace(title, '\t', ' ', 'g')) AS title, concat('https://ex.test/annunci/', CAST(id AS STRING), '/') AS url, price_text AS prezzo, 'a.jpg' AS immagine,
 concat_ws('|', CASE WHEN rooms IS NOT NULL THEN concat(CAST(rooms AS STRING), ' locale') END, 'Balcone') AS caratteristiche,
 CASE WHEN rooms IS NOT NULL THEN concat(CAST(rooms AS STRING), ' locale') END AS locali, 'Balcone' AS balcone, NULL::STRING AS cantina FROM listings"""))
def listing_cards(spark, sf):
    df = spread(listings(spark, sf, "id", "title", "price_text", "rooms"))
    feature = lambda c: F.concat(F.lit('<div class="in-listingCardFeatureList__item"> <span><span></span>'), c, F.lit("</span></div>"))
    html = F.concat(
        F.lit('<ul><li class="nd-list__item in-searchLayoutListItem"><ol><li>1</li><li>2</li></ol><img class="x" src="a.jpg"><a class="in-listingCardTitle" href="/annunci/'),
        F.col("id").cast("string"), F.lit('/" title="'), F.btrim(F.regexp_replace("title", "\t", " "), F.lit(" ")), F.lit('">t</a>'),
        F.coalesce(F.concat(F.lit('<div class="in-listingCardPrice"> <span>'), "price_text", F.lit("</span></div>")), F.lit("")),
        F.lit('<div class="in-listingCardFeatureList">'),
        F.coalesce(feature(F.concat(F.col("rooms").cast("string"), F.lit(" locale"))), F.lit("")), feature(F.lit("Balcone")),
        F.lit("</div></li></ul>"),
    )
    cards = extract.portal_cards(df.select("id", html.alias("html")), "https://ex.test").withColumn("caratteristiche", F.array_join("caratteristiche", "|"))
    return cards.select("id", "title", "url", "prezzo", "immagine", "caratteristiche", "locali", "balcone", "cantina")


@query("item_cards", """
SELECT o_orderkey AS id, concat('/items/', CAST(o_orderkey AS STRING)) AS link, concat('Giacca,', CAST(o_orderkey AS STRING)) AS titolo, o_orderstatus AS brand,
 o_orderpriority AS condizione, CAST(o_orderkey % 90 AS DOUBLE) AS prezzo, CAST(o_orderkey % 90 + 2 AS DOUBLE) AS spedito,
 CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 40 AS INTEGER) END AS preferiti FROM orders WHERE o_orderkey % 5 <> 0""")
def item_cards(spark, sf):
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, "no parts").otherwise(F.concat(
        F.lit("Giacca, "), k.cast("string"), F.lit(", brand: "), "o_orderstatus", F.lit(", condizioni: "), "o_orderpriority",
        F.lit(", "), (k % 90).cast("string"), F.lit(" €, "), (k % 90 + 2).cast("string"), F.lit("€ spedizione inclusa")))
    likes = F.when(k % 3 != 0, F.concat(
        F.lit('<button class="u-background-white new-item-box__favourite-icon"><span class="web_ui__Text__x"> '),
        (k % 40).cast("string"), F.lit(" </span></button>"))).otherwise("")
    html = F.concat(F.lit('<div class="new-item-box__container x"><div class="new-item-box__image-container"> <a href="/items/'),
                    k.cast("string"), F.lit('" title="'), title, F.lit('">i</a></div>'), likes, F.lit("</div>"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    cards = extract.item_cards(spread(orders).select(k.alias("id"), html.alias("html")))
    named = {"Link": "link", "Titolo": "titolo", "Brand": "brand", "Condizione": "condizione", "Prezzo": "prezzo",
             "Prezzo con spedizione": "spedito", "Preferiti": "preferiti"}
    return cards.select("id", *[F.col(f"`{a}`").alias(b) for a, b in named.items()])


@query("label_value_pairs", with_listings("""
SELECT id, concat(CAST(1 + id % 6 AS STRING), ' locali') AS locali, nullif(trim(floor_text), '') AS piano, nullif(surface, '') AS superficie, nullif(surface, '') AS dettaglio_superficie,
 CASE WHEN id % 2 = 0 THEN concat('€ ', CAST(id % 100 AS STRING)) END AS spese_condominio, nullif(trim(elevator), '') AS ascensore, NULL::STRING AS cantina FROM listings"""))
def label_value_pairs(spark, sf):
    df = listings(spark, sf, "id", "floor_text", "surface", "elevator")
    pair = lambda label, c: F.concat(
        F.lit(f'<div class="im-properties__title"><div> {label}</div> </div>\n<div class="v"><div> '), F.coalesce(c, F.lit("")), F.lit(" </div></div>"))
    html = F.concat(
        F.lit("<section>"), pair("Locali", F.concat((1 + F.col("id") % 6).cast("string"), F.lit(" <i>locali</i>"))),
        pair("Piano", F.col("floor_text")), pair("Superficie", F.col("surface")),
        F.when(F.col("id") % 2 == 0, pair("Spese condominio", F.concat(F.lit("€ "), (F.col("id") % 100).cast("string")))).otherwise(""),
        pair("Ascensore", F.col("elevator")), F.lit("</section>"),
    )
    fields = ["locali", "piano", "superficie", "dettaglio_superficie", "spese_condominio", "ascensore", "cantina"]
    out = extract.label_values(df.select("id", html.alias("html")), {f: extract.DETAIL_LABELS[f] for f in fields})
    return out


@query("link_extract", rf"""
WITH b AS (SELECT page_id, url, {_BARE} AS h FROM pages), l AS (SELECT page_id, url, h, regexp_extract_all(h, '<a [^>]*href="([^"]*)"', 1) AS x FROM b)
SELECT page_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos, concat('https://ex.test', unnest(x)) AS target FROM l""")
def link_extract(spark, sf):
    edges = extract.all_links(table(spark, sf, "pages").select("page_id", "html"))
    return edges.select("page_id", "pos", absolute_url(F.col("href"), "https://ex.test").alias("target"))


@query("next_page_edges", rf"""
WITH b AS (SELECT url, {_BARE} AS h FROM pages)
SELECT url AS page_url, CASE WHEN regexp_matches(h, '<a href="(/[a-p][^"]*)"')
 THEN concat('https://ex.test', regexp_extract(h, '<a href="(/[a-p][^"]*)"', 1)) END AS next_url FROM b""")
def next_page_edges(spark, sf):
    return extract.next_links(table(spark, sf, "pages"), r'<a href="(/[a-p][^"]*)"', "https://ex.test")
