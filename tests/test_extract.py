"""Rule-driven extraction."""

from pyspark.sql import functions as F

from borgata.functions import markup
from borgata.operators import clean, extract
from borgata.operators.extract import Rule


def records(spark, html, rules):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id int, html string")
    rows = extract.extract_records(pages, rules).orderBy("page_id", "pos").collect()
    return [(r["page_id"], r["pos"], r["record"]) for r in rows]


TITLE = Rule("single", r"(?s)<h1>(.*?)</h1>", "title")
ITEM = Rule("multiple", r"(?s)<li>(.*?)</li>", "item")
PRICE = Rule("multiple", r"(?s)<div>(.*?)</div>", "price", value_pattern=r"<b>(.*?)</b>")


def test_lists_are_padded_and_singles_repeated(spark):
    got = records(spark, ["<h1> A &amp; B </h1><li>x</li><li>y</li><div><b>1</b></div>"], [TITLE, ITEM, PRICE])
    assert got == [(0, 0, {"title": "A & B", "item": "x", "price": "1"}), (0, 1, {"title": "A & B", "item": "y"})]


def test_positions_count_after_dropping_valueless(spark):
    got = records(spark, ["<div>none</div><div><b>1</b></div><div><b></b></div><li>x</li>"], [PRICE, ITEM])
    assert got == [(0, 0, {"price": "1", "item": "x"}), (0, 1, {"price": ""})]


def test_key_order(spark):
    again = Rule("multiple", r"(?s)<p>(.*?)</p>", "item")
    single = Rule("single", r"(?s)<h1>(.*?)</h1>", "t", manual_key="item")
    assert records(spark, ["<h1>s</h1><li>a</li><li>b</li><p>z</p>"], [single, ITEM, again]) == [
        (0, 0, {"item": "z"}), (0, 1, {"item": "b"})]
    two = [TITLE, Rule("single", r"(?s)<h2>(.*?)</h2>", "x", manual_key="title")]
    assert records(spark, ["<h1>1</h1><h2>2</h2>"], two) == [(0, 0, {"title": "2"})]


def test_only_singles_and_no_match(spark):
    assert records(spark, ["<h1>a</h1>", "<i>nothing</i>", None], [TITLE, ITEM]) == [(0, 0, {"title": "a"})]
    assert records(spark, ["<li>a</li>"], [Rule("next_button", "x", "n")]) == []


def test_key_from_page_and_name_fallback(spark):
    rule = Rule("multiple", r"(?s)<tr>(.*?)</tr>", "row", value_pattern=r"<td>(.*?)</td>", key_pattern=r"<th>(.*?)</th>")
    got = records(spark, ["<tr><th>Piano</th><td>3</td></tr><tr><td>x</td></tr><tr><th> </th><td>y</td></tr>"], [rule])
    assert got == [(0, 0, {"Piano": "3"}), (0, 1, {"row": "x"}), (0, 2, {"row": "y"})]


def test_scripts_and_comments_do_not_count(spark):
    html = "<script>var s='<li>no</li>';</script><!-- <li>no</li> --><STYLE>li{}</STYLE><li>yes</li>"
    assert records(spark, [html], [ITEM]) == [(0, 0, {"item": "yes"})]


def test_no_shuffle_and_preview(spark):
    pages = spark.range(40).select(F.col("id").alias("page_id"), F.lit("<li>a</li><li>b</li>").alias("html"))
    found = extract.extract_records(pages, [TITLE, ITEM])
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["page_id"], r["pos"]) for r in extract.preview(found, ["page_id", "pos"]).collect()] == [
        (0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]


def test_market_cards(spark):
    card = lambda t, p, extra="": f'<li class="s-item x"><div class="s-item__title">{t}</div><span class="s-item__price">{p}</span>{extra}<a class="s-item__link" href="/i/1">v</a></li>'
    html = card("Shop on eBay", "EUR 1,00") + card("Lampada-- Spedizione GRATUITA", "EUR 1.234,50", '<span class="s-item__seller-info-text">bob</span>') + card("Senza", "gratis") + card("Gamma", "EUR 10,00 a EUR 20,00")
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    rows = extract.market_cards(df).orderBy("pos").collect()
    assert [(r["Title"], r["Price"], r["Seller"], r["Subtitle"]) for r in rows] == [("Lampada", 1234.5, "bob", ""), ("Gamma", 10.0, "N/A", "")]
    assert [r["Title"] for r in extract.market_cards(df, legacy_price=True).collect()] == ["Lampada"]


def test_second_portal_defaults(spark):
    html = '<article class="srp-card"><h3> Casa </h3><div class="feature-rooms"><span>3</span></div></article>'
    r = extract.second_portal_cards(spark.createDataFrame([(1, html)], "id int, html string"), "https://h").first()
    assert (r["titolo"], r["prezzo"], r["link"], r["agenzia"]) == ("Casa", "N/D", "N/D", "N/D")
    assert r["caratteristiche"]["locali"] == "3" and r["caratteristiche"]["piano"] is None


def test_label_values_take_first_containing_label(spark):
    pair = lambda k, v: f'<div class="im-properties__title">{k}</div><div>{v}</div>'
    html = pair("Superficie commerciale", "90 m²") + pair("Superficie", "80 m²") + pair("Piano", "") + pair("Piano", "3")
    r = extract.label_values(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert r["superficie"] == "90 m²" and r["superficie_commerciale"] == "90 m²" and r["piano"] == "3" and r["bagni"] is None
    assert len(extract.DETAIL_LABELS) >= 65


def test_next_links(spark):
    df = spark.createDataFrame([("u1", '<a class="next" href="/p2">n</a>'), ("u2", "end")], "url string, html string").coalesce(1)
    assert [tuple(r) for r in extract.next_links(df, r'<a class="next" href="([^"]*)"', "https://h").collect()] == [("u1", "https://h/p2"), ("u2", None)]


def test_detail_page(spark):
    pair = lambda k, v: f'<div class="im-properties__title">{k}</div><div>{v}</div>'
    html = ('<ul class="in-landingDetail__mainFeatures"><li aria-label="piano">4</li><li aria-label="superficie"> </li>'
            '<li class="x in-detail__mainFeaturesPrice">€\xa01.250.000</li></ul>' + pair("Piano", "3") + pair("Superficie", "80 m²") + pair("Ascensore", "Sì")
            + pair("Classe Energetica", "Classe g") + '<div class="im-description__text">Bella<br> casa </div><div class="im-features__list"><ul><li> Cantina </li><li></li></ul></div>'
            '<div class="im-carousel"><img src="a.jpg"><img class="z" src="b.jpg"></div><script>var coordinates = {"lat": 44.3, "lng": 8.4};</script>')
    pages = spark.createDataFrame([(1, html), (2, '<div data-cy="the-map" data-lat="1.5" data-lng="2.5"></div>')], "id int, html string")
    a, b = clean.normalize_details(extract.detail_fields(pages)).orderBy("id").collect()
    assert (a["piano"], a["superficie"], a["prezzo"], a["ascensore"], a["classe_energetica"]) == (4, 80.0, 1250000.0, True, "G")
    assert a["descrizione"] == "Bella casa" and a["altre_caratteristiche"] == ["Cantina"] and a["immagini"] == ["a.jpg", "b.jpg"]
    assert (a["latitudine"], a["longitudine"]) == (44.3, 8.4) and (b["latitudine"], b["longitudine"]) == (1.5, 2.5)
    assert b["piano"] is None


def test_containers_end_at_their_own_end_tag(spark):
    def found(pattern, *html):
        df = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, h string").coalesce(1)
        return [r[0] for r in df.orderBy("i").select(markup.elements(F.col("h"), pattern)).collect()]

    div = r"(?s)<div (.*?)</div>"
    assert found(div, '<div class="k"><div>in</div>out</div> <div x>y</div>', "<div>bare</div>", None, "") == [
        ['class="k"><div>in</div>out', "x>y"], [], None, []]
    assert found(div, '<div a>1<div b>2<div c>3</div></div>4</div>', "<div a>never ended<div>x</div>", "<DIV x></DIV><div y>1</DIV>2",
                 "<divider x></divider><div\nz></div><div z></div >") == [
        ["a>1<div b>2<div c>3</div></div>4"], ["a>never ended<div>x</div>"], ["y>1"], ["z>"]]
    item = r"(?s)<li[^>]*>(.*?)</li>"
    assert found(item, "<ul><li>a<ul><li>b</li></ul>c</li><li>d</li></ul>", "<ul><li>a<li>b</ul>tail<ol><li>c</ol>", "<li>x</li>y<li>z") == [
        ["a<ul><li>b</li></ul>c", "d"], ["a", "b", "c"], ["x", "z"]]
    assert found(r"(?s)<p>(.*?)</p>", "<p>a<p>b</p>c<p>d") == [["a", "b", "d"]]
    assert found(r"(?s)<tr>(.*?)</tr>", "<tr><td><table><tr><td>1</td></tr></table></td></tr><tr>2</tr>") == [
        ["<td><table><tr><td>1</td></tr></table></td>", "2"]]
    # What stands before the tag belongs to the pattern; a pattern of another form is matched as it stands.
    assert found(r'(?s)class="r">\s*<span>(.*?)</span>', '<i class="r"> <span>a<span>b</span></span></i><i class="q"><span>c</span></i>') == [["a<span>b</span>"]]
    assert found(r'href="([^"]*)"', '<a href="1"><a href="2">') == [["1", "2"]]


def test_containers_of_random_markup(spark):
    """Against a plain parser that walks the tags with a stack."""
    import random
    import re

    rng = random.Random(3)
    texts = ["".join(rng.choices(["<div>", "<div k>", "</div>", "x", "<b>", "</b>"], k=rng.randint(0, 14))) for _ in range(400)]

    def plain(h):
        out, level, start = [], 0, None
        for m in re.finditer(r"<div k>|<div>|</div>", h):
            if start is None:
                if m[0] == "<div k>":
                    start, level = m.end(), 1
                continue
            level += -1 if m[0] == "</div>" else 1
            if level == 0:
                out.append(h[start:m.start()])
                start = None
        return out + ([h[start:]] if start is not None else [])

    df = spark.createDataFrame([(i, h) for i, h in enumerate(texts)], "i int, h string")
    got = df.orderBy("i").select(markup.elements(F.col("h"), "(?s)<div k>(.*?)</div>")).collect()
    assert [r[0] for r in got] == [plain(h) for h in texts]


def test_records_of_nested_markup(spark):
    card = ('<li class="s-item x"><div class="s-item__title"><div>Lam</div>pada</div><ul><li>new</li><li>blue</li></ul>'
            '<span class="s-item__price"><span>EUR</span> 5,00</span><a class="s-item__link" href="/i/1">v</a></li>')
    df = spark.createDataFrame([(1, f"<ul>{card}{card}</ul>")], "page_id int, html string")
    assert [(r["pos"], r["Title"], r["Price"]) for r in extract.market_cards(df).collect()] == [(0, "Lampada", 5.0), (1, "Lampada", 5.0)]
    pair = lambda k, v: f'<div class="im-properties__title"><div>{k}</div></div>\n<div class="v"><div>{v}</div></div>'
    html = pair("Piano", "3<div>b</div>") + '<div class="im-features__list"><div><ul><li>a</li></ul></div><ul><li>b<ul><li>c</li></ul></li></ul></div>'
    r = extract.detail_fields(spark.createDataFrame([(1, html + pair("Locali", "5"))], "id int, html string")).first()
    assert (r["piano"], r["locali"], r["altre_caratteristiche"]) == ("3b", "5", ["a", "bc"])


def test_pairs_need_the_next_element(spark):
    html = '<div class="im-properties__title">a</div><div>1</div><div class="im-properties__title">b</div> x <div>2</div><div class="im-properties__title">c</div><p>3</p>'
    df = spark.createDataFrame([(html,)], "h string").select(markup.element_pairs(F.col("h"), extract.DETAIL_TITLE).alias("p"))
    assert [tuple(x) for x in df.first()["p"]] == [("a", "1")]
