"""Rule-driven extraction of records from page text.

All rules of a page run inside its row: the lists of several rules are lined up by position with
array functions, so a page never has to be shuffled to bring its own parts together.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from borgata.functions.markup import element, element_pairs, elements
from borgata.functions.numbers import market_price, to_double
from borgata.functions.text import absolute_url, blank_to_null, first_match, let, strip, strip_tags
from borgata.functions.titles import split_composite_title
from borgata.operators.clean import preview_labels, script_coordinates


@dataclass(frozen=True)
class Rule:
    """``pattern``'s group 1 is the element; ``value_pattern`` and ``key_pattern`` look inside it."""

    kind: str  # single | multiple | next_button
    pattern: str
    name: str
    value_pattern: str | None = None
    key_pattern: str | None = None
    manual_key: str | None = None


# The character references decoded in extracted text.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")]


def bare_markup(html: Column) -> Column:
    """Page text without scripts, styles and comments."""
    return F.regexp_replace(
        html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""
    )


def text_of(markup: Column) -> Column:
    bare = strip_tags(markup)
    decoded = bare
    for entity, char in ENTITIES:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    return strip(F.when(F.contains(markup, F.lit("&")), decoded).otherwise(bare))


def _key(scope: Column, rule: Rule) -> Column:
    if rule.manual_key:
        return F.lit(rule.manual_key)
    if rule.key_pattern:
        found = F.nullif(text_of(element(scope, rule.key_pattern)), F.lit(""))
        return F.coalesce(found, F.lit(rule.name))
    return F.lit(rule.name)


def _entry(key: Column, value: Column) -> Column:
    return F.when(value.isNotNull(), F.struct(key.alias("key"), value.alias("value")))


def _single(html: Column, rule: Rule) -> Column:
    return _entry(_key(html, rule), text_of(element(html, rule.pattern)))


def _multiple(html: Column, rule: Rule) -> Column:
    def one(inner: Column) -> Column:
        value = inner if rule.value_pattern is None else element(inner, rule.value_pattern)
        return let(let(value, text_of), lambda v: _entry(_key(inner, rule), v))

    return F.array_compact(F.transform(elements(html, rule.pattern), one))


def _last_of_each_key(entries: Column) -> Column:
    return F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )


def extract_records(pages: DataFrame, rules: Sequence[Rule], html: str = "html") -> DataFrame:
    """One row per record: page columns without the markup, ``pos`` and ``record`` (a map).

    Lists are lined up by position after entries without a value are dropped, and padded to the
    longest.  Single values go into every record; on equal keys the later rule wins, and a list
    value beats a single one.  A page with single values only gives one record.
    """
    lists = [r for r in rules if r.kind == "multiple"]
    singles = [r for r in rules if r.kind == "single"]
    keep = [c for c in pages.columns if c != html]
    bare = pages.select(*keep, bare_markup(F.col(html)).alias("_h"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    fixed = F.array_compact(F.array(*[_single(F.col("_h"), r) for r in singles])) if singles else none
    found = bare.select(
        *keep, fixed.alias("_s"), *[_multiple(F.col("_h"), r).alias(f"_m{i}") for i, r in enumerate(lists)]
    )
    columns = [f"_m{i}" for i in range(len(lists))]
    longest = F.lit(0)
    if len(columns) == 1:
        longest = F.size(columns[0])
    elif columns:
        longest = F.greatest(*[F.size(c) for c in columns])
    found = found.withColumn("_n", longest)

    def record(i: Column) -> Column:
        row = F.concat(F.col("_s"), F.array_compact(F.array(*[F.get(F.col(c), i) for c in columns])))
        return F.map_from_entries(_last_of_each_key(row))

    only_single = F.when(
        F.size("_s") > 0, F.array(F.map_from_entries(_last_of_each_key(F.col("_s"))))
    )
    listed = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), record) if columns else only_single
    records = F.when(F.col("_n") > 0, listed).otherwise(only_single)
    return found.select(*keep, F.posexplode(records).alias("pos", "record"))


def preview(records: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return records.orderBy(*order).limit(n)


@dataclass(frozen=True)
class CardField:
    patterns: tuple[str, ...]  # tried in order, group 1 is the value
    default: str | None = None
    plain: bool = True  # strip tags and blanks
    convert: Callable[[Column], Column] | None = None  # applied to the value last
    many: bool = False  # all matches of the first pattern, as an array


def extract_cards(pages: DataFrame, card: str, fields: Mapping[str, CardField], html: str = "html") -> DataFrame:
    """One row per card of a result page with its fields, in page order."""
    keep = [c for c in pages.columns if c != html]

    def value(inner: Column, spec: CardField) -> Column:
        if spec.many:
            every = elements(inner, spec.patterns[0])
            return F.array_compact(F.transform(every, lambda x: blank_to_null(text_of(x))) if spec.plain else every)
        found = [element(inner, p) for p in spec.patterns]
        if spec.plain:
            found = [let(f, text_of) for f in found]
        out = F.coalesce(*found, F.lit(spec.default).cast("string"))
        return out if spec.convert is None else let(out, spec.convert)

    # The fields are built inside the array: below a generator nothing can pull them apart again,
    # so a later filter on a field does not compute it a second time.
    cards = F.transform(elements(bare_markup(F.col(html)), card), lambda inner: F.struct(*[value(inner, s).alias(n) for n, s in fields.items()]))
    return pages.select(*keep, F.posexplode(cards).alias("pos", "_c")).select(*keep, "pos", "_c.*")


# Marketplace result cards, their promotional titles and the suffix cut from titles.
MARKET_CARD = r'(?s)<li class="s-item[^"]*">(.*?)</li>'
MARKET_FIELDS = {
    "Title": CardField((r'(?s)<div class="s-item__title">(.*?)</div>',), "N/A"),
    "Subtitle": CardField((r'(?s)<div class="s-item__subtitle">(.*?)</div>',), ""),
    "Price": CardField((r'(?s)<span class="s-item__price">(.*?)</span>',)),
    "Seller": CardField((r'(?s)<span class="s-item__seller-info-text">(.*?)</span>',), "N/A"),
    "Link": CardField((r'<a class="s-item__link" href="([^"]*)"',), "N/A", plain=False),
}
PROMO_TITLES = ["shop on ebay", "results matching fewer words"]
TITLE_SUFFIX = "-- Spedizione GRATUITA"


def market_cards(pages: DataFrame, html: str = "html", legacy_price: bool = False) -> DataFrame:
    """Marketplace listings of result pages; promotions and cards without title, link or price go."""
    price = replace(MARKET_FIELDS["Price"], convert=lambda c: market_price(c, legacy_price))
    cards = extract_cards(pages, MARKET_CARD, {**MARKET_FIELDS, "Price": price}, html)
    priced = cards.filter(
        ~F.lower("Title").isin(PROMO_TITLES)
        & (F.col("Title") != "N/A") & (F.col("Link") != "N/A") & F.col("Price").isNotNull()
    )
    title = strip(F.replace(F.col("Title"), F.lit(TITLE_SUFFIX), F.lit("")))
    return priced.withColumn("Title", title)


# Result cards of the two listing portals.
PORTAL_CARD = r'(?s)<li class="nd-list__item in-searchLayoutListItem">(.*?)</li>'
PORTAL_FIELDS = {
    "title": CardField((r'<a class="in-listingCardTitle"[^>]*title="([^"]*)"',), plain=False),
    "url": CardField((r'<a class="in-listingCardTitle"[^>]*href="([^"]*)"',), plain=False),
    "prezzo": CardField((r'(?s)class="in-listingCardPrice"[^>]*>\s*<span>(.*?)</span>',)),
    "immagine": CardField((r'<img[^>]*src="([^"]*)"',), plain=False),
    "caratteristiche": CardField((r'(?s)class="in-listingCardFeatureList__item"[^>]*>\s*<span[^>]*>(.*?)</span>',), many=True),
}
SECOND_CARD = r'(?s)<article class="srp-card">(.*?)</article>'
SECOND_FIELDS = {
    "titolo": CardField((r"(?s)<h3[^>]*>(.*?)</h3>",), "N/D"),
    "prezzo": CardField((r'(?s)<div class="price">(.*?)</div>',), "N/D"),
    "indirizzo": CardField((r'(?s)<p class="address">(.*?)</p>',), "N/D"),
    "link": CardField((r'<a class="card-link" href="([^"]*)"',), "N/D", plain=False),
    "agenzia": CardField((r'(?s)<div class="advertiser-name">(.*?)</div>',), "N/D"),
    "locali": CardField((r'(?s)<div class="feature-rooms">\s*<span>(.*?)</span>',)),
    "superficie": CardField((r'(?s)<div class="feature-surface">\s*<span>(.*?)</span>',)),
    "bagni": CardField((r'(?s)<div class="feature-bathrooms">\s*<span>(.*?)</span>',)),
    "piano": CardField((r'(?s)<div class="feature-floor">\s*<span>(.*?)</span>',)),
}


def portal_cards(pages: DataFrame, host: str, html: str = "html") -> DataFrame:
    """Cards with their list of preview features, each also in the field that its label names."""
    cards = extract_cards(pages, PORTAL_CARD, PORTAL_FIELDS, html)
    return preview_labels(cards.withColumn("url", absolute_url(F.col("url"), host)), "caratteristiche")


# Item cards of the second marketplace; everything but the favourites is in the link's title.
ITEM_CARD = r'(?s)<div class="new-item-box__container[^>]*>(.*?)(?=<div class="new-item-box__container|$)'
ITEM_FIELDS = {
    "Link": CardField((r'(?s)new-item-box__image-container[^>]*>\s*<a[^>]*href="([^"]*)"',), plain=False),
    "_text": CardField((r'(?s)new-item-box__image-container[^>]*>\s*<a[^>]*title="([^"]*)"',), plain=False),
    "_likes": CardField((r'(?s)new-item-box__favourite-icon.*?<span class="web_ui__Text[^>]*>(.*?)</span>',)),
}


def item_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """Items of the second marketplace; cards whose title does not split into its parts go."""
    cards = extract_cards(pages, ITEM_CARD, ITEM_FIELDS, html).withColumn("_t", split_composite_title(F.col("_text")))
    named = {"Titolo": "title", "Brand": "brand", "Condizione": "condition", "Prezzo": "price",
             "Prezzo con spedizione": "price_with_shipping", "Note": "notes"}
    likes = F.regexp_replace("_likes", r"\s", "").try_cast("int").alias("Preferiti")
    rest = [c for c in cards.columns if c not in ("_text", "_likes", "_t")]
    return cards.filter(F.col("_t").isNotNull()).select(*rest, *[F.col("_t")[f].alias(n) for n, f in named.items()], likes)


def second_portal_cards(pages: DataFrame, host: str, html: str = "html") -> DataFrame:
    """Cards with the nested ``caratteristiche`` struct."""
    cards = extract_cards(pages, SECOND_CARD, SECOND_FIELDS, html)
    inner = ["locali", "superficie", "bagni", "piano"]
    link = F.when(F.col("link") == "N/D", F.col("link")).otherwise(absolute_url(F.col("link"), host))
    return cards.withColumn("link", link).withColumn("caratteristiche", F.struct(*inner)).drop(*inner)


# Label of a detail page -> field; the first field label found wins.
DETAIL_TITLE = r'(?s)<div class="im-properties__title">(.*?)</div>'
DETAIL_LABELS = {
    "riferimento_annuncio": ["Riferimento Annuncio"], "data_pubblicazione": ["Data Pubblicazione Annuncio"],
    "data_aggiornamento": ["Data Aggiornamento Annuncio"], "codice_immobiliare": ["Codice Immobiliare"],
    "citta": ["Città"], "provincia": ["Provincia"], "regione": ["Regione"], "zona": ["Zona"],
    "indirizzo": ["Indirizzo"], "cap": ["CAP"], "quartiere": ["Quartiere"],
    "distanza_dal_mare": ["Distanza dal Mare"], "tipologia": ["Tipologia"], "categoria": ["Categoria"],
    "contratto": ["Contratto"], "tipo_contratto": ["Tipo Contratto"], "tipo_proprieta": ["Tipo Proprietà"],
    "piano": ["Piano"], "piani_edificio": ["Piani edificio"], "totale_piani_edificio": ["Totale piani edificio"],
    "ascensore": ["Ascensore"], "superficie": ["Superficie"], "locali": ["Locali"], "bagni": ["Bagni"],
    "camere_da_letto": ["Camere da letto"], "camere": ["Camere"], "altre_stanze": ["Altre stanze"],
    "arredato": ["Arredato"], "cucina": ["Cucina"], "balcone": ["Balcone"], "terrazzo": ["Terrazzo"],
    "giardino": ["Giardino"], "cantina": ["Cantina"], "soffitta": ["Soffitta"], "taverna": ["Taverna"],
    "mansarda": ["Mansarda"], "posti_auto": ["Posti Auto"], "box_auto": ["Box Auto"],
    "anno_costruzione": ["Anno di costruzione"], "stato": ["Stato"], "stato_immobile": ["Stato Immobile"],
    "riscaldamento": ["Riscaldamento"], "tipo_riscaldamento": ["Tipo riscaldamento"],
    "climatizzazione": ["Climatizzazione"], "vista": ["Vista"], "esposizione": ["Esposizione"],
    "orientamento": ["Orientamento"], "dettaglio_superficie": ["Superficie"], "coefficiente": ["Coefficiente"],
    "tipo_superficie": ["Tipo superficie"], "superficie_commerciale": ["Superficie commerciale"],
    "superficie_coperta": ["Superficie coperta"], "superficie_giardino": ["Superficie giardino"],
    "superficie_terrazzo": ["Superficie terrazzo"], "superficie_balcone": ["Superficie balcone"],
    "prezzo": ["Prezzo"], "prezzo_al_mq": ["Prezzo al m²"], "spese_condominio": ["Spese condominio"],
    "spese_extra": ["Spese extra"], "cauzione": ["Cauzione"], "caparra": ["Caparra"],
    "durata_contratto": ["Durata contratto"], "disponibilita": ["Disponibilità"], "requisiti": ["Requisiti"],
    "ideale_per": ["Ideale per"], "classe_energetica": ["Classe Energetica"],
    "indice_prestazione_energetica": ["Indice di prestazione energetica"],
    "consumo_energetico": ["Consumo di energia"], "ep_globale_non_rinnovabile": ["EP globale non rinnovabile"],
    "prestazione_inverno": ["Prestazione inverno"], "prestazione_estate": ["Prestazione estate"],
    "portineria": ["Portineria"], "tipo_edificio": ["Tipo Edificio"], "num_unita": ["Numero unità"],
    "agente": ["Agente"], "agenzia": ["Agenzia"],
}


def label_values(pages: DataFrame, labels: Mapping[str, Sequence[str]] = DETAIL_LABELS,
                 title: str = DETAIL_TITLE, html: str = "html") -> DataFrame:
    """One column per field: the first value whose label contains one of the field's label texts.  A value is the
    element right after its label's."""
    keep = [c for c in pages.columns if c != html]
    bare = pages.select(*keep, bare_markup(F.col(html)).alias("_h"))
    pairs = F.transform(element_pairs(F.col("_h"), title), lambda e: F.struct(
        let(e["k"], text_of).alias("k"), let(e["v"], text_of).alias("v")))
    listed = bare.select(*keep, pairs.alias("_p"))

    def first(word: str) -> Column:
        return F.get(F.filter("_p", lambda e: F.contains(e["k"], F.lit(word)) & (e["v"] != "")), F.lit(0))["v"]

    def value(wanted: Sequence[str]) -> Column:
        return F.coalesce(*[first(w) for w in wanted])

    return listed.select(*keep, *[value(w).alias(n) for n, w in labels.items()])


# Parts of a detail page outside its label pairs.
MAIN_FEATURES = {
    "piano": r'(?s)<li[^>]*aria-label="piano"[^>]*>(.*?)</li>',
    "superficie": r'(?s)<li[^>]*aria-label="superficie"[^>]*>(.*?)</li>',
    "locali": r'(?s)<li[^>]*aria-label="locali"[^>]*>(.*?)</li>',
    "bagni": r'(?s)<li[^>]*aria-label="bagn[^"]*"[^>]*>(.*?)</li>',
    "prezzo": r'(?s)<li[^>]*class="[^"]*in-detail__mainFeaturesPrice[^"]*"[^>]*>(.*?)</li>',
}
DETAIL_LISTS = {
    "descrizione": r'(?s)<div[^>]*class="[^"]*im-description__text[^"]*"[^>]*>(.*?)</div>',
    "altre_caratteristiche": r'(?s)<div[^>]*class="[^"]*im-features__list[^"]*"[^>]*>(.*?)</div>',
    "immagini": r'(?s)<div[^>]*class="[^"]*im-carousel[^"]*"[^>]*>(.*?)</div>',
}


def detail_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """All fields of a detail page: main features first, label pairs where those are silent, then
    description, feature and image lists, and coordinates from the map or an inline script."""
    keep = [c for c in pages.columns if c != html]
    # Parsed once: label values, the markup without scripts, and the markup itself.
    fields = label_values(pages.withColumn("_raw", F.col(html)), html=html).withColumn("_h", bare_markup(F.col("_raw")))
    main = {n: F.coalesce(F.nullif(text_of(element(F.col("_h"), p)), F.lit("")), F.col(n)) for n, p in MAIN_FEATURES.items()}
    block = {n: element(F.col("_h"), p) for n, p in DETAIL_LISTS.items()}
    lists = {
        "descrizione": F.filter(F.transform(F.split(block["descrizione"], "<[^>]*>"), strip), lambda x: x != ""),
        "altre_caratteristiche": F.transform(elements(block["altre_caratteristiche"], r"(?s)<li[^>]*>(.*?)</li>"), text_of),
        "immagini": elements(block["immagini"], r'<img[^>]*src="([^"]*)"'),
    }
    number = lambda name: to_double(element(F.col("_h"), f'<div[^>]*data-cy="[^"]*map[^"]*"[^>]*{name}="([^"]*)"'))
    lat, lng = number("data-lat"), number("data-lng")
    script = F.when(F.contains("_raw", F.lit("coordinates")), F.col("_raw"))
    s_lat, s_lng = script_coordinates(script)
    on_map = lat.isNotNull() & lng.isNotNull()
    place = {"latitudine": F.when(on_map, lat).otherwise(s_lat), "longitudine": F.when(on_map, lng).otherwise(s_lng)}
    out = fields.withColumns({**main, **lists, **place})
    return out.select(*keep, *DETAIL_LABELS, *lists, *place)


def next_links(pages: DataFrame, pattern: str, host: str, url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, next_url); the last page has NULL."""
    link = first_match(bare_markup(F.col(html)), pattern)
    return pages.select(F.col(url).alias("page_url"), absolute_url(link, host).alias("next_url"))


def all_links(pages: DataFrame, html: str = "html") -> DataFrame:
    keep = [c for c in pages.columns if c != html]
    found = F.regexp_extract_all(bare_markup(F.col(html)), F.lit(r'<a [^>]*href="([^"]*)"'), F.lit(1))
    return pages.select(*keep, F.posexplode(found).alias("pos", "href"))
