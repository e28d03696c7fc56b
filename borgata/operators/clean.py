"""Cleaning: types, texts, missing values, names, flattening."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from borgata.functions import dates, flags, floors, numbers, text, titles

# Columns of the flat listing table by kind.
LONG_COLUMNS = ["id", "typology_id", "propertiesCount", "rooms", "bathrooms", "agency_id"]
DOUBLE_COLUMNS = ["price_value", "price_min", "price_max", "latitude", "longitude"]
FLAG_COLUMNS = ["isNew", "luxury", "visibility", "isProjectLike", "isMosaic", "price_visible", "elevator"]
TEXT_COLUMNS = [
    "title", "description", "address", "caption", "ga4features", "ga4Heating",
    "ga4Garage", "views", "city", "province", "region", "macrozone", "nation",
    "agency_name", "agency_label", "agency_url", "photo_caption", "typologyGA4Translation",
]
URL_COLUMNS = ["url", "agency_url", "photo_url_small", "photo_url_medium", "photo_url_large"]
TIME_COLUMNS = ["created_at", "updated_at"]
READ_TEXT_COLUMNS = [
    "title", "description", "address", "caption", "ga4features", "ga4Heating",
    "ga4Garage", "views", "city", "province", "region", "macrozone", "nation",
    "agency_name", "agency_label", "agency_type", "photo_caption", "typologyGA4Translation",
    "matchSearch", "contract", "type", "typology_name", "geoHash",
]
MARKET_NAMES = {
    "Titolo": "Title",
    "Sottotitolo": "Subtitle",
    "Prezzo": "Price",
    "Prezzo con spedizione": "Price with Shipping",
    "Link": "Link",
    "Brand": "Brand",
    "Condizione": "Condition",
    "Preferiti": "Favorites",
    "Note": "Notes",
}


def apply_by_kind(df: DataFrame, rules: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """Rewrite the columns that exist, in one projection."""
    present = {name: rule(F.col(f"`{name}`")) for name, rule in rules.items() if name in df.columns}
    return df.withColumns(present) if present else df


def coerce_types(df: DataFrame) -> DataFrame:
    """Typed columns for the store; values that do not parse become NULL."""
    kinds = dict(df.dtypes)
    texts = lambda names: [c for c in names if kinds.get(c) == "string"]
    rules: dict[str, Callable[[Column], Column]] = {}
    rules |= {c: numbers.whole_number if kinds.get(c) == "string" else numbers.to_long for c in LONG_COLUMNS}
    rules |= {c: numbers.to_double for c in DOUBLE_COLUMNS}
    rules |= {c: flags.to_flag for c in FLAG_COLUMNS if kinds.get(c) != "boolean"}
    rules |= {c: text.clean_text for c in texts(TEXT_COLUMNS + URL_COLUMNS)}
    rules |= {c: dates.parse_iso for c in texts(TIME_COLUMNS)}
    rules |= {c: floors.floor_store for c in texts(["floor_number"])}
    if "surface" in kinds:
        df = df.withColumn("surface_m2", numbers.surface_first_number(F.col("surface")))
    return apply_by_kind(df, rules)


def clean_on_read(df: DataFrame) -> DataFrame:
    """Read side of the store: trim texts, missing words to NULL, dates parsed."""
    kinds = dict(df.dtypes)
    texts = lambda names: [c for c in names if kinds.get(c) == "string"]
    trimmed = lambda c: text.strip(text.missing_to_null(c))
    rules = {c: trimmed for c in texts([*READ_TEXT_COLUMNS, *URL_COLUMNS, "price_formatted", "price_range"])}
    return apply_by_kind(df, rules | {c: dates.parse_iso for c in texts(TIME_COLUMNS)})


def null_normalize(df: DataFrame) -> DataFrame:
    """NaN and empty text become NULL in every column."""
    fixed = {}
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            fixed[field.name] = F.when(~F.isnan(c), c)
        elif isinstance(field.dataType, T.StringType):
            fixed[field.name] = text.blank_to_null(c)
    return df.withColumns(fixed)


def add_raw_json(df: DataFrame, name: str = "raw_data") -> DataFrame:
    """Whole row as JSON text, unless the column is there already."""
    return df if name in df.columns else df.withColumn(name, F.to_json(F.struct("*")))


def rename_canonical(df: DataFrame, names: Mapping[str, str] = MARKET_NAMES) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def clean_listing(df: DataFrame) -> DataFrame:
    """Strip every text, collapse two of them, and read five as whole numbers.

    The numeric reading replaces the column; the stripped text stays in ``<name>_raw``, so texts
    without a number ("Piano rialzato") are not lost.
    """
    out: list[Column] = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if not isinstance(field.dataType, T.StringType):
            out.append(c)
        elif field.name in ("descrizione", "titolo"):
            out.append(F.regexp_replace(text.strip(c), text.BLANK_CLASS + "+", " ").alias(field.name))
        elif field.name in ("prezzo", "superficie", "locali", "bagni", "piano"):
            bare = text.strip(c)
            out.append(numbers.digit_group(bare).alias(field.name))
            out.append(bare.alias(f"{field.name}_raw"))
        else:
            out.append(text.strip(c).alias(field.name))
    return df.select(*out)


def select_existing(df: DataFrame, wanted: Iterable[str], fallback: Mapping[str, str] | None = None) -> DataFrame:
    """Columns that exist, after filling absent ones from their fallback column."""
    for target, source in (fallback or {}).items():
        if target not in df.columns and source in df.columns:
            df = df.withColumn(target, F.col(source))
    return df.select(*[c for c in wanted if c in df.columns])


# Column groups of the flat listing table; a trailing * means every such prefix.
COLUMN_GROUPS = [
    ["id", "uuid", "title", "url", "geoHash"],
    ["type", "typology_id", "typology_name", "contract", "isNew", "luxury", "visibility",
     "isProjectLike", "isMosaic", "propertiesCount"],
    ["price_*"],
    ["surface", "rooms", "bathrooms", "floor", "floor_number", "floor_ga4value", "elevator"],
    ["address", "latitude", "longitude", "city", "province", "region", "macrozone", "nation"],
    ["description", "caption", "ga4features", "ga4Heating", "ga4Garage", "views"],
    ["agency_*"],
    ["photo_*"],
]


def ordered_columns(columns: list[str]) -> list[str]:
    placed: dict[str, None] = {}
    for entry in (e for group in COLUMN_GROUPS for e in group):
        if entry.endswith("*"):
            placed.update(dict.fromkeys(c for c in columns if c.startswith(entry[:-1])))
        elif entry in columns:
            placed[entry] = None
    placed.update(dict.fromkeys(columns))
    return list(placed)


def flatten_ads(df: DataFrame) -> DataFrame:
    """Nested ad -> flat columns; first property only; ads without ``realEstate`` dropped."""
    home = F.get(F.col("realEstate.properties"), F.lit(0))
    # Output column and where it lies in the ad, then in its first property.
    ad_paths = {
        "id": "realEstate.id", "uuid": "realEstate.uuid", "visibility": "realEstate.visibility",
        "contract": "realEstate.contract", "isNew": "realEstate.isNew", "luxury": "realEstate.luxury",
        "title": "realEstate.title", "type": "realEstate.type",
        "typology_id": "realEstate.typology.id", "typology_name": "realEstate.typology.name",
        "isProjectLike": "realEstate.isProjectLike", "isMosaic": "realEstate.isMosaic",
        "propertiesCount": "realEstate.propertiesCount", "url": "seo.url", "geoHash": "idGeoHash",
        "price_value": "realEstate.price.value", "price_formatted": "realEstate.price.formattedValue",
        "price_min": "realEstate.price.minValue", "price_max": "realEstate.price.maxValue",
        "price_range": "realEstate.price.priceRange", "price_visible": "realEstate.price.visible",
        "agency_id": "realEstate.advertiser.agency.id", "agency_type": "realEstate.advertiser.agency.type",
        "agency_name": "realEstate.advertiser.agency.displayName",
        "agency_label": "realEstate.advertiser.agency.label",
        "agency_url": "realEstate.advertiser.agency.agencyUrl",
    }
    home_paths = {
        "surface": "surface", "rooms": "rooms", "bathrooms": "bathrooms", "description": "description",
        "elevator": "elevator", "typologyGA4Translation": "typologyGA4Translation",
        "ga4Heating": "ga4Heating", "ga4Garage": "ga4Garage", "caption": "caption",
        "matchSearch": "matchSearch", "address": "location.address", "latitude": "location.latitude",
        "longitude": "location.longitude", "region": "location.region", "province": "location.province",
        "city": "location.city", "macrozone": "location.macrozone", "nation": "location.nation.name",
        "floor": "floor.value", "floor_number": "floor.floorOnlyValue",
        "floor_ga4value": "floor.ga4FloorValue", "photo_id": "photo.id",
        "photo_caption": "photo.caption", "photo_url_small": "photo.urls.small",
        "photo_url_medium": "photo.urls.medium", "photo_url_large": "photo.urls.large",
    }

    def at(root: Column, path: str) -> Column:
        for step in path.split("."):
            root = root.getField(step)
        return root

    features = home.getField("ga4features")
    views = F.transform(home.getField("views"), lambda v: F.coalesce(v["name"], F.lit("")))
    picked = [F.col(p).alias(n) for n, p in ad_paths.items()]
    picked += [at(home, p).alias(n) for n, p in home_paths.items()]
    picked.append(F.when(F.size(features) > 0, F.array_join(features, ", ")).alias("ga4features"))
    picked.append(F.when(F.size(views) > 0, F.array_join(views, ", ")).alias("views"))
    # A filter would move below the parsing of the landed text and have every ad parsed twice; a
    # generator that gives one row or none stays where it is.
    ads = F.when(F.col("realEstate").isNotNull(), F.array(F.struct("realEstate", "seo", "idGeoHash")))
    flat = df.select(F.inline(ads)).select(*picked)
    return flat.select(*ordered_columns(flat.columns))


def spread_struct(df: DataFrame, name: str) -> DataFrame:
    """Fields of a struct column as capitalised top-level columns."""
    fields = df.schema[name].dataType.fieldNames()
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, *[F.col(name)[f].alias(f.capitalize()) for f in fields])


# Field processors: name -> (per value, over the values).  Users add their own entries.
def take_first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull() & (v != "")), F.lit(0))


def join_values(values: Column) -> Column:
    return F.array_join(F.filter(values, lambda v: v.isNotNull()), " ")


FIELD_PROCESSORS: dict[str, tuple[Callable[[Column], Column] | None, Callable[[Column], Column]]] = {
    "prezzo": (numbers.price_token, join_values),
    "superficie": (numbers.surface_text, join_values),
    "locali": (text.strip_tags, join_values),
    "piano": (floors.floor_letter, join_values),
    "bagni": (None, lambda v: text.strip_tags(F.coalesce(take_first(v), F.lit("")))),
    "numero_piani": (None, lambda v: text.parse_digits(take_first(v))),
    "posti_auto": (None, lambda v: text.strip_tags(F.coalesce(take_first(v), F.lit("")))),
    "data": (None, lambda v: text.parse_date_text(take_first(v))),
    "stato": (None, lambda v: text.strip_tags(take_first(v))),
    "spese_condominio": (None, lambda v: text.parse_digits(take_first(v))),
}


def process_fields(df: DataFrame, processors: Mapping = FIELD_PROCESSORS) -> DataFrame:
    """Run the value and list processors of every multi-valued field that exists."""
    out = {}
    for name, (each, whole) in processors.items():
        if name in df.columns:
            values = F.col(name) if each is None else F.transform(F.col(name), each)
            out[name] = whole(values)
    return df.withColumns(out)


# Flag, number (text before and after it) and count fields of a detail page.
DETAIL_FLAGS = ["ascensore", "arredato", "balcone", "terrazzo", "giardino",
                "cantina", "soffitta", "mansarda", "portineria", "taverna"]
DETAIL_NUMBERS = {
    "superficie": ("", r"\s*m²?"),
    "superficie_commerciale": ("", r"\s*m²?"),
    "superficie_coperta": ("", r"\s*m²?"),
    "superficie_giardino": ("", r"\s*m²?"),
    "superficie_terrazzo": ("", r"\s*m²?"),
    "superficie_balcone": ("", r"\s*m²?"),
    "prezzo": (r"€?\s*", ""),
    "prezzo_al_mq": ("", r"\s*€/m²"),
    "spese_condominio": (r"€?\s*", ""),
    "spese_extra": (r"€?\s*", ""),
    "cauzione": (r"€?\s*", ""),
    "caparra": (r"€?\s*", ""),
    "consumo_energetico": ("", r"\s*kWh/m²"),
    "ep_globale_non_rinnovabile": ("", ""),
    "indice_prestazione_energetica": ("", ""),
    "distanza_dal_mare": ("", r"\s*metri"),
}
DETAIL_COUNTS = ["locali", "bagni", "camere_da_letto", "camere", "piani_edificio", "piano",
                 "totale_piani_edificio", "posti_auto", "num_unita"]


def normalize_details(df: DataFrame, legacy: bool = False) -> DataFrame:
    """Typed detail fields of a listing page, in one projection.

    Blanks of every kind are made plain first, so that NBSP before a unit is seen.
    ``legacy`` keeps the narrow number shape that cuts ``1.250.000`` after ``1.250``.
    """
    plain = lambda c: F.regexp_replace(c, text.BLANK_CLASS, " ")
    rules: dict[str, Callable[[Column], Column]] = {c: flags.detail_flag for c in DETAIL_FLAGS}
    for name, (before, after) in DETAIL_NUMBERS.items():
        rules[name] = lambda c, b=before, a=after: numbers.locale_number(plain(c), b, a, legacy)
    rules["anno_costruzione"] = lambda c: numbers.to_long(text.first_match(c, r"(\d{4})"))
    rules.update({c: numbers.first_count for c in DETAIL_COUNTS})
    rules["classe_energetica"] = lambda c: F.coalesce(
        F.upper(text.first_match(plain(c), r"(?i)Classe\s+([A-G][\+\d]*)")), c
    )
    types = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(types.get("descrizione"), T.ArrayType):
        rules["descrizione"] = lambda c: F.array_join(clean_list(c), " ")
    else:
        rules["descrizione"] = text.strip
    rules["altre_caratteristiche"] = lambda c: clean_list(
        c if isinstance(types.get("altre_caratteristiche"), T.ArrayType) else F.array(c)
    )
    return apply_by_kind(df, rules)


def clean_list(values: Column) -> Column:
    return F.filter(F.transform(values, text.strip), lambda v: v.isNotNull() & (v != ""))


def script_coordinates(script: Column) -> tuple[Column, Column]:
    """Latitude and longitude of an inline script; both or neither."""
    lat = numbers.to_double(text.first_match(script, r'"lat":\s*([0-9.]+)'))
    lng = numbers.to_double(text.first_match(script, r'"lng":\s*([0-9.]+)'))
    both = lat.isNotNull() & lng.isNotNull()
    return F.when(both, lat), F.when(both, lng)


def preview_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """List-page labels mapped to their fields."""
    return df.withColumn("_m", titles.label_map(F.col(labels))).select(
        *[F.col(f"`{c}`") for c in df.columns], "_m.*"
    )
