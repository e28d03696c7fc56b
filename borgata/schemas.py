"""Explicit schemas of the landed data and of the store."""

from __future__ import annotations

from pyspark.sql import types as T


# Plain DDL texts: every reader takes them, and building a type from one needs a session.


def parse(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# The nested ad.
NESTED_AD = (
    "realEstate STRUCT<id BIGINT, uuid STRING, visibility STRING, contract STRING, isNew BOOLEAN, "
    "luxury BOOLEAN, title STRING, type STRING, typology STRUCT<id INT, name STRING>, "
    "isProjectLike BOOLEAN, isMosaic BOOLEAN, propertiesCount INT, "
    "price STRUCT<visible BOOLEAN, value BIGINT, formattedValue STRING, minValue STRING, "
    "maxValue STRING, priceRange STRING>, "
    "advertiser STRUCT<agency STRUCT<id INT, type STRING, displayName STRING, label STRING, agencyUrl STRING>>, "
    "properties ARRAY<STRUCT<surface STRING, rooms STRING, bathrooms STRING, description STRING, "
    "elevator BOOLEAN, typologyGA4Translation STRING, ga4Heating STRING, ga4features ARRAY<STRING>, "
    "ga4Garage STRING, caption STRING, matchSearch BOOLEAN, "
    "location STRUCT<address STRING, latitude DOUBLE, longitude DOUBLE, region STRING, province STRING, "
    "city STRING, macrozone STRING, nation STRUCT<id STRING, name STRING>>, "
    "floor STRUCT<abbreviation STRING, value STRING, floorOnlyValue STRING, ga4FloorValue STRING>, "
    "photo STRUCT<id INT, caption STRING, urls STRUCT<small STRING, medium STRING, large STRING>>, "
    "views ARRAY<STRUCT<id INT, name STRING>>>>>, "
    "seo STRUCT<anchor STRING, url STRING>, idGeoHash STRING"
)

# The flat listing table.
FLAT_LISTING = (
    "db_id BIGINT, id BIGINT, uuid STRING, title STRING, url STRING, geoHash STRING, type STRING, "
    "typology_id BIGINT, typology_name STRING, contract STRING, isNew BOOLEAN, luxury BOOLEAN, "
    "visibility BOOLEAN, isProjectLike BOOLEAN, isMosaic BOOLEAN, propertiesCount BIGINT, "
    "price_value DOUBLE, price_formatted STRING, price_min DOUBLE, price_max DOUBLE, price_range STRING, "
    "price_visible BOOLEAN, surface STRING, surface_m2 BIGINT, rooms BIGINT, bathrooms BIGINT, "
    "floor STRING, floor_number BIGINT, floor_ga4value STRING, elevator BOOLEAN, address STRING, "
    "latitude DOUBLE, longitude DOUBLE, city STRING, province STRING, region STRING, macrozone STRING, "
    "nation STRING, description STRING, caption STRING, ga4features STRING, ga4Heating STRING, "
    "ga4Garage STRING, views STRING, agency_id BIGINT, agency_type STRING, agency_name STRING, "
    "agency_label STRING, agency_url STRING, photo_id STRING, photo_caption STRING, "
    "photo_url_small STRING, photo_url_medium STRING, photo_url_large STRING, "
    "typologyGA4Translation STRING, matchSearch STRING, raw_data STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

# The agent listing document, all texts.
AGENT_FIELDS = [
    "url", "titolo", "descrizione", "indirizzo", "comune", "provincia", "zona", "tipologia", "piano",
    "ascensore", "locali", "cucina", "arredato", "terrazzo", "climatizzazione", "contratto",
    "piani_edificio", "superficie", "camere_da_letto", "bagni", "balcone", "riscaldamento",
    "altre_caratteristiche", "prezzo", "prezzo_al_mq", "spese_condominio", "cauzione", "consumo_di_energia",
]
AGENT_LISTING = T.StructType([T.StructField(n, T.StringType()) for n in AGENT_FIELDS])

MARKET_LISTING = (
    "Title STRING, Subtitle STRING, Brand STRING, Condition STRING, Price DOUBLE, "
    "`Price with Shipping` DOUBLE, Favorites BIGINT, Seller STRING, Link STRING, Notes STRING"
)

_PLACE = "STRUCT<iataCode STRING, name STRING, countryName STRING>"
FARE_LEG = (
    f"STRUCT<departureAirport {_PLACE}, arrivalAirport {_PLACE}, departureDate STRING, "
    "flightNumber STRING, price STRUCT<value DOUBLE, currencyCode STRING>>"
)
FARES = (f"fares ARRAY<STRUCT<outbound {FARE_LEG}, inbound {FARE_LEG}>>")

CITY_MAP = (
    "MAP<STRING, STRUCT<idComune STRING, name STRING, path STRING, "
    "macrozones MAP<STRING, STRUCT<id STRING, name STRING>>>>"
)
ZONE_ENTRIES = (
    "ARRAY<STRUCT<id STRING, type INT, label STRING, keyurl STRING, "
    "parents ARRAY<STRUCT<id STRING, type INT, label STRING, keyurl STRING>>>>"
)
AIRPORT = ("iata_code STRING, iso_region STRING, iso_country STRING, latitude_deg DOUBLE, longitude_deg DOUBLE")
