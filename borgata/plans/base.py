"""Input tables, the derived listings, and the registry of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt out evenly to as many tasks as a shuffle has, for work that is large beside what is read:
    a file of a few MB is read by one or two tasks, however many cores there are."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)


_K = "o_orderkey"
_THOUSANDS = (
    "concat(CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING), '.', "
    "lpad(CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS STRING), 3, '0'))"
)
_PRICE = f"""CASE {_K} % 6
 WHEN 0 THEN concat('€ ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING))
 WHEN 1 THEN concat('€\xa0', {_THOUSANDS})
 WHEN 2 THEN concat('€ ', CAST(CAST(floor(o_totalprice / 100) AS BIGINT) AS STRING), '/mese')
 WHEN 3 THEN concat({_THOUSANDS}, ',50 €')
 WHEN 4 THEN 'Prezzo su richiesta' END"""

# Listing texts derived from orders, in SQL that both engines read the same way.
FROM_ORDERS = {
    "id": _K,
    "url": f"concat('https://ex.test/annunci/', CAST({_K} AS STRING), '/?q=', CAST({_K} % 7 AS STRING))",
    "title": f"concat('  Casa', ' \xa0 ', o_orderpriority, ' \t n.', CAST({_K} AS STRING), ' ')",
    "contract": f"CASE WHEN {_K} % 2 = 0 THEN 'sale' ELSE 'rent' END",
    "typology_name": f"CASE {_K} % 7 WHEN 0 THEN 'Attico' WHEN 1 THEN 'Villa' WHEN 2 THEN 'Loft' "
                     f"WHEN 3 THEN NULL ELSE 'Appartamento' END",
    "price_value": f"CASE WHEN {_K} % 23 = 0 THEN NULL ELSE o_totalprice END",
    "price_text": _PRICE,
    "surface": f"CASE WHEN {_K} % 17 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN 'circa 95.5 m² | commerciale' "
               f"ELSE concat(CAST(20 + {_K} % 130 AS STRING), ' m²') END",
    "surface_m2": f"CASE WHEN {_K} % 17 = 0 THEN NULL ELSE 20 + {_K} % 130 END",
    "rooms": f"CASE WHEN {_K} % 19 = 0 THEN NULL ELSE 1 + {_K} % 6 END",
    "bathrooms": f"1 + {_K} % 3",
    "floor_text": f"CASE {_K} % 14 WHEN 0 THEN '3' WHEN 1 THEN 'Piano terra' WHEN 2 THEN 'da 2 a 5' "
                  "WHEN 3 THEN 'seminterrato, 2' WHEN 4 THEN 'interrato (-1)' WHEN 5 THEN 'su più livelli' "
                  "WHEN 6 THEN 'ammezzato' WHEN 7 THEN 'piano rialzato' WHEN 8 THEN 'da seminterrato a piano terra' "
                  "WHEN 9 THEN ' 12 ' WHEN 10 THEN 'ultimo' WHEN 11 THEN 'T' WHEN 12 THEN 'interrato (-2), 1' END",
    "garage_text": f"CASE {_K} % 6 WHEN 0 THEN '1 in box privato/box in garage' "
                   "WHEN 1 THEN '2 in parcheggio/garage comune' "
                   "WHEN 2 THEN '1 in box privato, 2 in parcheggio/garage comune' WHEN 3 THEN 'Box privato' "
                   "WHEN 4 THEN 'nessuno' END",
    "features": f"CASE {_K} % 5 WHEN 0 THEN 'Balcone, Terrazzo,Ascensore' WHEN 1 THEN 'Cantina, Balcone' "
                "WHEN 2 THEN 'Fibra ottica' WHEN 3 THEN 'Ascensore , Vista mare' END",
    "elevator": f"CASE {_K} % 9 WHEN 0 THEN 'Sì' WHEN 1 THEN 'No' WHEN 2 THEN 'TRUE' WHEN 3 THEN '0' "
                "WHEN 4 THEN ' s ' WHEN 5 THEN 'forse' WHEN 6 THEN 'falso' WHEN 7 THEN 'Autonomo' END",
    "created_at": "o_orderdate",
}
FROM_PLACES = {
    "city": "n_name",
    "province": "concat('P', CAST(n_nationkey % 10 AS STRING))",
    "region": "r_name",
}


def listings(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The asked columns.  Tables that none of them needs are not read."""
    src = table(spark, sf, "orders")
    if any(c in FROM_PLACES for c in columns):
        customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
        src = src.join(customer, src["o_custkey"] == customer["c_custkey"], "left")
        src = src.join(nation, src["c_nationkey"] == nation["n_nationkey"], "left")
        if "region" in columns:
            region = table(spark, sf, "region")
            src = src.join(region, src["n_regionkey"] == region["r_regionkey"], "left")
    every = {**FROM_ORDERS, **FROM_PLACES}
    return src.selectExpr(*[f"{every[c]} AS {c}" for c in columns])


LISTINGS = "listings AS (SELECT {} FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)".format(
    ", ".join(f"{e} AS {n}" for n, e in {**FROM_ORDERS, **FROM_PLACES}.items())
)


def with_listings(sql: str) -> str:
    """SQL over ``listings``; further CTEs of the text start with a comma."""
    text = sql.strip()
    return f"WITH {LISTINGS}{text}" if text.startswith(",") else f"WITH {LISTINGS} {text}"


# The blanks of borgata.functions.text.BLANK_CLASS for DuckDB.
SQL_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SQL_BLANK}+', ' ', 'g'))"
