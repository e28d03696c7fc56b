"""Readers of landed CSV and JSON.  Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from borgata import schemas

CORRUPT = "_corrupt_record"


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType, keep_bad: bool = False,
             multi_line: bool = False) -> DataFrame:
    """CSV with a header.  ``keep_bad`` adds the raw text of rows that do not fit the schema.

    Quoted line breaks need ``multi_line``, which makes every file one task: ask for it only where
    texts hold line breaks, and land such data as many files of a few hundred MB.
    """
    schema = schemas.parse(schema)
    full = schema
    if keep_bad and CORRUPT not in schema.names:
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(full).option("header", True).option("multiLine", multi_line)
    # A doubled quote is the escape of every common CSV writer.
    reader = reader.option("escape", '"').option("mode", "PERMISSIVE")
    if keep_bad:
        reader = reader.option("columnNameOfCorruptRecord", CORRUPT)
    return reader.csv(path if isinstance(path, str) else list(path))


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def read_documents(spark: SparkSession, path: str, record: T.StructType, root: str = "immobili") -> DataFrame:
    """Whole-file JSON: an array below ``root``, or a bare array."""
    array = T.ArrayType(record)
    whole = spark.read.text(path, wholetext=True)
    return explode_root(whole, F.col("value"), root, array)


def explode_root(df: DataFrame, text: Column, root: str, array: T.ArrayType) -> DataFrame:
    """Records of JSON texts that are an object with ``root`` or a bare array."""
    under_root = F.from_json(text, T.StructType([T.StructField(root, array)]))[root]
    bare = F.from_json(F.when(F.ltrim(text).startswith("["), text), array)
    return df.select(F.inline(F.coalesce(bare, under_root)))


def paged_results(pages: DataFrame, start_page: int = 1, max_pages: int | None = None,
                  page: str = "page", status: str = "status", results: str = "results") -> DataFrame:
    """Results of the pages from ``start_page`` up to the last page, before the first failed one.

    ``pages``: page number, HTTP status, announced ``maxPages`` and the result array.
    """
    asked = pages.filter(F.col(page) >= start_page)
    if max_pages is not None:
        asked = asked.filter(F.col(page) <= max_pages)
    failed = asked.filter(F.col(status) != 200).agg(F.min(page)).scalar()
    last = asked.filter(F.col(status) == 200).agg(F.max("maxPages")).scalar()
    good = asked.filter((F.coalesce(F.col(page) < failed, F.lit(True))) & (F.col(page) <= last))
    return good.select(page, F.posexplode(results).alias("pos", "result"))


def paged_until_last(pages: DataFrame, page: str = "page", last: str = "last", content: str = "content") -> DataFrame:
    """Entries of all pages up to the first that says it is the last."""
    stop = pages.filter(F.col(last)).agg(F.min(page)).scalar()
    return pages.filter(F.coalesce(F.col(page) <= stop, F.lit(True))).select(
        page, F.posexplode(content).alias("pos", "entry")
    )


def parse_fares(df: DataFrame, text: str = "json") -> DataFrame:
    """(outbound, inbound) legs of fare answers; an empty list gives no rows."""
    keep = [c for c in df.columns if c != text]
    return df.select(*keep, F.inline(F.from_json(text, schemas.FARES)["fares"]))


def parse_city_map(df: DataFrame, text: str = "json") -> DataFrame:
    """City map from JSON text; unreadable text gives an empty map."""
    empty = F.create_map().cast(schemas.CITY_MAP)
    return df.select(F.coalesce(F.from_json(text, schemas.CITY_MAP), empty).alias("cities"))


def parse_zone_entries(df: DataFrame, text: str = "json", seq: Column | None = None) -> DataFrame:
    """Zone entries from JSON arrays; anything but an array gives no rows.

    ``ingest_seq`` is (``seq`` of the document, place in its array), which orders entries in reading
    order; without ``seq`` the document's text itself tells documents apart.
    """
    entries = F.from_json(F.when(F.ltrim(text).startswith("["), F.col(text)), schemas.ZONE_ENTRIES)
    order = F.col(text) if seq is None else seq
    exploded = df.select(order.alias("_o"), F.posexplode(entries).alias("_p", "e"))
    return exploded.select("e.*", F.struct(F.col("_o").alias("document"), F.col("_p").alias("place")).alias("ingest_seq"))


def read_airports(spark: SparkSession, path: str) -> DataFrame:
    return airport_dimension(read_csv(spark, path, schemas.AIRPORT))


def airport_dimension(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("iata_code").alias("code"), F.col("latitude_deg").alias("lat"), F.col("longitude_deg").alias("lng"),
        F.concat_ws(",", "iso_region", "iso_country").alias("location"),
    )


def validate(df: DataFrame, text: str, schema: str | T.StructType, required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): records parsed by ``schema`` with all required fields, and the rest with
    the reason."""
    keep = [c for c in df.columns if c != text]
    schema = schemas.parse(schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = df.withColumn("_d", F.from_json(text, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    missing = F.array_compact(F.array(*[F.when(F.col(f"_d.{c}").isNull(), c) for c in required]))
    reason = (
        F.when(F.col("_d").isNull() | F.col(f"_d.{CORRUPT}").isNotNull(), "unreadable")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
    )
    marked = parsed.withColumn("_reason", reason)
    valid = marked.filter(F.col("_reason").isNull()).select(*keep, *[F.col(f"_d.{f.name}") for f in schema.fields])
    rejected = marked.filter(F.col("_reason").isNotNull()).select(*keep, text, F.col("_reason").alias("reason"))
    return valid, rejected


def json_or_text(text: Column, schema: str) -> Column:
    """Struct of the parsed value and, where the text is no such JSON, the raw text."""
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.struct(parsed.alias("value"), F.when(F.try_parse_json(text).isNull(), text).alias("raw"))


def result_list(text: Column, item: str) -> Column:
    """``items`` of the ``list`` object of an answer; a ``list`` that is no object counts as empty."""
    found = F.from_json(text, f"list STRUCT<items: ARRAY<{item}>>")["list"]["items"]
    return F.coalesce(found, F.array().cast(f"array<{item}>"))


def file_name_parts(path: Column) -> Column:
    """Struct of city and contract of ``ads_CITY_CONTRACT.csv``; 'unknown' where a part is absent."""
    parts = F.split(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.csv$", ""), "_")
    is_ads = (F.get(parts, F.lit(0)) == "ads") & (F.size(parts) >= 3)
    return F.struct(
        F.when(is_ads, F.get(parts, F.lit(1))).otherwise("unknown").alias("city"),
        F.when(is_ads, F.get(parts, F.lit(2))).otherwise("unknown").alias("contract"),
    )


def container_name(path: Column) -> Column:
    """``CITY_CONTRACT`` of the file name; a file without both fails the job."""
    parts = file_name_parts(path)
    name = F.concat_ws("_", parts["city"], parts["contract"])
    return F.when(parts["city"] != "unknown", name).otherwise(
        F.raise_error(F.concat(F.lit("no container name in "), path))
    )


def seen_ids(spark: SparkSession, path: str, key: str = "id", kind: str = "string") -> DataFrame:
    """Saved id set; an absent or unreadable one is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path).select(key)
    except AnalysisException:
        return spark.createDataFrame([], f"{key} {kind}")
