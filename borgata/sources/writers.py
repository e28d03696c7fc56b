"""Sinks: CSV, JSON, envelope, partitioned tables, versions, fan-out, load reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from borgata.operators import store
from borgata.session import scratch_dir


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str) -> bool:
    """Write unless there is nothing to write; tells whether it wrote."""
    if df.isEmpty():
        return False
    write_csv(df, path)
    return True


def export_name(city: str, contract: str) -> str:
    return f"ads_{city}_{contract}"


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, NULL fields kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def metadata(df: DataFrame, source: str, stamp: str) -> DataFrame:
    """One row that describes a written set."""
    return df.agg(F.count("*").alias("count")).select(
        F.lit(stamp).alias("timestamp"), F.lit(source).alias("spider"), "count"
    )


def write_envelope(df: DataFrame, path: str, source: str, stamp: str) -> None:
    """Records below ``items`` and their metadata row below ``_metadata``, from one pass."""
    seen = Observation("written")
    write_json(df.observe(seen, F.count(F.lit(1)).alias("count")), f"{path}/items")
    row = [(stamp, source, seen.get["count"])]
    write_json(df.sparkSession.createDataFrame(row, "timestamp string, spider string, count bigint"), f"{path}/_metadata")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], mode: str = "overwrite") -> None:
    """One folder per value.  Only folders that receive rows are replaced.

    Rebalancing lets AQE split a value that holds a third of the rows over many tasks and pack
    small values together.
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    )


def upsert_partitioned(batch: DataFrame, path: str, keys: Sequence[str] = ("id", "city"), part: str = "city",
                       seq: str = "ingest_seq") -> None:
    """Document upsert into a partitioned folder; only partitions that the batch touches are read
    and replaced.

    The join on the partition column prunes the folder at run time; the touched values stay in the
    job.  The merged partitions are written aside first, so no partition is read while it is replaced.
    """
    spark = batch.sparkSession
    if not batch.filter(F.col(part).isNull()).isEmpty():
        raise ValueError(f"fill {part} first: a document without it has no partition")
    try:
        whole = spark.read.parquet(path)
    except AnalysisException:
        whole = spark.createDataFrame([], batch.drop(seq).schema)
    touched = whole.join(batch.select(part).distinct(), part, "left_semi").select(*whole.columns)
    merged = store.upsert_documents(touched, batch, keys, seq)
    aside = scratch_dir(spark, "upsert")
    merged.write.parquet(aside)
    write_partitioned(spark.read.parquet(aside), path, [part])


def write_table(df: DataFrame, table: str, if_exists: str = "append") -> None:
    """``fail``, ``replace`` or ``append``."""
    modes = {"fail": "errorifexists", "replace": "overwrite", "append": "append"}
    if if_exists not in modes:
        raise ValueError(f"if_exists must be one of {sorted(modes)}")
    df.write.mode(modes[if_exists]).format("parquet").saveAsTable(table)


def create_listing_table(spark: SparkSession, table: str, location: str | None = None) -> None:
    from borgata.schemas import FLAT_LISTING, parse

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parse(FLAT_LISTING))
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet{place}")


def stamp_times(df: DataFrame, now: Column, changed: Column) -> DataFrame:
    """``created_at`` where it is missing; ``updated_at`` of changed rows only."""
    return df.withColumns(
        {
            "created_at": F.coalesce("created_at", now),
            "updated_at": F.when(changed, now).otherwise(F.coalesce("updated_at", now)),
        }
    )


# --- versioned folders ---------------------------------------------------------------------------

def _folder(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions below ``path``, oldest first; unfinished writes have no marker."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("v=") and fs.exists(marker):
            found.append(int(name[2:]))
    return sorted(found)


def write_version(df: DataFrame, path: str) -> int:
    """Write the next version beside the older ones: readers keep theirs, and the prior version is
    the backup.  A lost executor only repeats its tasks; the version counts once it is complete."""
    number = max(versions(df.sparkSession, path), default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    if number is None:
        found = versions(spark, path)
        if not found:
            raise FileNotFoundError(f"no finished version below {path}")
        number = found[-1]
    return spark.read.parquet(f"{path}/v={number}")


def rewrite_sorted(spark: SparkSession, path: str, *order: str) -> int:
    """Sort a versioned table into its next version; the version being read is left alone."""
    return write_version(read_version(spark, path).orderBy(*order), path)


# --- fan-out and reports -------------------------------------------------------------------------

def fan_out(df: DataFrame, sinks: Mapping[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Run every sink on the same data; one that fails does not stop the others."""
    data = df.persist(StorageLevel.DISK_ONLY)
    outcome = {}
    try:
        for name, write in sinks.items():
            try:
                write(data)
                outcome[name] = "ok"
            except Exception as error:  # noqa: BLE001 - the summary carries every failure
                outcome[name] = f"failed: {str(error).splitlines()[0]}"
    finally:
        data.unpersist()
    return outcome


def load_report(df: DataFrame, file: str, error: str, order: str, at_most: int = 10, stamp: str | None = None) -> DataFrame:
    """Per file: total, successful, failed and the first errors, in one aggregation.

    The counts are exact; the error list is the report's feature of showing the first few.  With the
    time each row was handled, ``stamp``, also ``seconds`` from a file's first row to its last, NULL
    for a file without any time.
    """
    failed = F.col(error).isNotNull()
    took = []
    if stamp:
        at = F.unix_micros(F.col(stamp).cast("timestamp"))
        took = [((F.max(at) - F.min(at)) / F.lit(1e6)).alias("seconds")]
    counts = df.groupBy(file).agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("successful"), F.count_if(failed).alias("failed"),
        *took
    )
    return counts.join(first_values(df.filter(failed), file, error, order, at_most, "errors"), file, "left").select(
        file, "total", "successful", "failed", F.coalesce("errors", F.array().cast("array<string>")).alias("errors"),
        *(["seconds"] if stamp else [])
    )


def load_totals(report: DataFrame) -> DataFrame:
    """One row over all files of a load report."""
    return report.agg(
        F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "successful", "failed")],
        F.try_divide(F.sum("successful") * F.lit(100.0), F.sum("total")).alias("percent"))


def first_values(df: DataFrame, key: str, value: str, order: str, n: int, name: str, parts: int = 64) -> DataFrame:
    """First ``n`` values per key by ``order``, exact under any skew: the first ``n`` of each of
    ``parts`` slices of a key come first, then the first ``n`` of those."""
    from pyspark.sql import Window

    sliced = df.select(key, value, order, F.pmod(F.xxhash64(order), F.lit(parts)).alias("_s"))
    some = sliced.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_s").orderBy(order))).filter(F.col("_r") <= n)
    few = some.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_r") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.col(value).alias("v"))))
    return few.groupBy(key).agg(F.transform(listed, lambda e: e["v"]).alias(name))


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
