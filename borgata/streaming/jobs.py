"""Streaming jobs: deduplication, price-drop alerts, micro-batch upsert, running append.

State that must survive a lost executor lives in the checkpoint and in versioned tables below a
shared folder.  A micro-batch that runs twice gives the same table: its batch number names the
version it writes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from borgata.session import scratch_dir
from borgata.sources import writers


def source(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000,
           pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def dedup(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, late: str | None = None) -> DataFrame:
    """First record of each key.  With a watermark the state is dropped after ``late``."""
    if event_time and late:
        return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything there is to a table, then stop; started again it goes on after the last
    finished batch."""
    return (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def counts(stream: DataFrame, keys: Sequence[str], path: str, checkpoint: str) -> StreamingQuery:
    """Running row counts per key; each batch writes the counts that changed under its number."""
    counted = stream.groupBy(*keys).agg(F.count("*").alias("n"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        counted.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))


def upsert(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Micro-batch upsert as a log: each batch adds its collapsed rows and rewrites nothing, so its
    cost follows the batch, not the table.  Every column is logged with the ``seq`` of its value, so a
    late batch does not win.  ``upserted`` reads the current table."""

    def add(batch: DataFrame, number: int) -> None:
        rest = [c for c in batch.columns if c not in (key, seq)]
        stamped = batch.filter(F.col(key).isNotNull()).select(
            key, *[F.when(F.col(c).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(c).alias("value"))).alias(c) for c in rest])
        _newest(stamped, key, F.lit(0)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def _newest(stamped: DataFrame, key: str, tie: Column) -> DataFrame:
    """Per key and column the (seq, value) of the highest seq; ``tie`` decides between equal ones."""
    rest = [c for c in stamped.columns if c not in (key, "batch")]
    ranked = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c)["seq"], tie)) for c in rest}
    return stamped.groupBy(key).agg(*[F.max_by(c, ranked[c]).alias(c) for c in rest])


def upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Current table of an upsert log: per key and column the value of the highest seq that is not NULL."""
    newest = _newest(spark.read.parquet(path), key, F.col("batch"))
    return newest.select(key, *[F.col(c)["value"].alias(c) for c in newest.columns if c != key])


def compact(spark: SparkSession, path: str, target: str, key: str) -> None:
    """Write the log's newest values as batch 0 of a new log, for a log that has grown long."""
    _newest(spark.read.parquet(path), key, F.col("batch")).write.mode("errorifexists").parquet(f"{target}/batch=0")


STATE_SLOTS = 64


def _state(spark: SparkSession, path: str, number: int, shape: T.StructType) -> DataFrame:
    """Newest row of every key before batch ``number``: of each slot the last version an earlier batch wrote."""
    if number == 0:
        return spark.createDataFrame([], shape)
    kept = spark.read.parquet(path).filter(F.col("_version") <= number)
    newest = kept.groupBy("_slot").agg(F.max("_version").alias("_version"))  # one row a slot
    return kept.join(newest, ["_slot", "_version"], "left_semi").select(*shape.names)


def price_drops(stream: DataFrame, alerts: str, state: str, checkpoint: str, keys: Sequence[str],
                order: Sequence[str], price: str, slots: int = STATE_SLOTS) -> StreamingQuery:
    """Rows cheaper than the row before them: in the micro-batch by ``order``, and for a key's first row
    in a batch the newest row that earlier batches brought.  A late row is compared like any other; it
    does not become the newest.  The state holds one row a key in ``slots`` by key hash, and a batch
    replaces only the slots it touches."""
    from borgata.operators.monitor import previous_value

    def compare(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        slot = F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")
        # Both the batch and the state are read more than once below.
        work = scratch_dir(spark, "drops")
        batch.withColumn("_slot", slot).write.parquet(f"{work}/batch")
        rows = spark.read.parquet(f"{work}/batch")
        touched = rows.select("_slot").distinct()  # at most ``slots`` rows
        last = _state(spark, state, number, batch.schema).withColumn("_slot", slot).join(touched, "_slot", "left_semi")
        columns = [*batch.columns, "_slot"]
        both = rows.select(*columns, F.lit(1).alias("_new")).unionByName(last.select(*columns, F.lit(0).alias("_new")))
        # The state's row stands first, also where the batch is late.
        stepped = previous_value(both, keys, ["_new", *order], price)
        found = stepped.filter((F.col("_new") == 1) & (F.col(price) < F.col("previous"))).drop("_new", "_slot")
        found.write.mode("overwrite").parquet(f"{alerts}/batch={number}")
        newest = both.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r")).select("_r.*")
        newest.write.mode("overwrite").partitionBy("_slot").parquet(f"{state}/_version={number + 1}")

    return (
        stream.writeStream.foreachBatch(compare).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def fan_out(stream: DataFrame, sinks, checkpoint: str) -> StreamingQuery:
    """Every micro-batch to several sinks; ``sinks``: name -> (DataFrame, batch number) -> None."""

    def write(batch: DataFrame, number: int) -> None:
        outcome = writers.fan_out(batch, {n: (lambda df, w=w: w(df, number)) for n, w in sinks.items()})
        failed = {n: o for n, o in outcome.items() if o != "ok"}
        if len(failed) == len(sinks):
            raise RuntimeError(f"every sink failed: {failed}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
