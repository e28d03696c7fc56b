"""Sharding by histogram sort: shards of near equal bytes from one exchange.

Rows are ordered by a 64-bit key: the upper bits hash the text, so equal texts stand together, the
lower 24 hash the id, so that even a text that a third of all rows share can be cut.  Splitters are
found by rounds of counting: every task counts the exact bytes and rows between candidate boundaries
(probes), the counts are added, and each splitter's interval shrinks to the two probes around its
target, until the bytes below it are within tolerance.  Few rounds reach any tolerance down to one
key.  Shards are cut with ``TOLERANCE``; inside a shard, coarser splitters cut the work of the
exchange.  As the counts also say how many rows lie below each splitter, a row's slot is its rank in
its own piece plus a known number, and the rows move once.

Probes sit at round positions first, so a boundary falls inside a group of equal texts only where the
tolerance asks for it.  Null text: no bytes, size 1, checksum of nothing.  Null ids are hashed like
any value.  Rows equal in key and id are alike, so their order does not matter.  An empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from borgata import session

SHARDS = 8
#: Of a shard's even share of the bytes.
TOLERANCE = 0.002
#: Of a piece's even share; pieces only spread the work.
PIECE_TOLERANCE = 0.25
PROBES = 32
_LOW_BITS = (1 << 24) - 1
_LEAST, _MOST = -(1 << 63), 1 << 63


def sort_key(text: Column, row_id: Column) -> Column:
    group = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit(~_LOW_BITS))
    return group.bitwiseOR(F.xxhash64(row_id).bitwiseAND(F.lit(_LOW_BITS)))


def below(df: DataFrame, probes: np.ndarray, key: str, size: str) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe; one row a probe comes to the driver."""

    def count(batches):
        total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            place = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            np.add.at(total, place, batch.column(1).to_numpy())
            rows += np.bincount(place, minlength=len(rows))
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used]), pa.array(rows[used])],
                                         names=["place", "size", "n"])

    counts = df.select(key, size).mapInArrow(count, "place long, size long, n long")
    total, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in counts.groupBy("place").agg(F.sum("size"), F.sum("n")).collect():
        total[r[0]], rows[r[0]] = r[1], r[2]
    return np.cumsum(total)[:-1], np.cumsum(rows)[:-1]


class Splitter:
    """One boundary: the bytes wanted below it, and the nearest known probes on both sides."""

    def __init__(self, target: float, tolerance: float, total: int, rows: int):
        self.target, self.tolerance = target, tolerance
        self.low, self.high = (_LEAST, 0, 0), (_MOST, total, rows)

    @property
    def best(self) -> tuple[int, int, int]:
        """(key, bytes below, rows below) of the nearer side."""
        return min(self.low, self.high, key=lambda p: abs(p[1] - self.target))

    @property
    def done(self) -> bool:
        return abs(self.best[1] - self.target) <= self.tolerance or self.high[0] - self.low[0] <= 1

    def probes(self, n: int) -> list[int]:
        step = max(1, (self.high[0] - self.low[0]) // n)
        return list(range(self.low[0] + step, self.high[0], step))

    def learn(self, keys: np.ndarray, total: np.ndarray, rows: np.ndarray) -> None:
        at = int(np.searchsorted(total, self.target, side="right"))  # first probe with more below
        for k in (at - 1, at):
            if 0 <= k < len(keys):
                point = (int(keys[k]), int(total[k]), int(rows[k]))
                if point[1] <= self.target and point[0] > self.low[0]:
                    self.low = point
                elif point[1] > self.target and point[0] < self.high[0]:
                    self.high = point


def find_splitters(df: DataFrame, key: str, size: str, shards: int, pieces: int,
                   tolerance: float = TOLERANCE) -> list[tuple[int, int, int]]:
    """(key, bytes below, rows below) of the ``shards * pieces - 1`` boundaries, ascending."""
    total, rows = df.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    n = shards * pieces
    wanted = [
        Splitter(total * j / n, total / shards * tolerance if j % pieces == 0 else total / n * PIECE_TOLERANCE, total, rows)
        for j in range(1, n)
    ]
    probes: set[int] = set(Splitter(0, 0, 1, 1).probes(PROBES * n)) if total else set()
    while probes:
        keys = np.array(sorted(probes), np.int64)
        counted = below(df, keys, key, size)
        for s in wanted:
            s.learn(keys, *counted)
        probes = {p for s in wanted if not s.done for p in s.probes(PROBES)}
    found = [s.best for s in wanted]
    for k in range(1, len(found)):  # boundaries inside one heavy key may have met
        found[k] = max(found[k - 1], found[k])
    return found


def shard_rows(df: DataFrame, key: str, size: str, order: list[str], shards: int = SHARDS,
               tolerance: float = TOLERANCE) -> DataFrame:
    """The rows with ``shard`` and ``slot``, ordered in a shard by key and ``order``.

    ``df`` is read once a round, so it should be a written table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(1, -(-2 * parts // shards))
    found = find_splitters(df, key, size, shards, pieces, tolerance)
    # A boundary above all keys cannot be held as a long, and no row reaches it.
    cuts = np.array([min(p[0], _MOST - 1) for p in found], np.int64)
    start = np.array([0, *[p[2] for p in found]], np.int64)
    base = start - start[np.arange(len(start)) // pieces * pieces]
    schema = T.StructType([*df.schema, T.StructField("_piece", T.IntegerType()), T.StructField("_base", T.LongType())])

    def place(batches):
        for batch in batches:
            piece = np.searchsorted(cuts, batch.column(key).to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(piece.astype(np.int32)), pa.array(base[piece])],
                                             names=schema.names)

    rank = F.row_number().over(Window.partitionBy("_piece").orderBy(key, *order))
    return (
        df.mapInArrow(place, schema).withColumn("slot", F.col("_base") + rank - 1)
        .withColumn("shard", (F.col("_piece") / pieces).cast("int")).drop("_piece", "_base")
    )


def op2_sharding(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    path = session.scratch_dir(spark, "shard-keys")
    docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                sort_key(F.col("text"), F.col("doc_id")).alias("_key")).write.parquet(path)
    placed = shard_rows(spark.read.parquet(path), "_key", "size", ["doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))
