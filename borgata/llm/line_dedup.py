"""Line deduplication against levelled sorted runs of line hashes.

Documents are taken in batches, by ranges of their id, lowest first.  A line's key (the stripped,
lower-cased line, if it has ``LEAST`` code points) is held as two 64-bit hashes.  A batch's keys are
reduced to the smallest document that holds each, and anti-joined with the runs of all earlier
batches: what is left is new and its owner is final, because every later document has a larger id.
It becomes a run of its own, bucketed and sorted by hash, so the next batches merge-join it in place
without shuffling it.  When a level holds ``FANOUT`` runs they are compacted into one of the next level, so a batch
meets few runs however many came before.  A line stays if its key is short or its document owns it.

Null or empty text: one empty line, which stays.  A null id counts as larger than all others, and all
rows with it as one document; the same holds for rows that repeat an id.  An empty table gives no
rows.  Native: DataFrame functions only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borgata import session
from borgata.llm import columns

LEAST = 10
BATCHES = 4
FANOUT = 3
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    # lower() has a fast path for ASCII and folds just A-Z there; other lines are translated.
    ascii_only = F.octet_length(line) == F.char_length(line)
    folded = F.when(ascii_only, F.lower(line)).otherwise(F.translate(line, _UPPER, _LOWER))
    return F.btrim(folded, F.lit(_BLANKS))


class LineRuns:
    """Runs of (h1, h2) by level, as bucketed sorted tables below one shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.folder = session.scratch_dir(spark, "line-runs")
        self.levels: list[list[str]] = [[]]
        self.written = 0

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, keys: DataFrame) -> str:
        self.written += 1
        table = f"{self.name}_{self.written}"
        spread = keys.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
        (spread.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
         .option("path", f"{self.folder}/{table}").saveAsTable(table))
        return table

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows whose key no run holds."""
        for t in self.tables():
            run = self.spark.table(t).select("h1", "h2").hint("merge")
            keys = keys.join(run, ["h1", "h2"], "left_anti")
        return keys

    def add(self, fresh: DataFrame) -> DataFrame:
        """Keep the new rows as a run; returns it."""
        table = self._write(fresh)
        self.levels[0].append(table)
        added = self.spark.table(table)
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self.spark.table(level[0])
                for t in level[1:]:
                    merged = merged.unionByName(self.spark.table(t))
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._write(merged))
                self.levels[k] = []
        return added

    def forget(self) -> None:
        """Take the runs out of the catalogue; their files stay below the scratch folder."""
        for k in range(1, self.written + 1):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{k}")


def id_ranges(docs: DataFrame, doc: str, batches: int) -> list[tuple[int | None, int | None]]:
    """(above, up to) bounds of about equal rows; any bounds give the same result."""
    marks = docs.select(F.percentile_approx(F.coalesce(doc, F.lit(_LAST)), [k / batches for k in range(1, batches)], 1000))
    cuts = sorted(set(marks.first()[0] or []))
    return list(zip([None, *cuts], [*cuts, None], strict=True))


def dropped_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """(_d_doc, _d_row, _d_at): position of every line that goes, from 0; ``_d_row`` is a hash of the
    text, which tells rows of one id apart."""
    spark = docs.sparkSession
    work = session.scratch_dir(spark, "line-keys")
    lines = docs.select(F.coalesce(doc, F.lit(_LAST)).alias("_d_doc"), F.xxhash64(text).alias("_d_row"),
                        F.posexplode(split_lines(F.col(text))).alias("_d_at", "_d_line"))
    keyed = lines.select("_d_doc", "_d_row", "_d_at", line_key(F.col("_d_line")).alias("k")).filter(F.char_length("k") >= LEAST)
    # xxhash64 of the key, and of the key with a constant before it: independent seeds.
    hashes = F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), F.col("k")).alias("h2")
    keyed.select("_d_doc", "_d_row", "_d_at", *hashes).write.parquet(work)
    keyed = spark.read.parquet(work)
    runs, gone = LineRuns(spark), None
    for low, high in id_ranges(docs, doc, batches):
        batch = keyed
        if low is not None:
            batch = batch.filter(F.col("_d_doc") > low)
        if high is not None:
            batch = batch.filter(F.col("_d_doc") <= high)
        owned = runs.add(runs.fresh(batch.groupBy("h1", "h2").agg(F.min("_d_doc").alias("_d_doc"))))
        lost = batch.join(owned, ["h1", "h2", "_d_doc"], "left_anti").select("_d_doc", "_d_row", "_d_at")
        gone = lost if gone is None else gone.unionByName(lost)
    gone.write.parquet(f"{work}-gone")
    runs.forget()
    return spark.read.parquet(f"{work}-gone")


def deduplicated(docs: DataFrame, text: str = "text", doc: str = "doc_id", batches: int = BATCHES) -> DataFrame:
    """The rows with ``_d_text`` (lines that stay, joined), ``_d_n_lines`` and ``_d_n_dropped``."""
    gone = dropped_lines(docs, text, doc, batches)
    gone = gone.groupBy("_d_doc", "_d_row").agg(F.collect_set("_d_at").alias("_d_gone"))
    split = docs.withColumn("_d_lines", split_lines(F.col(text))).withColumn("_d_hash", F.xxhash64(text))
    split = split.withColumn("_d_key", F.coalesce(doc, F.lit(_LAST)))
    both = split.join(gone, (F.col("_d_key") == F.col("_d_doc")) & (F.col("_d_hash") == F.col("_d_row")), "left")
    n = F.size("_d_lines")
    stays = F.array_except(F.sequence(F.lit(0), n - 1), F.col("_d_gone"))
    text_of = F.array_join(F.transform(stays, lambda i: F.get("_d_lines", i)), "\n")
    return both.select(
        *docs.columns,
        F.when(F.col("_d_gone").isNull(), F.array_join("_d_lines", "\n")).otherwise(text_of).alias("_d_text"),
        n.cast("long").alias("_d_n_lines"),
        F.when(F.col("_d_gone").isNull(), 0).otherwise(F.size("_d_gone")).cast("long").alias("_d_n_dropped"))


def dedup_lines(docs: DataFrame, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """The documents with their own columns and only the lines that stay; a null text stays null."""
    rows, own = columns.numbered(docs)
    at, key = columns.numbers(docs, text, doc)
    new = F.when(F.col(at).isNotNull(), F.col("_d_text")).alias(text)
    return deduplicated(rows, at, key).select(*[new if c == text else o for c, o in zip(docs.columns, own, strict=True)])


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select(
        "doc_id", F.col("_d_n_lines").alias("n_lines"), F.col("_d_n_dropped").alias("n_dropped"),
        F.sha2("_d_text", 256).alias("kept_sha256"))
