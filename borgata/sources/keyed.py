"""Keyed tables kept bucketed and sorted by their key, so that a batch is merged in place.

A version is a folder ``path/v=N`` with one file per bucket.  A batch of any size is shuffled to the
buckets and merge-joined there; the table itself is read bucket by bucket, never shuffled, and
because a task holds one bucket, the next version is written without a shuffle too.  The bucket
count is the caller's (about 1 GB of table a bucket) and belongs to the path: every call must give
the same one.  An unfinished write has no marker and is passed over; its number is not used again.

With ``spark.sql.legacy.bucketedTableScan.outputOrdering`` set, the table's side is not sorted
again either, since every bucket is one sorted file.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from borgata.operators import store
from borgata.sources import writers


@dataclass(frozen=True)
class KeyedTable:
    spark: SparkSession
    path: str
    key: str
    buckets: int

    def _name(self, number: int) -> str:
        return f"keyed_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}_v{number}"

    def _next(self) -> int:
        fs, root = writers._folder(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return max((int(n[2:]) for n in names if n.startswith("v=")), default=0) + 1

    def _write(self, df: DataFrame) -> int:
        number = self._next()
        files = df.write.format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key)
        files.option("path", f"{self.path}/v={number}").saveAsTable(self._name(number))
        return number

    def replace(self, df: DataFrame) -> int:
        """Any rows as the next version; they are dealt out to the buckets first."""
        return self._write(df.repartition(self.buckets, self.key))

    def read(self, number: int | None = None) -> DataFrame:
        """A version, by default the last finished one; another session's tables are found by path."""
        found = writers.versions(self.spark, self.path)
        if not found:
            raise FileNotFoundError(f"no finished version below {self.path}")
        number = found[-1] if number is None else number
        name, place = self._name(number), f"{self.path}/v={number}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.read.parquet(place).schema)
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{self.key}`) "
                           f"SORTED BY (`{self.key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def merged(self, batch: DataFrame, replace_existing: bool = True, seq: str = store.SEQ) -> DataFrame:
        """The table after the batch, not yet written."""
        return store.upsert_merged(self.read(), batch, self.key, replace_existing, seq, self.buckets)

    def upsert(self, batch: DataFrame, replace_existing: bool = True, seq: str = store.SEQ) -> int:
        return self._write(self.merged(batch, replace_existing, seq))

    def unseen(self, items: DataFrame, seq: str = store.SEQ) -> DataFrame:
        """First item of every key the table lacks; items without a key all pass."""
        return store.dedup_against_seen(items, self.read(), self.key, seq, self.buckets)

    def add_keys(self, items: DataFrame) -> int:
        """A table of keys alone, with the items' keys added."""
        return self._write(store.seen_merged(self.read(), items, self.key, self.buckets))
