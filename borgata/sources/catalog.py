"""Catalog questions and reuse of collected sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F


def split_tables(spark: SparkSession) -> list[str]:
    """Names of tables made of at least two parts joined by ``_``."""
    return sorted(t.name for t in spark.catalog.listTables() if len(t.name.split("_")) >= 2)


def distinct_across(frames: Sequence[DataFrame], column: str = "province") -> DataFrame:
    """Distinct values, NULL left out, of a column over every frame that has it.

    Each frame is made distinct first, so only distinct values meet.
    """
    parts = [f.select(column).filter(F.col(column).isNotNull()).distinct() for f in frames if column in f.columns]
    if not parts:
        raise ValueError(f"no table has a column {column}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.distinct()


def provinces(spark: SparkSession, column: str = "province", table: str | None = None) -> DataFrame:
    names = [table] if table else [t.name for t in spark.catalog.listTables()]
    return distinct_across([spark.table(n) for n in names], column)


class Collected:
    """Already collected sets by (query, source), kept on executor disks until cleared."""

    def __init__(self) -> None:
        self._sets: dict[tuple[str, str], DataFrame] = {}

    def has(self, query: str, source: str) -> bool:
        return (query, source) in self._sets

    def store(self, query: str, source: str, df: DataFrame) -> DataFrame:
        self.clear(query, source)
        self._sets[(query, source)] = df.persist(StorageLevel.DISK_ONLY)
        return self._sets[(query, source)]

    def get(self, query: str, source: str) -> DataFrame | None:
        return self._sets.get((query, source))

    def get_or_compute(self, query: str, source: str, compute) -> DataFrame:
        return self._sets.get((query, source)) or self.store(query, source, compute())

    def clear(self, query: str, source: str) -> None:
        old = self._sets.pop((query, source), None)
        if old is not None:
            old.unpersist()
