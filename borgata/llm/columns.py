"""Room for work columns beside columns of any name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def numbered(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The rows with their columns named c0, c1, ..., beside which every other name is free, and the
    selection that gives them their own names back."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    return docs.toDF(*names), [F.col(k).alias(c) for k, c in zip(names, docs.columns, strict=True)]


def numbers(docs: DataFrame, *columns: str) -> list[str]:
    """What ``numbered`` calls the columns."""
    return [f"c{docs.columns.index(c)}" for c in columns]
