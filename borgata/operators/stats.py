"""Counts, descriptive statistics, histogram, overlay, profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from borgata.functions import numbers
from borgata.functions.text import strip
from borgata.operators.quantiles import summarize, wide_percentiles

PERCENTILES = [25, 50, 75, 90, 95, 99]
BINS = 30
OVERLAY_POINTS = 500


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, min, max, sample standard deviation and median, per group that has values."""
    return summarize(df, value, {"median": 0.5}, by)


def percentiles(df: DataFrame, value: str, by: Sequence[str] = (), at: Sequence[int] = PERCENTILES) -> DataFrame:
    return wide_percentiles(df, value, {f"p{p}": p / 100 for p in at}, by)


def value_counts(df: DataFrame, column: str, keep_null: bool = True, order: str = "count") -> DataFrame:
    """Rows per value; ``order`` is "count" (most first) or "value"."""
    counted = (df if keep_null else df.filter(F.col(column).isNotNull())).groupBy(column).agg(
        F.count("*").alias("n")
    )
    keys = [F.col("n").desc(), F.col(column)] if order == "count" else [F.col(column)]
    return counted.orderBy(*keys)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return value_counts(df, column, keep_null=False).limit(k)


def average_stored_price(df: DataFrame, by: str, price: str) -> DataFrame:
    """Mean of the price text per group, monthly prices left out, unreadable ones NULL."""
    return (
        df.filter(~F.col(price).like("%/mese%"))
        .groupBy(by)
        .agg(F.avg(numbers.stored_price(F.col(price))).alias("avg_price"))
    )


def store_summary(df: DataFrame, kind: str = "typology_name", city: str = "city",
                  price: str = "price_formatted", created: str = "created_at", cities: int = 10) -> DataFrame:
    """All store statistics from one pass, as rows (section, name, n, average_price, latest).

    Sections: ``total``, one row per ``type`` with its average price, and the ``city`` rows of the
    ``cities`` most frequent ones.
    """
    readable = F.when(~F.col(price).like("%/mese%"), numbers.stored_price(F.col(price)))
    rows = df.select(F.col(kind).alias("_kind"), F.col(city).alias("_city"), readable.alias("_price"), F.col(created).alias("_created"))
    sets = rows.groupingSets([["_kind"], ["_city"], []], "_kind", "_city").agg(
        F.grouping_id().alias("_set"), F.count("*").alias("n"), F.avg("_price").alias("_average"), F.max("_created").alias("_latest"))
    # grouping_id: 1 leaves the type, 2 the city, 3 nothing.
    section = F.when(F.col("_set") == 1, "type").when(F.col("_set") == 2, "city").otherwise("total")
    named = sets.select(section.alias("section"), F.coalesce("_kind", "_city").alias("name"), "n",
                        F.when(F.col("_set") == 1, F.col("_average")).alias("average_price"),
                        F.when(F.col("_set") == 3, F.col("_latest")).alias("latest")).filter("section = 'total' OR name IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc("n"), "name"))
    return named.withColumn("_r", place).filter((F.col("section") != "city") | (F.col("_r") <= cities)).drop("_r")


def price_favourites(df: DataFrame, price: str = "price", favourites: str = "favourites") -> DataFrame:
    """Rows with both numbers, and beside them the correlation of the two over all such rows."""
    both = df.filter(F.col(price).isNotNull() & F.col(favourites).isNotNull())
    return both.withColumn("correlation", both.agg(F.corr(price, favourites)).scalar())


def per_square_metre(price: Column, surface: Column) -> Column:
    return F.try_divide(price, surface)


def bounds(df: DataFrame, value: str) -> Column:
    """One scalar subquery: struct of n, lo, hi, mean, std of a column."""
    v = F.col(value)
    return df.agg(
        F.struct(
            F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        ).alias("s")
    ).scalar()


def histogram(df: DataFrame, value: str, bins: int = BINS) -> DataFrame:
    """(bin, n) over equal widths of [min, max]; the last bin is closed."""
    v, s = F.col(value), bounds(df, value)
    width = (s["hi"] - s["lo"]) / bins
    place = F.when(width > 0, F.least(F.floor((v - s["lo"]) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return df.filter(v.isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def gaussian_overlay(df: DataFrame, value: str, points: int = OVERLAY_POINTS, bins: int = BINS) -> DataFrame:
    """(i, x, y): normal density of the column scaled to its histogram."""
    s = bounds(df, value)
    span = s["hi"] - s["lo"]
    x = s["lo"] + span * F.col("id") / (points - 1)
    z = (F.col("x") - s["mean"]) / s["std"]
    density = F.exp(-z * z / 2) / (s["std"] * F.sqrt(F.lit(2.0) * F.pi()))
    grid = df.sparkSession.range(points, numPartitions=1)
    return grid.withColumn("x", x).select(
        F.col("id").alias("i"), "x", (density * s["n"] * span / bins).alias("y")
    )


def sigma_lines(df: DataFrame, value: str) -> DataFrame:
    """(line, value): the reference lines of the overlay."""
    c = F.col
    lines = {
        "mean": c("mean"), "median": c("median"), "mean-1s": c("mean") - c("std"),
        "mean+1s": c("mean") + c("std"), "mean+3s": c("mean") + c("std") * 3, "p25": c("p25"), "p75": c("p75"),
    }
    entries = F.array(*[F.struct(F.lit(n).alias("line"), v.alias("value")) for n, v in lines.items()])
    return summarize(df, value, {"p25": 0.25, "median": 0.5, "p75": 0.75}).select(F.inline(entries))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, type, nulls, rows), one scan for all columns, most nulls first."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("nulls"))
            for i, (c, t) in enumerate(df.dtypes)
        ]
    )
    return row.select(F.inline(entries), "rows").orderBy(F.desc("nulls"), "column")


def entry_counts(df: DataFrame, column: str, threshold: int = 1) -> DataFrame:
    """Frequency of the entries of a comma list, at least ``threshold``."""
    entries = df.select(F.explode(F.split(F.col(column), ",")).alias("e")).select(strip(F.col("e")).alias("feature"))
    return entries.groupBy("feature").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def filter_yield(df: DataFrame, test: Column) -> DataFrame:
    kept = F.count_if(test)
    return df.agg(
        kept.alias("kept"), F.count("*").alias("total"),
        F.try_divide(kept * F.lit(100.0), F.count("*")).alias("percent"),
    )


def best_by(df: DataFrame, name: str, score: str, lowest: bool = False) -> DataFrame:
    pick = F.min_by if lowest else F.max_by
    return df.agg(pick(F.struct("*"), F.struct(score, name)).alias("s")).select("s.*")
