"""Exact percentiles that never bring a whole group into one task.

The built-in exact ``percentile`` merges a value -> count map of the whole group in a single task.
Here a first pass keeps a mergeable quantile sketch of every group, with the moments.  Its error is
bounded, so it brackets each wanted percentile between two values that lie a few ranks in ten
thousand apart, however the values are spread or bunched.  A second pass counts: rows outside the
brackets collapse to one cell per gap with its count, least and greatest value, rows inside to
(value, count).  The counts give exact ranks, so the percentiles are exact.

Ranks are a prefix sum over ranges: the counted cells are dealt out by ranges of (group, value) and
written once, the counts of the ranges are added up (one row per group and range), and only the
ranges that hold a wanted rank are ordered, each in its own task.  No task orders a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from borgata.session import scratch_dir

#: A sketch's rank error is one in so many; a bracket reaches three times as far on both sides.
ACCURACY = 10_000
MOMENTS = ("n", "mean", "min", "max", "std")


def _wanted(fractions: Sequence[float]) -> list[tuple[Column, Column, Column]]:
    """Per fraction the ranks (from 0) on both sides of it and the weight between them."""
    spots = [F.lit(float(p)) * (F.col("n") - 1) for p in fractions]
    return [(F.floor(s), F.ceil(s), s - F.floor(s)) for s in spots]


def _holds(rank: Column) -> Column:
    return (F.col("_start") <= rank) & (rank < F.col("_end"))


def _ranked(cells: DataFrame, keys: Sequence[str], fractions: Sequence[float], parts: int | None) -> DataFrame:
    """The cells of the ranges that hold a wanted rank, each with its ranks [_start, _end)."""
    spark = cells.sparkSession
    # Written once: sums and cells must see the same ranges, also after a lost executor.
    path = scratch_dir(spark, "cells")
    dealt = cells.repartitionByRange(*([parts] if parts else []), *keys, "_low")
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    group = list(keys) or [F.lit(0)]
    sums = cut.groupBy(*keys, "_range").agg(F.sum("_c").alias("_sum"), F.max("n").alias("n"))
    upto = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    spans = sums.withColumn("_end", F.sum("_sum").over(upto)).withColumn("_start", F.col("_end") - F.col("_sum"))
    wanted = F.lit(False)
    for low, high, _ in _wanted(fractions):
        wanted = wanted | _holds(low) | _holds(high)
    spans = spans.filter(wanted).select(
        *[F.col(k).alias(f"_j{k}") for k in keys], F.col("_range").alias("_j_range"), F.col("_start").alias("_base"))
    same = [F.col(k).eqNullSafe(F.col(f"_j{k}")) for k in keys] + [F.col("_range") == F.col("_j_range")]
    inside = Window.partitionBy(*keys, "_range").orderBy("_low").rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(spans, same)
        .withColumn("_end", F.col("_base") + F.sum("_c").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )


def _placed(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str],
            moments: Sequence[str] = ("n",), accuracy: int = ACCURACY, parts: int | None = None) -> DataFrame:
    """One row per group with values: keys _k0.., the moments asked for, and per fraction the two
    neighbours of its rank and the weight between them (_a0, _z0, _w0, ...).  ``parts`` (default the
    shuffle partitions) changes how the work is cut, never the result."""
    v = F.col(value).cast("double")
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(v)).select(
        *[F.col(c).alias(k) for c, k in zip(by, keys)], v.alias("_v")
    )
    reach = 3 / accuracy
    ends = [min(1.0, max(0.0, float(p) + side)) for p in fractions for side in (-reach, reach)]
    summary = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.stddev_samp("_v").alias("std"), F.percentile_approx("_v", ends, accuracy).alias("_q"),
    )
    if by:
        named = summary.withColumnsRenamed({k: f"_j{k}" for k in keys})
        same = [rows[k].eqNullSafe(named[f"_j{k}"]) for k in keys]
        marked = rows.join(named, same)
    else:
        marked = rows.withColumn("_s", summary.select(F.struct("*")).scalar()).select("_v", "_s.*")
    pairs = [(F.get("_q", F.lit(2 * i)), F.get("_q", F.lit(2 * i + 1))) for i in range(len(fractions))]
    inside, passed = F.lit(False), F.lit(0)
    for low, high in pairs:
        inside = inside | F.col("_v").between(low, high)
        passed = passed + (F.col("_v") > high).cast("int")
    cells = marked.groupBy(*keys, passed.alias("_gap"), F.when(inside, F.col("_v")).alias("_in")).agg(
        F.count("*").alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"),
        *[F.max(m).alias(m) for m in moments],
    )
    ranked = _ranked(cells, keys, fractions, parts)
    out = [F.max(m).alias(m) for m in moments]
    for i, (floor, ceil, weight) in enumerate(_wanted(fractions)):
        for name, rank in ((f"_a{i}", floor), (f"_z{i}", ceil)):
            at = (
                F.when(F.col("_in").isNotNull() | (rank == F.col("_start")), F.col("_low"))
                .when(rank == F.col("_end") - 1, F.col("_high"))
                .otherwise(F.raise_error(F.lit("a rank outside its bracket")).cast("double"))
            )
            out.append(F.max(F.when(_holds(rank), at)).alias(name))
        out.append(F.max(weight).alias(f"_w{i}"))
    return ranked.groupBy(*keys).agg(*out).filter("n IS NOT NULL")


def _value(i: int) -> Column:
    low, high = F.col(f"_a{i}"), F.col(f"_z{i}")
    return low + (high - low) * F.col(f"_w{i}")


def _keys(by: Sequence[str]) -> list[Column]:
    return [F.col(f"_k{i}").alias(k) for i, k in enumerate(by)]


def exact_percentiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., fraction, value) with linear interpolation; NULL and NaN values are left out."""
    rows = _placed(df, value, fractions, by)
    each = F.array(*[F.struct(F.lit(float(p)).alias("fraction"), _value(i).alias("value")) for i, p in enumerate(fractions)])
    return rows.select(*_keys(by), F.inline(each))


def wide_percentiles(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """One row per group with one column per named fraction; without groups always one row."""
    rows = _placed(df, value, list(named.values()), by)
    rows = rows.select(*_keys(by), *[_value(i).alias(n) for i, n in enumerate(named)])
    return rows if by else rows.agg(*[F.max(n).alias(n) for n in named])


def summarize(df: DataFrame, value: str, named: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, min, max, sample standard deviation and named percentiles per group, from the
    same two passes as the percentiles alone.  Groups without a value give no row."""
    rows = _placed(df, value, list(named.values()), by, MOMENTS)
    return rows.select(*_keys(by), *MOMENTS, *[_value(i).alias(n) for i, n in enumerate(named)])
