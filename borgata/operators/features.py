"""Feature preparation: imputation, one-hot, scaling, feature columns, split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from borgata.functions import floors, garage, numbers, text
from borgata.operators.quantiles import exact_percentiles
from borgata.operators.stats import entry_counts

MAX_LEVELS = 10_000

# Thresholds and column lists of the price model.
MIN_OCCURRENCES = {"default": 20, "city": 40, "zone": 15, "typology_name": 10,
                   "garage_type": 25, "garage_primary_type": 25}
FEATURE_THRESHOLD = 100
TYPOLOGIES = ["Appartamento", "Attico"]
MODEL_COLUMNS = ["price_value", "surface", "rooms", "bathrooms", "floor", "typology_name", "elevator",
                 "ga4Heating", "ga4Garage", "ga4features", "latitude", "longitude", "city", "macrozone",
                 "zone", "isNew", "luxury"]
NUMERIC = ["surface", "rooms", "bathrooms", "garage_total_count", "floor_numeric"]
CATEGORICAL = ["typology_name", "city", "zone", "elevator", "ga4Heating", "garage_type", "garage_primary_type"]
FLAGS = ["isNew", "luxury"]


class _OneColumn(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _expression(self, c: Column) -> Column:
        raise NotImplementedError

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), self._expression(F.col(self.getInputCol())))


class NumberReader(_OneColumn):
    """First number of a text as DOUBLE; numbers pass through."""

    def _expression(self, c: Column) -> Column:
        return numbers.first_number(c.cast("string"))


class FloorReader(_OneColumn):
    """Floor text as DOUBLE."""

    def _expression(self, c: Column) -> Column:
        return floors.normalize_floor(c.cast("string"))


def model_frame(df: DataFrame) -> DataFrame:
    """Typed model columns: numbers read from text, floor, garage; sources dropped."""
    for target, source in {"zone": "macrozone"}.items():
        if target not in df.columns and source in df.columns:
            df = df.withColumn(target, F.col(source))
    df = df.select(*[c for c in MODEL_COLUMNS if c in df.columns])
    out = {c: numbers.first_number(F.col(c).cast("string")) for c in ("surface", "rooms", "bathrooms") if c in df.columns}
    if "floor" in df.columns:
        out["floor_numeric"] = floors.normalize_floor(F.col("floor"))
    if "ga4Garage" in df.columns:
        out["garage_type"] = garage.garage_type(F.col("ga4Garage"))
        out["garage_primary_type"] = garage.garage_details(F.col("ga4Garage"))["primary_type"]
        out["garage_total_count"] = garage.garage_details(F.col("ga4Garage"))["total_count"].cast("double")
    return df.withColumns(out).drop("floor", "ga4Garage")


def levels(df: DataFrame, column: str, at_most: int = MAX_LEVELS) -> list[str]:
    """Distinct values in order.  They become columns, so more than ``at_most`` is an error,
    never a silent cut."""
    found = [r[0] for r in df.select(column).filter(F.col(column).isNotNull()).distinct().limit(at_most + 1).collect()]
    if len(found) > at_most:
        raise ValueError(f"{column} has more than {at_most} values; filter rare ones first")
    return sorted(found)


def frequent_features(df: DataFrame, column: str = "ga4features", threshold: int = FEATURE_THRESHOLD,
                      at_most: int = MAX_LEVELS) -> list[str]:
    rows = entry_counts(df, column, threshold).orderBy(F.desc("n"), "feature").limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"more than {at_most} features reach the threshold; raise it")
    return [r["feature"] for r in rows]


def add_feature_columns(df: DataFrame, features: Sequence[str], column: str = "ga4features") -> DataFrame:
    return df.withColumns(
        {text.feature_column_name(f): text.has_feature(F.col(column), f) for f in features}
    ).drop(column)


def medians(df: DataFrame, columns: Sequence[str]) -> Column:
    """Exact medians of many columns from one job, as a scalar subquery struct."""
    stacked = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns]))
    )
    rows = exact_percentiles(stacked, "v", [0.5], ["c"])
    wide = rows.agg(*[F.max(F.when(F.col("c") == c, F.col("value"))).alias(c) for c in columns])
    return wide.select(F.struct(*columns).alias("m")).scalar()


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), flag: Sequence[str] = (),
           target: str | None = None) -> DataFrame:
    """Median for numbers, 'Unknown' for categories, 0 for flags; rows without a target go.

    As in the model this prepares for, medians are taken before rows without a target are dropped.
    """
    out: dict[str, Column] = {}
    if numeric:
        middle = medians(df, numeric)
        out.update({c: F.coalesce(F.col(c).cast("double"), middle[c]) for c in numeric})
    out.update({c: F.coalesce(F.col(c).cast("string"), F.lit("Unknown")) for c in categorical})
    out.update({c: F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flag})
    done = df.withColumns(out)
    return done if target is None else done.filter(F.col(target).isNotNull())


def modes(df: DataFrame, columns: Sequence[str]) -> Column:
    """Most frequent value per column, the smallest on ties, as a scalar subquery struct."""
    stacked = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("int").alias("v")) for c in columns]))
    ).filter("v is not null")
    best = stacked.groupBy("c", "v").agg(F.count("*").alias("n")).groupBy("c").agg(
        F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("v")
    )
    wide = best.agg(*[F.max(F.when(F.col("c") == c, F.col("v"))).alias(c) for c in columns])
    return wide.select(F.struct(*columns).alias("m")).scalar()


def one_hot(df: DataFrame, columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns per level but the first in order; an unknown value gives zeros everywhere."""
    hot = {
        f"{c}_{level}": F.coalesce((F.col(c) == level).cast("int"), F.lit(0))
        for c, values in columns.items()
        for level in sorted(values)[1:]
    }
    return df.withColumns(hot).drop(*columns)


def standardize(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """(x - mean) / population standard deviation of ``fit_on``; constant columns are only centred."""
    base = df if fit_on is None else fit_on
    s = base.agg(
        F.struct(
            *[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"d_{c}") for c in columns]
        ).alias("s")
    ).scalar()
    scaled = {
        c: (F.col(c) - s[f"a_{c}"]) / F.when(s[f"d_{c}"] > 0, s[f"d_{c}"]).otherwise(F.lit(1.0)) for c in columns
    }
    return df.withColumns(scaled)


def split(df: DataFrame, key: str, parts: int = 5, bucket: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Train and test (one part in ``parts``) by key: the same rows again whatever the
    partitioning.  ``bucket`` replaces the key hash."""
    held_out = F.pmod(F.xxhash64(key) if bucket is None else bucket, F.lit(parts)) == 0
    return df.filter(~held_out), df.filter(held_out)
