"""Price regression with MLlib: pipelines, models, metrics, feature selection."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from borgata.functions.text import let
from borgata.operators import features as f

SEED = 42
TREES = 100
TOP_FEATURES = 20


def column_info(df: DataFrame) -> dict[str, Any]:
    """Column groups found in a frame; everything else is left out of the model."""
    have = set(df.columns)
    floor = next((c for c in ("floor_number", "floor") if c in have), None)
    return {
        "numeric_cols": [c for c in ("surface", "rooms", "bathrooms", "garage_total_count") if c in have],
        "floor_col": floor,
        "categorical_cols": [c for c in f.CATEGORICAL if c in have],
        "bool_cols": [c for c in f.FLAGS if c in have],
        "binary_features_cols": [c for c in df.columns if c.startswith("has_")],
    }


def preprocessor(df: DataFrame, info: Mapping[str, Any]) -> tuple[list, list[str]]:
    """(stages, feature names).  Fills come from ``df`` as exact medians and modes, one row each.

    One-hot keeps an unknown bucket while encoding, then a slicer drops the alphabetically first
    level, so a value not seen in training becomes all zeros.
    """
    stages: list = []
    names: list[str] = []
    inputs: list[str] = []
    read: list[tuple[str, str]] = []
    for c in info["numeric_cols"]:
        stages.append(f.NumberReader(inputCol=c, outputCol=f"n_{c}"))
        read.append((c, f"n_{c}"))
    if info["floor_col"]:
        stages.append(f.FloorReader(inputCol=info["floor_col"], outputCol="n_floor_numeric"))
        read.append(("floor_numeric", "n_floor_numeric"))
    typed = df
    for stage in stages:
        typed = stage.transform(typed)
    new: dict[str, str] = {}
    if read:
        row = df.sparkSession.range(1).select(f.medians(typed, [o for _, o in read]).alias("m")).first()["m"]
        new.update({f"f_{c}": f"coalesce({_q(o)}, {float(row[o] or 0.0)!r}D)" for c, o in read})
    binary = [*info["bool_cols"], *info["binary_features_cols"]]
    if binary:
        row = df.sparkSession.range(1).select(f.modes(df, binary).alias("m")).first()["m"]
        new.update({f"f_{c}": f"coalesce(CAST({_q(c)} AS DOUBLE), {float(row[c] or 0)!r}D)" for c in binary})
    new.update({f"c_{c}": f"coalesce(CAST({_q(c)} AS STRING), 'Unknown')" for c in info["categorical_cols"]})
    listed = ", ".join(["*", *[f"{e} AS {_q(n)}" for n, e in new.items()]])
    stages.append(SQLTransformer(statement=f"SELECT {listed} FROM __THIS__"))
    scaled = [c for c, _ in read if c != "floor_numeric"]
    if scaled:
        stages.append(VectorAssembler(inputCols=[f"f_{c}" for c in scaled], outputCol="_numeric"))
        # The scaler divides by the sample deviation; the factor to the population one is the
        # same for all columns and leaves every fitted prediction unchanged.
        stages.append(StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True))
        inputs.append("_scaled")
        names += scaled
    if info["floor_col"]:
        inputs.append("f_floor_numeric")
        names.append("floor_numeric")
    for c in info["categorical_cols"]:
        values = f.levels(df.select(F.coalesce(F.col(c).cast("string"), F.lit("Unknown")).alias(c)), c)
        if len(values) < 2:
            continue
        stages.append(StringIndexer(inputCol=f"c_{c}", outputCol=f"i_{c}", handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"i_{c}", outputCol=f"h_{c}", dropLast=True, handleInvalid="keep"))
        stages.append(VectorSlicer(inputCol=f"h_{c}", outputCol=f"v_{c}", indices=list(range(1, len(values)))))
        inputs.append(f"v_{c}")
        names += [f"{c}_{v}" for v in values[1:]]
    inputs += [f"f_{c}" for c in binary]
    names += binary
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages, names


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def ridge(df: DataFrame, label: str, alpha: float = 1.0, **params: Any) -> LinearRegression:
    """Ridge with penalty ``alpha`` on the plain squared-error sum.

    MLlib scales label and penalty, hence the factor of sample deviation over row count.
    """
    row = df.agg(F.stddev_samp(label).alias("s"), F.count(label).alias("n")).first()
    return LinearRegression(
        labelCol=label, elasticNetParam=0.0, standardization=False, solver="l-bfgs",
        regParam=alpha * row["s"] / row["n"], **params,
    )


def models(df: DataFrame, label: str = "price_value", trees: int = TREES) -> dict[str, Any]:
    """The compared models; the boosted variant uses deeper trees."""
    return {
        "Linear Regression": LinearRegression(labelCol=label),
        "Ridge Regression": ridge(df, label),
        "Random Forest": RandomForestRegressor(labelCol=label, numTrees=trees, seed=SEED, featureSubsetStrategy="all"),
        "Gradient Boosting": GBTRegressor(labelCol=label, maxIter=trees, stepSize=0.1, maxDepth=3, seed=SEED),
        "Boosted Trees": GBTRegressor(labelCol=label, maxIter=trees, stepSize=0.1, maxDepth=6, seed=SEED),
    }


def metrics(df: DataFrame, label: str, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """mae, rmse and r2 per group in one aggregation."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    return df.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"),
    )


def evaluate(fitted: Mapping[str, PipelineModel], train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """One row per model: training and test metrics."""
    parts = []
    for name, model in fitted.items():
        both = model.transform(train).select(label, "prediction", F.lit("train").alias("part")).unionByName(
            model.transform(test).select(label, "prediction", F.lit("test").alias("part"))
        )
        parts.append(metrics(both, label, by=["part"]).withColumn("name", F.lit(name)))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    picked = [
        F.max(F.when(F.col("part") == p, F.col(m))).alias(f"{p}_{m}")
        for m in ("mae", "rmse", "r2") for p in ("train", "test")
    ]
    return rows.groupBy("name").agg(*picked)


def train_all(train: DataFrame, test: DataFrame, info: Mapping[str, Any], label: str = "price_value",
              chosen: Mapping[str, Any] | None = None) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every model behind one shared, once-fitted preprocessor."""
    stages, _ = preprocessor(train, info)
    prepared = Pipeline(stages=stages).fit(train)
    base = prepared.transform(train).select("features", label).persist()
    try:
        fitted = {
            name: PipelineModel(stages=[*prepared.stages, est.fit(base)])
            for name, est in (chosen or models(train, label)).items()
        }
    finally:
        base.unpersist()
    return fitted, evaluate(fitted, train, test, label)


def compare(results: Mapping[str, DataFrame]) -> DataFrame:
    """Comparison table of several model sets."""
    rows = None
    for name, df in results.items():
        part = df.select(F.lit(name).alias("model_set"), F.col("name").alias("model_type"), "test_r2", "test_mae", "test_rmse")
        rows = part if rows is None else rows.unionByName(part)
    return rows


# --- feature selection -------------------------------------------------------------------------

def f_scores(df: DataFrame, features: Sequence[str], label: str, p_values: bool = True) -> DataFrame:
    """(feature, score, p_value): univariate F test of every feature in one pass over the data."""
    # Not corr(): it fails on a constant feature in ANSI mode, where the score is simply unknown.
    r = lambda c: F.try_divide(F.covar_pop(c, label), F.stddev_pop(c) * F.stddev_pop(label))
    one = df.agg(F.count("*").alias("n"), *[r(c).alias(f"r{i}") for i, c in enumerate(features)])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(features)])
    rows = one.select("n", F.inline(entries))
    r2 = F.col("r") * F.col("r")
    scored = rows.withColumn("score", F.try_divide(r2, 1 - r2) * (F.col("n") - 2))
    p_value = [f_survival(F.col("score"), F.col("n") - 2).alias("p_value")] if p_values else []
    return scored.select("feature", "score", *p_value)


#: Levels of the continued fraction; some dozens are enough on the side that is used.
LEVELS = 400


def f_survival(score: Column, df2: Column) -> Column:
    """P(F(1, df2) > score), by the continued fraction of the incomplete beta function, from its far end."""
    a, part = df2.cast("double") / 2, score / df2
    x = 1 / (1 + part)
    # ln Γ(a + 1/2) - ln Γ(a): the series for large arguments, sixteen steps up.
    up = a + 16
    ratio = F.log(up) / 2 - 1 / (8 * up) + 1 / (192 * up * up * up)
    for j in range(16):
        ratio = ratio + F.log(a + j) - F.log(a + j + 0.5)
    front = F.exp(ratio - a * F.log1p(part) + F.log(part / (1 + part)) / 2) / math.sqrt(math.pi)
    near, far = _beta_fraction(a, F.lit(0.5), x), _beta_fraction(F.lit(0.5), a, part / (1 + part))
    value = F.when(x < (a + 1) / (a + 2.5), front / a / near).otherwise(1 - front / 0.5 / far)
    return F.when(score.isNull() | F.isnan(score) | (df2 <= 0), None).when(score <= 0, 1.0).when(
        score == float("inf"), 0.0).otherwise(value)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """1 + d1 / (1 + d2 / (1 + ...)), folded over its levels."""

    def folded(s: Column) -> Column:
        def level(t: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (s["b"] - m) / ((s["a"] + 2 * m - 1) * (s["a"] + 2 * m))
            odd = -(s["a"] + m) * (s["a"] + s["b"] + m) / ((s["a"] + 2 * m) * (s["a"] + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) * s["x"] / t

        return F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), F.lit(1.0), level)

    return let(F.struct(a.alias("a"), b.alias("b"), x.alias("x")), folded)


def top_scores(df: DataFrame, features: Sequence[str], label: str, k: int = TOP_FEATURES, p_values: bool = True) -> DataFrame:
    return f_scores(df, features, label, p_values).orderBy(F.desc_nulls_last("score"), "feature").limit(k)


def importances(spark, model: Any, names: Sequence[str]) -> DataFrame:
    """(feature, importance), most important first; as many rows as the model has features."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


def eliminate_features(df: DataFrame, names: Sequence[str], label: str, keep: int = TOP_FEATURES,
                       trees: int = TREES, vector: str = "features") -> DataFrame:
    """Recursive elimination: drop the least important feature until ``keep`` are left.

    Rank 1 marks the kept ones.  The loop is one distributed fit per dropped feature; only feature
    numbers come back to the driver.
    """
    data = df.select(vector, label).persist()
    try:
        left, dropped = list(range(len(names))), []
        while len(left) > keep:
            cut = VectorSlicer(inputCol=vector, outputCol="_cut", indices=left).transform(data)
            forest = RandomForestRegressor(featuresCol="_cut", labelCol=label, numTrees=trees, seed=SEED,
                                           featureSubsetStrategy="all").fit(cut)
            weights = forest.featureImportances.toArray()
            worst = min(range(len(left)), key=lambda i: (weights[i], i))
            dropped.append(left.pop(worst))
    finally:
        data.unpersist()
    rows = [(names[i], True, 1) for i in left]
    rows += [(names[i], False, rank) for rank, i in enumerate(reversed(dropped), start=2)]
    return df.sparkSession.createDataFrame(rows, "feature string, selected boolean, ranking int")


def selected_columns(info: Mapping[str, Any], chosen: Sequence[str]) -> dict[str, Any]:
    """Column groups that the chosen feature names come from; one-hot names map back by prefix."""
    return {
        "numeric_cols": [c for c in info["numeric_cols"] if c in chosen],
        "floor_col": info["floor_col"] if "floor_numeric" in chosen else None,
        "categorical_cols": [c for c in info["categorical_cols"] if any(n.startswith(f"{c}_") for n in chosen)],
        "bool_cols": [c for c in info["bool_cols"] if c in chosen],
        "binary_features_cols": [c for c in info["binary_features_cols"] if c in chosen],
    }


def feature_columns(df: DataFrame, names: Sequence[str], vector: str = "features") -> DataFrame:
    """Assembled vector as one DOUBLE column per feature name."""
    values = vector_to_array(F.col(vector))
    rest = [F.col(_q(c)) for c in df.columns if c != vector]
    return df.select(*rest, *[F.get(values, F.lit(i)).alias(n) for i, n in enumerate(names)])


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
