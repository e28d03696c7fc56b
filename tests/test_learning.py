"""Feature preparation and regression."""

import math
import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from borgata.operators import features, regress


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        m2 = int(rng.integers(30, 150))
        city = ["Genova", "Savona", "Albenga"][i % 3]
        price = 1000.0 * m2 + {"Genova": 50000, "Savona": 20000, "Albenga": 0}[city] + float(rng.normal(0, 3000))
        rows.append((i, None if i % 40 == 7 else price, None if i % 15 == 0 else f"{m2} m²", str(1 + i % 5), str(1 + i % 2),
                     ["3", "piano terra", "da 2 a 5", None][i % 4], "Appartamento", city, None if i % 20 == 0 else "Sì",
                     ["1 in box privato", None][i % 2], "Balcone, Ascensore" if i % 2 else "Cantina", i % 9 == 0, None if i % 6 == 0 else False))
    return spark.createDataFrame(rows, "id long, price_value double, surface string, rooms string, bathrooms string, floor string, "
                                 "typology_name string, city string, elevator string, ga4Garage string, ga4features string, isNew boolean, luxury boolean")


def test_model_frame_and_matrix(homes):
    frame = features.model_frame(homes)
    assert "id" not in frame.columns and "floor" not in frame.columns and "ga4Garage" not in frame.columns
    row = frame.filter("garage_total_count > 0").first()
    assert row["garage_type"] == "private box" and row["garage_primary_type"] == "private_box"
    wide = features.add_feature_columns(frame, features.frequent_features(frame, threshold=100))
    assert {c for c in wide.columns if c.startswith("has_")} == {"has_balcone", "has_ascensore", "has_cantina"}
    assert wide.agg(F.sum("has_cantina")).first()[0] == 120
    done = features.impute(wide, ["surface", "floor_numeric"], ["city", "elevator"], ["isNew", "luxury"], target="price_value")
    assert done.count() == homes.filter("price_value IS NOT NULL").count()
    assert done.filter("surface IS NULL OR elevator IS NULL OR luxury IS NULL").count() == 0
    med = np.median([float(r["surface"].split()[0]) for r in homes.collect() if r["surface"]])
    got = features.impute(frame, ["surface"]).filter(F.col("surface") == float(med)).count()
    assert got >= 16


def test_one_hot_drops_first_and_zeroes_unknown(spark):
    df = spark.createDataFrame([("b",), ("a",), ("new",), (None,)], "c string").coalesce(1)
    out = features.one_hot(df, {"c": ["b", "a"]})
    assert out.columns == ["c_b"] and [r[0] for r in out.collect()] == [1, 0, 0, 0]


def test_levels_never_cut(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    assert len(features.levels(df, "c")) == 20
    with pytest.raises(ValueError):
        features.levels(df, "c", at_most=10)
    with pytest.raises(ValueError):
        features.frequent_features(df, "c", threshold=1, at_most=5)


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double").coalesce(1)
    assert [tuple(r) for r in features.standardize(df, ["x", "k"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_is_stable(spark):
    df = spark.range(1000)
    first = {r["id"] for r in features.split(df, "id")[1].collect()}
    again = {r["id"] for r in features.split(df.repartition(9), "id")[1].collect()}
    assert first == again and 120 < len(first) < 280
    train, test = features.split(df, "id")
    assert train.count() + test.count() == 1000


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 10, 100]
    y = x @ [3.0, -2.0, 0.5] + 7 + rng.normal(size=300)
    df = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y)], "a double, b double, c double, y double")
    data = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = regress.ridge(data, "y", 50.0, tol=1e-12, maxIter=500).fit(data)
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(model.coefficients.toArray(), np.linalg.solve(xc.T @ xc + 50 * np.eye(3), xc.T @ yc), atol=1e-4)


def test_metrics_and_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 5.0)], "y double, prediction double")
    m = regress.metrics(df, "y").first()
    assert m["mae"] == pytest.approx(2 / 3) and m["rmse"] == pytest.approx((2 / 3) ** 0.5) and m["r2"] == pytest.approx(1 - 2 / 14)
    rng = np.random.default_rng(2)
    x = rng.normal(size=80)
    y = x + rng.normal(size=80)
    sdf = spark.createDataFrame([(float(a), float(rng.normal()), 1.0, float(b)) for a, b in zip(x, y)], "a double, noise double, k double, y double")
    rows = regress.top_scores(sdf, ["a", "noise", "k"], "y", 2).collect()
    r = np.corrcoef(x, y)[0, 1]
    assert rows[0]["feature"] == "a" and rows[0]["score"] == pytest.approx(r * r / (1 - r * r) * 78)
    assert rows[0]["p_value"] < 1e-6 < rows[1]["p_value"] <= 1


def test_f_survival(spark):
    """Table values, tails, and t distributions whose tails are known in closed form (1 and 2 degrees)."""
    table = [(4.0, 10, 0.07339), (161.4476, 1, 0.05), (6.635, 10_000_000, 0.01), (0.0, 5, 1.0), (3.841459, 10**12, 0.05), (1e-9, 3, 1.0), (1e9, 60, 0.0)]
    table += [(t * t, 1, 1 - 2 / math.pi * math.atan(t)) for t in (0.01, 0.5, 1.7, 3.0, 40.0)]
    table += [(t * t, 2, 1 - t / math.sqrt(2 + t * t)) for t in (0.01, 0.5, 1.7, 3.0, 40.0)]
    rows = [(i, f, d) for i, (f, d, _) in enumerate(table)] + [(100, None, 5), (101, float("nan"), 5), (102, 1.0, 0), (103, float("inf"), 5)]
    df = spark.createDataFrame(rows, "i int, f double, d long").select("i", regress.f_survival(F.col("f"), F.col("d")).alias("p"))
    got = {r["i"]: r["p"] for r in df.collect()}
    assert [got[k] for k in (100, 101, 102, 103)] == [None, None, None, 0.0]
    for i, (_, d, p) in enumerate(table):
        assert got[i] == pytest.approx(p, rel=1e-9 if d < 3 else 2e-3, abs=1e-7)


def test_pipeline_selection_and_reload(spark, homes, tmp_path):
    frame = homes.filter("price_value IS NOT NULL")
    frame = features.add_feature_columns(frame, ["Balcone"])
    train, test = features.split(frame, "id")
    info = regress.column_info(frame)
    assert info["floor_col"] == "floor" and info["binary_features_cols"] == ["has_balcone"]
    stages, names = regress.preprocessor(train, info)
    prepared = Pipeline(stages=stages).fit(train)
    wide = regress.feature_columns(prepared.transform(train).select("id", "features"), names)
    assert names[:3] == ["surface", "rooms", "bathrooms"] and "city_Genova" in names and "city_Albenga" not in names
    one = wide.join(train.select("id", "city"), "id").filter("city = 'Savona'").first()
    assert one["city_Savona"] == 1.0 and one["city_Genova"] == 0.0
    # A city not seen in training becomes zeros.
    strange = regress.feature_columns(prepared.transform(test.withColumn("city", F.lit("Roma"))).select("features"), names).first()
    assert strange["city_Savona"] == 0.0 and strange["city_Genova"] == 0.0

    chosen = {n: m for n, m in regress.models(train, trees=5).items() if n in ("Linear Regression", "Random Forest")}
    fitted, scores = regress.train_all(train, test, info, chosen=chosen)
    table = {r["name"]: r for r in scores.collect()}
    assert table["Linear Regression"]["test_r2"] > 0.9 and set(table) == set(chosen)
    best = regress.compare({"all": scores}).orderBy(F.desc("test_r2")).first()
    assert best["model_set"] == "all" and best["model_type"] == "Linear Regression"

    regress.save_model(fitted["Linear Regression"], str(tmp_path / "m"))
    again = regress.load_model(str(tmp_path / "m"))
    assert isinstance(again, PipelineModel)
    a = [r[0] for r in fitted["Linear Regression"].transform(test).orderBy("id").select("prediction").collect()]
    assert a == [r[0] for r in again.transform(test).orderBy("id").select("prediction").collect()]

    data = prepared.transform(train)
    ranked = regress.eliminate_features(data, names, "price_value", keep=len(names) - 1, trees=2)
    assert ranked.filter("selected").count() == len(names) - 1 and ranked.agg(F.max("ranking")).first()[0] == 2
    weights = regress.importances(spark, fitted["Random Forest"].stages[-1], names).collect()
    assert weights[0]["feature"] == "surface" and len(weights) == len(names)

    small = regress.selected_columns(info, ["surface", "city_Genova", "floor_numeric"])
    assert small == {"numeric_cols": ["surface"], "floor_col": "floor", "categorical_cols": ["city"], "bool_cols": [], "binary_features_cols": []}
    _, picked = regress.preprocessor(train, small)
    assert picked == ["surface", "floor_numeric", "city_Genova", "city_Savona"]
