"""The preparation pipeline with sparse vectors and named entries."""

import pytest
from pyspark.ml import PipelineModel

from borgata.operators import encoding

SCHEMA = "id long, n double, kind string, tags string"
ROWS = [(1, 1.0, "b", "x, y,x"), (2, None, "a", ""), (3, 3.0, None, "y,,"), (4, float("nan"), "c", None), (5, 5.0, "b", " y ")]


@pytest.fixture(scope="module")
def fitted(spark):
    return encoding.fit(spark.createDataFrame(ROWS, SCHEMA), ["n"], ["kind"], ["tags"], least=2)


def _pairs(encoder, df):
    return sorted((r["id"], r["name"], round(r["value"], 6)) for r in encoder.pairs(df, "id").collect())


def test_names_and_values(table, fitted):
    assert fitted.names == ["n", "kind_a", "kind_b", "kind_c", "has_y"]
    # Median 3 fills two rows; mean 3, sample deviation sqrt(2).
    step = round(2 / 2**0.5, 6)
    assert _pairs(fitted, table(ROWS, SCHEMA)) == [
        (1, "has_y", 1.0), (1, "kind_b", 1.0), (1, "n", -step), (2, "kind_a", 1.0), (3, "has_y", 1.0), (4, "kind_c", 1.0),
        (5, "has_y", 1.0), (5, "kind_b", 1.0), (5, "n", step)]


def test_levels_not_seen_and_empty_rows(table, fitted):
    new = [(9, 3.0, "new", "z"), (10, None, None, None)]
    assert _pairs(fitted, table(new, SCHEMA)) == []
    assert _pairs(fitted, table([], SCHEMA)) == []


def test_columns_stay_and_the_model_reloads(spark, table, fitted, tmp_path):
    df = table(ROWS, SCHEMA)
    assert fitted.transform(df).columns == [*df.columns, "encoded"]
    fitted.model.write().save(str(tmp_path / "model"))
    again = encoding.Encoder(PipelineModel.load(str(tmp_path / "model")), fitted.names, "encoded")
    assert _pairs(again, df) == _pairs(fitted, df)


def test_more_levels_than_columns_allow(spark):
    from pyspark.sql import functions as F

    df = spark.range(12_000).select("id", F.format_string("k%05d", "id").alias("kind"))
    encoder = encoding.fit(df, categorical=["kind"])
    assert len(encoder.names) == 11_999
    pairs = encoder.pairs(df, "id")
    assert pairs.count() == 11_999 and pairs.filter(F.col("name") != F.format_string("kind_k%05d", "id")).count() == 0
