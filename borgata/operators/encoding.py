"""The model's preparation as one fitted pipeline with sparse vectors and a name for every entry.

Categories are indexed and encoded, entries of lists are counted, numbers are filled and scaled; all
meet in one vector.  Levels are entries of the vector and not columns, so a plan has the same width
with ten levels or with millions; the fitted model holds each level's text once.

A NULL category is the level 'Unknown'; the first level in order has no entry, and neither has a level
that the fit did not see.  NULL, NaN and empty lists give no entry.  A column with a single level, or
with none, gives no entries.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer,
)
from pyspark.sql import DataFrame, functions as F

from borgata.functions import text
from borgata.operators.features import FEATURE_THRESHOLD, medians

#: Greatest vocabulary the vectoriser can be asked for: the threshold alone decides.
EVERY = 2**31 - 1


class Encoder(NamedTuple):
    """A fitted pipeline and the names of its vector's entries, in order."""

    model: PipelineModel
    names: list[str]
    output: str

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with the vector beside its columns."""
        return self.model.transform(df).select(*[F.col(_q(c)) for c in df.columns], self.output)

    def pairs(self, df: DataFrame, key: str) -> DataFrame:
        """(key, name, value) of all entries that are not zero."""
        spark = df.sparkSession
        vector = self.transform(df).select(F.col(_q(key)).alias("_key"), F.unwrap_udt(self.output).alias("v"))
        # Type 0 is sparse; a dense vector has no indices.
        at = F.when(F.col("v.type") == 0, F.col("v.indices")).when(
            F.size("v.values") > 0, F.sequence(F.lit(0), F.size("v.values") - 1)).otherwise(F.array().cast("array<int>"))
        each = vector.select("_key", F.inline(F.arrays_zip(at.alias("at"), F.col("v.values").alias("value")))).filter("value <> 0")
        names = spark.createDataFrame(list(enumerate(self.names)), "at int, name string")
        # Few names would leave their entries to a few tasks; they are no more than the model, which goes to every task.
        return each.join(F.broadcast(names), "at").select(F.col("_key").alias(key), "name", "value")


def _q(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def fit(df: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = (), listed: Sequence[str] = (),
        least: int = FEATURE_THRESHOLD, output: str = "encoded") -> Encoder:
    """Fit on ``df``: exact medians and scales, all levels, and the list entries of ``least`` rows or more.

    ``listed`` columns hold texts with commas.  All categories are indexed in one pass.
    """
    stages, inputs, names = [], [], []
    made = {f"_c{i}": f"coalesce(CAST({_q(c)} AS STRING), 'Unknown')" for i, c in enumerate(categorical)}
    made |= {f"_l{i}": f"filter(transform(split(coalesce({_q(c)}, ''), ','), x -> trim(x)), x -> x <> '')" for i, c in enumerate(listed)}
    if numeric:
        # NaN is no number to fill with, and none to scale by.
        typed = df.select(*[F.nanvl(F.col(_q(c)).cast("double"), F.lit(None)).alias(f"n{i}") for i, c in enumerate(numeric)])
        row = df.sparkSession.range(1).select(medians(typed, typed.columns).alias("m")).first()["m"]
        made |= {f"_n{i}": f"coalesce(nanvl(CAST({_q(c)} AS DOUBLE), NULL), {float(row[f'n{i}'] or 0.0)!r}D)"
                 for i, c in enumerate(numeric)}

    def grow(stage, on: DataFrame) -> DataFrame:
        fitted = stage.fit(on) if hasattr(stage, "fit") else stage
        stages.append(fitted)
        return fitted.transform(on)

    current = grow(SQLTransformer(statement="SELECT " + ", ".join(["*", *[f"{e} AS {n}" for n, e in made.items()]]) + " FROM __THIS__"), df)
    if numeric:
        current = grow(VectorAssembler(inputCols=[f"_n{i}" for i in range(len(numeric))], outputCol="_numbers"), current)
        current = grow(StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True), current)
        inputs.append("_scaled")
        names += list(numeric)
    if categorical:
        at = range(len(categorical))
        current = grow(StringIndexer(inputCols=[f"_c{i}" for i in at], outputCols=[f"_i{i}" for i in at], handleInvalid="keep",
                                     stringOrderType="alphabetAsc"), current)
        labels = stages[-1].labelsArray
        current = grow(OneHotEncoder(inputCols=[f"_i{i}" for i in at], outputCols=[f"_h{i}" for i in at], handleInvalid="keep"), current)
        for i, values in enumerate(labels):
            if len(values) > 1:
                current = grow(VectorSlicer(inputCol=f"_h{i}", outputCol=f"_v{i}", indices=list(range(1, len(values)))), current)
                inputs.append(f"_v{i}")
                names += [f"{categorical[i]}_{v}" for v in values[1:]]
    for i, _ in enumerate(listed):
        frequent = current.select(F.explode(F.array_distinct(f"_l{i}")).alias("x")).groupBy("x").count().filter(F.col("count") >= least)
        if frequent.isEmpty():
            continue
        current = grow(CountVectorizer(inputCol=f"_l{i}", outputCol=f"_w{i}", binary=True, minDF=float(least), vocabSize=EVERY), current)
        inputs.append(f"_w{i}")
        names += [text.feature_column_name(v) for v in stages[-1].vocabulary]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output))
    return Encoder(PipelineModel(stages), names, output)
