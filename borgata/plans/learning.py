"""Feature preparation and regression."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from borgata.functions import text
from borgata.operators import encoding, features, regress
from borgata.plans.base import listings, query, table, with_listings


@query("impute_median", with_listings("""
SELECT id, coalesce(price_value, (SELECT median(price_value) FROM listings)) AS price_value,
 coalesce(CAST(rooms AS DOUBLE), (SELECT median(rooms) FROM listings)) AS rooms,
 coalesce(CAST(surface_m2 AS DOUBLE), (SELECT median(surface_m2) FROM listings)) AS surface_m2,
 coalesce(typology_name, 'Unknown') AS typology_name, CASE WHEN elevator = 'TRUE' THEN 1 ELSE 0 END AS luxury FROM listings"""))
def impute_median(spark, sf):
    df = listings(spark, sf, "id", "price_value", "rooms", "surface_m2", "typology_name", "elevator")
    df = df.withColumn("luxury", F.when(F.col("elevator") == "TRUE", True)).drop("elevator")
    return features.impute(df, ["price_value", "rooms", "surface_m2"], ["typology_name"], ["luxury"])


@query("one_hot", with_listings("""
SELECT id, CAST(coalesce(typology_name, 'Unknown') = 'Attico' AS INT) AS "typology_name_Attico", CAST(coalesce(typology_name, 'Unknown') = 'Loft' AS INT) AS "typology_name_Loft",
 CAST(coalesce(typology_name, 'Unknown') = 'Unknown' AS INT) AS "typology_name_Unknown", CAST(coalesce(typology_name, 'Unknown') = 'Villa' AS INT) AS "typology_name_Villa",
 CAST(contract = 'sale' AS INT) AS contract_sale FROM listings"""))
def one_hot(spark, sf):
    df = listings(spark, sf, "id", "typology_name", "contract")
    df = features.impute(df, [], ["typology_name"])
    return features.one_hot(df, {c: features.levels(df, c) for c in ("typology_name", "contract")})


@query("standardize", """
WITH s AS (SELECT avg(l_quantity) AS qa, stddev_pop(l_quantity) AS qd, avg(l_extendedprice) AS pa, stddev_pop(l_extendedprice) AS pd FROM lineitem)
SELECT l_orderkey, l_linenumber, round((l_quantity - qa) / qd, 6) AS l_quantity, round((l_extendedprice - pa) / pd, 6) AS l_extendedprice FROM lineitem, s""")
def standardize(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    z = features.standardize(df, ["l_quantity", "l_extendedprice"])
    return z.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


def _model_frame(spark, sf):
    df = listings(spark, sf, "id", "price_value", "surface", "rooms", "bathrooms", "floor_text", "typology_name",
                  "elevator", "garage_text", "features", "city", "province")
    raw = df.withColumnsRenamed({"floor_text": "floor", "garage_text": "ga4Garage", "features": "ga4features", "province": "macrozone"})
    frame = features.model_frame(raw.withColumns({"luxury": F.col("id") % 13 == 0, "latitude": F.col("id")}))
    return frame.withColumnRenamed("latitude", "id")


_FEATURES = ["Ascensore", "Balcone", "Cantina", "Fibra ottica", "Terrazzo", "Vista mare"]


@query("feature_matrix", with_listings(r"""
SELECT id, TRY_CAST(nullif(regexp_extract(surface, '(\d+\.?\d*)', 1), '') AS DOUBLE) AS surface, CAST(rooms AS DOUBLE) AS rooms, CASE WHEN contains(lower(garage_text), 'box privato') THEN 'private box'
 WHEN contains(lower(garage_text), 'parcheggio') THEN 'common park' ELSE 'no park' END AS garage_type, province AS zone, """ + ", ".join(
    f"CAST(coalesce(list_contains(list_transform(string_split(features, ','), lambda x: trim(x)), '{f}'), false) AS INT) AS \"{text.feature_column_name(f)}\"" for f in _FEATURES) + """
FROM listings"""))
def feature_matrix(spark, sf):
    frame = _model_frame(spark, sf)
    wide = features.add_feature_columns(frame, features.frequent_features(frame))
    return wide.select("id", "surface", "rooms", "garage_type", "zone", *[c for c in wide.columns if c.startswith("has_")])


_TAGS = "list_filter(list_transform(string_split(coalesce(features, ''), ','), lambda x: trim(x)), lambda x: x <> '')"
_SCALED = " UNION ALL ".join(
    f"SELECT id, '{c}' AS name, round((coalesce({c}, m) - avg(coalesce({c}, m)) OVER ()) / stddev_samp(coalesce({c}, m)) OVER (), 6) AS value "
    f"FROM listings, (SELECT median({c}) AS m FROM listings)" for c in ("rooms", "surface_m2"))
_LEVELS = " UNION ALL ".join(
    f"SELECT id, concat('{c}_', v), 1.0 FROM (SELECT id, coalesce({c}, 'Unknown') AS v FROM listings) "
    f"WHERE v <> (SELECT min(coalesce({c}, 'Unknown')) FROM listings)" for c in ("typology_name", "contract", "city"))


@query("encoded_pairs", with_listings(f""", tags AS (SELECT id, unnest(list_distinct({_TAGS})) AS tag FROM listings),
few AS (SELECT tag FROM tags GROUP BY tag HAVING count(*) >= 100),
p AS ({_SCALED} UNION ALL {_LEVELS}
 UNION ALL SELECT id, CASE tag {" ".join(f"WHEN '{f}' THEN '{text.feature_column_name(f)}'" for f in _FEATURES)} END, 1.0 FROM tags SEMI JOIN few USING (tag))
SELECT id, name, CAST(value AS DOUBLE) AS value FROM p WHERE value <> 0"""))
def encoded_pairs(spark, sf):
    """The fitted pipeline's sparse vectors as named entries."""
    df = listings(spark, sf, "id", "rooms", "surface_m2", "typology_name", "contract", "city", "features")
    fitted = encoding.fit(df, ["rooms", "surface_m2"], ["typology_name", "contract", "city"], ["features"])
    return fitted.pairs(df, "id").withColumn("value", F.round("value", 6)).filter("value <> 0")


@query("split_counts", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1""")
def split_counts(spark, sf):
    train, test = features.split(table(spark, sf, "orders"), "o_orderkey", bucket=F.col("o_orderkey"))
    named = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return named.groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("linear_fit", """
SELECT count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept,
 round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def linear_fit(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    model = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(data)
    fit = model.summary
    return spark.range(1).select(
        F.lit(fit.numInstances).cast("long").alias("n"), F.round(F.lit(float(model.coefficients[0])), 4).alias("slope"),
        F.round(F.lit(float(model.intercept)), 2).alias("intercept"), F.round(F.lit(float(fit.r2)), 6).alias("r2"))


@query("regression_metrics", """
WITH p AS (SELECT l_suppkey % 5 AS k, l_extendedprice AS y, l_quantity * 1500 AS e FROM lineitem)
SELECT CASE WHEN k = 0 THEN 'test' ELSE 'train' END AS part, round(avg(abs(y - e)), 4) AS mae, round(sqrt(avg((y - e) * (y - e))), 4) AS rmse,
 round(1 - avg((y - e) * (y - e)) / var_pop(y), 6) AS r2 FROM p GROUP BY 1""")
def regression_metrics(spark, sf):
    scored = table(spark, sf, "lineitem").select(
        F.when(F.col("l_suppkey") % 5 == 0, "test").otherwise("train").alias("part"), "l_extendedprice",
        (F.col("l_quantity") * 1500).alias("prediction"))
    m = regress.metrics(scored, "l_extendedprice", by=["part"])
    return m.select("part", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


_SCORED = {"l_quantity": "l_quantity", "l_discount": "l_discount", "l_tax": "l_tax", "l_linenumber": "CAST(l_linenumber AS DOUBLE)",
           "is_r": "CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END", "is_open": "CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END"}


_LEVEL = """CASE WHEN k % 2 = 0 THEN (k // 2) * (b - k // 2) / ((a + k - 1) * (a + k))
 ELSE -(a + k // 2) * (a + b + k // 2) / ((a + k - 1) * (a + k)) END"""


@query("f_regression_topk", "WITH RECURSIVE r AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS feature, corr({e}, l_extendedprice) AS r, count(*) - 2 AS df FROM lineitem" for n, e in _SCORED.items())
    + f"""), s AS (SELECT feature, r * r / (1 - r * r) * df AS f, df, df / 2.0::DOUBLE AS h FROM r),
sides AS (SELECT *, df / (df + f) < (h + 1) / (h + 2.5) AS near FROM s),
fraction AS (SELECT feature, f, df, h, near, CASE WHEN near THEN h ELSE 0.5 END::DOUBLE AS a, CASE WHEN near THEN 0.5 ELSE h END::DOUBLE AS b,
 CASE WHEN near THEN df / (df + f) ELSE f / (df + f) END AS x, {regress.LEVELS} AS k, 1.0::DOUBLE AS t FROM sides
 UNION ALL SELECT feature, f, df, h, near, a, b, x, k - 1, 1 + ({_LEVEL}) * x / t FROM fraction WHERE k > 0),
p AS (SELECT feature, f, near, exp(lgamma(h + 0.5) - lgamma(h) - lgamma(0.5) + h * ln(df / (df + f)) + 0.5 * ln(f / (df + f))) / a / t AS v FROM fraction WHERE k = 0)
SELECT feature, round(f, 3) AS score, round(CASE WHEN near THEN v ELSE 1 - v END, 6) AS p_value FROM p ORDER BY score DESC, feature LIMIT 4""")
def f_regression_topk(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_extendedprice", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _SCORED.items()])
    top = regress.top_scores(df, list(_SCORED), "l_extendedprice", 4)
    return top.select("feature", F.round("score", 3).alias("score"), F.round("p_value", 6).alias("p_value"))


@query("forest_metrics")
def forest_metrics(spark, sf):
    """Random forest of the price model on line items: metrics of both parts and the importances."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber")
    names = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    data = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    train, test = features.split(data, "l_orderkey")
    forest = RandomForestRegressor(labelCol="l_extendedprice", numTrees=regress.TREES, seed=regress.SEED, featureSubsetStrategy="all")
    model = forest.fit(train)
    scored = lambda d, part: model.transform(d).select("l_extendedprice", "prediction", F.lit(part).alias("part"))
    both = scored(train, "train").unionByName(scored(test, "test"))
    m = regress.metrics(both, "l_extendedprice", by=["part"])
    long = m.select("part", F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("mae", "rmse", "r2")])))
    weights = regress.importances(spark, model, names).select(F.lit("importance").alias("part"), F.col("feature").alias("name"), F.col("importance").alias("value"))
    return long.unionByName(weights)


def _stump_sql(name, source, label):
    """CTEs: best single cut of ``label`` over the two features, and the mean on both sides of it."""
    cuts = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS cut, sum(n) OVER w AS n_left, sum(s) OVER w AS s_left, sum(n) OVER () AS n, sum(s) OVER () AS s "
        f"FROM (SELECT {f}, count(*) AS n, sum({label}) AS s FROM {source} GROUP BY {f}) WINDOW w AS (ORDER BY {f})"
        for f in ("l_linenumber", "l_discount"))
    return f"""{name}_cuts AS ({cuts}),
{name} AS (SELECT feature, cut, s_left / n_left AS low, (s - s_left) / (n - n_left) AS high FROM {name}_cuts WHERE n_left < n
 ORDER BY s_left * s_left / n_left + (s - s_left) * (s - s_left) / (n - n_left) DESC LIMIT 1)"""


def _side(name):
    return (f"CASE WHEN CASE {name}.feature WHEN 'l_linenumber' THEN l_linenumber ELSE l_discount END <= {name}.cut "
            f"THEN {name}.low ELSE {name}.high END")


_STUMP_DATA = "d AS (SELECT CAST(l_linenumber AS DOUBLE) AS l_linenumber, l_discount, l_extendedprice AS y FROM lineitem)"


def _predicted(spark, sf, estimator):
    """Mean prediction of a model of two columns, for every pair of their values."""
    names = ["l_linenumber", "l_discount"]
    df = table(spark, sf, "lineitem").select(*names, "l_extendedprice")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    scored = estimator.setLabelCol("l_extendedprice").fit(data).transform(data)
    return scored.groupBy(*names).agg(F.round(F.avg("prediction"), 4).alias("prediction"))


@query("tree_stump", f"""
WITH {_STUMP_DATA}, {_stump_sql('one', 'd', 'y')}
SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, l_discount, round({_side('one')}, 4) AS prediction FROM (SELECT DISTINCT l_linenumber, l_discount FROM d), one""")
def tree_stump(spark, sf):
    """A forest of one unsampled tree of depth one: split and leaf means have a closed form."""
    return _predicted(spark, sf, RandomForestRegressor(
        numTrees=1, maxDepth=1, maxBins=64, bootstrap=False, featureSubsetStrategy="all", seed=regress.SEED))


@query("boosted_stumps", f"""
WITH {_STUMP_DATA}, {_stump_sql('one', 'd', 'y')},
r AS (SELECT l_linenumber, l_discount, 2 * (y - {_side('one')}) AS rest FROM d, one), {_stump_sql('two', 'r', 'rest')}
SELECT CAST(l_linenumber AS INTEGER) AS l_linenumber, l_discount, round({_side('one')} + 0.1 * {_side('two')}, 4) AS prediction
FROM (SELECT DISTINCT l_linenumber, l_discount FROM d), one, two""")
def boosted_stumps(spark, sf):
    """Two boosting steps of depth one: the second fits twice the residual of the first, at a tenth."""
    return _predicted(spark, sf, GBTRegressor(maxIter=2, maxDepth=1, maxBins=64, stepSize=0.1, seed=regress.SEED))


@query("ridge_fit", """
WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my, covar_pop(l_extendedprice, l_quantity) AS c, var_pop(l_quantity) AS v FROM lineitem)
SELECT round(c * n / (v * n + 1000000), 2) AS slope, round(my - c * n / (v * n + 1000000) * mx, 0) AS intercept FROM m""")
def ridge_fit(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    model = regress.ridge(data, "l_extendedprice", alpha=1e6, tol=1e-12, maxIter=200).fit(data)
    return spark.range(1).select(F.round(F.lit(float(model.coefficients[0])), 2).alias("slope"),
                                 F.round(F.lit(float(model.intercept)), 0).alias("intercept"))
