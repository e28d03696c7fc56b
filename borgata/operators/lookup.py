"""Dimension lookups: exact, fuzzy, zones, distances, detail over preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from borgata.functions import geo
from borgata.functions.text import strip, tokens, zone_key
from borgata.operators.store import keep_first


def lookup_key(c: Column) -> Column:
    return strip(F.lower(c))


def exact_lookup(queries: DataFrame, cities: DataFrame, query: str = "query") -> DataFrame:
    """City by key, else by name.  ``cities``: city_key (unique), city_id, city_name, dim_ord.

    No broadcast hint: Catalyst broadcasts the dimension while it is below the threshold and joins
    by sort-merge with skew splitting beyond it.
    """
    names = keep_first(cities, [F.lower("city_name")], "dim_ord")
    by_key = cities.select(F.col("city_key").alias("_k1"), F.col("city_id").alias("_id1"), F.col("city_name").alias("_n1"))
    by_name = names.select(F.lower("city_name").alias("_k2"), F.col("city_id").alias("_id2"), F.col("city_name").alias("_n2"))
    q = queries.withColumn("_q", lookup_key(F.col(query)))
    return (
        q.join(by_key, F.col("_q") == F.col("_k1"), "left")
        .join(by_name, F.col("_q") == F.col("_k2"), "left")
        .select(
            *[F.col(c) for c in queries.columns],
            F.coalesce("_id1", "_id2").alias("city_id"),
            F.when(F.col("_k1").isNotNull(), F.col("_n1")).otherwise(F.col("_n2")).alias("city_name"),
        )
    )


def _substrings(c: Column, longest: Column) -> Column:
    """Distinct substrings of a word, at most ``longest`` characters each."""
    size = F.length(c)
    starts = F.sequence(F.lit(1), size)
    return F.array_distinct(
        F.flatten(
            F.transform(
                starts,
                lambda i: F.transform(
                    F.sequence(F.lit(1), F.least(size - i + 1, longest)), lambda n: F.substr(c, i, n)
                ),
            )
        )
    )


def _word_counts(df: DataFrame, key: str, words: Column) -> DataFrame:
    return df.select(key, F.explode(words).alias("_t")).groupBy(key, "_t").agg(F.count("*").alias("_c"))


def fuzzy_scores(queries: DataFrame, cities: DataFrame, query: str = "query", rank: str = "dim_ord") -> DataFrame:
    """(_q, best city, score) per distinct normalised query with a score above 0.

    The score counts pairs of words where one contains the other.  "a is inside b" is the same as
    "a equals a substring of b", so the pairs come from two equi-joins on distinct words; the rows
    of the queries never meet the dimension.
    """
    distinct_queries = queries.select(lookup_key(F.col(query)).alias("_q")).filter("_q is not null").distinct()
    q_words = _word_counts(distinct_queries, "_q", tokens(F.col("_q"))).withColumnsRenamed({"_t": "_qt", "_c": "_qc"})
    c_words = _word_counts(cities, "city_key", tokens(F.col("city_key"))).withColumnsRenamed({"_t": "_ct", "_c": "_cc"})
    qt, ct = q_words.select("_qt").distinct(), c_words.select("_ct").distinct()
    longest = ct.agg(F.max(F.length("_ct"))).scalar()
    query_in_city = ct.select("_ct", F.explode(_substrings(F.col("_ct"), F.length("_ct"))).alias("_qt")).join(qt, "_qt")
    # No substring of a query word longer than the longest city word can equal one.
    limited = qt.withColumn("_len", longest)
    city_in_query = limited.select("_qt", F.explode(_substrings(F.col("_qt"), F.col("_len"))).alias("_ct")).join(ct, "_ct")
    pairs = query_in_city.select("_qt", "_ct").union(city_in_query.select("_qt", "_ct")).distinct()
    # What each query word adds to each city, and its best city: per distinct word, not per query.
    share = pairs.join(c_words, "_ct").groupBy("_qt", "city_key").agg(F.sum("_cc").alias("_v"))
    share = share.join(cities.select("city_key", F.col(rank).alias("_rank")), "city_key")
    best = F.max_by("city_key", F.struct(F.col("_v"), -F.col("_rank")))
    words = q_words.join(share.groupBy("_qt").agg(F.max("_v").alias("_most"), F.count("*").alias("_cities"), best.alias("_top")), "_qt")
    candidates = _candidates(words, share)
    scored = (
        candidates.join(words.select("_q", "_qt", "_qc"), "_q")
        .join(share.select("_qt", "city_key", "_v"), ["_qt", "city_key"])
        .groupBy("_q", "city_key")
        .agg(F.sum(F.col("_qc") * F.col("_v")).alias("score"))
    )
    ranked = scored.join(cities, "city_key")
    best = F.max_by(F.struct("city_key", "city_id", "city_name", "score"), F.struct(F.col("score"), -F.col(rank)))
    return ranked.groupBy("_q").agg(best.alias("_b")).select("_q", "_b.*")


def _candidates(words: DataFrame, share: DataFrame) -> DataFrame:
    """(_q, city_key): the cities that can be a query's best.

    A query's words stand by the number of cities they fit, rarest first.  The exact score of the rarest word's
    best city is a score to beat.  A city whose rarest fitting word is the i-th scores at most what that
    word gives it and the most that the later words give any city, so it is a candidate only where that
    reaches the score.  Of the cities that only the commonest word fits, its best city beats all others.  So a
    word that fits nearly every city costs a query one row.
    """
    order = Window.partitionBy("_q").orderBy("_cities", "_qt")
    placed = words.select(
        "*", F.row_number().over(order).alias("_i"), F.count("*").over(Window.partitionBy("_q")).alias("_n"),
        F.coalesce(F.sum(F.col("_qc") * F.col("_most")).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).alias("_later"))
    probe = placed.filter("_i = 1").select("_q", F.col("_top").alias("city_key"))
    known = (
        probe.join(words.select("_q", "_qt", "_qc"), "_q")
        .join(share.select("_qt", "city_key", "_v"), ["_qt", "city_key"])
        .groupBy("_q").agg(F.sum(F.col("_qc") * F.col("_v")).alias("_score"))
    )
    rare = placed.filter("_i < _n").join(known, "_q").select(
        "_q", "_qt", F.ceil((F.col("_score") - F.col("_later")) / F.col("_qc")).alias("_least"))
    reached = rare.join(share, (rare["_qt"] == share["_qt"]) & (F.col("_v") >= F.col("_least"))).select("_q", "city_key")
    return probe.union(placed.filter("_i = _n").select("_q", "_top")).union(reached).distinct()


def fuzzy_lookup(queries: DataFrame, cities: DataFrame, query: str = "query") -> DataFrame:
    """Every query row with its best city, the first in ``dim_ord`` on ties; NULL when none fits."""
    best = fuzzy_scores(queries, cities, query)
    keyed = queries.withColumn("_q", lookup_key(F.col(query)))
    return keyed.join(best, "_q", "left").drop("_q")


def resolve_zones(requests: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct matches, unmatched requests) of (city_key, zone_name) against
    (city_key, zone_key, zone_id)."""
    wanted = requests.select(
        F.lower("city_key").alias("city_key"), F.lower("zone_name").alias("zone_key")
    ).distinct()
    dim = zones.select("city_key", "zone_key", "zone_id")
    found = wanted.join(dim, ["city_key", "zone_key"]).distinct()
    return found, wanted.join(dim, ["city_key", "zone_key"], "left_anti")


def zone_rows(entries: DataFrame) -> DataFrame:
    """Usable zone entries: type 3 with id and label, and a first type-2 parent with id and label."""
    city = F.get(F.filter("parents", lambda p: p["type"] == 2), F.lit(0))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        entries.filter((F.col("type") == 3) & filled(F.col("id")) & filled(F.col("label")))
        .withColumn("_city", city)
        .filter(filled(F.col("_city.id")) & filled(F.col("_city.label")))
        .select(
            F.lower(F.coalesce("_city.keyurl", F.lit(""))).alias("city_key"),
            F.col("_city.id").alias("city_id"), F.col("_city.label").alias("city_name"),
            zone_key(F.col("keyurl")).alias("zone_key"), F.col("id").alias("zone_id"),
            F.col("label").alias("zone_name"), "ingest_seq",
        )
    )


def upsert_zones(entries: DataFrame, cities: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cities, zones) after adding the unknown ones; known keys are never changed."""
    rows = zone_rows(entries)
    fresh_cities = keep_first(rows, ["city_key"]).join(cities.select("city_key"), "city_key", "left_anti").select(
        "city_key", "city_id", "city_name", F.concat(F.lit("/"), F.col("city_key"), F.lit("/")).alias("path")
    )
    keys = ["city_key", "zone_key"]
    fresh_zones = keep_first(rows, keys).join(zones.select(*keys), keys, "left_anti").select(*keys, "zone_id", "zone_name")
    return (
        cities.unionByName(fresh_cities, allowMissingColumns=True),
        zones.unionByName(fresh_zones, allowMissingColumns=True),
    )


def explode_dimension(df: DataFrame, column: str = "cities") -> DataFrame:
    """Map city -> {idComune, name, path, macrozones} as one row per zone (one row if none)."""
    city = df.select(F.explode(column).alias("city_key", "c"))
    return city.select(
        "city_key", F.col("c.idComune").alias("city_id"), F.col("c.name").alias("city_name"),
        F.col("c.path").alias("path"), F.explode_outer("c.macrozones").alias("zone_key", "z"),
    ).select("city_key", "city_id", "city_name", "path", "zone_key",
             F.col("z.id").alias("zone_id"), F.col("z.name").alias("zone_name"))


def rebuild_dimension(rows: DataFrame) -> DataFrame:
    """Inverse of ``explode_dimension``: one row per city with its zones as a map."""
    zone = F.struct(F.col("zone_id").alias("id"), F.col("zone_name").alias("name"))
    entry = F.when(F.col("zone_key").isNotNull(), F.struct(F.col("zone_key").alias("k"), zone.alias("v")))
    return rows.groupBy("city_key", "city_id", "city_name", "path").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("macrozones")
    )


def dimension_contract(rows: DataFrame) -> DataFrame:
    """Missing required values of both levels; all zero when the dimension is sound."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    has_zone = F.col("zone_key").isNotNull()
    return rows.agg(
        missing("city_id").alias("missing_city_id"), missing("city_name").alias("missing_city_name"),
        missing("path").alias("missing_path"),
        F.count_if(has_zone & F.col("zone_id").isNull()).alias("missing_zone_id"),
        F.count_if(has_zone & F.col("zone_name").isNull()).alias("missing_zone_name"),
    )


def leg_distances(legs: DataFrame, places: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Great-circle km between two looked-up places; an unknown code gives NULL.

    ``places``: code, lat, lng.
    """
    side = lambda p: places.select(F.col("code").alias(f"_{p}"), F.col("lat").alias(f"_{p}lat"), F.col("lng").alias(f"_{p}lng"))
    both = legs.join(side("a"), F.col(origin) == F.col("_a"), "left").join(side("b"), F.col(destination) == F.col("_b"), "left")
    km = geo.haversine_km(F.col("_alat"), F.col("_alng"), F.col("_blat"), F.col("_blng"))
    return both.select(*[F.col(c) for c in legs.columns], km.alias("km"))


def unknown_places(legs: DataFrame, places: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """(code, role, legs): the reject side of ``leg_distances``, codes that no place has."""
    named = F.array(*[F.struct(F.col(c).alias("code"), F.lit(r).alias("role")) for c, r in ((origin, "origin"), (destination, "destination"))])
    counted = legs.select(F.inline(named)).groupBy("code", "role").agg(F.count("*").alias("legs"))
    return counted.join(places.select("code"), "code", "left_anti")


def detail_over_preview(preview: DataFrame, detail: DataFrame, key: str = "url") -> DataFrame:
    """Preview rows with every detail value that is there; the preview stands in for the rest."""
    extra = [c for c in detail.columns if c != key]
    side = detail.withColumnsRenamed({c: f"_d_{c}" for c in extra})
    kept = [F.coalesce(f"_d_{c}", c).alias(c) if c in extra else F.col(c) for c in preview.columns]
    added = [F.col(f"_d_{c}").alias(c) for c in extra if c not in preview.columns]
    return preview.join(side, key, "left").select(*kept, *added)


def min_occurrence(df: DataFrame, thresholds: Sequence[tuple[str, int]]) -> DataFrame:
    """Keep rows of frequent values, column after column, counts taken anew each time.

    Whether a row stays depends on its values in these columns only, so the cascade runs on the
    counted value combinations: the rows are read once to count them and once to be filtered,
    however many columns there are.
    """
    columns = [c for c, _ in thresholds]
    combos = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    for column, least in thresholds:
        total = F.sum("_n").over(Window.partitionBy(column))
        combos = combos.withColumn("_t", total).filter(F.col(column).isNotNull() & (F.col("_t") >= least))
    return df.join(combos.select(*columns), columns, "left_semi")
