"""Predicates: filter dictionaries, ranges, keywords, text search, optional parameters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from borgata.functions import dates
from borgata.functions.text import keywords


def _known(df: DataFrame, names: Iterable[str]) -> None:
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(and_, tests) if tests else F.lit(True)


def by_dictionary(df: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """AND of ``column = value`` / ``column IN (values)``; NULL equals nothing."""
    _known(df, filters)
    tests = [
        F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v)
        for c, v in filters.items()
    ]
    return df.filter(all_of(tests))


def order_by_text(df: DataFrame, spec: str | None) -> DataFrame:
    """``"a DESC, b"``; NULL sorts first going up and last going down."""
    if not spec:
        return df
    keys = []
    for item in spec.split(","):
        words = item.split()
        if not words or len(words) > 2 or (len(words) == 2 and words[1].upper() not in ("ASC", "DESC")):
            raise ValueError(f"bad order: {item!r}")
        _known(df, words[:1])
        down = len(words) == 2 and words[1].upper() == "DESC"
        keys.append(F.col(words[0]).desc() if down else F.col(words[0]).asc())
    return df.orderBy(*keys)


def read_listings(
    df: DataFrame, filters: Mapping[str, Any] | None = None,
    order_by: str | None = "created_at DESC", limit: int | None = None,
) -> DataFrame:
    """Filter, order and limit; with a limit Spark keeps the best rows per partition only."""
    out = order_by_text(by_dictionary(df, filters or {}), order_by)
    return out if limit is None else out.limit(limit)


# Columns searched when none are named.
SEARCH_COLUMNS = ["title", "description", "address", "macrozone", "city"]


def contains_text(c: Column, query: str) -> Column:
    """``query`` somewhere in the text, case ignored; ``%`` and ``_`` are wildcards, a backslash is itself."""
    return c.ilike("%" + query.replace("\\", "\\\\") + "%")


def search_text(df: DataFrame, query: str, columns: Sequence[str] = tuple(SEARCH_COLUMNS)) -> DataFrame:
    """Any column contains ``query``, case ignored; ``%`` and ``_`` in it are wildcards."""
    _known(df, columns)
    return df.filter(reduce(or_, [contains_text(F.col(c), query) for c in columns]))


def value_range(df: DataFrame, bounds: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """Inclusive ranges, NULL excluded; an open end is None."""
    _known(df, bounds)
    tests = []
    for c, (low, high) in bounds.items():
        tests.append(F.col(c).isNotNull())
        if low is not None:
            tests.append(F.col(c) >= F.lit(low))
        if high is not None:
            tests.append(F.col(c) <= F.lit(high))
    return df.filter(all_of(tests))


def _contains_any(c: Column, words: list[str], need_all: bool) -> Column:
    low = F.lower(c)
    return reduce(and_ if need_all else or_, [F.contains(low, F.lit(w)) for w in words])


def has_keywords(c: Column, query: str, mode: str = "And") -> Column:
    """``And``: every keyword occurs; ``Or``: at least one.  NULL text has none."""
    words = keywords(query)
    return F.coalesce(_contains_any(c, words, mode == "And"), F.lit(False)) if words else F.lit(True)


def lacks_keywords(c: Column, query: str, mode: str = "And") -> Column:
    """``And``: no keyword occurs; ``Or``: not all do.  NULL text lacks them."""
    words = keywords(query)
    return F.coalesce(~_contains_any(c, words, mode != "And"), F.lit(True)) if words else F.lit(True)


def keyword_include(df: DataFrame, column: str, query: str, mode: str = "And") -> DataFrame:
    return df.filter(has_keywords(F.col(column), query, mode))


def keyword_exclude(df: DataFrame, column: str, query: str, mode: str = "And") -> DataFrame:
    return df.filter(lacks_keywords(F.col(column), query, mode))


def explode_tests(df: DataFrame, tests: Mapping[str, Column], name: str) -> DataFrame:
    """A row for every test that holds, with the test's name: several filters in one scan."""
    held = F.array_compact(F.array(*[F.when(test, label) for label, test in tests.items()]))
    return df.withColumn(name, F.explode(held))


def optional(df: DataFrame, tests: Mapping[str, tuple[Any, Any]]) -> DataFrame:
    """``name -> (value, value -> Column)``; parameters left at None do not constrain."""
    return df.filter(all_of([make(value) for value, make in tests.values() if value is not None]))


def listing_search(
    df: DataFrame, *, max_price: float | None = None, min_rooms: int | None = None,
    min_baths: int | None = None, min_surface: int | None = None,
    features: Sequence[str] | None = None, zone_ids: Sequence[str] | None = None,
) -> DataFrame:
    """Listings search; ``features`` is an array column and all wanted ones must be there."""
    return optional(
        df,
        {
            "price": (max_price, lambda v: F.col("price_value") < v),
            "rooms": (min_rooms, lambda v: F.col("rooms") >= v),
            "baths": (min_baths, lambda v: F.col("bathrooms") >= v),
            "surface": (min_surface, lambda v: F.col("surface_m2") >= v),
            "features": (
                features,
                lambda v: all_of([F.array_contains(F.col("features"), w) for w in v]),
            ),
            "zones": (zone_ids, lambda v: F.col("zone_id").isin(list(v))),
        },
    )


def posting_search(
    df: DataFrame, *, text: str | None = None, status: Sequence[str] | None = ("OPEN",),
    regione_id: str | None = None, categoria_id: str | None = None, settore_id: str | None = None,
    date_from: str | None = None, date_to: str | None = None,
    livelli_anzianita_ids: Sequence[str] | None = None, tipo_impiego_id: str | None = None,
    salary_min: float | None = None, salary_max: float | None = None,
) -> DataFrame:
    """Public job postings by optional parameters."""
    return optional(
        df,
        {
            "text": (text or None, lambda v: contains_text(F.col("text"), v)),
            "status": (status, lambda v: F.col("status").isin(list(v))),
            "regione": (regione_id, lambda v: F.col("regioneId") == v),
            "categoria": (categoria_id, lambda v: F.col("categoriaId") == v),
            "settore": (settore_id, lambda v: F.col("settoreId") == v),
            "from": (date_from, lambda v: F.col("date") >= F.lit(v).cast("date")),
            "to": (date_to, lambda v: F.col("date") <= F.lit(v).cast("date")),
            "livelli": (livelli_anzianita_ids, lambda v: F.col("livelloAnzianitaId").isin(list(v))),
            "impiego": (tipo_impiego_id, lambda v: F.col("tipoImpiegoId") == v),
            "smin": (salary_min, lambda v: F.col("salary") >= v),
            "smax": (salary_max, lambda v: F.col("salary") <= v),
        },
    )


def fare_search(
    df: DataFrame, *, origin: str | None = None, date_from: str | None = None,
    date_to: str | None = None, time_from: str = "00:00", time_to: str = "23:59",
    max_price: float | None = None, destination: str | None = None,
    destination_country: str | None = None, currency: str | None = None,
) -> DataFrame:
    """Fares by day range, departure-time window and optional limits."""
    window = dates.clock(F.col("departureTime")).between(time_from, time_to)
    day = F.col("departureTime")
    found = optional(
        df,
        {
            "origin": (origin, lambda v: F.col("origin") == v),
            "from": (date_from, lambda v: day >= F.lit(v).cast("timestamp")),
            "to": (date_to, lambda v: day < F.date_add(F.lit(v).cast("date"), 1).cast("timestamp")),
            "price": (max_price, lambda v: F.col("price") <= v),
            "dest": (destination, lambda v: F.col("destination") == v),
            "country": (destination_country, lambda v: F.col("destinationCountry") == v),
            "currency": (currency, lambda v: F.col("currency") == v),
        },
    )
    return found.filter(window)


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


# Words that mark a blocked page, and the short list of the browser variant.
BLOCK_WORDS = ["captcha", "robot", "automated", "blocked", "denied",
               "access forbidden", "suspicious", "unusual activity"]
BLOCK_WORDS_SHORT = ["captcha", "robot"]


def block_words_found(c: Column, words: Sequence[str] = BLOCK_WORDS) -> Column:
    low = F.lower(c)
    hits = F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in words])
    return F.array_compact(hits)


def split_blocked(pages: DataFrame, html: str = "html", status: str | None = None,
                  words: Sequence[str] = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(usable pages, pages for the quarantine with the words found).

    With a status column a page is set aside for a status other than 200, and the words only tell
    why; without one a page is set aside for its words or for having no text.
    """
    marked = pages.withColumn("found", block_words_found(F.col(html), words))
    bad = (F.col(html).isNull() | (F.size("found") > 0)) if status is None else F.coalesce(F.col(status) != 200, F.lit(True))
    return marked.filter(~bad).drop("found"), marked.filter(bad)
