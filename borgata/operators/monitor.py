"""Price snapshots, history, calendar, trips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from borgata.functions import dates
from borgata.session import scratch_dir


def compare_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], price: str, stamp: str) -> DataFrame:
    """Old rows with their new price and time, ``<price>_new`` in second place."""
    side = new.select(*keys, F.col(price).alias(f"{price}_new"), F.col(stamp).alias(f"{stamp}_new"))
    joined = old.join(side, list(keys))
    columns = list(old.columns)
    columns.insert(1, f"{price}_new")
    return joined.select(*columns, f"{stamp}_new")


def price_drops(old: DataFrame, new: DataFrame, keys: Sequence[str], price: str = "totalPrice",
                stamp: str = "queryDatetime") -> DataFrame:
    both = compare_snapshots(old, new, keys, price, stamp)
    return both.filter(F.col(f"{price}_new") < F.col(price))


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   name: str = "previous", parts: int | None = None) -> DataFrame:
    """Value of the row before, per key, without ordering a whole key in one task.

    The rows are dealt out by ranges of (keys, order): the ranges follow the rows, so a hot key, a
    burst or an outlier only decides how many ranges a key spans.  A row finds its neighbour inside
    its range; the last value of a key in a range is carried to the key's next range by a second
    series of one row per key and range.  ``parts`` (default the shuffle partitions) changes how the
    work is cut, never the result.  NULL keys are one key, NULL order values come first.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order)
    # Written once: both uses below must see the same ranges, also after a lost executor.
    path = scratch_dir(spark, "ranges")
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    cut = spark.read.parquet(path)
    # Structs, so that max_by also picks a last value that is NULL and NULL order values come first.
    last = cut.groupBy(*keys, "_range").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carry = last.select(
        *[F.col(k).alias(f"_c_{k}") for k in keys], F.col("_range").alias("_c_range"),
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_range"))["v"].alias("_carry")
    ).filter(F.col("_carry").isNotNull())
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    stepped = cut.withColumn("_prev", F.lag(value).over(inside)).withColumn("_rn", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys] + [F.col("_range") == F.col("_c_range")]
    joined = stepped.join(carry, same, "left")
    result = F.when(F.col("_rn") > 1, F.col("_prev")).otherwise(F.col("_carry")).alias(name)
    return joined.select(*[F.col(c) for c in df.columns], result)


def weekend_trips(start: Column, today: Column, weeks: int = 24) -> Column:
    """Array of (departure Friday, return Monday) after ``today``, from the week of ``start`` on."""
    friday = F.date_sub(start, F.weekday(start) - 4)
    trips = F.transform(
        F.sequence(F.lit(0), F.lit(weeks - 1)),
        lambda w: F.struct(
            F.date_add(friday, w * 7).alias("departure"), F.date_add(friday, w * 7 + 3).alias("back")
        ),
    )
    return F.filter(trips, lambda t: t["departure"] > today)


def zip_dates(departures: Column, returns: Column) -> Column:
    """Pairs of equally long date lists; any other input fails the job."""
    both = departures.isNull() == returns.isNull()
    same = F.coalesce(F.size(departures) == F.size(returns), F.lit(True))
    pairs = F.zip_with(departures, returns, lambda d, r: F.struct(d.alias("departure"), r.alias("back")))
    return F.when(both & same, pairs).otherwise(
        F.raise_error(F.lit("departure and return dates must come in equal numbers"))
    )


def parse_leg(leg: Column) -> Column:
    """One fare leg of the landed JSON as a flat struct."""
    place = lambda p: F.concat_ws(", ", leg[p]["name"], leg[p]["countryName"])
    number = leg["flightNumber"]
    return F.struct(
        dates.parse_iso(leg["departureDate"]).alias("departureTime"),
        F.concat(F.substr(number, F.lit(1), F.lit(2)), F.lit(" "), F.substr(number, F.lit(3))).alias("flightNumber"),
        leg["price"]["value"].alias("price"),
        leg["price"]["currencyCode"].alias("currency"),
        leg["departureAirport"]["iataCode"].alias("origin"),
        place("departureAirport").alias("originFull"),
        leg["arrivalAirport"]["iataCode"].alias("destination"),
        place("arrivalAirport").alias("destinationFull"),
    )


def flatten_trips(df: DataFrame, stamp: Column, outbound: str = "outbound", inbound: str = "inbound") -> DataFrame:
    """Trip rows with prefixed leg columns, the rounded total and the query time."""
    legs = df.select(
        *[F.col(c) for c in df.columns if c not in (outbound, inbound)],
        parse_leg(F.col(outbound)).alias("_o"), parse_leg(F.col(inbound)).alias("_i"),
    )
    fields = ["departureTime", "flightNumber", "price", "currency", "origin", "originFull",
              "destination", "destinationFull"]
    flat = [F.col(f"_o.{f}").alias(f"outbound_{f}") for f in fields]
    flat += [F.col(f"_i.{f}").alias(f"inbound_{f}") for f in fields]
    total = F.round(F.col("_i.price") + F.col("_o.price"), 2).alias("totalPrice")
    rest = [F.col(c) for c in legs.columns if c not in ("_o", "_i")]
    return legs.select(*rest, total, *flat, stamp.alias("queryDatetime"))
