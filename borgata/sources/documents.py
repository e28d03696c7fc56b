"""JSON array documents of any length, read in many tasks and cut at the ends of their records.

A file is read as pieces that end at a closing brace, so it splits like any text file.  Whether a
piece begins inside a string, how deep it lies and which record it belongs to are running totals over
the file: each block adds up its own pieces, and one row a block carries the totals on to the next.
A record that lies over two blocks meets by its number.  No task holds more than a block or a record.

A file holds one or more documents, each a bare array of objects or an object whose only entry is the
``root`` array.  Empty arrays and files give no rows; a record that is cut off at the end of a file
has a NULL ``value``.  Records of drifting shape stay VARIANT until a field is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BLOCK = ["file", "block"]


def _opened(text: Column) -> Column:
    """Opening braces outside strings in a text that begins outside one."""
    return F.regexp_count(F.regexp_replace(text, F.lit(r'"[^"]*("|$)'), F.lit("")), F.lit(r"\{")).cast("bigint")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, piece, odd, d0, d1): odd number of quotes; change of depth begun outside and inside a string."""
    lines = spark.read.option("lineSep", "}").text(path)
    placed = lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("piece"),
        # Escaped quotes and backslashes no longer matter.
        F.regexp_replace("value", r"\\.", "").alias("_bare"))
    odd = F.regexp_count("_bare", F.lit('"')) % 2
    # Up to the first quote a piece begun inside a string is text; the closing brace counts where the piece ends outside.
    rest = F.regexp_replace("_bare", r'^[^"]*("|$)', "")
    return placed.select(
        *BLOCK, "at", "piece", odd.alias("odd"), (_opened(F.col("_bare")) - F.when(odd == 0, 1).otherwise(0)).alias("d0"),
        (_opened(rest) - F.when(odd == 1, 1).otherwise(0)).alias("d1"))


def split_records(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """(file, record, text, value): the records of the array documents at ``path``, from 1 in each file."""
    base = 0 if root is None else 1
    inside = Window.partitionBy(*BLOCK).orderBy("at")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    # State of each piece for a block that begins outside a string (0), and the other way round (1).
    state = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).alias("state")
    stated = _pieces(spark, path).select("*", state).select(
        *BLOCK, "at", "piece", "odd", "state", *[
            F.when((F.col("state") == begun), F.col("d0")).otherwise(F.col("d1")).alias(f"c{begun}") for begun in (0, 1)])

    # One row a block: parity, then depth, carried along the file.
    blocks = stated.groupBy(*BLOCK).agg((F.sum("odd") % 2).alias("odd"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    along = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.select("*", (F.coalesce(F.sum("odd").over(along), F.lit(0)) % 2).alias("begun"))
    change = F.when(F.col("begun") == 0, F.col("c0")).otherwise(F.col("c1"))
    carried = begun.select(*BLOCK, "begun", F.coalesce(F.sum(change).over(along), F.lit(0)).alias("depth"))

    # The depth after each piece; a record ends where it is back at the array's.
    joined = stated.join(carried, BLOCK)
    own = F.when(F.col("begun") == 0, F.col("c0")).otherwise(F.col("c1"))
    outside = (F.col("state") + F.col("begun") + F.col("odd")) % 2 == 0
    deep = joined.select(*BLOCK, "at", "piece", outside.alias("outside"), (F.col("depth") + F.sum(own).over(inside)).alias("depth"))
    ends = deep.select("*", (F.col("outside") & (F.col("depth") == base)).cast("bigint").alias("end"))
    numbered = ends.select("*", F.coalesce(F.sum("end").over(before), F.lit(0)).alias("ended"))
    earlier = numbered.groupBy(*BLOCK).agg(F.sum("end").alias("ends")).select(
        *BLOCK, F.coalesce(F.sum("ends").over(along), F.lit(0)).alias("earlier"))
    parts = numbered.join(earlier, BLOCK).select(
        "file", (F.col("earlier") + F.col("ended") + 1).alias("record"), F.struct("block", "at", "piece").alias("part"), "end")

    whole = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("end").alias("closed"))
    text = F.concat_ws("}", F.transform("parts", lambda p: p["piece"]))
    text = F.when(F.col("closed") == 1, F.concat(text, F.lit("}"))).otherwise(text)
    if root is not None:
        # The end of the document before, empty documents, and this one's beginning.
        text = F.regexp_replace(text, r'^([\s,\[\]}]*\{\s*"' + _literal(root) + r'"\s*:)+', "")
    bare = F.regexp_replace(text, r"^[\s,\[\]}]+", "")
    records = whole.select("file", "record", bare.alias("text")).filter(F.col("text").startswith("{"))
    return records.select("*", F.try_parse_json("text").alias("value"))


def _literal(name: str) -> str:
    """``name`` as a pattern that matches itself."""
    return "".join(c if c.isalnum() or c in "_ -" else "\\" + c for c in name)
