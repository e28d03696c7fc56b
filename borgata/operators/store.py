"""The keyed store: collapse, upsert, insert-if-absent, delete, dedup.

A key that fills a third of a batch is harmless: every collapse is an aggregation with map-side
partials, never a window over the key.  Batches are joined to the store as the smaller side, so
Catalyst/AQE broadcasts a batch below the broadcast threshold and the store is then only scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

SEQ = "ingest_seq"


def shared_columns(batch: DataFrame, store: DataFrame) -> list[str]:
    return [c for c in store.columns if c in batch.columns]


def collapse_last_value(batch: DataFrame, key: str, seq: str = SEQ) -> DataFrame:
    """One row per key: for each column its last value that is not NULL."""
    rest = [c for c in batch.columns if c not in (key, seq)]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in rest]
    return batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"), *last)


def keep_first(df: DataFrame, keys: Sequence[str | Column], seq: str = SEQ) -> DataFrame:
    """First row of every key by ``seq``; NULL keys count as one value."""
    whole = F.min_by(F.struct("*"), F.col(seq)).alias("_row")
    names = [k if isinstance(k, Column) else F.col(k) for k in keys]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(names)]).agg(whole).select("_row.*")


def keep_last(df: DataFrame, keys: Sequence[str], seq: str = SEQ) -> DataFrame:
    whole = F.max_by(F.struct("*"), F.col(seq)).alias("_row")
    return df.groupBy(*keys).agg(whole).select("_row.*")


def absent_from(batch: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """Batch rows whose key the store lacks.

    The store side shrinks to the keys that occur in the batch before it meets the batch, so with a
    small batch the store is read once, key column only, and not shuffled.
    """
    known = store.select(key).join(batch.select(key).distinct(), key, "left_semi").distinct()
    return batch.join(known, key, "left_anti")


def upsert(store: DataFrame, batch: DataFrame, key: str = "url", replace_existing: bool = True,
           seq: str = SEQ) -> DataFrame:
    """Store after the batch.  With ``replace_existing`` non-NULL batch values win; columns the
    store does not know and rows without a key are ignored."""
    columns = shared_columns(batch, store)
    keyed = batch.select(*dict.fromkeys([*columns, seq])).filter(F.col(key).isNotNull())
    if not replace_existing:
        fresh = absent_from(keep_first(keyed, [key], seq), store, key)
        return store.unionByName(fresh.select(*columns), allowMissingColumns=True)
    new = collapse_last_value(keyed, key, seq).drop("_rows")
    side = new.withColumnsRenamed({c: f"_new_{c}" for c in columns if c != key})
    merged = store.join(side, key, "left").select(
        *[
            F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in columns and c != key else F.col(c)
            for c in store.columns
        ]
    )
    return merged.unionByName(absent_from(new, store, key), allowMissingColumns=True)


def upsert_merged(store: DataFrame, batch: DataFrame, key: str = "url", replace_existing: bool = True,
                  seq: str = SEQ, buckets: int | None = None) -> DataFrame:
    """The same as ``upsert`` by one full outer merge join: batch and store are each read once.

    For a store bucketed by its key (``sources.keyed``): the collapsed batch is dealt out to the
    ``buckets`` and the store stays where it is.  A store that is not bucketed would be shuffled.
    """
    columns = shared_columns(batch, store)
    keyed = batch.select(*dict.fromkeys([*columns, seq])).filter(F.col(key).isNotNull())
    new = collapse_last_value(keyed, key, seq) if replace_existing else keep_first(keyed, [key], seq)
    side = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns if c != key])
    if buckets:
        side = side.repartition(buckets, key)
    both = store.withColumn("_stored", F.lit(True)).join(side, key, "full_outer")
    kept = {
        c: F.coalesce(f"_new_{c}", c) if replace_existing else F.when(F.col("_stored"), F.col(c)).otherwise(F.col(f"_new_{c}"))
        for c in columns if c != key
    }
    return both.select(*[kept.get(c, F.col(c)).alias(c) for c in store.columns])


def upsert_counts(store: DataFrame, batch: DataFrame, key: str = "url", replace_existing: bool = True) -> DataFrame:
    """(new, updated) as a row-by-row loader counts them: the first row of an unknown key is new,
    every other row is an update when replacing and nothing otherwise."""
    per_key = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    known = store.select(key).join(per_key.select(key), key, "left_semi").distinct().withColumn("_known", F.lit(1))
    marked = per_key.join(known, key, "left")
    fresh = F.col("_known").isNull()
    updated = F.coalesce(F.sum(F.when(fresh, F.col("_rows") - 1).otherwise(F.col("_rows"))), F.lit(0))
    return marked.agg(
        F.count_if(fresh).alias("new_records"),
        (updated if replace_existing else F.lit(0)).cast("bigint").alias("updated_records"),
    )


def upsert_documents(store: DataFrame, batch: DataFrame, keys: Sequence[str] = ("id", "city"), seq: str = SEQ) -> DataFrame:
    """Whole-record replace on the document key; the last record of a key wins."""
    last = keep_last(batch, keys, seq).select(*store.columns)
    return store.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def document_id(uuid: Column, *fallback: Column) -> Column:
    """``uuid`` if there is one, else a hash of the record: a retried task gives the same id."""
    return F.coalesce(F.nullif(uuid, F.lit("")), F.sha2(F.concat_ws("|", *fallback), 256))


def delete_keys(store: DataFrame, doomed: DataFrame, key: str = "url") -> DataFrame:
    return store.join(doomed.select(key).distinct(), key, "left_anti")


def delete_count(store: DataFrame, doomed: DataFrame, key: str = "url") -> DataFrame:
    gone = store.select(key).join(doomed.select(key).distinct(), key, "left_semi")
    return gone.agg(F.count("*").alias("deleted"))


def dedup_against_seen(items: DataFrame, seen: DataFrame, key: str = "id", seq: str = SEQ,
                       buckets: int | None = None) -> DataFrame:
    """Items not seen in earlier runs, first of each id; items without an id all pass.  With seen ids
    bucketed by the key, ``buckets`` deals the items out to them."""
    has_id = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    fresh = keep_first(items.filter(has_id), [key], seq).select(*items.columns)
    if buckets:
        fresh = fresh.repartition(buckets, key)
    return fresh.join(seen.select(key), key, "left_anti").select(*items.columns).unionByName(
        items.filter(~has_id)
    )


def seen_union(seen: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    ids = seen.select(key).union(items.select(key))
    return ids.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()


def seen_merged(seen: DataFrame, items: DataFrame, key: str = "id", buckets: int | None = None) -> DataFrame:
    """``seen_union`` for seen ids that are distinct and bucketed by the key: one merge join in place."""
    ids = items.select(key).filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct()
    return seen.select(key).join(ids.repartition(buckets, key) if buckets else ids, key, "full_outer").select(key)
