"""Benchmark decontamination: texts are scanned for the word windows of benchmark items.

The windows of the items (``WINDOW`` words; a shorter item is one window) become a hash set.  Up to
``BROADCAST_BYTES`` (the windows' own bytes are counted first) the set goes to every task, which
looks up all windows of a slice of texts at once; the first place of every hit is compared word by
word with the item's text before hits of that hash count.  A larger set is not broadcast: the hashes
of the documents' windows are joined with it instead, with the same result (hits there are confirmed
by a second, independent hash), and the places found return to their texts.

Null or empty texts have no words and no hits.  Very long texts are scanned whole, a text at a time.
Items without words have no window; an item without id hits and counts as no item.  Repeated rows
are each judged, so there are no ties to break.  With an empty benchmark nothing is hit; an empty
table gives no rows.  ``decontaminate`` drops contaminated rows and ``cut_spans`` cuts the hit words;
both carry all other columns along, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borgata import session
from borgata.llm import columns, ragged

WINDOW = 13
#: Most bytes of windows that go to every task, each counted with its words, its item's id and ``EACH`` more.
BROADCAST_BYTES = 128 * 1024 * 1024
EACH = 64
_SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


class Scan(NamedTuple):
    """Words of a slice of texts, lower-cased, with two independent hashes."""

    data: np.ndarray
    words: ragged.Words
    one: np.ndarray
    two: np.ndarray


def scan(t: ragged.Texts) -> Scan:
    data = ragged.LOWER[t.data]
    w = ragged.words(ragged.Texts(data, t.offsets), ragged.ALNUM)
    h = ragged.Hasher(data).spans(w.start, w.end)
    return Scan(data, w, h, ragged.mix(h ^ _SECOND))


def words_text(s: Scan, at: int, size: int) -> bytes:
    """The words of a window, one space between them."""
    return b" ".join(s.data[a:b].tobytes() for a, b in zip(s.words.start[at:at + size], s.words.end[at:at + size],
                                                          strict=True))


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, size, one, two, words) of every distinct window of every item."""

    def run(batches):
        for batch, t in ragged.slices(batches, "_text"):
            s, ids = scan(t), batch.column("_item").to_pylist()
            out = []
            for row, (a, b) in enumerate(zip(s.words.first[:-1], s.words.first[1:], strict=True)):
                size = int(min(window, b - a))
                if not size:
                    continue
                one, two = ragged.windows(s.one[a:b], size), ragged.windows(s.two[a:b], size)
                found = {words_text(s, int(a) + i, size): (int(x), int(y))
                         for i, (x, y) in enumerate(zip(one.view(np.int64), two.view(np.int64), strict=True))}
                out += [(ids[row], size, x, y, words) for words, (x, y) in found.items()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["item", "size", "one", "two", "words"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    rows = benchmark.select(F.col(item).cast("string").alias("_item"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "item string, size int, one long, two long, words binary")


class Windows(NamedTuple):
    """Distinct windows of one size, by hash; the items of window k are owners[first[k]:first[k + 1]]."""

    keys: np.ndarray
    words: pa.BinaryArray
    first: np.ndarray
    owners: np.ndarray


class WindowSet:
    """Windows by size, kept as arrays; ``owners`` are positions in ``items``."""

    def __init__(self, table: pa.Table):
        self.items = sorted(pc.unique(table.column("item")).drop_null().to_pylist())
        self.sizes = {size: self._of(table.filter(pc.equal(table.column("size"), size)))
                      for size in sorted(pc.unique(table.column("size")).to_pylist())}

    def _of(self, rows: pa.Table) -> Windows:
        coded = rows.column("words").combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy()
        keys = np.zeros(len(coded.dictionary), np.uint64)
        keys[code] = rows.column("one").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        item = pc.index_in(rows.column("item"), pa.array(self.items, pa.string())).combine_chunks()
        known = item.is_valid().to_numpy(zero_copy_only=False)
        pairs = np.unique(np.stack([place[code[known]], item.drop_null().to_numpy().astype(np.int64)], axis=1), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
        return Windows(keys[order], coded.dictionary.take(pa.array(order)), first, pairs[:, 1])


def _find(s: Scan, known: WindowSet):
    """For each size: first words of the hit windows, and which window of the set each is."""
    for size, held in known.sizes.items():
        starts = ragged.within(s.words, size)
        h = ragged.windows(s.one, size)[starts]
        place = np.minimum(np.searchsorted(held.keys, h), len(held.keys) - 1)
        hit = held.keys[place] == h
        starts, place = starts[hit], place[hit]
        if not len(starts):
            continue
        # Compare one place of each (window, second hash) with the item's words.
        second = ragged.windows(s.two, size)[starts]
        pairs = np.stack([place.astype(np.uint64), second], axis=1)
        _, first, inverse = np.unique(pairs, axis=0, return_index=True, return_inverse=True)
        good = np.array([words_text(s, int(starts[i]), size) == held.words[int(place[i])].as_py() for i in first])[inverse.ravel()]
        yield size, starts[good], place[good], held


def _hit(s: Scan, known: WindowSet) -> np.ndarray:
    """Which words lie in an occurrence of a window."""
    hit = np.zeros(len(s.one), bool)
    for size, starts, _, _ in _find(s, known):
        hit |= ragged.covered(starts, size, len(hit))
    return hit


def _items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _judge(s: Scan, known: WindowSet) -> dict[str, np.ndarray | list]:
    rows = len(s.words.first) - 1
    hit = np.zeros(len(s.one), bool)
    found: dict[int, set[int]] = {}
    for size, starts, place, held in _find(s, known):
        hit |= ragged.covered(starts, size, len(hit))
        pairs = np.unique(np.stack([s.words.row[starts], place], axis=1), axis=0)
        for row, p in pairs.tolist():
            found.setdefault(row, set()).update(held.owners[held.first[p]:held.first[p + 1]].tolist())
    n_hit, n_words = ragged.per_row(hit, s.words.first), s.words.count
    items = [[known.items[i] for i in found.get(r, ())] for r in range(rows)]
    return {"n_words": n_words, "n_hit": n_hit, "n_items": np.array([len(x) for x in items], np.int64),
            "items_sha256": [_items_digest(x) for x in items], "contaminated": (n_hit > 0) & (20 * n_hit >= n_words)}


RESULT = {"n_words": "long", "n_hit": "long", "n_items": "long", "items_sha256": "string", "contaminated": "boolean"}


def _fields(names: dict[str, str]) -> list[T.StructField]:
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return [T.StructField(n, kinds[k]) for n, k in names.items()]


def window_set(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW,
               most: int = BROADCAST_BYTES) -> tuple[WindowSet | None, DataFrame]:
    """The set to broadcast, or None where it takes more than ``most`` bytes; and its table."""
    table = item_windows(benchmark, item, text, window)
    each = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + EACH
    if (table.agg(F.sum(each).alias("size")).first()["size"] or 0) > most:
        return None, table
    return WindowSet(table.toArrow()), table


def marked(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
           item_text: str = "text", window: int = WINDOW, most: int = BROADCAST_BYTES,
           keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every row (default all) with its hits, in ``RESULT``'s columns."""
    keep = docs.columns if keep is None else keep
    small, table = window_set(benchmark, item, item_text, window, most)
    if small is None:
        return _joined(docs, table, text, keep, prefix)
    known = docs.sparkSession.sparkContext.broadcast(small)
    schema = T.StructType([*[docs.schema[c] for c in keep], *_fields({prefix + n: k for n, k in RESULT.items()})])

    def run(batches):
        for batch, t in ragged.slices(batches, text):
            found = _judge(scan(t), known.value)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], *[pa.array(found[n]) for n in RESULT]], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _located(docs: DataFrame, table: DataFrame, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For a set too large to broadcast, by a join on window hashes: the rows with a ``_row`` id beside
    their columns (which must leave ``_row`` free), the places of windows in each (``_row``, ``_at``
    and ``_size``, no more than its words times the sizes), and the items of each (``_row``, ``item``)."""
    spark = docs.sparkSession
    # Ids only name the rows of this one read, and uuid() is new in every read, so the rows are written once.
    path = session.scratch_dir(spark, "decontaminate")
    docs.withColumn("_row", F.expr("uuid()")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = [r["size"] for r in table.select("size").distinct().collect()]  # one to WINDOW

    def places(batches):
        for batch, t in ragged.slices(batches, "_text"):
            s, ids = scan(t), batch.column("_row")
            for size in sizes:
                starts = ragged.within(s.words, size)
                at = starts - s.words.first[s.words.row[starts]]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(s.words.row[starts])), pa.array(np.full(len(starts), size, np.int32)),
                     pa.array(at.astype(np.int64)), pa.array(ragged.windows(s.one, size)[starts].view(np.int64)),
                     pa.array(ragged.windows(s.two, size)[starts].view(np.int64))],
                    names=["_row", "size", "at", "one", "two"])

    found = rows.select("_row", F.col(text).alias("_text")).mapInArrow(
        places, "_row string, size int, at long, one long, two long")
    window = ["size", "one", "two"]
    # A window stands once however many items hold it.
    spots = found.join(table.select(*window).distinct(), window, "left_semi").groupBy("_row").agg(
        F.collect_list("at").alias("_at"), F.collect_list(F.col("size").cast("long")).alias("_size"))
    items = found.select("_row", *window).distinct().join(
        table.select("item", *window).distinct(), window).select("_row", "item").distinct()
    return rows, spots, items


def _spotted(s: Scan, batch: pa.RecordBatch) -> np.ndarray:
    """Which words lie in a place that the batch's ``_at`` and ``_size`` name."""
    at, size = batch.column("_at"), batch.column("_size")
    row = np.repeat(np.arange(len(at)), pc.fill_null(pc.list_value_length(at), 0).to_numpy())
    starts = s.words.first[row] + at.flatten().to_numpy()
    return ragged.covered(starts.astype(np.int64), size.flatten().to_numpy(), len(s.one))


def _joined(docs: DataFrame, table: DataFrame, text: str, keep: list[str], prefix: str) -> DataFrame:
    """``marked`` for a set too large to broadcast."""
    every = list(dict.fromkeys([*keep, text]))
    plain, _ = columns.numbered(docs.select(*every))
    name = dict(zip(every, plain.columns, strict=True))
    rows, spots, items = _located(plain, table, name[text])
    listed = items.groupBy("_row").agg(F.sort_array(F.collect_set("item")).alias("_items"))
    kept = [*[name[c] for c in keep], "_row"]
    counted = ["_n_words", "_n_hit"]
    shape = T.StructType([*[rows.schema[c] for c in kept], *[T.StructField(c, T.LongType()) for c in counted]])

    def counts(batches):
        for batch, t in ragged.slices(batches, name[text]):
            s = scan(t)
            arrays = [pa.array(s.words.count.astype(np.int64)), pa.array(ragged.per_row(_spotted(s, batch), s.words.first))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *arrays], names=[*kept, *counted])

    out = rows.join(spots, "_row", "left").mapInArrow(counts, shape).join(listed, "_row", "left")
    n_hit, ids = F.col("_n_hit"), F.coalesce("_items", F.array().cast("array<string>"))
    result = [F.col("_n_words"), n_hit, F.size(ids).cast("long"), F.sha2(F.array_join(ids, ","), 256),
              (n_hit > 0) & (20 * n_hit >= F.col("_n_words"))]
    return out.select(*[F.col(name[c]).alias(c) for c in keep],
                      *[r.alias(prefix + n) for r, n in zip(result, RESULT, strict=True)])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    rows, own = columns.numbered(docs)
    return marked(rows, benchmark, *columns.numbers(docs, text)).filter(~F.col("contaminated")).select(*own)


def _without(s: Scan, t: ragged.Texts, hit: np.ndarray) -> list[str]:
    """The texts without their hit words and what stands between hit neighbours."""
    gone = np.bincount(s.words.start[hit], minlength=len(t.data) + 1)
    gone -= np.bincount(s.words.end[hit], minlength=len(t.data) + 1)
    both = np.flatnonzero(hit[1:] & hit[:-1] & (s.words.row[1:] == s.words.row[:-1]))
    np.add.at(gone, s.words.end[both], 1)
    np.add.at(gone, s.words.start[both + 1], -1)
    stay = np.cumsum(gone[:len(t.data)]) == 0
    return [t.data[a:b][stay[a:b]].tobytes().decode() for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True)]


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", most: int = BROADCAST_BYTES) -> DataFrame:
    """Instead of whole documents, the hit words (and what stands between hit neighbours) go.  Null
    texts stay null.  Works for a benchmark of any size, by the broadcast set or by the join."""
    small, table = window_set(benchmark, most=most)
    rows, own = columns.numbered(docs)
    body = columns.numbers(docs, text)[0]
    known = docs.sparkSession.sparkContext.broadcast(small) if small is not None else None
    names, at = rows.columns, rows.columns.index(body)
    if known is None:
        rows, spots, _ = _located(rows, table, body)
        rows = rows.join(spots, "_row", "left")

    def run(batches):
        for batch, t in ragged.slices(batches, body):
            s = scan(t)
            left = _without(s, t, _spotted(s, batch) if known is None else _hit(s, known.value))
            arrays = [batch.column(c) for c in names]
            mask = arrays[at].is_null().to_pylist()
            arrays[at] = pa.array([None if m else x for m, x in zip(mask, left, strict=True)], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in names])).select(*own)


def op8_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return marked(docs, spark.read.parquet(f"{sf}/benchmark.parquet"), keep=["doc_id"])
