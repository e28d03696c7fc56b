"""The best documents for each query text, by range-maximum tables over posting lists.

A term's impact in a document is a whole number (see ``impacts``); a document's score is the sum of the
impacts of the query's terms, each counted once.  Documents are read in blocks.  Each block has a posting
list for every query term, in the order of the documents' ids, and over each list's impacts a sparse table
that answers "where is the greatest impact between these two documents" at once.

A query begins with the interval of all documents of a block.  An interval's bound is the sum of its
terms' greatest impacts.  The intervals with the highest bounds are taken first; each is split at the
document of its greatest single impact, which is scored in full, and the two halves get bounds of their
own.  It ends when no bound can reach the k-th best score (for equal scores, the k-th best id).  What a
task has found in one block holds for its next ones.  The blocks' best documents meet in one last ranking.

Queries are broadcast by groups of at most ``QUERY_BYTES`` bytes of distinct terms (or one item, where it
alone is larger); the documents are scanned once for each group.

Null texts have no terms.  Rows that repeat an item's id are one item with all their terms (rows with null
id as well); items without any found term get no rows.  Repeated documents are ranked one by one; equal
scores stand by id, nulls last.  A text of any length is one document.  Empty tables give no rows.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borgata import session
from borgata.llm import ragged

BEST = 10
QUERY_BYTES = 8 << 20
#: Postings of one block, and intervals of a query that are split at once.
BLOCK_POSTINGS, AT_ONCE = 1 << 19, 64
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def query_terms(queries: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term) of all distinct terms."""
    found = F.regexp_extract_all(F.col(text), F.lit(_TERM), F.lit(0))
    folded = F.translate("term", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return queries.select(F.col(item).alias("item"), F.explode(found).alias("term")).select("item", folded.alias("term")).distinct()


def query_groups(pairs: DataFrame, most: int) -> Iterator[DataFrame]:
    """The pairs in groups of whole items with at most ``most`` bytes, or one item."""
    parts = 1
    while True:
        group = F.pmod(F.xxhash64("item"), F.lit(parts))
        sizes = pairs.groupBy(group.alias("part"), "item").agg(F.sum(F.octet_length("term") + 16).alias("bytes"))
        sizes = sizes.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("items"))
        if sizes.filter((F.col("bytes") > most) & (F.col("items") > 1)).isEmpty():
            break
        parts *= 2
    for part in range(parts):
        yield pairs.filter(group == part)


class Terms:
    """Distinct terms in the order of their hashes, and the items that ask for them."""

    def __init__(self, rows: list):
        words = sorted({r["term"].encode() for r in rows})
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(x) for x in words], dtype=np.int64)
        start = end - np.array([len(x) for x in words], np.int64)
        key = ragged.Hasher(data).spans(start, end)
        order = np.argsort(key)
        self.data, self.key, self.start, self.size = data, key[order], start[order], (end - start)[order]
        at = {words[k]: i for i, k in enumerate(order.tolist())}
        self.items: dict = {}
        for r in rows:
            self.items.setdefault(r["item"], []).append(at[r["term"].encode()])

    def found(self, data: np.ndarray, w: ragged.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are terms, and which terms; equal hashes are compared byte by byte."""
        h = ragged.Hasher(data).spans(w.start, w.end)
        term = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        word = np.flatnonzero((self.key[term] == h) & (self.size[term] == w.end - w.start))
        term = term[word]
        size = self.size[term]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wrong = data[np.repeat(w.start[word], size) + step] != self.data[np.repeat(self.start[term], size) + step]
        good = np.ones(len(word), bool)
        good[np.repeat(np.arange(len(word)), size)[wrong]] = False
        return word[good], term[good]


def term_counts(docs: DataFrame, terms, doc: str, text: str) -> DataFrame:
    """(doc, n, terms, tf) of every document with a term of any kind: all of them, and those asked for."""

    def run(batches):
        for batch, t in ragged.slices(batches, "_text"):
            data, asked = ragged.LOWER[t.data], terms.value
            w = ragged.words(ragged.Texts(data, t.offsets), ragged.ALNUM)
            word, term = asked.found(data, w)
            key, tf = np.unique(w.row[word] * len(asked.key) + term, return_counts=True)
            row, term = np.divmod(key, len(asked.key))
            offsets = pa.array(np.searchsorted(row, np.arange(t.rows + 1)).astype(np.int32))
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(w.count), pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                 pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], names=["doc", "n", "terms", "tf"])
            yield out.filter(pa.array(w.count > 0))

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc long, n long, terms array<int>, tf array<long>")


def impacts(weight: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 100 - 90 + (90 * n * documents) // length
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class Block:
    """Posting lists of some documents, with a sparse table over each."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        by_id = np.lexsort((ids, nulls))
        self.ids, self.nulls, self.width = ids[by_id], nulls[by_id], len(ids)
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        key = term * self.width + place[row]
        order = np.argsort(key)
        self.key, self.impact = key[order], impact[order]
        self.first = np.searchsorted(self.key, np.arange(terms + 1) * self.width)
        longest = int(np.diff(self.first).max(initial=1))
        n = len(key)
        # Level k: the place of the greatest impact among 2^k postings.  Ranges stay within one list.
        self.table = np.empty((longest.bit_length(), n), np.int32)
        self.table[0] = np.arange(n)
        for k in range(1, len(self.table)):
            half = 1 << (k - 1)
            self.table[k] = self.table[k - 1]
            left, right = self.table[k - 1][:-half], self.table[k - 1][half:]
            self.table[k][:n - half] = np.where(self.impact[right] > self.impact[left], right, left)

    def greatest(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of intervals, and a document of each interval's greatest impact, from ranges of its lists."""
        size = high - low
        some = size > 0
        level = np.frexp(np.maximum(size, 1))[1] - 1
        at = np.where(some, low, 0)
        left, right = self.table[level, at], self.table[level, np.where(some, high - (1 << level), 0)]
        where = np.where(self.impact[right] > self.impact[left], right, left)
        value = np.where(some, self.impact[where], 0)
        top = value.argmax(axis=1)
        rows = np.arange(len(low))
        return value.sum(axis=1), self.key[where[rows, top]] % self.width

    def search(self, terms: np.ndarray, best: list[tuple[int, bool, int]], k: int) -> None:
        """Puts the block's documents among the k ``best``, which are (-score, null id, id) in order."""
        terms = terms[self.first[terms + 1] > self.first[terms]]
        if not len(terms):
            return
        low, high = self.first[terms][None], self.first[terms + 1][None]
        begin = np.zeros(1, np.int64)
        bound, split = self.greatest(low, high)
        at_once = 1
        while len(bound):
            if len(best) == k:
                score, null, last = -best[-1][0], best[-1][1], best[-1][2]
                before = (self.nulls[begin] < null) | ((self.nulls[begin] == null) & (self.ids[begin] <= last))
                live = (bound > score) | ((bound == score) & before)
                low, high, begin, bound, split = low[live], high[live], begin[live], bound[live], split[live]
                if not len(bound):
                    return
            take = np.lexsort((begin, -bound))[:at_once]
            doc = split[take]
            key = terms * self.width + doc[:, None]
            at = np.searchsorted(self.key, key)
            there = self.key[np.minimum(at, len(self.key) - 1)] == key
            scores = np.where(there, self.impact[np.minimum(at, len(self.key) - 1)], 0).sum(axis=1)
            found = zip((-scores).tolist(), self.nulls[doc].tolist(), self.ids[doc].tolist(), strict=True)
            best[:] = sorted([*best, *(x for x in found if x[0] < 0)])[:k]
            lows, highs = np.concatenate([low[take], at + there]), np.concatenate([at, high[take]])
            begins = np.concatenate([begin[take], doc + 1])
            bounds, splits = self.greatest(lows, highs)
            stay = np.ones(len(bound), bool)
            stay[take] = False
            new = bounds > 0
            low, high = np.concatenate([low[stay], lows[new]]), np.concatenate([high[stay], highs[new]])
            begin, bound = np.concatenate([begin[stay], begins[new]]), np.concatenate([bound[stay], bounds[new]])
            split = np.concatenate([split[stay], splits[new]])
            at_once = min(2 * at_once, AT_ONCE)


def _ranked(counts: DataFrame, terms, weights, documents: int, length: int, kind: T.DataType, k: int) -> DataFrame:
    """(item, doc, score): each task's best documents for every item."""

    def run(batches):
        asked, weight = terms.value, weights.value
        items = [(item, np.unique(t)) for item, t in asked.items.items()]
        best: list[list] = [[] for _ in items]
        held, size = [], 0

        def search() -> None:
            table = pa.Table.from_batches(held)
            held.clear()
            ids = table.column("doc").combine_chunks()
            lists = table.column("terms").combine_chunks()
            row = np.repeat(np.arange(table.num_rows), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy().astype(np.int64)
            impact = impacts(weight[term], table.column("tf").combine_chunks().flatten().to_numpy(),
                             table.column("n").to_numpy()[row], documents, length)
            block = Block(ids.fill_null(0).to_numpy(), np.asarray(ids.is_null()), row, term, impact, len(weight))
            for (_, t), found in zip(items, best, strict=True):
                block.search(t, found, k)

        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= BLOCK_POSTINGS:
                search()
                size = 0
        if size:
            search()
        out = [(item, None if null else doc, -score) for (item, _), found in zip(items, best, strict=True)
               for score, null, doc in found]
        if out:
            item, doc, score = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, of_item), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "doc", "score"])

    of_item = pa.int64() if isinstance(kind, T.LongType) else pa.string()
    shape = T.StructType([T.StructField("item", kind), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())])
    return counts.mapInArrow(run, shape)


def search(docs: DataFrame, queries: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", k: int = BEST, most: int = QUERY_BYTES) -> DataFrame:
    """(item, rank, doc, score) of the k best documents of every item; whole-number ids as long, others as text."""
    spark = docs.sparkSession
    folder = session.scratch_dir(spark, "search")
    whole = isinstance(queries.schema[item].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    kind = T.LongType() if whole else T.StringType()
    pairs = query_terms(queries.withColumn(item, F.col(item).cast(kind)), item, item_text)
    pairs.write.parquet(f"{folder}/queries")
    pairs = spark.read.parquet(f"{folder}/queries")
    found = spark.createDataFrame([], T.StructType([
        T.StructField("item", kind), T.StructField("doc", T.LongType()), T.StructField("score", T.LongType())]))
    for g, group in enumerate(query_groups(pairs, most)):
        rows = group.collect()
        if not rows:
            continue
        asked = Terms(rows)
        terms = spark.sparkContext.broadcast(asked)
        term_counts(docs, terms, doc, text).write.parquet(f"{folder}/counts-{g}")
        counts = spark.read.parquet(f"{folder}/counts-{g}")
        documents, length = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(len(asked.key), np.int64)
        for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            weight[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))
        if documents:
            found = found.unionAll(_ranked(counts, terms, spark.sparkContext.broadcast(weight), documents, length, kind, k))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item", "rank", "doc", "score")


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = search(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
