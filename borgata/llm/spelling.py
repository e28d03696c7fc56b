"""Spelling variants: words one edit apart, found by walking tries as tables, level by level.

Words are counted over all texts.  Two tries hold them, one of the words and one of their reverses, as a
table of edges (node, label, child or word); nodes are hashes of prefixes, and a chain of nodes without
a branch is one edge, so a word of any length takes as many steps as it has branches.

Two words that differ by one edit are equal up to a branch where they part; there the edit is made, and the
rest is equal again.  The frontier is a table of states (word, node, rest of the word, one edit made).  It
begins at the branches of every word: a character replaced (the child's is another one, greater, so that a pair is
made from one side) or dropped (a pair of unequal lengths is made from the longer word).  At every step the
states are joined with the edges on node and next character, and live on where the label is what
the rest begins with.  A state that ends in a word is a pair of neighbours.  An edit lies in the second
half of a word or of its reverse, so only branches in second halves begin a state, where tries are thin;
few words share a node there, and no node near the root is ever joined.

Pairs are confirmed on the words themselves.  Null texts have no words; a null id counts as an empty one.
Repeated rows are each counted.  Runs of any length are words.  Equal counts: the smaller word in code-point
order is the form.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borgata.llm import ragged
from borgata.llm.near_dups import Work

LEAST_LENGTH, LEAST_TIMES = 5, 3
TYPO_OF = 97
_TEXT_BYTES = 1 << 20
_LONG = 64
_BACKWARD = np.uint64(0x7F4A7C159E3779B9)


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, value >> 1 ^ np.uint32(0xEDB88320), value >> 1)
    return value


_CRC = _crc_table()


def crc32(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte spans, each carried on from the CRC of what stands before it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = end - start
    left = np.flatnonzero((size > 0) & (size <= _LONG))
    step = 0
    while len(left):
        s = state[left]
        state[left] = _CRC[(s ^ data[start[left] + step]) & np.uint32(255)] ^ s >> np.uint32(8)
        step += 1
        left = left[size[left] > step]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _LONG).tolist():
        state[i] = zlib.crc32(data[start[i]:end[i]].tobytes(), int(before[i]))
    return state


def letters(t: ragged.Texts) -> ragged.Words:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF (in UTF-8: C3 and the byte after it)."""
    first = t.data == 0xC3
    inside = first | ((t.data | 32) - np.uint8(97) < 26)
    inside[1:] |= first[:-1] & ((t.data[1:] & 0xC0) == 0x80)
    return ragged._spans(inside, t)


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    taken = data[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]).cast(pa.string())


def count_words(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): words of at least ``least`` code points with their occurrences, one row per word.

    In every document one run of 97 or so, chosen by the CRC of id and run, is read without one character."""

    def run(batches):
        for batch, t in ragged.slices(batches, "_text", _TEXT_BYTES):
            t = ragged.Texts(ragged.LOWER[t.data], t.offsets)
            w = letters(t)
            points = np.zeros(len(t.data) + 1, np.int64)
            np.cumsum((t.data & 0xC0) != 0x80, out=points[1:])
            long = np.flatnonzero(points[w.end] - points[w.start] >= least)
            start, end, row = w.start[long], w.end[long], w.row[long]
            h = ragged.Hasher(t.data).spans(start, end)
            _, at, times = np.unique(h ^ ragged.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
            start, end, row, h = start[at], end[at], row[at], h[at]
            ids = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in batch.column("_doc").to_pylist()]
            crc = crc32(t.data, start, end, np.array(ids, np.uint32)[row])
            typo = crc % TYPO_OF == 0
            made, many = [], []
            for i in np.flatnonzero(typo).tolist():
                word = t.data[start[i]:end[i]].tobytes().decode()
                gone = int(crc[i]) % len(word)
                if len(word) > least:
                    made.append(word[:gone] + word[gone + 1:])
                    many.append(times[i])
            plain = np.flatnonzero(~typo)
            _, first, of = np.unique(h[plain], return_index=True, return_inverse=True)
            n = np.zeros(len(first), np.int64)
            np.add.at(n, of, times[plain])
            whole = _strings(t.data, start[plain][first], end[plain][first])
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([whole, pa.array(made, pa.string())]), pa.array(np.concatenate([n, np.array(many, np.int64)]))],
                names=["word", "n"])

    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at some places of UTF-8 bytes."""
    byte = [np.append(data, np.zeros(4, np.uint8))[at + k].astype(np.int64) for k in range(4)]
    low = [b & 63 for b in byte]
    two = (byte[0] & 31) << 6 | low[1]
    three = (byte[0] & 15) << 12 | low[1] << 6 | low[2]
    four = (byte[0] & 7) << 18 | low[1] << 12 | low[2] << 6 | low[3]
    return np.select([byte[0] < 0x80, byte[0] < 0xE0, byte[0] < 0xF0], [byte[0], two, three], four)


def prefixes(sides: DataFrame) -> DataFrame:
    """(id, back, depth, node, next) of the prefixes in the second half of each word (text, length ``n``):
    ``next`` is the code point after them, 0 at the end."""

    def run(batches):
        for batch, t in ragged.slices(batches, "text"):
            back, n = batch.column("back").to_numpy(zero_copy_only=False), batch.column("n").to_numpy()
            at = np.flatnonzero((t.data & 0xC0) != 0x80)
            place = np.sort(np.concatenate([at, t.offsets[1:]]), kind="stable")
            row = np.repeat(np.arange(t.rows), n + 1)
            # Where a text ends and the next begins, the end comes first.
            depth = np.arange(len(row)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
            keep = depth >= np.where(back, n // 2, (n - 1) // 2)[row]
            follows = np.where(depth < n[row], _code_points(t.data, place), 0)
            row, depth, place, follows = row[keep], depth[keep], place[keep], follows[keep]
            node = ragged.Hasher(t.data).spans(t.offsets[:-1][row], place) ^ np.where(back, _BACKWARD, np.uint64(0))[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(back[row]), pa.array(depth.astype(np.int32)),
                 pa.array(node.view(np.int64)), pa.array(follows.astype(np.int32))], names=["id", "back", "depth", "node", "next"])

    return sides.mapInArrow(run, "id long, back boolean, depth int, node long, next int")


def _rest(text, start):
    """What follows the first ``start`` characters."""
    return F.substr(text, start + 1)


def near_words(work: Work, words: DataFrame) -> DataFrame:
    """(a, b): ids of words (id, word) at exactly one edit, each pair once."""
    n = F.char_length("text").alias("n")
    forward = words.select("id", F.lit(False).alias("back"), F.col("word").alias("text"))
    sides = forward.unionAll(words.select("id", F.lit(True).alias("back"), F.reverse("word").alias("text"))).select("*", n)
    places = work.keep(prefixes(sides))
    branches = places.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high")).filter("low <> high")
    paths = places.join(branches.select("node"), "node", "left_semi").groupBy("id", "back").agg(
        F.array_sort(F.collect_list(F.struct("depth", "node", "next"))).alias("path"))
    # A word's own branches, each with the one after it (none: the word's end).
    steps = paths.join(sides, ["id", "back"]).select(
        "id", "back", "text", "n", F.posexplode("path").alias("k", "here"), F.get("path", F.col("k") + 1).alias("there"))
    steps = work.keep(steps.select(
        "id", "back", "n", "here.depth", "here.node", "here.next", _rest(F.col("text"), F.col("here.depth")).alias("rest"),
        (F.col("there.depth") - F.col("here.depth")).alias("size"), F.col("there.node").alias("child")))
    inner = steps.filter("child IS NOT NULL").select(
        "node", F.col("next").alias("first"), F.expr("left(rest, size)").alias("label"), "child", F.lit(None).cast("long").alias("word")).distinct()
    last = steps.filter("child IS NULL").select("node", F.col("next").alias("first"), F.col("rest").alias("label"), "child", F.col("id").alias("word"))
    edges = work.keep(inner.unionAll(last))

    begin = steps.filter((F.col("rest") != "") & (F.col("depth") >= F.expr("if(back, n - n div 2, n div 2)")))
    begin = begin.select("id", "node", "next", F.expr("substr(rest, 2)").alias("rest")).withColumn("after", F.ascii("rest"))
    met = begin.join(edges, "node").filter((F.col("first") > F.col("next")) | (F.col("first") == F.col("after")))
    replaced = F.when(F.col("first") > F.col("next"), F.expr("substr(label, 2)"))
    dropped = F.when((F.col("first") == F.col("after")) & (F.col("first") != F.col("next")), F.col("label"))
    met = met.select("id", "rest", "child", "word", F.explode(F.array_compact(F.array(replaced, dropped))).alias("label"))
    pairs = None
    while True:
        fits = F.when(F.col("child").isNull(), F.col("rest") == F.col("label")).otherwise(F.col("rest").startswith(F.col("label")))
        states = work.keep(met.filter(fits).select(
            "id", F.col("child").alias("node"), "word", F.expr("substr(rest, char_length(label) + 1)").alias("rest")))
        found = states.filter("word IS NOT NULL").select(F.least("id", "word").alias("a"), F.greatest("id", "word").alias("b"))
        pairs = found if pairs is None else pairs.unionAll(found)
        states = states.filter("word IS NULL").select("id", "node", "rest", F.ascii("rest").alias("first"))
        if states.isEmpty():
            break
        met = states.join(edges, ["node", "first"]).select("id", "rest", "child", "word", "label")
    one, two = (words.select(F.col("id").alias(x), F.col("word").alias(f"w{x}")) for x in "ab")
    return pairs.distinct().join(one, "a").join(two, "b").filter("levenshtein(wa, wb, 1) = 1").select("a", "b")


def group_variants(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of enough code points and occurrences."""
    work = Work(docs.sparkSession)
    counted = count_words(docs, doc, text).filter(F.col("n") >= LEAST_TIMES)
    words = work.keep(counted.withColumn("id", F.monotonically_increasing_id()))
    pairs = work.keep(near_words(work, words))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("n").alias("m"), F.col("word").alias("near"))
    best = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near", "b")).alias("best"))
    better = -F.col("best.m") >= 2 * F.col("n")
    known = work.keep(words.join(best, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.near")).alias("form"),
        F.when(better, -F.col("best.m")).alias("form_n"), F.when(better, F.col("best.b")).alias("to")))
    # Counts at least double from a word to its form, so a path is as short as a count has bits.
    links = work.keep(known.filter("to IS NOT NULL").select("id", "to"))
    while True:
        onward = links.select(F.col("id").alias("to"), F.col("to").alias("far"))
        joined = work.keep(links.join(onward, "to", "left").select("id", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("moved")))
        links = joined.select("id", "to")
        if joined.filter("moved").isEmpty():
            break
    ends = links.join(words.select(F.col("id").alias("to"), F.col("word").alias("end")), "to").select("id", "end")
    return known.join(ends, "id", "left").select(
        "word", "form", F.coalesce("end", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
