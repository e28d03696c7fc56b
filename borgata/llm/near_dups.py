"""Near-duplicates by chosen-path set similarity join.

A document's set of five-word shingles is summarised by ``WIDTH`` minwise tokens.  Each of ``TREES``
independent trees puts every document into the root node of one minwise token; a pair of similarity
0.75 shares a given root with probability 0.75, so sixteen miss it together with probability 2e-10.
Nodes of up to ``SMALL`` sets are leaves.  Larger ones branch: a node chooses one further minwise
token, and with probability 1/3 a second, and its members go to the children of their own values, so
that a pair at the threshold is expected to meet in one child at every depth (1 / 0.75).

Documents with equal sets are one class from the start.  What is asked for are components, so pairs
are compared in two steps.  First every node's members with its smallest member, a number of pairs
linear in the members; confirmed links give components that gather the groups of copies.  Then the
leaves are compared exhaustively, but only between members of different components: no other pair can
change the result.  A member drops out first if too few of its minwise tokens occur in any other
member, and a pair if its sizes and the number of each set's shingles that occur in any other member
rule the similarity out: variants of one text that have drifted too far from it are not compared with
all its other variants.  A node that is still large after ``DEPTH`` levels is compared the same way,
so nothing is capped.  Pairs whose minwise tokens agree in less than half of the places are left out (a
pair of similarity 0.75 agrees so rarely with probability 1e-9); all others are confirmed by exact
counts on their full sets.

No words or null text: an empty set, linked with nothing.  Fewer than five words: one shingle.  A row
without id cannot be named: it is kept and has no component.  Rows that repeat an id are one document.
An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borgata import session
from borgata.llm import columns, ragged

SHINGLE = 5
LEAST_PERCENT = 75
WIDTH = 128
TREES = 16
SMALL = 32
DEPTH = 2
AGREE = WIDTH // 2
#: Of so many minwise tokens a pair of similarity 0.75 shares so many, but for one in 1e8.
MARKS, FEW_MARKS = 32, 10
#: Bits of the filter over ids whose texts are fetched: 8 MB at most.
FILTER_BITS = 1 << 26

_seeded = np.random.default_rng(75)
_FACTOR = _seeded.integers(1, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _seeded.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def shingle_sets(t: ragged.Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text after text, and the index of each text's first."""
    data = ragged.LOWER[t.data]
    w = ragged.words(ragged.Texts(data, t.offsets), ragged.NOT_BLANK)
    h = ragged.Hasher(data).spans(w.start, w.end)
    starts = ragged.within(w, size)
    hashes, rows = [ragged.windows(h, size)[starts]], [w.row[starts]]
    for few in range(1, size):
        short = np.flatnonzero(w.count == few)
        if len(short):
            hashes.append(ragged.windows(h, few)[w.first[short]])
            rows.append(short)
    value, row = np.concatenate(hashes), np.concatenate(rows)
    by_row = np.argsort(row, kind="stable")
    value, row = value[by_row], row[by_row]
    key = value ^ ragged.mix(row.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    once = np.ones(len(key), bool)
    once[order[1:][key[order][1:] == key[order][:-1]]] = False
    value, row = value[once], row[once]
    return value, np.searchsorted(row, np.arange(t.rows + 1))


def minwise(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of tokens for each text with a set, as 32-bit names of the smallest value."""
    filled = first[:-1][np.diff(first) > 0]
    out = np.empty((len(filled), WIDTH), np.int32)
    for k in range(WIDTH if len(filled) else 0):
        least = np.minimum.reduceat(value * _FACTOR[k] + _SHIFT[k], filled)
        out[:, k] = (least & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
    return out


def summaries(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, n, f1, f2, tokens): size, 128-bit fingerprint and minwise tokens of each row's set."""

    def run(batches):
        for batch, t in ragged.slices(batches, "_text"):
            value, first = shingle_sets(t)
            sums = []
            for seed in (0x51ED270B, 0x2545F491):
                total = np.zeros(len(value) + 1, np.uint64)
                np.cumsum(ragged.mix(value ^ np.uint64(seed)), out=total[1:])
                sums.append(pa.array((total[first[1:]] - total[first[:-1]]).view(np.int64)))
            n = np.diff(first)
            tokens = minwise(value, first)
            offsets = np.zeros(t.rows + 1, np.int32)
            np.cumsum(np.where(n > 0, WIDTH, 0), out=offsets[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n), *sums, pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens.ravel()))],
                names=["doc", "n", "f1", "f2", "tokens"])

    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc long, n long, f1 long, f2 long, tokens array<int>")


class Work:
    """Tables written once below one shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, session.scratch_dir(spark, "near-dups"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def grow_trees(work: Work, reps: DataFrame) -> DataFrame:
    """(node, rep, n, pivot, pivot_n, members, leaf) of all nodes with two members or more, of all levels."""
    roots = reps.select("rep", "n", F.posexplode(F.slice("tokens", 1, TREES)).alias("k", "token"))
    nodes = roots.select(F.xxhash64("k", "token").alias("node"), "rep", "n")
    levels = None
    for depth in range(DEPTH + 1):
        nodes = work.keep(nodes)
        sizes = nodes.groupBy("node").agg(
            F.count("*").alias("members"), F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pivot_n")).filter("members > 1")
        level = work.keep(nodes.join(sizes, "node").withColumn("leaf", (F.col("members") <= SMALL) | F.lit(depth == DEPTH)))
        levels = level if levels is None else levels.unionByName(level)
        large = level.filter(~F.col("leaf"))
        if depth == DEPTH or large.isEmpty():
            break
        own = WIDTH - TREES

        def chosen(seed: int):
            return (F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(own)) + TREES).cast("int")

        second = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(3)) == 0, chosen(2))
        places = F.array_compact(F.array(chosen(1), second))
        nodes = (
            large.join(reps.select("rep", "tokens"), "rep")
            .select("node", "rep", "n", "tokens", F.explode(F.array_distinct(places)).alias("k"))
            .select(F.xxhash64("node", "k", F.get("tokens", F.col("k"))).alias("node"), "rep", "n")
        )
    return levels


def _likely(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and minwise tokens allow the similarity."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy().reshape(-1, WIDTH) for c in ("ta", "tb"))
            likely = (left == right).sum(axis=1) >= AGREE
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    one, two = (reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").filter(
        100 * F.least("na", "nb") >= LEAST_PERCENT * F.greatest("na", "nb"))
    return sized.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _id_places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    return [ragged.mix(ids.view(np.uint64) + np.uint64(seed)) % np.uint64(bits) for seed in (11, 12, 13)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the ids, of fixed greatest size: fuller it lets more through, never less."""
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * ids.count()).bit_length()))

    def mark(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for place in _id_places(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(words, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["at", "word"])

    out = np.zeros(bits // 64, np.int64)
    marked = ids.mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    for batch in marked.toArrow().to_batches():
        out[batch.column("at").to_numpy()] = batch.column("word").to_numpy()
    return out.view(np.uint64)


def full_sets(docs: DataFrame, ids: DataFrame, doc: str, text: str) -> DataFrame:
    """(rep, members) of the documents named in ``ids``: sorted shingle hashes, eight bytes each.

    The filter thins the texts out before the join that decides; without it all texts would move."""
    words = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def pick(batches):
        table = words.value
        for batch in batches:
            passing = np.ones(batch.num_rows, bool)
            for place in _id_places(batch.column("rep").to_numpy(), 64 * len(table)):
                passing &= table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
            yield batch.filter(pa.array(passing))

    def run(batches):
        for batch, t in ragged.slices(batches, "_text"):
            value, first = shingle_sets(t)
            sets = [np.sort(value[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "members"])

    rows = docs.select(F.col(doc).cast("long").alias("rep"), F.col(text).alias("_text")).filter("rep IS NOT NULL")
    picked = rows.mapInArrow(pick, "rep long, _text string")
    return picked.join(ids, "rep", "left_semi").mapInArrow(run, "rep long, members binary")


def comparable(work: Work, ids: DataFrame, reps: DataFrame) -> DataFrame:
    """The ids enough of whose minwise tokens are some other id's too."""
    marks = reps.join(ids, "rep", "left_semi").select("rep", F.posexplode(F.slice("tokens", 1, MARKS)).alias("k", "token"))
    shared = marks.groupBy("k", "token").agg(F.count("*").alias("times")).filter("times > 1")
    return work.keep(marks.join(shared, ["k", "token"], "left_semi").groupBy("rep").agg(F.count("*").alias("times"))
                     .filter(F.col("times") >= FEW_MARKS).select("rep"))


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(rep, shared): how many of its shingles are in any other of the sets."""

    def run(batches):
        for batch in batches:
            for rep, members in zip(batch.column("rep").to_pylist(), batch.column("members"), strict=True):
                values = np.frombuffer(members.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), rep)), pa.array(values)], names=["rep", "s"])

    each = sets.mapInArrow(run, "rep long, s long")
    several = each.groupBy("s").agg(F.count("*").alias("times")).filter("times > 1")
    return each.join(several, "s", "left_semi").groupBy("rep").agg(F.count("*").alias("shared"))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with their sets' sizes and how much is in both, counted on the full sets."""

    def run(batches):
        for batch in batches:
            counts = []
            for x, y in zip(batch.column("ma"), batch.column("mb"), strict=True):
                left, right = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                counts.append((len(left), len(right), len(np.intersect1d(left, right, assume_unique=True))))
            na, nb, both = np.array(counts, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), *[pa.array(np.ascontiguousarray(x)) for x in (na, nb, both)]],
                names=["a", "b", "na", "nb", "both"])

    one, two = (sets.select(F.col("rep").alias(x), F.col("members").alias(f"m{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ma", "mb").mapInArrow(
        run, "a long, b long, na long, nb long, both long")


def _reached(both: Column) -> Column:
    """Whether so many common shingles reach the similarity."""
    return (100 + LEAST_PERCENT) * both >= LEAST_PERCENT * (F.col("na") + F.col("nb"))


def components(work: Work, links: DataFrame) -> DataFrame:
    """(rep, component): smallest id reachable, for every id that has a link.

    Smallest label of the neighbours, then the label's own label, until nothing changes; a hub's
    neighbours meet in an aggregation with partial results, never in a group."""
    both = work.keep(links.select("a", "b").unionAll(links.select("b", "a")).distinct())
    labels = work.keep(both.groupBy(F.col("a").alias("rep")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("rep").alias("b"), "component"), "b")
        least = heard.groupBy(F.col("a").alias("rep")).agg(F.min("component").alias("heard"))
        new = labels.join(least, "rep").select("rep", F.least("component", "heard").alias("near"), F.col("component").alias("old"))
        jump = labels.select(F.col("rep").alias("near"), F.col("component").alias("far"))
        new = work.keep(new.join(jump, "near", "left").select(
            "rep", F.least("near", F.coalesce("far", "near")).alias("component"), "old"))
        labels = new.select("rep", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def find_components(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n, component) of every row."""
    spark = docs.sparkSession
    work = Work(spark)
    found = work.keep(summaries(docs, doc, text))
    known = found.filter("n > 0 AND doc IS NOT NULL")
    classes = known.groupBy("f1", "f2", "n").agg(F.min("doc").alias("rep"))
    reps = work.keep(known.join(classes.select(F.col("rep").alias("doc"), "f1", "f2", "n"), ["doc", "f1", "f2", "n"], "left_semi")
                     .dropDuplicates(["doc", "f1", "f2", "n"]).select(F.col("doc").alias("rep"), "n", "tokens"))
    nodes = grow_trees(work, reps)
    # Members against their node's smallest, where the sizes allow the similarity.
    close = 100 * F.least("n", "pivot_n") >= LEAST_PERCENT * F.greatest("n", "pivot_n")
    stars = work.keep(nodes.filter((F.col("rep") != F.col("pivot")) & close).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct())
    first = work.keep(_likely(stars, reps))
    ids = first.select(F.col("a").alias("rep")).unionAll(first.select("b")).distinct()
    sets = work.keep(full_sets(docs, ids, doc, text))
    counted = work.keep(_overlaps(first, sets))
    links = counted.filter(_reached(F.col("both")))
    labels = components(work, links)
    # Leaves whose members are not all in one component: every pair across components.
    leaves = nodes.filter("leaf").select("node", "rep", "pivot").join(labels, "rep", "left")
    leaves = leaves.select("node", "rep", "pivot", F.coalesce("component", "rep").alias("component"))
    mixed = leaves.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    leaves = work.keep(leaves.join(mixed.select("node"), "node", "left_semi"))
    able = comparable(work, leaves.select("rep").distinct(), reps)
    more = able.join(sets.select("rep"), "rep", "left_anti")
    sets = sets.unionByName(work.keep(full_sets(docs, more, doc, text)))
    sizes = shared_sizes(sets.join(able, "rep", "left_semi"))
    leaves = leaves.join(sizes, "rep").join(reps.select("rep", "n"), "rep")
    # Each member's reference: the smallest member of a node, the one with which it shares most, else itself; and
    # the shingles beside the reference that any other member holds (all such, if the reference is not
    # comparable itself).
    best = counted.groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("both", -F.col("a"))).alias("best"))
    best = best.select("rep", (-F.col("best.col2")).alias("ref"), F.col("best.both").alias("both"))
    leaves = leaves.join(best, "rep", "left").select(
        "node", "rep", "component", "shared", "n", F.coalesce("ref", "rep").alias("ref"), F.coalesce("both", "n").alias("both"))
    leaves = leaves.join(able.select(F.col("rep").alias("ref"), F.lit(1).alias("able")), "ref", "left")
    beside = F.when(F.col("able").isNotNull(), F.col("shared") - F.col("both")).otherwise(F.col("n") - F.col("both"))
    # A member is in a few dozen leaves at most; a pair is made in the first leaf that both are in.
    places = leaves.groupBy("rep").agg(F.collect_set("node").alias("places"))
    leaves = work.keep(leaves.withColumn("beside", beside).join(places, "rep"))
    one, two = (leaves.select("node", F.col("rep").alias(x), F.col("component").alias(f"c{x}"), F.col("n").alias(f"n{x}"),
                              F.col("shared").alias(f"s{x}"), F.col("both").alias(f"p{x}"), F.col("beside").alias(f"r{x}"),
                              F.col("ref").alias(f"f{x}"), F.col("places").alias(f"l{x}"))
                for x in "ab")
    # No more shingles than these can be in both.
    most = F.least("sa", "sb")
    most = F.when(F.col("fa") == F.col("fb"), F.least(most, F.least("pa", "pb") + F.least("ra", "rb"))).otherwise(most)
    pairs = one.join(two, (one["node"] == two["node"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                     & _reached(most) & (one["node"] == F.array_min(F.array_intersect("la", "lb"))))
    pairs = pairs.select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    across = work.keep(_overlaps(work.keep(_likely(pairs, reps)), sets)).filter(_reached(F.col("both"))).select("a", "b")
    if not across.isEmpty():
        old = labels.filter("rep <> component").select(F.col("rep").alias("a"), F.col("component").alias("b"))
        labels = components(work, old.unionByName(across))
    named = classes.join(labels, "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    out = found.select("doc", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    # A set-less document is its own component.
    own = F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc"))
    return out.select("doc", "n", own.alias("component"))


def drop_near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that are not the smallest of their component."""
    found = find_components(docs, doc, text)
    gone = found.filter("component <> doc").select(F.col("doc").alias("gone")).distinct()
    rows, own = columns.numbered(docs)
    return rows.join(gone, F.col(columns.numbers(docs, doc)[0]) == F.col("gone"), "left_anti").select(*own)


def op4_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return find_components(docs).select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("doc") == F.col("component"), F.lit(True)).alias("kept"))
