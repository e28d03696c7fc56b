"""Vector duplicates, ranked search and spelling variants against plain versions."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from borgata.llm import queries, ranked_search, ragged, spelling, vector_dups
from llm_fixtures import ITEMS, SF, VECTORS, edges, empty, pairs  # noqa: F401
from test_llm_queries import given, rows, table  # noqa: F401

Q = queries.QUERIES


def single(x):
    return x if x is None else [y if y is None else float(np.float32(y)) for y in x]


def test_vector_links_of_edge_cases(spark, edges):
    got = Q["op11_vector_dups"](spark, edges)
    want = brute.vector_links([(i, single(v)) for i, v in VECTORS])
    assert rows(got, "vec_id", "n_links", "component_id") == sorted(want, key=repr)
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got.collect())


def clouds(dim=6):
    """A dense cloud around one vector, a chain of links, pairs, copies and vectors apart."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=dim)
    dense = base + 0.12 * np.linalg.norm(base) / math.sqrt(dim) * rng.normal(size=(500, dim))
    turn = np.arange(40) * math.acos(0.9) * 0.97
    chain = np.stack([np.cos(turn), np.sin(turn), *np.zeros((dim - 2, 40))], axis=1)
    apart = rng.normal(size=(300, dim))
    return np.concatenate([dense, chain, apart, apart[:50] + 0.05 * rng.normal(size=(50, dim)), apart[:20], 3 * apart[:20]])


@pytest.mark.parametrize("block", [vector_dups.BLOCK_BYTES, 512 * 48])
@pytest.mark.parametrize("cells", [2, 16])
def test_vector_links_of_clouds(spark, monkeypatch, block, cells):
    monkeypatch.setattr(vector_dups, "BLOCK_BYTES", block)
    monkeypatch.setattr(vector_dups, "FEWEST_CELLS", cells)
    monkeypatch.setattr(vector_dups, "_STEP", 128)
    data = [(i * 7 - 100, [float(y) for y in x]) for i, x in enumerate(clouds())]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    assert rows(vector_dups.find_links(df), "vec", "n_links", "component") == sorted(brute.vector_links(data), key=repr)


def test_dense_bands_are_linked_and_not_compared(spark, monkeypatch):
    """Copies around one pivot: no block compares core with core, however many there are."""
    seen = []
    plan = vector_dups.Join.plan
    monkeypatch.setattr(vector_dups.Join, "plan", lambda self, *a: (plan(self, *a), seen.append(self))[0])
    rng = np.random.default_rng(1)
    x = rng.normal(size=16)
    data = [(i, [float(y) for y in x + 0.02 * rng.normal(size=16)]) for i in range(900)]
    got = vector_dups.find_links(spark.createDataFrame(data, "vec_id long, embedding array<double>"))
    assert {(r["n_links"], r["component"]) for r in got.collect()} == {(899, 0)}
    assert sum(map(len, seen[0].linked.values())) == 1 and not any(seen[0].compared.values())


def test_cells_a_vector_does_not_visit_hold_no_link():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    join = vector_dups.Join(vector_dups.choose_pivots(x[:100], 30, 0.9), 0.9, 100)
    angle = join.angles(x)
    home = angle.argmin(axis=1)
    np.maximum.at(join.radius, home, angle.min(axis=1))
    visited = set(zip(*(v.tolist() for v in join.visits(angle)), strict=True))
    one, two = np.nonzero(x @ x.T >= 0.9)
    assert all((i, home[j]) in visited for i, j in zip(one.tolist(), two.tolist(), strict=True))
    assert len(visited) < 400 * len(join.pivots) / 2


def test_vectors_in_another_range(spark):
    with pytest.raises(ValueError):
        vector_dups.find_links(spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>"), least=1.0)


@pytest.mark.parametrize("most", [ranked_search.QUERY_BYTES, 300])
def test_ranked_search(spark, table, most):
    folder, docs = table
    df = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    got = ranked_search.search(df, bench, most=most)
    assert rows(got, "item", "rank", "doc", "score") == sorted(brute.ranked(docs, items), key=repr)


def test_ranked_search_over_many_blocks(spark, monkeypatch):
    """Ties, copies and rare terms, with blocks of a few documents that carry on what came before."""
    monkeypatch.setattr(ranked_search, "BLOCK_POSTINGS", 40)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = [(i if i % 11 else None, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(1, 40)))) for i in range(600)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(300)]
    items = [(f"i{j}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for j in range(40)] + [("few", "w1 w2 w3")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = ranked_search.search(df, spark.createDataFrame(items, "item_id string, text string"), k=7)
    want = brute.ranked(docs, items, 7)
    # Rows without id cannot be told apart in a tie.
    assert rows(got, "item", "rank", "doc", "score") == sorted(want, key=repr)


def test_bounds_hold_and_prune():
    """The greatest impact of any interval, and a search that scores few documents."""
    rng = np.random.default_rng(2)
    docs, terms = 4000, 6
    row, term = np.nonzero(rng.random((docs, terms)) < 0.5)
    impact = np.minimum(rng.pareto(1.5, len(row)) * 100 + 1, 1e6).astype(np.int64)
    block = ranked_search.Block(np.arange(docs), np.zeros(docs, bool), row, term, impact, terms)
    for _ in range(200):
        t = rng.integers(terms)
        low, high = sorted(rng.integers(block.first[t], block.first[t + 1] + 1, 2))
        bound, doc = block.greatest(np.array([[low]]), np.array([[high]]))
        inside = block.impact[low:high]
        assert bound[0] == inside.max(initial=0)
        assert low == high or inside[(block.key[low:high] % docs) == doc[0]][0] == inside.max()
    scored = []
    greatest = block.greatest
    block.greatest = lambda low, high: (scored.append(len(low)), greatest(low, high))[1]
    best = []
    block.search(np.arange(terms), best, 10)
    total = np.bincount(row, impact, docs).astype(np.int64)
    want = sorted((-s, False, i) for i, s in enumerate(total.tolist()))[:10]
    assert best == want and sum(scored) < docs


def test_spelling(spark, table):
    folder, docs = table
    got = Q["op13_spelling"](spark, folder)
    assert rows(got, "word", "form", "root", "n", "n_near", "form_n") == sorted(brute.variants(docs), key=repr)


def test_spelling_of_made_words(spark):
    """Runs of one letter, words that are others' beginnings or ends, accents, ties, chains of forms, very long words."""
    rng = random.Random(9)
    words = ["a" * k for k in range(4, 12)] + ["b" + "a" * k for k in range(4, 9)] + ["ÀÀàÀà", "àÀàÀà", "éclair", "eclair", "écl×ir"]
    words += ["".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(400)]
    long = "".join(rng.choices("xyz", k=5000))
    words += [long, long[:4000] + "a" + long[4000:], long[:10] + long[11:], long + "q", long[::-1]]
    docs = [(k, " ".join([w] * rng.choice([1, 3, 7, 20])) + f"{rng.randint(0, 9)}_") for k, w in enumerate(words * 2)]
    df = spark.createDataFrame([*docs, (None, "aaaaa AAAAA-aaaaa"), (None, None), (7, "")], "doc_id long, text string").repartition(3)
    got = rows(spelling.group_variants(df), "word", "form", "root", "n", "n_near", "form_n")
    assert got == sorted(brute.variants([*docs, (None, "aaaaa AAAAA-aaaaa")]), key=repr)


def test_crc_of_spans():
    rng = np.random.default_rng(8)
    data = rng.integers(0, 256, 4000).astype(np.uint8)
    start = rng.integers(0, 3000, 300)
    end = start + np.where(rng.random(300) < 0.1, rng.integers(60, 900, 300), rng.integers(0, 20, 300))
    before = [zlib.crc32(b"%d:" % i) for i in range(300)]
    got = spelling.crc32(data, start, end, np.array(before, np.uint32))
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes(), c) for a, b, c in zip(start, end, before, strict=True)]


def test_only_second_halves_begin_a_state(spark):
    """No state begins at a node that a large part of the words share."""
    texts = spark.createDataFrame([(i, f"{i:05d}".translate(str.maketrans("0123456789", "abcdefghij"))) for i in range(2000)], "id long, word string")
    sides = texts.select("id", F.lit(False).alias("back"), F.col("word").alias("text"), F.char_length("word").alias("n"))
    places = spelling.prefixes(sides)
    assert places.agg(F.min("depth")).first()[0] == 2
    assert places.groupBy("node").count().agg(F.max("count")).first()[0] <= 2000


def test_letter_runs():
    import pyarrow as pa
    texts = ["abc×ÿ d1é", "Ā a", "", "éé", "¿aÀ"]
    t = ragged.texts_of(pa.array(texts))
    w = spelling.letters(ragged.Texts(ragged.LOWER[t.data], t.offsets))
    got = [(r, t.data[a:b].tobytes().decode()) for a, b, r in zip(w.start, w.end, w.row, strict=True)]
    assert got == [(0, "abc×ÿ"), (0, "d"), (0, "é"), (1, "a"), (3, "éé"), (4, "aÀ")]
