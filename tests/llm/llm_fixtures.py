"""Fixtures of the tests in this folder, imported by them."""

import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977} q{i % 31}" for i in range(30_000))
BODY = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ROWS = [
    (1, f"{BODY}\nThis line is shared by many\nshort\nshort", "en", "a"),
    (2, f"{BODY}\nthis LINE is shared by many  \nshort", "en", "a"),
    (2, f"{BODY}\nthis LINE is shared by many  \nshort", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "a"),
    (5, " \t\n\n ", "en", "a"),
    (6, LONG, "en", "a"),
    (7, LONG + " end", "en", "b"),
    (8, "Released under the MIT License. MIT license; cc by and CC-BY the GNU general public license", "en", "b"),
    (9, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. ÀÉ è", "fr", "b"),
    (10, "à b", "fr", "b"), (11, "à b", "fr", "b"), (12, "À b", "fr", "b"),
    (None, "a row without an id: This line is shared by many\nThis line is shared by many", None, None),
    (None, f"{BODY}\nnobody", None, None),
    (13, "#*$%&|<> " * 40, "en", "a"),
    (14, "go go go " * 30, "en", "a"),
    (15, "x\n" * 50 + "▁ mark <|endoftext|> <s> \x00   \x1c tail" + "    spaces  ", "en", "a"),
    (-3, f"{BODY} a b c d e f g", "en", "a"),
]
ITEMS = [(1, BODY), (2, "à b"), (3, None), (4, "--"), (None, "shared by many"), (5, BODY)]
_A, _B = [3.0, 1.0, 0.0, -2.0], [3.0, 1.2, 0.1, -2.0]
VECTORS = [
    (1, _A), (2, _A), (2, _B), (3, [2 * x for x in _A]), (None, _A), (4, None), (5, []), (6, [0.0] * 4), (7, [0.0, -0.0, 0.0, 0.0]),
    (8, [1.0, None, 0.0, 0.0]), (9, [float("nan"), 1.0, 0.0, 0.0]), (10, [float("inf"), 1.0, 0.0, 0.0]), (11, [-x for x in _A]),
    (12, [3.0, 1.0, 0.0]), (13, [3.0, 1.0, 0.0]), (14, [1e-30, 0.0, 0.0, 0.0]), (15, [1e30, 0.0, 0.0, 0.0]), (-5, [1.0]), (16, [7.0]),
    (17, [0.1, 0.1, 0.1, 1.0]), (18, [0.1, 0.1, 0.1, 1.1]), (18, [0.1, 0.1, 0.1, 1.1]),
]
EXTRA = ("_text string, doc long, rep long, n long, key string, node long, block long, train boolean, h long, word string, "
         "score double, rule string, value long, size long, shard int, slot long, ids string, a long, b long, n_words long")


@pytest.fixture(scope="session")
def edges(spark, tmp_path_factory):
    """A folder with tables of edge cases and clashing column names; its documents as (id, text)."""
    folder = tmp_path_factory.mktemp("edges")
    extra = EXTRA.count(",") + 1
    docs = spark.createDataFrame([(*r, *[None] * extra) for r in ROWS], f"doc_id long, text string, lang string, source string, {EXTRA}")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = [(1, 1, 0), (2, 1, 0), (13, 0, 0), (14, 0, 0), (8, 1, 0), (99, 1, 0), (None, 1, 0), (5, None, 0), (15, 0, 0), (6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(*v, None, None, None) for v in VECTORS],
                          "vec_id long, embedding array<float>, cls long, v double, cell long").repartition(2).write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def pairs():
    return [r[:2] for r in ROWS]
