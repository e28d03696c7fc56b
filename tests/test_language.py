"""Languages by byte-pair profiles."""

from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as entry
from borgata.operators import language

TRAIN = [("en", "the house and the garden of the town"), ("en", "this is the other one that was there"),
         ("it", "il giardino della casa che non è grande"), ("it", "questo è un altro che abbiamo"), (None, "zzzz qqqq")]


def _found(table, rows, train=TRAIN):
    docs = table(rows, "id long, text string")
    out = language.detect(docs, table(train, "lang string, text string"), "id")
    return {r["id"]: (r["detected"], r["lead"]) for r in out.collect()}


def test_known_unknown_empty_and_null(table):
    rows = [(1, "the other town"), (2, "che grande giardino"), (3, ""), (4, None), (5, "x"), (6, "€€"), (7, "the " * 50_000)]
    found = _found(table, rows)
    assert found[1][0] == "en" and found[2][0] == "it" and found[7][0] == "en"
    assert found[3] == found[4] == found[5] == (None, None) and found[6] == (None, None)
    assert found[7][1] > found[1][1] > 0


def test_ties_take_the_first_code_and_one_language_has_no_lead(table):
    same = [("it", "abab"), ("de", "abab")]
    assert _found(table, [(1, "ab")], same)[1] == ("de", 0)
    assert _found(table, [(1, "ab")], same[:1])[1] == ("it", None)


def test_rows_of_one_key_and_null_keys_are_one_text_each(table):
    found = _found(table, [(1, "the other town"), (1, "the garden"), (None, "che non è")])
    assert len(found) == 2 and found[1][0] == "en" and found[None][0] == "it"


def test_empty_tables(table):
    assert _found(table, []) == {}
    assert _found(table, [(1, "the")], []) == {1: (None, None)}


def test_weights_equal_a_plain_count(table):
    got = {bytes(r["pair"]): r["w_0"] for r in language.profiles(
        table([("a", "aba"), ("b", "bb")], "lang string, text string"), "text", "lang", ["a", "b"]).collect()}
    import math

    # Three pairs in all; 'a' has two of them once each.
    assert got == {b"ab": math.floor(1000 * math.log(2 / 5)), b"ba": math.floor(1000 * math.log(2 / 5)),
                   b"bb": math.floor(1000 * math.log(1 / 5))}


def test_better_than_the_vote_on_texts_not_learnt_from(spark):
    rows = {r["held_out"]: r for r in entry.queries()["language_accuracy"](spark, SF.replace("0.001", "0.01")).collect()}
    held = rows[True]
    assert held["by_profile"] >= 0.95 * held["n"] and held["by_profile"] >= held["by_stop_words"]


def test_texts_are_not_shuffled(spark, executed):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = executed(language.detect(docs.select("doc_id", "text"), docs, "doc_id"))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "SortAggregate" not in plan
