"""Language-model scores follow the order of words."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from borgata.llm import lm_scoring, queries, ragged


def test_meetings_of_words():
    texts = ["ab c", None, "", "Déjà ab", " ab ", "c"]
    t = ragged.texts_of(pa.array(texts, pa.string()))
    data, w, h = lm_scoring.tokens_of(t)
    words = [x.lower().encode().replace("À".encode(), "à".encode()) for text in texts for x in (text or "").split()]
    known = np.sort([h[words.index(b"ab")]])
    inner, ends = [], []
    for text in texts:
        before, left = 1, b"  "
        for x in [*((text or "").lower().encode().split()), b"\xff"]:
            m = before << 32 | left[0] << 24 | left[1] << 16 | x[0] << 8 | (x + b" ")[1]
            (ends if x == b"\xff" else inner).append(m)
            before, left = (2 if x == b"ab" else 0), (b" " + x)[-2:]
    assert lm_scoring.meetings_of(t, data, w, h, known).tolist() == inner + ends
    none = lm_scoring.meetings_of(t, data, w, h, known[:0]).tolist()
    assert [m & 0xFFFFFFFF for m in none] == [m & 0xFFFFFFFF for m in inner + ends] and all(m >> 32 < 2 for m in none)


def test_first_bytes_and_the_rest_are_all_bits():
    code = lm_scoring.Code(np.arange(256))
    counts = lm_scoring.Counts(code, np.arange(9, dtype=np.uint64), np.ones(9, np.int64), *(np.zeros(0, k) for k in (np.uint64, np.int64, np.int64)))
    for word in (b"a", b"ab", b"abc", b"\xff", b"language"):
        meeting = np.array([(word[0] << 8) | (word + b" ")[1]], np.uint64)
        begun, rest = lm_scoring.Beginnings(meeting, code), lm_scoring.Decisions([word], np.ones(1), code, counts, lm_scoring.MET)
        whole = lm_scoring.Decisions([word], np.ones(1), code, counts)
        assert [*begun.bit, *rest.bit] == whole.bit.tolist()


def test_shuffled_words_score_lower(spark):
    queries.ship(spark)
    line = "the cat sat on the mat and the dog ran to the door"
    words = sorted(line.split())
    rows = [(i, line, True) for i in range(40)] + [(50 + i, w, True) for i, w in enumerate(words)]
    rows += [(100, line, False), (101, " ".join(words), False), (102, " ".join(reversed(words)), False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc"]: r for r in lm_scoring.score_documents(docs, train=F.col("train")).filter("doc >= 100").collect()}
    assert got[100]["score"] > got[101]["score"] + 1 and got[100]["score"] > got[102]["score"] + 1
    assert got[100]["n_tokens"] == got[101]["n_tokens"] and abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-9
