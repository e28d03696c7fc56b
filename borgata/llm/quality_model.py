"""Quality classifier on learned subword embeddings.

A text's features are hashed into ``BUCKETS`` rows of an embedding table: its words, the pairs of
neighbouring words, the character n-grams of ``GRAMS`` bytes inside words and at their ends, and a
mark beside each word that says whether it, or the eight words it starts, stood in the text before.
A document is the average of its features' vectors; a softmax over two classes reads that average.
The table and the softmax are learned together by numpy stochastic gradient descent.

Only the fit uses a sample: the ``SAMPLE`` documents per class with the smallest hash of their id,
among labelled rows whose crc32(doc_id as text) mod 3 is not 1, read whole in one task.  Class
shares come from counts of all those labels.  Scoring covers every document: as the softmax reads a
mean, each bucket's vector folds to one number, and a score is the mean of those numbers.

Null or empty text: the average of nothing, so the bias alone.  Null labels and labels of unknown
documents are left out; without any label every score is 0.5, with labels of one class only their
share counts.  Repeated rows are each scored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borgata.llm import ragged

BUCKETS = 1 << 17
WIDTH = 8
GRAMS = (3, 4, 5)
SAMPLE = 1500
EPOCHS = 6
RATE = 0.5
_WORD, _PAIR, _AGAIN, _PHRASE = (np.uint64(x) for x in (0x1F83D9AB, 0x5BE0CD19, 0x3C6EF372, 0xA54FF53A))


def features(t: ragged.Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every feature of every text."""
    data = ragged.LOWER[t.data]
    data = np.where(ragged.BLANK[data], np.uint8(32), data)
    low = ragged.Texts(data, t.offsets)
    hasher = ragged.Hasher(data)
    w = ragged.words(low, ragged.NOT_BLANK)
    h = hasher.spans(w.start, w.end)
    values, rows = [ragged.mix(h ^ _WORD)], [w.row]

    two = ragged.within(w, 2)
    values.append(ragged.windows(h, 2)[two] ^ _PAIR)
    rows.append(w.row[two])

    def seen_before(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        key = hashes ^ ragged.mix(w.row[at].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order][1:] == key[order][:-1]
        return again

    # Marks, not words: 0 or 1 for "again", and whether the word repeats its neighbour.
    every = np.arange(len(h))
    mark = seen_before(h, every).astype(np.uint64)
    if len(h):
        mark[1:] += np.uint64(2) * ((h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1]))
    values.append(ragged.mix(mark + _AGAIN))
    rows.append(w.row)
    eight = ragged.within(w, 8)
    phrase = seen_before(ragged.windows(h, 8)[eight], eight)
    values.append(ragged.mix(phrase.astype(np.uint64) + _PHRASE))
    rows.append(w.row[eight])

    blanks = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data == 32, out=blanks[1:])
    heads = np.zeros(len(data) + 1, np.int32)
    np.add.at(heads, t.offsets[:-1], 1)
    text_at = np.cumsum(heads[:len(data)]) - 1
    for n in GRAMS:
        if len(data) < n:
            continue
        at = np.arange(len(data) - n + 1)
        inner = blanks[at + n - 1] == blanks[at + 1]
        at = at[inner & (text_at[at] == text_at[at + n - 1])]
        values.append(hasher.spans(at, at + n))
        rows.append(text_at[at])
    value, row = np.concatenate(values), np.concatenate(rows)
    return (value >> np.uint64(47)).astype(np.int32), row


def _sums(bucket_value: np.ndarray, t: ragged.Texts) -> tuple[np.ndarray, np.ndarray]:
    bucket, row = features(t)
    return (np.bincount(row, bucket_value[bucket], minlength=t.rows),
            np.bincount(row, minlength=t.rows))


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 3) -> tuple[np.ndarray, float]:
    """One number per bucket and the bias, from (label, buckets, shares) of each sample document."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((2, WIDTH), np.float32)
    bias = np.zeros(2, np.float32)
    steps = EPOCHS * len(samples)
    for step, k in enumerate(np.concatenate([rng.permutation(len(samples)) for _ in range(EPOCHS)]) if samples else ()):
        label, bucket, share = samples[k]
        rate = np.float32(RATE * (1 - step / steps))
        mean = share @ table[bucket]
        score = out @ mean + bias
        p = np.exp(score - score.max())
        p /= p.sum()
        p[label] -= 1
        back = p @ out
        out -= rate * np.outer(p, mean)
        bias -= rate * p
        # The mean spreads a step over all its features; each bucket is named once, so this adds right.
        table[bucket] -= rate * np.minimum(share * len(share), 4)[:, None] * back
    return table @ (out[1] - out[0]), float(bias[1] - bias[0])


def trained(labelled: DataFrame, text: str = "text", label: str = "quality", row_id: str = "doc_id",
            docs: DataFrame | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on the (row_id, label) rows of ``labelled`` and the texts of ``docs``."""
    rows = labelled.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    if not counts:
        return np.zeros(BUCKETS), 0.0
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    if len(counts) < 2:
        return np.zeros(BUCKETS), prior
    order = F.xxhash64(row_id)
    chosen = [rows.filter(F.col(label) == c).select(row_id, F.col(label).cast("int").alias("_label"), order.alias("_order"))
              .orderBy("_order", row_id).limit(sample) for c in (0, 1)]
    texts = docs.select(row_id, F.col(text).alias("_text")).join(chosen[0].unionByName(chosen[1]), row_id)

    def learn(batches):
        samples = []
        for batch, t in ragged.slices(batches, "_text"):
            bucket, row = features(t)
            by_row = np.argsort(row, kind="stable")
            bucket, first = bucket[by_row], np.searchsorted(row[by_row], np.arange(t.rows + 1))
            for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                used, n = np.unique(bucket[a:b], return_counts=True)
                if len(used):
                    share = (n / n.sum()).astype(np.float32)
                    samples.append((batch.column("_order")[k].as_py(), batch.column("_label")[k].as_py(), used, share))
        samples.sort(key=lambda s: (s[0], s[1]))
        weights, bias = fit([s[1:] for s in samples])
        used = min(counts[0], sample), min(counts[1], sample)
        # The sample is balanced; the scores follow all labels.
        bias += prior - float(np.log(used[1] / used[0]))
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float32).tobytes()]), pa.array([bias])], names=["weights", "bias"])

    found = texts.repartition(1).mapInArrow(learn, "weights binary, bias double").first()
    return np.frombuffer(found["weights"], np.float32), found["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: list[str] | None = None,
           prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default all) of every row with its ``score``."""
    keep = docs.columns if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(prefix + "score", T.DoubleType())])

    def run(batches):
        weights, bias = shared.value
        for batch, t in ragged.slices(batches, text):
            total, n = _sums(weights, t)
            score = 1 / (1 + np.exp(-(total / np.maximum(n, 1) + bias)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(score)], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op3_quality_model(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").filter(fold != 1)
    found = scored(docs, trained(labels, docs=docs), keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))
