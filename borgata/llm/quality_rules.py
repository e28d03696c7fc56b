"""Quality rules with thresholds learnt from the corpus, per language and source.

Every rule looks at one ratio of a document (an integer, so that any engine computes the same).
The ratios of each (language, source) are collected in a quantile sketch: counts over buckets that
keep the eight leading bits of a value, so a quantile is off by less than 1/128 of itself and two
sketches merge by adding counts, in any order and with the same result.  A group is read as half its
own shares and half those of its language, whatever its size: the same mix of documents gets the same
verdicts in fifty rows or in fifty million.  A document fails where a ratio lies outside its group's
fence: quartiles, stretched by ``STRETCH`` times the distance between them and at least by the rule's
slack.  No group's fence goes farther than its language's with twice the language's stretch, so a source full of
junk cannot widen its own.

Null language or source: a group of its own.  Null or empty text: no words, so the base rule
rejects it.  Repeated rows are judged one by one and alike.  A text of any length is counted whole, by one
task.  Ties: values of one bucket share its rank, and a value on the fence passes.  An empty table gives no
rows.  Extra columns of any name are carried along by ``filter_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from borgata import session
from borgata.llm import columns, ragged

WINDOW = 8
STRETCH = 3
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters")

# Ratio of each rule in SQL over the counts (words, lines > 0), its least slack, and whether low
# values fail too.
RULES = {
    "symbols": ("1000 * n_symbols DIV n_words", 100, False),
    "dup_lines": ("1000 * n_dup_lines DIV n_lines", 500, False),
    "repeats": ("1000 * n_repeat_words DIV n_words", 300, False),
    "stutters": ("1000 * n_stutters DIV n_words", 200, False),
    "word_length": ("100 * word_chars DIV n_words", 150, True),
}


def count_slice(t: ragged.Texts) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` of each text."""
    inside = ragged.NOT_BLANK[t.data]
    w = ragged._spans(inside, t)
    hasher = ragged.Hasher(t.data)
    h = hasher.spans(w.start, w.end)
    starts = ragged.within(w, WINDOW)
    keys = ragged.windows(h, WINDOW)[starts] ^ ragged.mix(w.row[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    again = np.zeros(len(keys), bool)
    again[1:] |= same
    again[:-1] |= same
    repeated = ragged.covered(starts[order[again]], WINDOW, len(h))

    stutter = np.zeros(len(h), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])

    spans = ragged.lines(t)
    filled = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(inside, out=filled[1:])
    spans_with = np.flatnonzero(filled[spans.end] > filled[spans.start])
    line_row = spans.row[spans_with]
    line = hasher.spans(spans.start[spans_with], spans.end[spans_with])
    line ^= ragged.mix(line_row.astype(np.uint64) + np.uint64(1))
    by = np.argsort(line)
    twice = line[by][1:] == line[by][:-1]

    def bytes_of(flags: np.ndarray) -> np.ndarray:
        return ragged.per_row(flags, t.offsets)

    return {
        "n_words": w.count,
        "word_chars": bytes_of(inside & ((t.data & 0xC0) != 0x80)),
        "n_symbols": bytes_of(SYMBOLS[t.data]),
        "n_lines": np.bincount(line_row, minlength=t.rows),
        "n_dup_lines": np.bincount(line_row[by][1:][twice], minlength=t.rows),
        "n_repeat_words": ragged.per_row(repeated, w.first),
        "n_stutters": ragged.per_row(stutter, w.first),
    }


def with_counts(df: DataFrame, text: str = "text", prefix: str = "", keep_text: bool = True) -> DataFrame:
    """The rows with their counts, in columns ``prefix + name``."""
    kept = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(prefix + c, T.LongType()) for c in COUNTS]])

    def run(batches):
        for batch, t in ragged.slices(batches, text):
            made = count_slice(t)
            arrays = [batch.column(c) for c in kept] + [pa.array(made[c], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *[prefix + c for c in COUNTS]])

    return df.mapInArrow(run, schema)


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def _ratio(rule: str, prefix: str) -> Column:
    text = RULES[rule][0]
    for c in COUNTS:
        text = text.replace(c, f"`{prefix}{c}`") if c in text else text
    return F.when(F.col(prefix + "n_words") > 0, F.expr(text))


def bucket(value: Column) -> Column:
    """The value with all but its eight leading bits cleared."""
    drop = F.greatest(F.length(F.bin(value)) - 8, F.lit(0))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), drop)
    return value - value % low


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source", prefix: str = "") -> DataFrame:
    """(language, source, rule, bucket, documents): what partitions add up."""
    values = F.array(*[F.struct(F.lit(r).alias("rule"), _ratio(r, prefix).alias("value")) for r in RULES])
    return (
        counted.filter(F.col(prefix + "n_words") > 0)
        .select(F.col(lang).alias("_q_lang"), F.col(source).alias("_q_source"), F.inline(values))
        .groupBy("_q_lang", "_q_source", "rule", bucket(F.col("value")).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame) -> DataFrame:
    """Lowest and highest passing value of each rule for every (language, source)."""
    lang = F.col("_q_lang").eqNullSafe(F.col("_l_lang"))
    shared = sketch.groupBy(F.col("_q_lang").alias("_l_lang"), F.col("rule").alias("_l_rule"),
                            F.col("bucket").alias("_l_bucket")).agg(F.sum("n").alias("_l_n"))
    groups = sketch.select("_q_lang", "_q_source").distinct()
    # All buckets of the language, for each of its groups: own documents plus the language's share.
    both = groups.join(shared, lang).select(
        "_q_lang", "_q_source", F.col("_l_rule").alias("rule"), F.col("_l_bucket").alias("bucket"),
        F.lit(0).cast("long").alias("n"), F.col("_l_n").alias("l"))
    both = both.unionByName(sketch.withColumn("l", F.lit(0).cast("long")))
    both = both.groupBy("_q_lang", "_q_source", "rule", "bucket").agg(F.sum("n").alias("n"), F.sum("l").alias("l"))
    group = Window.partitionBy("_q_lang", "_q_source", "rule")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Weight n / N + l / L of the group's N and the language's L documents, times N * L to stay with whole numbers.
    whole = "DECIMAL(18)"
    ranked = (
        both.withColumn("L_all", F.sum("l").over(group)).withColumn("N_all", F.sum("n").over(group))
        .withColumn("w", F.expr(f"CAST(n AS {whole}) * CAST(L_all AS {whole}) + CAST(l AS {whole}) * CAST(N_all AS {whole})"))
        .withColumn("below", F.sum("w").over(upto)).withColumn("all", F.sum("w").over(group))
        .withColumn("l_below", F.sum("l").over(upto))
    )

    def quantile(quarter: int, below: str, all_: str) -> Column:
        return F.min(F.when(4 * F.col(below) >= quarter * F.col(all_), F.col("bucket")))

    slack = F.create_map(*[F.lit(x) for r in RULES for x in (r, RULES[r][1])])
    low_fails = [r for r in RULES if RULES[r][2]]
    found = ranked.groupBy("_q_lang", "_q_source", "rule").agg(
        quantile(1, "below", "all").alias("q1"), quantile(3, "below", "all").alias("q3"),
        quantile(1, "l_below", "L_all").alias("l1"), quantile(3, "l_below", "L_all").alias("l3"))

    def reach(low: str, high: str) -> Column:
        return F.greatest(STRETCH * (F.col(high) - F.col(low)), F.element_at(slack, F.col("rule")))

    found = found.select(
        "_q_lang", "_q_source", "rule",
        F.least(F.col("q3") + reach("q1", "q3"), F.col("l3") + 2 * reach("l1", "l3")).alias("hi"),
        F.when(F.col("rule").isin(low_fails), F.greatest(
            F.col("q1") - reach("q1", "q3"), F.col("l1") - 2 * reach("l1", "l3"))).alias("lo"))
    wide = [F.max(F.when(F.col("rule") == r, F.col(c))).alias(f"_q_{c}_{r}") for r in RULES for c in ("lo", "hi")]
    return found.groupBy("_q_lang", "_q_source").agg(*wide)


def judged(counted: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source",
           prefix: str = "") -> DataFrame:
    """The counted rows with ``_q_kept``.  The limits' side is left to the engine's size check."""
    same = F.col(lang).eqNullSafe(F.col("_q_lang")) & F.col(source).eqNullSafe(F.col("_q_source"))
    outside = F.lit(False)
    for r in RULES:
        value = _ratio(r, prefix)
        outside = outside | F.coalesce(value > F.col(f"_q_hi_{r}"), F.lit(False))
        outside = outside | F.coalesce(value < F.col(f"_q_lo_{r}"), F.lit(False))
    joined = counted.join(limits, same, "left").withColumn("_q_kept", ~base_failed(prefix) & ~outside)
    return joined.drop(*[c for c in limits.columns])


def filter_documents(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with their own columns."""
    limits = fences(sketches(with_counts(docs.select(text, lang, source), text, "_q_", False), lang, source, "_q_"))
    rows, own = columns.numbered(docs)
    text, lang, source = columns.numbers(docs, text, lang, source)
    return judged(with_counts(rows, text, "_q_"), limits, lang, source, "_q_").filter("_q_kept").select(*own)


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source", "text")
    path = session.scratch_dir(spark, "quality-counts")
    with_counts(docs, keep_text=False).write.parquet(path)
    counted = spark.read.parquet(path)
    return judged(counted, fences(sketches(counted))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), F.col("_q_kept").alias("kept"))
