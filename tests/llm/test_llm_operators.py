"""Operators beyond their queries: other parameters, other forms, parts by themselves."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from borgata.llm import decontaminate, licenses, line_dedup, lm_scoring, near_dups, pieces, quality_rules, queries, ragged, sharding, token_counts
from llm_fixtures import edges, pairs  # noqa: F401

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t'1.,▁  世", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_ragged_words_and_lines(texts):
    t = ragged.texts_of(pa.array(texts, pa.string()))
    w = ragged.words(t, ragged.NOT_BLANK)
    words = [t.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end)]
    assert words == [x for text in texts for x in brute.NOT_BLANK.findall(text or "")]
    assert w.count.tolist() == [len(brute.NOT_BLANK.findall(x or "")) for x in texts]
    spans = ragged.lines(t)
    lines = [t.data[a:b].tobytes().decode() for a, b in zip(spans.start, spans.end)]
    assert lines == [x for text in texts for x in (text or "").split("\n")]
    h = ragged.Hasher(t.data).spans(w.start, w.end)
    assert len(set(h.tolist())) == len(set(words))


def test_slices_cover_all_rows():
    batch = pa.record_batch({"i": list(range(50)), "t": ["x" * (k % 7) * 3 for k in range(50)]})
    got = [(b.column("i").to_pylist(), t.rows) for b, t in ragged.slices([batch.slice(3, 40)], "t", 20)]
    assert [i for rows, _ in got for i in rows] == list(range(3, 43)) and all(len(r) == n for r, n in got)


def test_license_spans(spark):
    texts = ["Permission is hereby granted, free of charge, to any person getting a copy of this software and associated "
             "documentation files (the Software), to deal in the Software without restriction", "a copy of the license of the of the"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert got[0]["labels"] == "mit" and got[0]["spans"][0]["first"] == 0 and got[0]["spans"][0]["end"] == 29
    assert got[1]["labels"] == "" and got[1]["spans"] == []


def test_a_stray_run_does_not_break_a_chain(spark):
    words = licenses.TEMPLATES[5][1].split()
    assert licenses.TEMPLATES[5][0] == "mit"
    stray = " ".join([*words[:17], *words[:4], *words[17:]])
    body = next(t for k, t in licenses.TEMPLATES if k == "mit" and t.startswith("the above"))
    texts = [stray, f"x {body} y", " ".join([*words, "and", *words]), " ".join(words) + " and so on " * 20_000 + " ".join(words)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    assert [r["labels"] for _, r in sorted(got.items())] == ["mit"] * 4
    spans = [(s["first"], s["end"], s["share"]) for s in got[0]["spans"]]
    assert (0, len(words) + 4, 1.0) in spans and got[0]["score"] == 1.0
    n = len(words)
    assert [(s["first"], s["end"]) for s in got[2]["spans"]] == [(0, n), (n + 1, 2 * n + 1)]
    assert [(s["first"], s["end"]) for s in got[3]["spans"]] == [(0, n), (n + 60_000, 2 * n + 60_000)]


SMALL_WORDS = st.lists(st.sampled_from("abc"), min_size=2, max_size=12)


@settings(max_examples=150, deadline=None)
@given(SMALL_WORDS, SMALL_WORDS, st.lists(st.sampled_from("abcx"), max_size=14), st.integers(2, 3), st.integers(0, 5))
def test_scores_are_the_best_chain_s(one, two, text, least, gap):
    """All common runs by comparison, and every chain of them tried."""
    known = licenses.Licenses({}, [("p", " ".join(one)), ("q", " ".join(two))], least, gap, 0.0)
    _, found = known.scan(ragged.texts_of(pa.array([" ".join(text)])))
    spans = found[0][1] if found else []
    for label, template in (("p", one), ("q", two)):
        runs = []
        for a in range(len(text)):
            for b in range(len(template)):
                n = 0
                while a + n < len(text) and b + n < len(template) and text[a + n] == template[b + n]:
                    n += 1
                if n >= least and not (a and b and text[a - 1] == template[b - 1]):
                    runs.append((a, b, n))

        def longest(end, stop):
            """Most words that runs behind (end, stop) can add to a chain."""
            most = 0
            for a, b, n in runs:
                cut = max(0, end - a, stop - b)
                if cut < n and a + cut - end <= gap:
                    most = max(most, n - cut + longest(a + n, b + n))
            return most

        want = max((n + longest(a + n, b + n) for a, b, n in runs), default=0) / len(template)
        mine = [s for s in spans if s.label == label]
        assert max((s.share for s in mine), default=0) == want
        ordered = sorted((s.first, s.end) for s in mine)
        assert all(x[1] <= y[0] for x, y in zip(ordered, ordered[1:]))


def test_automaton_finds_longest_runs():
    rng = random.Random(4)
    words = [[rng.randrange(4) for _ in range(rng.randrange(2, 14))] for _ in range(5)]
    runs = {tuple(w[i:j]) for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    a = licenses.Automaton(words)
    text = [rng.randrange(5) for _ in range(300)]
    for at, (state, length) in enumerate(a.stream(text), 1):
        assert length == max([k for k in range(1, 15) if tuple(text[max(0, at - k):at]) in runs and k <= at], default=0)
        for k, ends in a.ends[state].items():
            assert ends == [e for e in range(1, len(words[k]) + 1) if e >= length and words[k][e - length:e] == text[at - length:at]] or not length


def test_sharding_cuts_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    from pyspark.sql import functions as F
    keyed = df.select("doc_id", F.octet_length("text").cast("long").alias("size"), sharding.sort_key(F.col("text"), F.col("doc_id")).alias("key"))
    got = sharding.shard_rows(keyed, "key", "size", ["doc_id"], shards=8, tolerance=0.01).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    total = sum(r["s"] for r in got)
    assert len(got) == 8 and all(abs(r["s"] - total / 8) < 0.03 * total / 8 for r in got)


@pytest.mark.parametrize("small", [2, 8, 64])
def test_near_dups_in_dense_groups(spark, monkeypatch, small):
    """Variants of few texts, some past the threshold; leaves of any size give the same components."""
    rng = random.Random(7)
    docs = []
    for base in range(3):
        words = [f"b{base}w{rng.randrange(500)}" for _ in range(90)]
        for _ in range(60):
            copy = list(words)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(90)] = f"x{rng.randrange(40)}"
            docs.append((len(docs), " ".join(copy)))
    monkeypatch.setattr(near_dups, "SMALL", small)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc"]: r["component"] for r in near_dups.find_components(df).collect()}
    assert got == brute.near_dups(docs)


def test_id_filter_lets_all_ids_through(spark):
    ids = spark.range(0, 3000, 7)
    table = near_dups.id_filter(ids)
    known = np.arange(0, 3000, 7)
    passing = np.ones(len(known), bool)
    for place in near_dups._id_places(known, 64 * len(table)):
        passing &= table[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1) == 1
    assert passing.all()


def test_line_runs_however_batched(spark, edges, pairs, monkeypatch):
    monkeypatch.setattr(line_dedup.LineRuns.__init__, "__defaults__", (2,))
    df = spark.read.parquet(f"{edges}/documents.parquet").select("doc_id", "text")
    got = sorted((tuple(r) for r in line_dedup.deduplicated(df, batches=7).select("doc_id", "_d_n_dropped", "_d_text").collect()), key=repr)
    assert got == sorted([(i, k[1], k[2]) for (i, _), k in zip(pairs, brute.kept_lines(pairs))], key=repr)


def test_line_keys_lose_blanks_and_no_letters(spark):
    docs = [(1, "first line\nor example this\nfile of a leaf"), (2, "first line\nFor example this\n\x0cfile of a leaf\x0c"),
            (3, "\x0b\x0cOR EXAMPLE THIS\t\r\nFIRST LINE \nfffffffff\x0c"), (4, "fffffffff\x0c\nffffffffff"), (5, "ffffffffff\nFFFFFFFFFF")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.deduplicated(df).select("doc_id", "_d_n_lines", "_d_n_dropped", "_d_text").collect())
    assert got == [(i, *k) for (i, _), k in zip(docs, brute.kept_lines(docs))]
    assert [r[2] for r in got] == [0, 2, 2, 0, 2]


def test_line_dedup_keeps_null_texts(spark, edges):
    df = spark.read.parquet(f"{edges}/documents.parquet")
    assert line_dedup.dedup_lines(df).filter("text IS NULL").count() == 1


def test_quality_fences_lean_on_the_language(spark):
    """A clean source, a small one, and junk: the junk goes, the small source is not its own yardstick."""
    clean = lambda i: " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(60))
    rows = [(i, clean(i), "en", "big") for i in range(300)] + [(1000, clean(5), "en", "tiny"), (1001, "a$ %% <> && " * 20, "en", "tiny")]
    rows += [(2000 + i, " ".join(f"w{k // 4 * 7 + i}" for k in range(80)), "en", "big") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"] for r in quality_rules.filter_documents(df).collect()}
    assert got == {*range(300), 1000}


@pytest.mark.parametrize("times", [1, 10, 100])
def test_quality_fences_do_not_depend_on_size(spark, times):
    """A source with 30 % junk in a clean language, ten and a hundred times over: the junk goes."""
    clean = lambda i: " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(60))
    junk = " ".join(f"a{k} $" for k in range(30))
    rows = [(i, junk if i < 15 * times else clean(i), "en", "mixed") for i in range(50 * times)]
    rows += [(100_000 + i, clean(i), "en", "clean") for i in range(150 * times)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"] for r in quality_rules.filter_documents(df).select("doc_id").collect()}
    assert got == {r[0] for r in rows if r[1] != junk}


def test_stages_give_clashing_columns_back(spark, edges):
    """Every work name of the modules, as an extra column with a value of its own in every row."""
    import pathlib
    import re

    import corpus_pipeline
    from borgata import llm

    source = " ".join(p.read_text() for p in pathlib.Path(llm.__file__).parent.glob("*.py"))
    names = set(re.findall(r'"(_[a-z]+(?:_[a-z]+)*)"', source)) | {f"_d_{n}" for n in decontaminate.RESULT} | {f"_q_{n}" for n in quality_rules.COUNTS}
    names |= {f"_q_{side}_{rule}" for side in ("lo", "hi") for rule in quality_rules.RULES} | {"gone", "c0", "c1", "c9", "contaminated", "n_words", "rep", "a"}
    docs = spark.read.parquet(f"{edges}/documents.parquet").select("doc_id", "text", "lang", "source")
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in sorted(names)})
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, edges)
        assert out.columns == docs.columns
        plain = stage(spark, docs.select("doc_id", "text", "lang", "source"), edges)
        assert sorted(map(repr, out.select(*plain.columns).collect())) == sorted(map(repr, plain.collect()))
        assert all(r[n] is None if r["doc_id"] is None else r[n] == f"{n}{r['doc_id']}" for r in out.collect() for n in names)


def test_hit_spans_and_large_benchmarks(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{edges}/benchmark.parquet")
    few = decontaminate.marked(docs, items, keep=["doc_id"])
    many = decontaminate.marked(docs, items, keep=["doc_id"], most=0)
    assert sorted(map(tuple, few.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    docs = docs.withColumns({n: F.lit(n) for n in ("_row", "_at", "_size", "_text", "c1", "size", "one")})
    whole = [sorted(map(repr, decontaminate.cut_spans(docs, items, most=n).collect())) for n in (decontaminate.BROADCAST_BYTES, 0)]
    assert whole[0] == whole[1]
    found = decontaminate.marked(docs, items, keep=["doc_id", "_row", "size"], most=0)
    assert found.columns == ["doc_id", "_row", "size", *decontaminate.RESULT] and found.filter("_row = '_row' AND size = 'size'").count() == docs.count()
    cut = {r["doc_id"]: r["text"] for r in decontaminate.cut_spans(docs.filter("doc_id IS NOT NULL"), items, most=0).collect()}
    assert cut[1] == "\nThis line is \nshort\nshort" and cut[10] == "" and cut[3] is None and cut[12] == "À b"


def test_the_broadcast_is_bounded_by_bytes(spark):
    items = spark.createDataFrame([(1, " ".join(f"{i:0500d}" for i in range(40))), (2, "a b c")], "item_id long, text string")
    small, table = decontaminate.window_set(items)
    assert small.items == ["1", "2"] and [len(w.keys) for w in small.sizes.values()] == [1, 28]
    room = sum(len(r["words"]) + 1 + decontaminate.EACH for r in table.collect())
    assert decontaminate.window_set(items, most=room)[0] is not None and decontaminate.window_set(items, most=room - 1)[0] is None
    for most in (room, 0):  # nothing to hit, and no items at all
        out = decontaminate.cut_spans(spark.createDataFrame([(1, "a b  c d")], "doc_id long, text string"), items, most=most).first()
        assert out["text"] == " d"
        assert decontaminate.cut_spans(spark.createDataFrame([(1, "x a b")], "doc_id long, text string"), items.limit(0), most=most).first()["text"] == "x a b"


CUTS = st.text(alphabet=" ''sthe13.,\n\t\x1c\x85éß世界👍<|>endofx", max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(CUTS | st.just("a<|endoftext|> b"), max_size=8))
def test_token_counts_are_the_library_s(texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)] if texts else []
    assert token_counts.Counter(MERGES).counts(texts) == want


MERGES = token_counts.load(public_tokenizers.path("byte_bpe_50k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)
MODEL = pieces.load(PIECES)


def test_merging_runs_of_one_symbol():
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    words = ["a" * n for n in range(1, 60)] + ["=" * n for n in (5, 17, 64, 1001)] + ["ab" * 40]
    assert token_counts.Counter(MERGES).counts(words) == [len(library.encode(w).ids) for w in words]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abcdeinorst THE▁  \n\té世0123456789.()=-'", max_size=50), max_size=8))
def test_pieces_are_the_library_s_and_come_back(texts):
    coded = [np.frombuffer(x, np.int32) for x in pieces.encode_texts(MODEL, texts)]
    assert [x.tolist() for x in coded] == [LIBRARY.encode(t) for t in texts]
    first = np.cumsum([0, *map(len, coded)])
    data, offsets = pieces.Decoder(MODEL).decode(np.concatenate([*coded, np.zeros(0, np.int32)]).astype(np.int64), first)
    back = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:])]
    assert back == [t.replace("▁", " ") for t in texts]


def test_decode_gives_the_texts_back(spark, edges):
    docs = spark.read.parquet(f"{edges}/documents.parquet").select("doc_id", "text")
    queries.ship(spark)
    coded = pieces.encode(docs, PIECES, keep=["doc_id"])
    got = sorted(map(tuple, pieces.decode(coded.select("doc_id", "ids"), PIECES).collect()), key=repr)
    assert got == sorted([(r["doc_id"], r["text"] and r["text"].replace("▁", " ")) for r in docs.collect()], key=repr)


def test_unigram_forward_scores():
    """Best of all segmentations, by brute force, for every word of a small trie."""
    vocab = {"▁": -2.0, "a": -1.5, "b": -1.7, "ab": -2.5, "ba": -2.6, "aba": -3.2, "▁a": -2.1, "▁ab": -3.9, "bb": -4.0}
    names = ["<unk>", *vocab]
    model = pieces.Model(names, [0.0, *vocab.values()], [pieces.UNKNOWN, *[pieces.NORMAL] * len(vocab)], pieces.UNIGRAM, True, "small")
    encoder = pieces.Encoder(model)

    def best(word):
        if not word:
            return 0.0
        return max(vocab[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in vocab)

    rng = random.Random(2)
    words = sorted({"▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for _ in range(80)})
    for word, ids in encoder.encode_units(words).items():
        parts = [names[k] for k in np.frombuffer(ids, np.int32)]
        assert "".join(parts) == word and sum(vocab[p] for p in parts) == pytest.approx(best(word))


def test_lm_counts_of_words_so_far_are_exact_however_chunked(spark, monkeypatch):
    """Every word so far has its own counts, in one chunk or many; the other tables have room for all contexts found."""
    rng = random.Random(3)
    n_of = {"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))): rng.randrange(4) for _ in range(400)}
    queries.ship(spark)
    monkeypatch.setattr(lm_scoring, "_BATCH", 7)
    rows = [(w.encode(), i * 7919 % 4001, n) for i, (w, n) in enumerate(n_of.items())]
    df = spark.createDataFrame(rows, "word binary, h long, n long").repartitionByRange(3, "word").sortWithinPartitions("word")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        chunks = lm_scoring.chunks_of(df).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert len(chunks) > 20 and sum(len(c["word"]) for c in chunks) == len(n_of) and sum(c["total"] for c in chunks) == sum(n_of.values())
    table = spark.createDataFrame(chunks, "chunk long, total long, seen long, h array<long>, word array<binary>, n array<long>")
    grams, times = lm_scoring.count_grams(table)
    code = lm_scoring.Code(np.bincount((grams & np.uint64(255)).astype(int), times, 256))
    counts = lm_scoring.Counts(code, grams, times, *lm_scoring.count_beginnings(table))
    after = {}
    for w, n in n_of.items():
        for k, b in enumerate(w.encode() + b" "):
            for node, bit in zip(*(a[code.start[b]:code.start[b] + code.size[b]].tolist() for a in (code.node, code.bit))):
                after.setdefault((w[:k], node), [0, 0])[bit] += n
    for c in chunks:
        words = [bytes(w) for w in c["word"]]
        d = lm_scoring.Decisions(words, np.array(c["n"]), code, counts)
        want = [after[w.decode()[:k], node] for w in words for k, b in enumerate(w + b" ")
                for node in code.node[code.start[b]:code.start[b] + code.size[b]].tolist()]
        assert d.times[:, 3].T.tolist() == want
    small = counts.tables[2].shape[1]
    many = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 50_000, dtype=np.uint64))
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    large = lm_scoring.Counts(code, many, np.ones(len(many), np.int64), *none)
    assert large.tables[2].shape[1] >= 100_000 > small
