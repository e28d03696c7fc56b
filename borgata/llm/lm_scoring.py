"""Language-model scores by online logistic context mixing.

Tokens (lower-cased words, then one end of text) are spelled bit by bit: each byte by its Huffman code
over the training text, each word closed by a blank.  Four predictors keep how often a bit was 0 and
1 after the last byte, the last two, the last three, and the whole word so far.  A word's first two bytes, where
these would reach over the blank, have four of their own: after the word so far alone, with the last byte
of the word before, with its last two, and with that word itself (the ``KNOWN_WORDS`` most frequent are told apart, the
others are one; a text begins after none).  The logits are mixed by weights that a gate chooses (how often the word so
far, or the word before with it, was seen), and an adaptive map, indexed by the mixed logit and by how often the last
bytes were seen, refines the result.  The bits of a word add up to its log probability after the word before; a text's
score is the sum over its tokens in their order, and ``bits_per_byte`` the same per byte.

The bits after a word's second byte depend on the word alone, those before on a meeting: the two bytes and what is
known of the word before.  Meetings are few (bounded by the alphabet and ``KNOWN_WORDS``), so neither is done per occurrence:

1. one scan gives the distinct tokens of each block of documents with their training counts;
2. they add up to one table of all tokens, sorted by word and cut into chunks of one row each;
   counts of four bytes in a row give the code and the tables of the first three predictors, sized by
   the contexts found; counts after a word so far are exact: the words that share it are neighbours,
   so a chunk has them all, but for the beginnings of its first and last word, which are added up;
3. a second scan counts the training texts' meetings, with the most frequent words of that table told apart;
4. a mixer and a map for each of the two learn online from those tables, weighted by count, each occurrence
   predicted without itself (one is taken off its own counts); partitions average their weights;
5. every distinct token is scored once and joined back to the blocks that hold it;
6. each block's texts meet its tokens' counts and scores, and its distinct meetings are scored there.

Counts cover all training documents.  Null or empty text: only the end token.  Documents without id
count as training.  Repeated rows are each counted and scored.  A text of any length is scored as one row,
words of any length as one token; equal words have one score, so there are no ties to break.  Other columns are
not read.  ``score`` depends on how the table of tokens is cut into partitions, as the mixers learn from one
partition each and are averaged (on 1000 documents, 4 against 64 partitions: 1.9 % at most); the other columns do not.  Without any training token every count
is 0 and the predictors are even.  An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borgata import session
from borgata.llm import ragged

ORDERS = 4
#: Cells of a table for each context found, at least.
ROOM = 2
GATES = 12
STEPS = 33
#: Bytes of distinct tokens a task holds before it passes them on, and as much again before it merges them.
HELD_BYTES = 16 << 20
BLOCK_BYTES = 32 << 20
BROADCAST_FILES = 500_000
#: Previous words told apart where a word begins.
KNOWN_WORDS = 1024
#: Bytes of a word that are predicted from the word before as well.
MET = 2
#: Distinct meetings a task holds before it merges them, and as many again before it passes them on.
HELD_MEETINGS = 1 << 20
_END = b"\xff"
_BLANK = 32
_SALT = np.array([0x6A09E667F3BCC909, 0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1], np.uint64)
_NODE = np.uint64(0x9E3779B97F4A7C15)
_END_HASH = np.uint64(0x1234567)
_BATCH = 4096
_LIMIT = 8.0


def tokens_of(t: ragged.Texts) -> tuple[np.ndarray, ragged.Words, np.ndarray]:
    data = ragged.LOWER[t.data]
    w = ragged.words(ragged.Texts(data, t.offsets), ragged.NOT_BLANK)
    return data, w, ragged.Hasher(data).spans(w.start, w.end)


def block_tokens(docs: DataFrame) -> DataFrame:
    """(block, h, word, n) from (block, train, _text): distinct tokens of a task's blocks, with training counts."""

    def run(batches):
        held: list[pa.Table] = []
        merged = size = 0

        def merge() -> None:
            nonlocal merged, size
            keys = ["block", "h", "word"]
            table = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")])
            held[:] = [table.rename_columns({"n_sum": "n"}).select([*keys, "n"])]
            merged = size = table.nbytes

        for batch, t in ragged.slices(batches, "_text"):
            data, w, h = tokens_of(t)
            block = batch.column("block").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            h = np.concatenate([h, np.full(t.rows, _END_HASH)])
            row = np.concatenate([w.row, np.arange(t.rows)])
            key = h ^ ragged.mix(block[row].view(np.uint64) + np.uint64(1))
            distinct, at, inverse = np.unique(key, return_index=True, return_inverse=True)
            n = np.bincount(inverse, train[row], minlength=len(distinct)).astype(np.int64)
            # The end of a text is a word of one byte that no text holds.
            spelled = np.concatenate([data, np.frombuffer(_END, np.uint8)])
            start = np.append(w.start, np.full(t.rows, len(data)))[at]
            length = np.append(w.end, np.full(t.rows, len(data) + 1))[at] - start
            offsets = np.concatenate([[0], np.cumsum(length)])
            taken = spelled[np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])]
            words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)])
            held.append(pa.table({"block": block[row[at]], "h": h[at].view(np.int64), "word": words.cast(pa.binary()), "n": n}))
            size += held[-1].nbytes
            if size - merged > HELD_BYTES:
                merge()
            if merged > HELD_BYTES:
                yield from held.pop().to_batches(max_chunksize=1 << 16)
                merged = size = 0
        if held:
            merge()
            yield from held.pop().to_batches(max_chunksize=1 << 16)

    return docs.mapInArrow(run, "block long, h long, word binary, n long")


def meetings_of(t: ragged.Texts, data: np.ndarray, w: ragged.Words, h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each word of a slice begins, then where each text ends: the word before (its place in ``known``, 0 if not
    there, 1 at the beginning of a text), its last two bytes, and the two first bytes of the word itself."""
    shift = [np.uint64(x) for x in (8, 16, 24, 32)]
    blank = np.uint64(_BLANK)
    begin = np.uint64(1) << shift[3] | blank << shift[2] | blank << shift[1]
    begins = np.full(t.rows, begin)
    end = np.uint64(_END[0]) << shift[0] | blank
    if not len(h):
        return begins | end
    byte, long = data.astype(np.uint64), w.end - w.start > 1
    place = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    word = np.where(known[place] == h, place + 2, 0).astype(np.uint64) if len(known) else np.zeros(len(h), np.uint64)
    left = word << shift[3] | np.where(long, byte[w.end - 2], blank) << shift[2] | byte[w.end - 1] << shift[1]
    before = np.concatenate([begins[:1], left[:-1]])
    some = w.count > 0
    before[w.first[:-1][some]] = begin
    begins[some] = left[w.first[1:][some] - 1]
    first = byte[w.start] << shift[0] | np.where(long, byte[np.minimum(w.start + 1, len(byte) - 1)], blank)
    return np.concatenate([before | first, begins | end])


def known_words(chunks: DataFrame) -> np.ndarray:
    """Hashes of the words met most often in training, in their order; equal counts by hash."""
    end = int(_END_HASH.view(np.int64))
    each = chunks.select(F.inline(F.arrays_zip("h", "n"))).filter((F.col("n") > 0) & (F.col("h") != end))
    found = each.orderBy(F.desc("n"), "h").limit(KNOWN_WORDS).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(np.uint64))


def count_meetings(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """(m, n): the meetings of some texts and how often they occur, in the order of a hash, which is none."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            m, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            return m, np.bincount(at, np.concatenate([n for _, n in held]), len(m)).astype(np.int64)

        def passed(m: np.ndarray, n: np.ndarray):
            for i in range(0, len(m), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(a[i:i + (1 << 16)]) for a in (m.view(np.int64), n)], names=["m", "n"])

        for _, t in ragged.slices(batches, "_text"):
            held.append(np.unique(meetings_of(t, *tokens_of(t), known), return_counts=True))
            size += len(held[-1][0])
            if size > HELD_MEETINGS:
                held[:] = [merged()]
                size = len(held[0][0])
            if size > HELD_MEETINGS:
                yield from passed(*held.pop())
                size = 0
        if held:
            yield from passed(*merged())

    counted = texts.select("_text").mapInArrow(run, "m long, n long").groupBy("m").agg(F.sum("n").alias("n"))
    return counted.sortWithinPartitions(F.xxhash64("m"))


class Code:
    """Huffman code of the 256 bytes: internal nodes and bits on the way to each."""

    def __init__(self, counts: np.ndarray):
        queue = [(int(n) + 1, b, b) for b, n in enumerate(counts)]  # (weight, tie, node)
        heapq.heapify(queue)
        above: dict[int, tuple[int, int]] = {}
        for made in range(256, 511):
            (a, _, left), (b, _, right) = heapq.heappop(queue), heapq.heappop(queue)
            above[left], above[right] = (made, 0), (made, 1)
            heapq.heappush(queue, (a + b, made, made))
        nodes, bits, size = [], [], []
        for b in range(256):
            path, node = [], b
            while node in above:
                path.append((above[node][0] - 256, above[node][1]))
                node = above[node][0]
            size.append(len(path))
            nodes += [p[0] for p in reversed(path)]
            bits += [p[1] for p in reversed(path)]
        self.size = np.array(size, np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.node, self.bit = np.array(nodes, np.uint64), np.array(bits, np.int64)


    def spelled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every bit of some bytes: which byte, the hash of its node, the bit."""
        bits = self.size[data]
        rep = np.repeat(np.arange(len(data)), bits)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(bits) - bits, bits) + self.start[data][rep]
        return rep, (self.node[step] + np.uint64(1)) * _NODE, self.bit[step]


class Spelling:
    """The bytes of some words, closed by blanks, with the three bytes and the word so far before each."""

    def __init__(self, words: list[bytes]):
        self.data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
        size = np.array([len(x) + 1 for x in words], np.int64)
        self.start = np.repeat(np.cumsum(size) - size, size)
        at = np.arange(len(self.data))
        last = [np.where(at - k >= self.start, self.data[np.maximum(at - k, 0)], _BLANK).astype(np.uint64) for k in (1, 2, 3)]
        self.three = last[0] | last[1] << np.uint64(8) | last[2] << np.uint64(16)
        self.prefix = ragged.Hasher(self.data).spans(self.start, at)
        self.word = np.repeat(np.arange(len(words)), size)


def _key(order: int, context: np.ndarray) -> np.ndarray:
    if order < 3:
        context = context & np.uint64((1 << 8 * (order + 1)) - 1)
    return ragged.mix(context + _SALT[order])


def _cells(key: np.ndarray, bits: int) -> np.ndarray:
    return ((key * _NODE) >> np.uint64(64 - bits)).astype(np.int64)


def _table(key: np.ndarray, bit: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Times of bit 0 and 1 in the cells of a hashed table, sized by the keys found."""
    bits = max(1, int(ROOM * len(np.unique(key)) - 1).bit_length())
    cell = _cells(key, bits)
    return np.stack([np.bincount(cell, n * (bit == b), 1 << bits) for b in (0, 1)]).astype(np.float32)


def _looked_up(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    return table[:, _cells(key, table.shape[1].bit_length() - 1)]


class Counts:
    """Times of bit 0 and 1: hashed tables after one to three bytes, sized by what was found, and exact
    ones after the beginnings of words that more than one chunk holds."""

    def __init__(self, code: Code, grams: np.ndarray, n: np.ndarray, beginning: np.ndarray, byte: np.ndarray, m: np.ndarray):
        self.tables = []
        rep, node, bit = code.spelled((grams & np.uint64(255)).astype(np.int64))
        for k in range(ORDERS - 1):
            self.tables.append(_table(_key(k, grams >> np.uint64(8))[rep] ^ node, bit, n[rep]))
        rep, node, bit = code.spelled(byte)
        self.shared, at = np.unique(_key(3, beginning)[rep] ^ node, return_inverse=True)
        self.times = np.stack([np.bincount(at, m[rep] * (bit == b), len(self.shared)) for b in (0, 1)])


class Decisions:
    """The bits of a chunk's words after their first ``skip`` bytes: which word, the bit, and each predictor's counts."""

    def __init__(self, words: list[bytes], n: np.ndarray, code: Code, counts: Counts, skip: int = 0):
        s = Spelling(words)
        rest = np.flatnonzero(np.arange(len(s.data)) - s.start >= skip)
        rep, node, self.bit = code.spelled(s.data[rest])
        rep = rest[rep]
        self.word = s.word[rep]
        self.times = np.empty((2, ORDERS, len(rep)))
        for k, table in enumerate(counts.tables):
            self.times[:, k] = _looked_up(table, _key(k, s.three)[rep] ^ node)
        keys, at = np.unique(_key(3, s.prefix)[rep] ^ node, return_inverse=True)
        own = np.stack([np.bincount(at, n[self.word] * (self.bit == b), len(keys)) for b in (0, 1)])
        if len(counts.shared):
            place = np.minimum(np.searchsorted(counts.shared, keys), len(counts.shared) - 1)
            known = counts.shared[place] == keys
            own[:, known] = counts.times[:, place[known]]
        self.times[:, 3] = own[:, at]


class Beginnings:
    """The bits of the first bytes of words, at each meeting: which meeting, the bit, and each predictor's keys."""

    def __init__(self, meetings: np.ndarray, code: Code):
        part = lambda bits, mask: meetings >> np.uint64(bits) & np.uint64(mask)
        first, second = part(8, 0xFF), part(0, 0xFF)
        # What is known of the word before, then the word so far: nothing, or one byte.
        scopes = [np.zeros_like(first), part(16, 0xFF), part(16, 0xFFFF), part(32, 0xFFFFFFFF)]
        rep, node, self.bit = code.spelled(np.concatenate([first, second]).astype(np.int64))
        self.keys = [ragged.mix(np.concatenate([x << np.uint64(9), x << np.uint64(9) | first + np.uint64(1)]) + _SALT[k])[rep] ^ node
                     for k, x in enumerate(scopes)]
        self.meeting = rep % max(len(meetings), 1)

    def times(self, tables: list[np.ndarray]) -> np.ndarray:
        return np.stack([_looked_up(table, key) for table, key in zip(tables, self.keys)], 1).astype(float)


def beginning_tables(meetings: np.ndarray, n: np.ndarray, code: Code) -> list[np.ndarray]:
    """Times of bit 0 and 1 for each predictor of the first bytes."""
    b = Beginnings(meetings, code)
    return [_table(key, b.bit, n[b.meeting]) for key in b.keys]


def chunks_of(tokens: DataFrame) -> DataFrame:
    """(chunk, total, seen, h, word, n): neighbouring rows of partitions sorted by word, as lists in the order of the hash."""

    def run(batches):
        base, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush():
            t = pa.Table.from_batches(held).sort_by("h")
            held.clear()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(c).combine_chunks())
                     for c in ("h", "word", "n")]
            n = t.column("n").to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([int(n.sum())]), pa.array([int((n > 0).sum())]), *lists],
                names=["chunk", "total", "seen", "h", "word", "n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= _BATCH or sum(b.nbytes for b in held) > 1 << 20:
                yield flush()
                made += 1
        if sum(b.num_rows for b in held):
            yield flush()

    return tokens.select("h", "word", "n").mapInArrow(
        run, "chunk long, total long, seen long, h array<long>, word array<binary>, n array<long>")


def _words(batches):
    """(chunk, h, words, n) of every chunk."""
    for batch in batches:
        for i in range(batch.num_rows):
            h, word, n = (batch.column(c)[i].values for c in ("h", "word", "n"))
            yield batch.column("chunk")[i].as_py(), h, word.to_pylist(), n.to_numpy()


def count_grams(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Four bytes in a row and how often training spells them; their number is bounded by the alphabet's, not the words'."""

    def run(batches):
        for _, _, words, n in _words(batches):
            s = Spelling(words)
            weight = n[s.word]
            used = weight > 0
            gram, at = np.unique(s.three[used] << np.uint64(8) | s.data[used], return_inverse=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.astype(np.int64)), pa.array(np.bincount(at, weight[used], len(gram)).astype(np.int64))], names=["g", "n"])

    found = chunks.mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    return found.column("g").to_numpy().view(np.uint64), found.column("n").to_numpy()


def count_beginnings(chunks: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(beginning, next byte, times) for the beginnings of words that more than one chunk holds."""

    def run(batches):
        for chunk, _, words, n in _words(batches):
            s = Spelling(words)
            ends = [words.index(min(words)), words.index(max(words))]
            at = np.flatnonzero(np.isin(s.prefix, s.prefix[np.isin(s.word, ends)]))
            key, place, inverse = np.unique(s.prefix[at] ^ ragged.mix(s.data[at].astype(np.uint64) + np.uint64(1)),
                                            return_index=True, return_inverse=True)
            times = np.bincount(inverse, n[s.word[at]], len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), chunk)), pa.array(s.prefix[at][place].view(np.int64)),
                 pa.array(s.data[at][place].astype(np.int64)), pa.array(times)], names=["chunk", "p", "b", "n"])

    rows = chunks.mapInArrow(run, "chunk long, p long, b long, n long").groupBy("p", "b")
    rows = rows.agg(F.sum("n").alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    rows = rows.groupBy("p").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_list(F.struct("b", "n")).alias("next"))
    found = rows.filter("low < high").select("p", F.inline("next")).toArrow()
    p, b, n = (found.column(c).to_numpy() for c in ("p", "b", "n"))
    return p.view(np.uint64), b, n


class Mixer:
    """Gated weights over the predictors' logits, and the adaptive map behind them."""

    def __init__(self):
        self.weights = np.zeros((GATES, ORDERS + 1))
        self.weights[:, :ORDERS] = 0.35
        grid = np.linspace(-_LIMIT, _LIMIT, STEPS)
        self.map = np.tile(1 / (1 + np.exp(-grid)), (GATES, 1))
        self.seen = np.zeros(GATES)

    @staticmethod
    def inputs(zeros: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits and bias, the gate, and the map's row."""
        total = zeros + ones
        x = np.empty((ORDERS + 1, zeros.shape[1]))
        x[:ORDERS] = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -_LIMIT, _LIMIT)
        x[ORDERS] = 0.5
        rows = [np.minimum(np.log2(total[k] + 1), GATES - 1).astype(np.int64) for k in (3, 2)]
        return x, rows[0], rows[1]

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        z = np.zeros(x.shape[1])
        for k in range(ORDERS + 1):
            z += self.weights[gate, k] * x[k]
        return np.clip(z, -_LIMIT, _LIMIT)

    def _places(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = (z + _LIMIT) * ((STEPS - 1) / (2 * _LIMIT))
        low = np.minimum(place.astype(np.int64), STEPS - 2)
        return low, place - low

    def refined(self, z: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Probability of a 1: the mean of the mix and of the map's value between its two nearest steps."""
        low, part = self._places(z)
        mapped = self.map[row, low] * (1 - part) + self.map[row, low + 1] * part
        return 0.5 / (1 + np.exp(-z)) + 0.5 * mapped

    def learn(self, x: np.ndarray, gate: np.ndarray, row: np.ndarray, bit: np.ndarray, weight: np.ndarray) -> None:
        """One online step on a short run of bits."""
        z = self.mixed(x, gate)
        error = weight * (bit - 1 / (1 + np.exp(-z)))
        mass = np.bincount(gate, weight, minlength=GATES)
        rate = 0.02 + 0.2 / (1 + 0.05 * self.seen)
        for k in range(ORDERS + 1):
            self.weights[:, k] += rate * np.bincount(gate, error * x[k], minlength=GATES) / np.maximum(mass, 1e-9)
        low, part = self._places(z)
        flat, n = row * STEPS + low + (part > 0.5), GATES * STEPS
        mass_at = np.bincount(flat, weight, minlength=n)
        mean = np.bincount(flat, weight * bit, minlength=n) / np.maximum(mass_at, 1e-9)
        share = np.where(mass_at > 0, 0.02, 0.0)
        self.map += (share * (mean - self.map.ravel())).reshape(self.map.shape)
        self.seen += mass > 0


def learn_mixer(rows: DataFrame, decisions: Callable) -> Mixer:
    """``decisions`` gives (weight, bit, times) of each batch's bits.  Each partition learns from its rows in turn; the
    driver averages one small model a partition by an aggregation over its numbers."""

    def run(batches):
        mixer, total = Mixer(), 0.0
        for n, bits, every in decisions(batches):
            for start in range(0, len(bits), 1 << 14):
                part = slice(start, start + (1 << 14))
                weight, bit, times = n[part], bits[part], every[:, :, part]
                used = weight > 0
                weight, bit, times = weight[used].astype(float), bit[used], times[:, :, used]
                if len(bit):
                    without = [np.maximum(times[b] - (bit == b), 0) for b in (0, 1)]
                    mixer.learn(*Mixer.inputs(*without), bit, weight)
                    total += weight.sum()
        if total:
            numbers = np.concatenate([mixer.weights.ravel(), mixer.map.ravel()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(numbers))), pa.array(numbers * total), pa.array(np.full(len(numbers), total))],
                names=["k", "x", "w"])

    mixer = Mixer()
    numbers = np.concatenate([mixer.weights.ravel(), mixer.map.ravel()])
    for k, x, w in rows.mapInArrow(run, "k long, x double, w double").groupBy("k").agg(F.sum("x"), F.sum("w")).collect():
        numbers[k] = x / w
    mixer.weights = numbers[:mixer.weights.size].reshape(mixer.weights.shape)
    mixer.map = numbers[mixer.weights.size:].reshape(mixer.map.shape)
    return mixer


def learn_words(chunks: DataFrame, code: Code, table) -> Mixer:
    """From the bits after the first bytes of all words."""

    def decisions(batches):
        for _, _, words, n in _words(batches):
            d = Decisions(words, n, code, table.value, MET)
            yield n[d.word], d.bit, d.times

    return learn_mixer(chunks, decisions)


def learn_beginnings(meetings: DataFrame, code: Code, tables) -> Mixer:
    """From the bits of the first bytes, at each meeting."""

    def decisions(batches):
        for batch in batches:
            b = Beginnings(batch.column("m").to_numpy().view(np.uint64), code)
            yield batch.column("n").to_numpy()[b.meeting], b.bit, b.times(tables.value)

    return learn_mixer(meetings, decisions)


def _log_p(mixer: Mixer, bit: np.ndarray, times: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """log10 probabilities of the bits, added up."""
    x, gate, row = Mixer.inputs(*times)
    p = np.clip(mixer.refined(mixer.mixed(x, gate), row), 1e-6, 1 - 1e-6)
    return np.bincount(at, np.log10(np.where(bit == 1, p, 1 - p)), minlength=size)


def score_tokens(chunks: DataFrame, code: Code, table, mixer: Mixer) -> DataFrame:
    """(h, n, lp): training count of each distinct token, and log10 probability of what follows its first bytes."""

    def run(batches):
        for _, h, words, n in _words(batches):
            d = Decisions(words, n, code, table.value, MET)
            lp = _log_p(mixer, d.bit, d.times, d.word, len(words))
            yield pa.RecordBatch.from_arrays([h, pa.array(n), pa.array(lp)], names=["h", "n", "lp"])

    return chunks.mapInArrow(run, "h long, n long, lp double")


class MeetingScores:
    """log10 probabilities of first bytes; each meeting is scored once."""

    def __init__(self, code: Code, tables: list[np.ndarray], mixer: Mixer):
        self.code, self.tables, self.mixer = code, tables, mixer
        self.keys, self.lp = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, meetings: np.ndarray) -> np.ndarray:
        distinct, at = np.unique(meetings, return_inverse=True)
        place = np.searchsorted(self.keys, distinct)
        new = np.ones(len(distinct), bool)
        if len(self.keys):
            new = self.keys[np.minimum(place, len(self.keys) - 1)] != distinct
        if new.any():
            lp = []
            for part in np.array_split(distinct[new], 1 + np.count_nonzero(new) // _BATCH):
                b = Beginnings(part, self.code)
                lp.append(_log_p(self.mixer, b.bit, b.times(self.tables), b.meeting, len(part)))
            self.keys, self.lp = np.insert(self.keys, place[new], distinct[new]), np.insert(self.lp, place[new], np.concatenate(lp))
        return self.lp[np.searchsorted(self.keys, distinct)][at]


def score_documents(docs: DataFrame, doc: str = "doc_id", text: str = "text", train: Column | None = None,
                    block: Column | None = None) -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    ``train``: which rows are learned from (default all).  ``block``: a long that groups some 32 MB of
    documents, the better the nearer they are stored; by default the id's hash."""
    spark = docs.sparkSession
    folder = session.scratch_dir(spark, "lm")
    if block is None:
        size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
        block = F.pmod(F.xxhash64(doc), F.lit(max(1, size // BLOCK_BYTES)))
    learned = F.lit(True) if train is None else F.coalesce(train, F.lit(True))
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("_text"), learned.alias("train"), block.alias("block"))
    block_tokens(rows.select("block", "train", "_text")).write.parquet(f"{folder}/blocks")
    blocks = spark.read.parquet(f"{folder}/blocks")
    # By ranges of words and sorted, so that words with one beginning are neighbours; the chunks then in
    # the order of a hash, which is none.
    merged = blocks.repartitionByRange("word").groupBy("word", "h").agg(F.sum("n").alias("n"))
    chunks_of(merged.sortWithinPartitions("word")).sortWithinPartitions(F.xxhash64("chunk")).write.parquet(f"{folder}/tokens")
    chunks = spark.read.parquet(f"{folder}/tokens")
    total, distinct = chunks.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    grams, n_grams = count_grams(chunks)
    code = Code(np.bincount((grams & np.uint64(255)).astype(np.int64), n_grams, 256))
    counts = Counts(code, grams, n_grams, *count_beginnings(chunks))
    table = spark.sparkContext.broadcast(counts)
    scored = score_tokens(chunks, code, table, learn_words(chunks, code, table))
    frequent = known_words(chunks)
    count_meetings(rows.filter("train"), frequent).write.parquet(f"{folder}/meetings")
    meetings = spark.read.parquet(f"{folder}/meetings")
    found = meetings.toArrow()
    tables = spark.sparkContext.broadcast(
        beginning_tables(found.column("m").to_numpy().view(np.uint64), found.column("n").to_numpy(), code))
    beginning = learn_beginnings(meetings, code, tables)
    wanted = blocks.select("block", "h").join(scored, "h").select("block", "h", "n", "lp")
    least = total + distinct + 1

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("h").to_numpy())
        keys, n, lp = (known.column(c).to_numpy()[order] for c in ("h", "n", "lp"))
        base = np.log10((n + 1) / least)
        met = MeetingScores(code, tables.value, beginning)
        out = []
        for batch, t in ragged.slices(texts.to_batches(), "_text"):
            data, w, h = tokens_of(t)
            end = np.searchsorted(keys, _END_HASH.view(np.int64))
            at = np.searchsorted(keys, h.view(np.int64))
            count = np.bincount(w.row, minlength=t.rows)

            def summed(values: np.ndarray) -> np.ndarray:
                return np.bincount(w.row, values[at], minlength=t.rows) + values[end]

            n_known = summed((n > 0).astype(np.int64)).astype(np.int64)
            row = np.concatenate([w.row, np.arange(t.rows)])
            model = summed(lp) + np.bincount(row, met.of(meetings_of(t, data, w, h, frequent)), minlength=t.rows)
            out.append(pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(count + 1), pa.array(n_known), pa.array(np.full(t.rows, total, np.int64)),
                 pa.array(summed(base)), pa.array(model),
                 pa.array(-model / np.log10(2) / np.maximum(np.diff(t.offsets), 1))], names=names))
        return pa.Table.from_batches(out)

    names = ["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kind = docs.schema[doc].dataType.simpleString()
    shape = (f"doc {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
             "bits_per_byte double")
    texts = rows.select("doc", "_text", "block")
    return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(score, shape)


def op9_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    # A file's rows, dealt to as many blocks as its texts fill; what a file takes on disk says little about them.
    docs = docs.select("doc_id", "text", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    texts = docs.groupBy("file").agg(F.sum(F.octet_length("text")).alias("bytes"))
    path = session.scratch_dir(spark, "lm-files")
    texts.select("file", F.ceil(F.col("bytes") / BLOCK_BYTES).alias("cuts")).filter("cuts > 1").write.parquet(path)
    cuts = spark.read.parquet(path)
    # Sixteen bytes a file; the texts move for a join only where there are too many files to send round.
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_FILES else cuts
    docs = docs.join(cuts, "file", "left")
    block = F.xxhash64("file", F.pmod("at", F.coalesce("cuts", F.lit(1))))
    found = score_documents(docs, train=~held_out, block=block)
    return found.withColumnRenamed("doc", "doc_id").withColumn("held_out", held_out)
