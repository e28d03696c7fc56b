"""SentencePiece encoding and decoding with forward states shared along a trie of words.

Text is marked (a space becomes U+2581, one stands before the text) and cut into units that no piece
crosses.  A slice's distinct new units are sorted, which is a depth-first walk of their trie: a unit
keeps the forward states of the prefix it shares with the one before and only extends them.

The forward state of a prefix is the last piece of its best segmentation.  For a unigram model that is
Viterbi on the piece scores.  For a BPE model, scores rank merges and do not add up, so the best sum is
not what the model's own encoder gives; there the state is the last piece of the prefix's BPE
segmentation, the one piece ending there that stays apart from the piece before it when the two are
merged alone (its Viterbi score is 0, that of all others minus infinity).  Pairs are remembered.
Units that begin with several marks, whose pieces tie in score, are merged directly.

Characters without a piece become byte pieces.  Null text: null ids; empty text: none.  Decoding gives
the text back, with U+2581 read as a space.  Repeated rows are each encoded; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from borgata.llm import ragged

MARK = "▁"
#: Units whose pieces a Python worker keeps between slices, and pairs of pieces: some 50 and 30 MB at most.
REMEMBERED, REMEMBERED_PAIRS = 200_000, 200_000
TAIL = 4
#: Longer units are encoded and not kept.
LONGEST_KEPT = 64
#: Text that is cut into units at once: the more units, the more prefixes they share.
SLICE_BYTES = 1 << 20
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
_NEVER = -1e18


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


class Model(NamedTuple):
    """Pieces with score and type, by id; the kind of model; how text is marked."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    prefix: bool
    name: str


def load(path: str) -> Model:
    """A ``.model`` file.  Only models that leave the characters as they are can be given back."""
    with open(path, "rb") as f:
        data = f.read()
    pieces, scores, types, kind, prefix = [], [], [], UNIGRAM, True
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            types.append(piece.get(3, NORMAL))
        elif number == 2:
            kind = dict(_fields(value)).get(3, UNIGRAM)
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                raise ValueError("the model rewrites characters or spaces")
    return Model(pieces, scores, types, kind, prefix, path)


class Encoder:
    """One model, ready to encode units; keeps what pairs of pieces do."""

    def __init__(self, model: Model):
        self.model = model
        usable = [k for k, t in enumerate(model.types) if t in (NORMAL, USER)]
        self.vocab = {model.pieces[k]: k for k in usable}
        self.score = {model.pieces[k]: model.scores[k] for k in usable}
        # Lengths, longest first, of the pieces that end in some given characters; by the last characters of a prefix.
        tails: dict[str, set[int]] = {}
        for p in self.vocab:
            if len(p) >= TAIL:
                tails.setdefault(p[-TAIL:], set()).add(len(p))
        self.tails = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.unknown = next((k for k, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): k for k, p in enumerate(model.pieces) if model.types[k] == BYTE}
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError("pieces cross words")
        # Characters that join no other character end a unit.
        joined = {c for p in self.vocab if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t\r" if c not in joined)
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|[{alone}]|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+").findall
        self.apart: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.merges: dict[int, list[tuple[float, str, str]]] = {}
        least = min(self.score.values(), default=0.0)
        self.unknown_score = least - 10

    def merged(self, unit: str, seen: list[tuple[float, str, str]] | None = None) -> list[str]:
        """BPE by its definition: the best-scored pair first, the left one of equals.  ``seen`` gets the score
        of each merge and the first and last part after it."""
        first, last = 0, len(unit) - 1
        part, n = list(unit), len(unit)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if i >= 0 and j >= 0:
                both = part[i] + part[j]
                if both in self.score:
                    heapq.heappush(queue, (-self.score[both], i, both))

        for i in range(n - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j] = both, ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            last = i if j == last else last
            if seen is not None:
                seen.append((self.score[both], part[first], part[last]))
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _stays_apart(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.apart.get(key)
        if found is None:
            found = self.apart[key] = self._is_whole(left) and self._is_whole(right) and self._no_merge_between(left, right)
        return found

    def _merges(self, piece: int) -> list[tuple[float, str, str]]:
        """(score, first part, last part) of a piece's own merges in their order, after its characters."""
        found = self.merges.get(piece)
        if found is None:
            text = self.model.pieces[piece]
            found = self.merges[piece] = [(0.0, text[0], text[-1])]
            self.merged(text, found)
        return found

    def _no_merge_between(self, left: int, right: int) -> bool:
        """Whether two pieces side by side become whole before a merge takes parts of both: the merges of each
        come in their own order, the best of both sides and of the pair between them first."""
        one, two, score = self._merges(left), self._merges(right), self.score.get
        i = j = 0
        while True:
            a = one[i + 1][0] if i + 1 < len(one) else _NEVER
            b = two[j + 1][0] if j + 1 < len(two) else _NEVER
            between = score(one[i][2] + two[j][1], _NEVER)
            if between > a and between >= b:
                return False
            if a == b == _NEVER:
                return True
            if a >= b:
                i += 1
            else:
                j += 1

    def _is_whole(self, piece: int) -> bool:
        found = self.whole.get(piece)
        if found is None:
            text = self.model.pieces[piece]
            found = self.whole[piece] = self.merged(text) == [text]
        return found

    def _lengths(self, last: str) -> tuple[int, ...]:
        """Lengths of two or more of the pieces that may end a prefix with these last characters."""
        short = [k for k in range(min(TAIL - 1, len(last)), 1, -1) if last[-k:] in self.vocab]
        if len(self.lengths) > REMEMBERED_PAIRS:
            self.lengths.clear()
        found = self.lengths[last] = (*self.tails.get(last, ()), *short)
        return found

    def _extend_bpe(self, unit: str, at: int, ids: list[int], sizes: list[int]) -> None:
        """Adds (id, length) of the last piece of each longer prefix; a character without a piece is -1 and
        joins nothing."""
        known, apart, lengths = self.vocab.get, self.apart.get, self.lengths.get
        for at in range(at, len(unit) + 1):
            last = unit[at - TAIL:at] if at > TAIL else unit[:at]
            found = lengths(last)
            for size in self._lengths(last) if found is None else found:
                if size > at:
                    continue
                piece = known(unit[at - size:at])
                if piece is None:
                    continue
                left = ids[at - size]
                if left == -2:
                    fits = self._is_whole(piece)
                else:
                    fits = left == -1 or apart(left << 32 | piece)
                    if fits is None:
                        fits = self._stays_apart(left, piece)
                if fits:
                    ids.append(piece)
                    sizes.append(size)
                    break
            else:
                ids.append(known(unit[at - 1], -1))
                sizes.append(1)

    def _extend_unigram(self, unit: str, at: int, best: list[float]) -> tuple[float, int, int]:
        """(score, id, length) of the best way to end here."""
        top, choice, length = _NEVER, -1, 1
        for size in (*self._lengths(unit[max(at - TAIL, 0):at]), 1):
            if size > at:
                continue
            piece = unit[at - size:at]
            score = best[at - size] + self.score.get(piece, self.unknown_score if size == 1 else _NEVER)
            if score > top:
                top, choice, length = score, self.vocab.get(piece, -1), size
        return top, choice, length

    def _without_piece(self, text: str) -> list[int]:
        return [self.bytes[b] for b in text.encode()] if self.bytes else [self.unknown]

    def encode_units(self, units: list[str]) -> dict[str, bytes]:
        """Ids (four bytes each) of sorted distinct units."""
        found: dict[str, bytes] = {}
        # Forward states of the unit's prefixes: last piece, its length, and for unigrams the score.
        ids, sizes, best, previous = [-2], [0], [0.0], ""
        bpe = self.model.kind == BPE
        for unit in units:
            if bpe and unit.startswith(MARK + MARK):
                out = []
                for p in self.merged(unit):
                    out += [self.vocab[p]] if p in self.vocab else self._without_piece(p)
                found[unit] = array("i", out).tobytes()
                continue
            shared, most = 0, min(len(unit), len(previous))
            while shared < most and unit[shared] == previous[shared]:
                shared += 1
            del ids[shared + 1:], sizes[shared + 1:], best[shared + 1:]
            if bpe:
                self._extend_bpe(unit, shared + 1, ids, sizes)
            for at in range(shared + 1, len(unit) + 1) if not bpe else ():
                score, piece, size = self._extend_unigram(unit, at, best)
                best.append(score)
                ids.append(piece)
                sizes.append(size)
            previous, out, at = unit, [], len(unit)
            while at:
                if ids[at] >= 0:
                    out.append(ids[at])
                else:
                    out += reversed(self._without_piece(unit[at - 1]))
                at -= sizes[at]
            out.reverse()
            found[unit] = array("i", out).tobytes()
        if len(self.apart) > REMEMBERED_PAIRS:
            self.apart.clear()
        return found

    def units(self, text: str) -> list[str]:
        return self.cut((MARK if self.model.prefix else "") + text.replace(" ", MARK)) if text else []


class Decoder:
    """Bytes of each id, gathered for many ids at once."""

    def __init__(self, model: Model):
        said = []
        for p, t in zip(model.pieces, model.types, strict=True):
            said.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else
                        " ⁇ ".encode() if t == UNKNOWN else p.replace(MARK, " ").encode())
        self.size = np.array([len(x) for x in said], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(said), np.uint8)
        self.prefix = model.prefix

    def decode(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, and where each begins; ``first``: where each text's ids begin."""
        size = self.size[ids]
        upto = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=upto[1:])
        place = np.repeat(self.start[ids] - upto[:-1], size) + np.arange(upto[-1])
        data, offsets = self.data[place], upto[first]
        if self.prefix:  # the mark put before each text that has any
            filled = offsets[1:] > offsets[:-1]
            data = np.delete(data, offsets[:-1][filled])
            offsets = offsets - np.concatenate([[0], np.cumsum(filled)])
        return data, offsets


_known: dict[str, tuple[Encoder, Decoder, dict[str, bytes]]] = {}


def _ready(model: Model) -> tuple[Encoder, Decoder, dict[str, bytes]]:
    if model.name not in _known:
        _known[model.name] = (Encoder(model), Decoder(model), {})
    return _known[model.name]


def encode_texts(model: Model, texts: list[str | None]) -> list[bytes]:
    """Ids of whole texts, four bytes each."""
    encoder, _, known = _ready(model)
    cut = [encoder.units(x) if x else [] for x in texts]
    new = set().union(*cut) - known.keys()
    if len(known) + len(new) > REMEMBERED:
        known.clear()
        new = set().union(*cut)
    long = [x for x in new if len(x) > LONGEST_KEPT]
    if new:
        known.update(encoder.encode_units(sorted(new)))
    look = known.__getitem__
    coded = [b"".join(map(look, u)) for u in cut]
    for x in long:
        del known[x]
    return coded


def _marked_equal(t: ragged.Texts, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each decoded text is the text, U+2581 read as a space."""
    out = np.diff(t.offsets) == np.diff(offsets)
    if len(t.data) == len(data) and out.all():
        wrong = np.flatnonzero(t.data != data)
        out[np.searchsorted(t.offsets, wrong, side="right") - 1] = False
    for row in np.flatnonzero(~out) if not out.all() else ():
        text = t.data[t.offsets[row]:t.offsets[row + 1]].tobytes().decode()
        out[row] = text.replace(MARK, " ").encode() == data[offsets[row]:offsets[row + 1]].tobytes()
    return out


def encode(docs: DataFrame, model_path: str, text: str = "text", keep: list[str] | None = None,
           with_ids: bool = True, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default all) of every row with ids, n_pieces, ids_sha256 (over four bytes
    an id, lowest first) and round_trip (decoding the ids gives the text)."""
    keep = docs.columns if keep is None else keep
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))
    ids_field = [T.StructField(prefix + "ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    schema = T.StructType([
        *[docs.schema[c] for c in keep], *ids_field, T.StructField(prefix + "n_pieces", T.LongType()),
        T.StructField(prefix + "ids_sha256", T.StringType()), T.StructField(prefix + "round_trip", T.BooleanType())])

    def run(batches):
        for batch, t in ragged.slices(batches, text, SLICE_BYTES):
            coded = encode_texts(model.value, batch.column(text).to_pylist())
            ids = np.frombuffer(b"".join(coded), np.int32)
            n = np.array([len(x) // 4 for x in coded], np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            same = _marked_equal(t, *_ready(model.value)[1].decode(ids, first))
            arrays = [batch.column(c) for c in keep]
            if with_ids:
                null = batch.column(text).is_null()
                arrays.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=null))
            arrays += [pa.array(n), pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array(same)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def decode(docs: DataFrame, model_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The rows with the text that their ids stand for; null ids give null, bytes that are no UTF-8 U+FFFD."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))
    kept = [c for c in docs.columns if c not in (ids, out)]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(out, T.StringType())])

    def run(batches):
        decoder = _ready(model.value)[1]
        for batch in batches:
            column = batch.column(ids)
            texts = []
            for value in column:
                one = None if not value.is_valid else np.array(value.as_py(), np.int64)
                if one is not None:
                    data, _ = decoder.decode(one, np.array([0, len(one)]))
                    one = data.tobytes().decode(errors="replace")
                texts.append(one)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string())],
                                             names=schema.names)

    return docs.mapInArrow(run, schema)


def op10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)
