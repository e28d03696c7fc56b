"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of ragged arrays.

A slice's texts are cut into pre-tokens; those not met before become one flat array of symbols with
their sequence's start.  Each round every sequence applies its own lowest-rank pair, at all its places
at once (left to right where places overlap); sequences without a pair that merges leave with their
number of symbols.  Because a merged symbol's pairs always rank after the pair that made it, this
gives what merging one place at a time gives.

Null or empty text: no tokens.  Special strings inside a text count as one token each, as the
vocabulary file lists them.  Repeated rows are each counted; an empty table gives no rows.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from borgata.llm import ragged

LIMIT = 1024
#: Pre-tokens whose counts a Python worker keeps between slices.
REMEMBERED = 300_000
_NONE = np.int32(np.iinfo(np.int32).max)
# Fixed value: how byte-level vocabularies of this kind cut texts; white space as Unicode defines it.
CUT = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|"
       r"\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Merges(NamedTuple):
    """byte -> symbol; sorted pair keys with rank and merged symbol of each; special strings."""

    symbol: np.ndarray
    keys: np.ndarray
    rank: np.ndarray
    made: np.ndarray
    special: tuple[str, ...]
    name: str


_WIDTH = np.int64(1 << 31)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such vocabularies: itself if printable, else the next
    letter from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for b in range(256):
        letters.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return letters


def load(path: str) -> Merges:
    """From a vocabulary file of the ``tokenizers`` library (byte-level BPE)."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    keys = np.array([vocab[a] for a, _ in pairs], np.int64) * _WIDTH + np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    symbol = np.array([vocab.get(x, -1) for x in byte_letters()], np.int64)
    special = tuple(t["content"] for t in file["added_tokens"])
    return Merges(symbol, keys[order], order.astype(np.int32), made[order], special, path)


def _ranks(m: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = left * _WIDTH + right
    place = np.minimum(np.searchsorted(m.keys, key), len(m.keys) - 1)
    hit = m.keys[place] == key
    return np.where(hit, m.rank[place], _NONE), np.where(hit, m.made[place], 0)


def merged_counts(m: Merges, sequences: list[bytes]) -> np.ndarray:
    """Symbols left of each sequence."""
    out = np.zeros(len(sequences), np.int64)
    size = np.array([len(s) for s in sequences], np.int64)
    ids = np.flatnonzero(size)
    if not len(ids):
        return out
    symbols = m.symbol[np.frombuffer(b"".join(sequences), np.uint8)]
    owner = np.repeat(np.arange(len(ids)), size[ids])
    rank = np.full(len(symbols), _NONE, np.int32)
    made = np.zeros(len(symbols), np.int64)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner], made[inner] = _ranks(m, symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        least = np.minimum.reduceat(rank, starts)
        length = np.diff(starts, append=len(symbols))
        done = least == _NONE
        if done.any():
            out[ids[done]] = length[done]
            stay = np.repeat(~done, length)
            ids, least, length = ids[~done], least[~done], length[~done]
            symbols, rank, made = symbols[stay], rank[stay], made[stay]
            owner = np.repeat(np.arange(len(ids)), length)
            if not len(symbols):
                break
        hit = rank == np.repeat(least, length)
        at = np.flatnonzero(hit)
        # Places that follow each other overlap; every other one merges, from the first on.
        new_run = np.diff(at, prepend=-2) != 1
        first = np.maximum.accumulate(np.where(new_run, at, 0))
        at = at[(at - first) % 2 == 0]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        here = at - np.arange(len(at))  # where the merged symbols are once the others are gone
        symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
        touched = np.unique(np.concatenate([here, here - 1]))
        touched = touched[touched >= 0]
        rank[touched] = _NONE
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched], made[touched] = _ranks(m, symbols[touched], symbols[touched + 1])
    return out


_known: dict[str, dict[str, int]] = {}


class Counter:
    """Counts of whole texts, with the pre-tokens of this worker remembered."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.cut = regex.compile(CUT).findall
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.known = _known.setdefault(merges.name, {})

    def _parts(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not any(x in text for x in self.merges.special):
            return self.cut(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.cut(part)], len(parts) - 1

    def counts(self, texts: list[str | None]) -> list[int]:
        parts = [self._parts(x) if x else ([], 0) for x in texts]
        new = set().union(*[p for p, _ in parts]) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*[p for p, _ in parts])
        if new:
            fresh = sorted(new)
            self.known.update(zip(fresh, merged_counts(self.merges, [x.encode() for x in fresh]).tolist(), strict=True))
        look = self.known.__getitem__
        return [sum(map(look, p)) + extra for p, extra in parts]


def count_tokens(docs: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None,
                 limit: int = LIMIT, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default all) of every row with n_bytes, n_tokens and over_limit."""
    keep = docs.columns if keep is None else keep
    merges = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    schema = T.StructType([
        *[docs.schema[c] for c in keep], T.StructField(prefix + "n_bytes", T.LongType()),
        T.StructField(prefix + "n_tokens", T.LongType()), T.StructField(prefix + "over_limit", T.BooleanType())])

    def run(batches):
        counter = Counter(merges.value)
        for batch, t in ragged.slices(batches, text):
            n = np.array(counter.counts(batch.column(text).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(np.diff(t.offsets)), pa.array(n), pa.array(n > limit)],
                names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op7_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
