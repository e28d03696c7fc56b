"""Near-duplicate vectors by an exact metric range join.

The angle between two vectors is a metric, and a cosine of at least ``least`` is an angle of at most r.
Pivots cut the vectors into cells: a vector's home is the nearest pivot's cell, and it also visits every
cell that may hold a home vector within r of it.  By the triangle inequality these are the cells whose
pivot is no farther than the cell's radius plus r, and no farther than its own pivot plus 2 r.  So each
cell has every link of its home vectors, and cells are joined independently.

Inside a cell, vectors lie in rings of r / 4 around the pivot; neighbouring rings make bands.  Two bands
whose angles to the pivot differ by more than r have no link; two whose angles add up to less than r are
linked throughout, so a group of near copies around a pivot is counted and never compared.  All other
pairs of bands are compared: in blocks of bounded size, the vectors of a large band dealt out by hash.

The pivots come from a bounded sample of ``CANDIDATES`` vectors, the ones with most links in it first.
They steer the work and not the result: links are confirmed in double precision, and none is lost
whatever the pivots are.  Where vectors are spread evenly in many dimensions, the inequality rules out
little, most vectors visit most cells, and the join is one of all blocks with all.

Every row is a vector: rows that repeat an id, or a vector, are linked like any others (equal vectors are
one class, joined once).  Null, zero, NaN or infinite components, null or empty vectors, and rows without
id link with nothing; such a row is its own component (null without id).  Vectors of different lengths
are not comparable.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borgata.llm.near_dups import Work, components

LEAST = 0.9
#: Vectors among which pivots are chosen, and bytes of them; bytes of vectors in one block.
CANDIDATES, CANDIDATE_BYTES, BLOCK_BYTES = 2048, 32 << 20, 16 << 20
FEWEST_CELLS, MOST_CELLS = 16, 1024
RINGS = 4
_EPS = 1e-6
_STEP = 512


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision.  Scaled by the largest component first, so no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Band(NamedTuple):
    """Neighbouring rings of a cell: how many vectors, with copies, the least class, and how many blocks."""

    low: int
    high: int
    rows: int
    weight: int
    least: int
    blocks: int


def bands(rings: list[tuple[int, int, int, int]], block: int) -> list[Band]:
    """Rings (ring, rows, weight, least) in order, as bands: the two that are linked throughout apart, the
    others together until they fill a block."""
    out: list[Band] = []
    for ring, rows, weight, least in sorted(rings):
        last = out[-1] if out else None
        core = RINGS // 2
        if last and (last.high < core) == (ring < core) and last.rows + rows <= block:
            out[-1] = Band(last.low, ring, last.rows + rows, last.weight + weight, min(last.least, least), 1)
        else:
            out.append(Band(ring, ring, rows, weight, least, -(-rows // block)))
    return out


class Join:
    """What every task needs to know: pivots, radii, and per cell which bands meet."""

    def __init__(self, pivots: np.ndarray, least: float, block: int):
        self.pivots, self.least, self.block = pivots, least, block
        self.range = math.acos(least)
        self.ring = (self.range - 2 * _EPS) / RINGS
        self.radius = np.full(len(pivots), -np.inf)

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(x @ self.pivots.T, -1, 1))

    def visits(self, angle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visits, the home included."""
        own = angle.min(axis=1, keepdims=True)
        return np.nonzero(angle <= np.minimum(self.radius + self.range, own + 2 * self.range) + _EPS)

    def rings(self, angle: np.ndarray) -> np.ndarray:
        return (angle / self.ring).astype(np.int64)

    def plan(self, home: dict[int, list], member: dict[int, list]) -> None:
        """Bands of each cell, which pairs are compared (and the number of the first of their blocks) or
        linked throughout."""
        self.homes = {c: bands(r, self.block) for c, r in home.items()}
        self.members = {c: bands(member[c], self.block) for c in home}
        self.compared: dict[int, list[tuple[int, int, int]]] = {}
        self.linked: dict[int, list[tuple[int, int]]] = {}
        first = 0
        for c, hs in self.homes.items():
            self.compared[c], self.linked[c] = [], []
            for i, a in enumerate(hs):
                for j, b in enumerate(self.members[c]):
                    gap = max(a.low - b.high, b.low - a.high) - 1
                    if gap * self.ring > self.range + _EPS:
                        continue
                    if (a.high + b.high + 2) * self.ring <= self.range - _EPS:
                        self.linked[c].append((i, j))
                    else:
                        self.compared[c].append((i, j, first))
                        first += a.blocks * b.blocks

    @staticmethod
    def place(found: list[Band], ring: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array([b.low for b in found]), ring, side="right") - 1


def choose_pivots(x: np.ndarray, cells: int, least: float) -> np.ndarray:
    """The candidates that cover most others not yet covered, one after the other."""
    near = x @ x.T >= least
    left, chosen = np.ones(len(x), bool), []
    while left.any() and len(chosen) < cells:
        best = int(np.argmax((near & left).sum(axis=1)))
        chosen.append(best)
        left &= ~near[best]
        left[best] = False
    return x[chosen]


def _labelled(labels: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Joins the sets of all pairs; ``labels`` leads from each place to the smallest of its set."""
    while True:
        a, b = labels[one], labels[two]
        apart = a != b
        if not apart.any():
            return
        one, two, a, b = one[apart], two[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels[:] = jumped


def compare_block(x: np.ndarray, weight: np.ndarray, home: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the members linked with each home vector, and the smallest place each place is linked with.

    Products in single precision decide what is clear; what is near the limit is done again in double."""
    labels = np.arange(len(x))
    mine, others = np.flatnonzero(home), np.flatnonzero(~home)
    single, to, near = x.astype(np.float32), weight[others], 1e-6 * (16 + x.shape[1])
    counts = np.zeros(len(mine), np.int64)
    for start in range(0, len(mine), _STEP):
        rows = mine[start:start + _STEP]
        i, j = np.nonzero(single[rows] @ single[others].T >= np.float32(least - near))
        exact = np.empty(len(i))
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            exact[part] = np.einsum("ij,ij->i", x[rows[i[part]]], x[others[j[part]]])
        i, j = i[exact >= least], j[exact >= least]
        counts[start:start + _STEP] = np.bincount(i, to[j], minlength=len(rows)).astype(np.int64)
        _labelled(labels, rows[i], others[j])
    return counts, labels


def _homed(classes: DataFrame, join, dim: int) -> DataFrame:
    """Classes with home cell and angle."""

    def run(batches):
        for batch in batches:
            angle = join.value.angles(_matrix(batch.column("v"), dim))
            home = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(angle.min(axis=1))], names=[*batch.schema.names, "cell", "angle"])

    kind = classes.schema["v"].dataType.simpleString()
    return classes.mapInArrow(run, f"cls long, size long, v {kind}, cell long, angle double")


def _ring_counts(homed: DataFrame, join, dim: int) -> tuple[dict[int, list], dict[int, list]]:
    """Rings of each cell's home vectors and of all that visit it; a row per ring and cell comes to the driver."""

    def run(batches):
        for batch in batches:
            angle = join.value.angles(_matrix(batch.column("v"), dim))
            row, cell = join.value.visits(angle)
            ring = join.value.rings(angle[row, cell])
            home = cell == batch.column("cell").to_numpy()[row]
            size, cls = (batch.column(c).to_numpy()[row] for c in ("size", "cls"))
            for of, which in ((True, home), (False, np.ones(len(row), bool))):
                key, at = np.unique(np.stack([cell[which], ring[which]]), axis=1, return_inverse=True)
                least = np.full(key.shape[1], np.iinfo(np.int64).max)
                np.minimum.at(least, at, cls[which])
                weight = np.zeros(key.shape[1], np.int64)
                np.add.at(weight, at, size[which])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(key.shape[1], of)), pa.array(key[0]), pa.array(key[1]),
                     pa.array(np.bincount(at, minlength=key.shape[1])), pa.array(weight), pa.array(least)],
                    names=["home", "cell", "ring", "n", "weight", "least"])

    counted = homed.mapInArrow(run, "home boolean, cell long, ring long, n long, weight long, least long")
    found: tuple[dict, dict] = ({}, {})
    for home, cell, *ring in counted.groupBy("home", "cell", "ring").agg(F.sum("n"), F.sum("weight"), F.min("least")).collect():
        found[not home].setdefault(cell, []).append(tuple(ring))
    return found


def _dealt(homed: DataFrame, join, dim: int) -> DataFrame:
    """(g, home, cls, size, v): every vector in all blocks it is compared in."""

    def run(batches):
        for batch in batches:
            j = join.value
            angle = j.angles(_matrix(batch.column("v"), dim))
            row, cell = j.visits(angle)
            ring = j.rings(angle[row, cell])
            own = batch.column("cell").to_numpy()
            salt = batch.column("cls").to_numpy() * np.int64(0x5851F42D4C957F2D) >> np.int64(33)
            for c in np.unique(cell).tolist():
                here = np.flatnonzero(cell == c)
                r, turn = row[here], salt[row[here]]
                as_home = own[r] == c
                hs, ms = j.homes[c], j.members[c]
                of_member = Join.place(ms, ring[here])
                of_home = np.where(as_home, Join.place(hs, ring[here]), -1)
                for i, m, first in j.compared[c]:
                    a, b = hs[i].blocks, ms[m].blocks
                    made = []
                    mine, others = np.flatnonzero(of_home == i), np.flatnonzero(of_member == m)
                    for k in range(b if len(mine) else 0):
                        made.append((first + turn[mine] % a * b + k, True, r[mine]))
                    for k in range(a if len(others) else 0):
                        made.append((first + k * b + turn[others] % b, False, r[others]))
                    for g, home, rows in made:
                        part = batch.select(["cls", "size", "v"]).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(g.astype(np.int64)), pa.array(np.full(len(rows), home)), *part.columns],
                            names=["g", "home", "cls", "size", "v"])

    kind = homed.schema["v"].dataType.simpleString()
    return homed.mapInArrow(run, f"g long, home boolean, cls long, size long, v {kind}")


def _linked(homed: DataFrame, join, dim: int) -> DataFrame:
    """(cls, other, n) of bands that are linked throughout: the weight for each home vector, and one link
    with the home band's least class for each vector of both."""

    def run(batches):
        for batch in batches:
            j = join.value
            angle = j.angles(_matrix(batch.column("v"), dim))
            row, cell = j.visits(angle)
            ring, cls = j.rings(angle[row, cell]), batch.column("cls").to_numpy()
            own = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                here = np.flatnonzero(cell == c)
                of_member = Join.place(j.members[c], ring[here])
                of_home = np.where(own[row[here]] == c, Join.place(j.homes[c], ring[here]), -1)
                for i, m in j.linked[c]:
                    for rows, n in ((row[here[of_home == i]], j.members[c][m].weight), (row[here[of_member == m]], 0)):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(cls[rows]), pa.array(np.full(len(rows), j.homes[c][i].least)),
                             pa.array(np.full(len(rows), n, np.int64))], names=["cls", "other", "n"])

    return homed.mapInArrow(run, "cls long, other long, n long")


def _links(work: Work, classes: DataFrame, dim: int, least: float) -> DataFrame:
    """(cls, other, n) of vectors of one length: n adds up to the weight linked with cls, itself included;
    the pairs (cls, other) connect what is connected."""
    spark, block = work.spark, max(_STEP, BLOCK_BYTES // (8 * dim))
    bound = max(64, min(CANDIDATES, CANDIDATE_BYTES // (8 * dim)))
    sample = classes.orderBy(F.xxhash64("v"), "cls").limit(bound).select("v").toArrow().column("v").combine_chunks()
    cells = min(MOST_CELLS, max(FEWEST_CELLS, -(-classes.count() // block)))
    join = Join(choose_pivots(_matrix(sample, dim), cells, least), least, block)
    shared = spark.sparkContext.broadcast(join)
    homed = work.keep(_homed(classes, shared, dim))
    for cell, radius in homed.groupBy("cell").agg(F.max("angle")).collect():
        join.radius[cell] = radius
    shared = spark.sparkContext.broadcast(join)
    join.plan(*_ring_counts(homed, shared, dim))
    shared = spark.sparkContext.broadcast(join)

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        cls, size = table.column("cls").to_numpy(), table.column("size").to_numpy()
        counts, labels = compare_block(_matrix(table.column("v").combine_chunks(), dim), size, home, least)
        joined = np.flatnonzero(cls[labels] != cls)
        a, b = np.concatenate([cls[home], cls[joined]]), np.concatenate([cls[home], cls[labels[joined]]])
        n = np.concatenate([counts, np.zeros(len(joined), np.int64)])
        return pa.table({"cls": a, "other": b, "n": n})

    found = _dealt(homed, shared, dim).groupBy("g").applyInArrow(compare, "cls long, other long, n long")
    if any(join.linked.values()):
        found = found.unionAll(_linked(homed, shared, dim))
    return work.keep(found)


def find_links(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", least: float = LEAST) -> DataFrame:
    """(vec, n_links, component) of every row: other vectors linked directly, and the smallest id reachable."""
    if not 0 < least < 1:
        raise ValueError("the least cosine must lie between 0 and 1")
    work = Work(vectors.sparkSession)
    v = F.col("v")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec).cast("long").alias("vec"), F.col(embedding).alias("v"))
    good = F.when(F.col("vec").isNotNull() & F.coalesce(usable, F.lit(False)), v)
    rows = rows.withColumn("v", good).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    rows = rows.withColumn("h1", F.when(v.isNotNull(), F.col("h1")))
    classes = rows.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("vec").alias("least"), F.count("*").alias("size"), F.any_value("v").alias("v"))
    classes = work.keep(classes.withColumn("cls", F.monotonically_increasing_id()))
    found = None
    for (dim,) in classes.select(F.size("v")).distinct().orderBy(F.size("v")).collect():
        same = classes.filter(F.size("v") == dim).select("cls", "size", "v")
        links = _links(work, same, dim, least)
        found = links if found is None else found.unionAll(links)
    if found is None:
        return rows.select("vec", F.lit(0).cast("long").alias("n_links"), F.col("vec").alias("component"))
    counts = found.groupBy("cls").agg((F.sum("n") - 1).alias("n_links"))
    labels = components(work, found.filter("cls <> other").select(F.col("cls").alias("a"), F.col("other").alias("b")).distinct())
    named = classes.select("cls", "h1", "h2", "least").join(counts, "cls").join(
        labels.select(F.col("rep").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("least").alias("smallest"))
    named = named.join(smallest, "component").select("h1", "h2", "n_links", "smallest")
    return rows.select("vec", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("smallest", "vec").alias("component"))


def op11_vector_dups(spark: SparkSession, sf: str) -> DataFrame:
    found = find_links(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return found.select(
        F.col("vec").alias("vec_id"), "n_links", F.col("component").alias("component_id"),
        F.coalesce(F.col("vec") == F.col("component"), F.lit(True)).alias("kept"))
