"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine t or more are at a squared distance of at most 2 - 2 t. They are rotated, which spreads every
direction over all coordinates, and cut into ``BLOCKS`` blocks of coordinates. If two vectors are that close, then in at
least one block their squared distance is at most the block's share of the budget. So each block is joined for itself
within its share, and what any block finds is verified on the whole vectors.

The range join of a block lays a grid over its first coordinates. Every vector stands in its home cell and is also sent
to the neighbouring cells (in one direction) that it can reach. Cells are divided into parts of at most about ``TILE``
vectors, fewer if they are long, and each pair of parts is one group, so a group is bounded whatever the data; inside it
distances are matrix products. Parts of one cell meet once, in one order. The number of cells is bounded by the geometry,
so their counts may be sent to every task. In many dimensions the grid separates little, and the groups of a crowded
cell compare nearly all of its pairs by a block's few coordinates.

Groups return for each vector how many others it is linked with, and a spanning forest of the links, never the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedwright.llm.components import components, saved, with_summary

BLOCKS = 4
#: Coordinates of a block that the grid covers.
GRID = 2
TILE = 32_768
#: Numbers in the vectors of one part.
_NUMBERS = 1 << 21
_ROWS, _COLUMNS = 512, 2048


class Space:
    """Rotation, blocks and cells for vectors of one dimension."""

    def __init__(self, dim: int, threshold: float) -> None:
        drawn = np.random.default_rng(dim).standard_normal((dim, dim))
        self.rotation = np.linalg.qr(drawn)[0]
        blocks = min(BLOCKS, dim)
        edges = np.linspace(0, dim, blocks + 1).astype(int).tolist()
        self.blocks = [slice(a, b) for a, b in zip(edges, edges[1:])]
        # A little is added so that rounding loses no pair.
        self.budgets = [max(0.0, 2 - 2 * threshold) * (s.stop - s.start) / dim + 1e-9 for s in self.blocks]

    def rotated(self, raw: np.ndarray) -> np.ndarray:
        return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)) @ self.rotation

    def cells(self, x: np.ndarray, block: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Home cells of rotated vectors, and per direction which vectors are sent on and to which cells."""
        s, reach = self.blocks[block], float(np.sqrt(self.budgets[block])) * (1 + 1e-6)
        grid = min(GRID, s.stop - s.start)
        at, width = x[:, s.start : s.start + grid], 2 * reach
        home = np.floor(at / width).astype(np.int64)
        low = at - home * width
        sent = []
        for way in product((-1, 0, 1), repeat=grid):
            if way <= (0,) * grid:
                continue
            gap = sum((np.square(width - low[:, k]) if w > 0 else np.square(low[:, k])) for k, w in enumerate(way) if w)
            near = np.flatnonzero(gap <= reach * reach)
            sent.append((near, home[near] + np.array(way)))
        return home, sent


def _cell(block: int, cells: np.ndarray) -> np.ndarray:
    """One number for block and cell."""
    out = np.full(len(cells), block, dtype=np.int64)
    for k in range(cells.shape[1]):
        out = out * (1 << 20) + cells[:, k] + (1 << 19)
    return out


def _vectors(column: pa.Array, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64)


def _by_dim(batch: pa.RecordBatch, kind: np.dtype) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, row numbers, vectors) of a batch with a column vec."""
    sizes = np.array([len(v) for v in batch.column("vec").to_pylist()]) // kind.itemsize
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, _vectors(batch.column("vec").take(pa.array(rows)), kind).reshape(-1, dim)


def _near(own: np.ndarray, h: np.ndarray, p: np.ndarray | None, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``h`` and one of ``p`` - or of two rows of ``h``, each once - at a squared distance of at most
    about ``most``, tile by tile. The product of the widened rows is the distance itself."""
    square, one = (own * own).sum(axis=1, dtype=np.float32)[:, None], np.ones((len(own), 1), np.float32)
    left, right = np.hstack([own, square, one]), np.hstack([-2 * own, one, square])
    others = h if p is None else p
    for at in range(0, len(h), _ROWS):
        rows = h[at : at + _ROWS]
        # Among themselves, rows meet those in front of them only.
        for start in range(0, min(len(others), at + _ROWS) if p is None else len(others), _COLUMNS):
            columns = others[start : start + _COLUMNS]
            i, j = np.nonzero(left[rows] @ right[columns].T <= most)
            if p is None:
                earlier = start + j < at + i
                i, j = i[earlier], j[earlier]
            if len(i):
                yield rows[i], columns[j]


def _links(space: Space, block: int, raw: np.ndarray, h: np.ndarray, p: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs, as row numbers out of ``h`` and ``p`` (or two of ``h``), whose first close block is this one."""
    turned, size = space.rotated(raw), np.sqrt((raw * raw).sum(axis=1))
    for i, j in _near(turned[:, space.blocks[block]].astype(np.float32), h, p, space.budgets[block] + 1e-4):
        for k in range(0, len(i), 50_000):
            a, b = i[k : k + 50_000], j[k : k + 50_000]
            linked = np.einsum("ij,ij->i", raw[a], raw[b]) / (size[a] * size[b]) >= threshold
            a, b = a[linked], b[linked]
            apart = np.square(turned[a] - turned[b])
            close = [apart[:, t].sum(axis=1) <= most for t, most in zip(space.blocks, space.budgets)]
            first = np.argmax(np.array(close), axis=0) == block
            yield a[first], b[first]


class Forest:
    """Joined sets of row numbers."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            self.up[high] = low  # of several writes to one place one holds; the others are met in the next round
            a, b = low, high

    def roots(self, a: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[a]
            if np.array_equal(up, a):
                return a
            self.up[a] = self.up[up]
            a = up


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tile: int = TILE
) -> DataFrame:
    """One row per row of ``vectors``: id, n_links (other vectors of cosine ``threshold`` or more), component_id (smallest
    id reachable by links) and kept (whether it is this id).

    Vectors that are null, empty or zero, or hold null or non-finite components, are linked with nothing, as are vectors
    of different dimensions. Equal vectors are compared as one. Rows without an id are linked with nothing and kept.
    ``threshold`` is above 0.
    """
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else np.float64)
    own = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<float>" if single else "array<double>").alias("_vec"))
    exact = threshold

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                x = None if v.as_py() is None else v.values.to_numpy(zero_copy_only=False).astype(kind)
                wide = None if x is None else x.astype(np.float64)
                good = x is not None and len(x) and np.isfinite(wide).all() and 0 < float(wide @ wide) < np.inf
                out.append(x.tobytes() if good else None)
            digests = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(digests, pa.binary())], names=["_id", "vec", "digest"])

    known = saved(own.mapInArrow(pack, "_id long, vec binary, digest binary"))
    usable = F.col("_id").isNotNull() & F.col("digest").isNotNull()
    # Map-side folding first: a vector that is everywhere leaves one row per task.
    classes = saved(known.where(usable).groupBy("digest").agg(F.min("_id").alias("id"), F.count(F.lit(1)).alias("n"), F.min("vec").alias("vec")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, raw in _by_dim(batch, kind):
                space = Space(dim, exact)
                x = space.rotated(raw)
                for b in range(len(space.blocks)):
                    home, sent = space.cells(x, b)
                    for probe, cells in ((False, [home]), (True, [c for _, c in sent])):
                        keys, n = np.unique(_cell(b, np.concatenate(cells)), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([dim] * len(keys), pa.int64()), pa.array(keys), pa.array([probe] * len(keys), pa.bool_()), pa.array(n, pa.int64())],
                            names=["dim", "cell", "probe", "n"],
                        )

    counts = classes.select("vec").mapInArrow(count, "dim long, cell long, probe boolean, n long").groupBy("dim", "cell", "probe").agg(F.sum("n").alias("n"))
    # Unit vectors span a fixed range, so there is a fixed number of cells for each dimension.
    parts = {(r["dim"], r["cell"], r["probe"]): -(-r["n"] // min(tile, max(1, _NUMBERS // r["dim"]))) for r in counts.collect()}
    shared = vectors.sparkSession.sparkContext.broadcast(parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            for dim, rows, raw in _by_dim(batch, kind):
                space = Space(dim, exact)
                x = space.rotated(raw)
                salt = batch.column("id").take(pa.array(rows)).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)

                def sent_to(block: int, cell: int, mine: np.ndarray, probe: bool, i: np.ndarray, j: np.ndarray, inside: bool) -> pa.RecordBatch:
                    table = batch.select(["id", "n", "vec"]).take(pa.array(rows[mine]))
                    numbers = [pa.array([v] * len(mine), pa.int64()) for v in (dim, block, cell)]
                    flags = [pa.array([v] * len(mine)) for v in (inside, probe)]
                    return pa.RecordBatch.from_arrays([*numbers, flags[0], pa.array(i), pa.array(j), flags[1], *table.columns], names=_DEALT)

                for b in range(len(space.blocks)):
                    home, sent = space.cells(x, b)
                    for probe, who, cells in [(False, np.arange(len(rows)), home), *((True, w, c) for w, c in sent)]:
                        cell = _cell(b, cells)
                        for c in np.unique(cell).tolist():
                            n_home, n_probe = parts.get((dim, c, False), 0), parts.get((dim, c, True), 0)
                            if not n_home:
                                continue
                            mine = who[cell == c]
                            part = (salt[mine] % np.uint64(n_probe if probe else n_home)).astype(np.int64)
                            # Homes meet the probes of other cells, every part with every part,
                            for other in range(n_home if probe else n_probe):
                                i, j = (np.full(len(mine), other), part) if probe else (part, np.full(len(mine), other))
                                yield sent_to(b, c, mine, probe, i, j, False)
                            # and each other: part i as homes meets the parts before it as probes, and itself.
                            for other in () if probe else range(n_home):
                                low, high = np.minimum(part, other), np.maximum(part, other)
                                for ahead in (False, True):
                                    take = (part < other) if ahead else (part >= other)
                                    if take.any():
                                        yield sent_to(b, c, mine[take], ahead, high[take], low[take], True)

    dealt = classes.select("id", "n", "vec").mapInArrow(deal, _DEALT_SCHEMA)

    def compare(table: pa.Table) -> pa.Table:
        dim, block = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        space = Space(dim, exact)
        probe, ids, n = (table.column(c).to_numpy() for c in ("probe", "id", "n"))
        itself = table.column("inside")[0].as_py() and table.column("i")[0].as_py() == table.column("j")[0].as_py()
        raw = _vectors(table.column("vec"), kind).reshape(-1, dim)
        h, p = np.flatnonzero(~probe), None if itself else np.flatnonzero(probe)
        linked = np.zeros(len(ids), dtype=np.int64)
        forest = Forest(len(ids))
        for a, b in _links(space, block, raw, h, p, exact):
            np.add.at(linked, a, n[b])
            np.add.at(linked, b, n[a])
            forest.join(a, b)
        some = np.flatnonzero(linked)
        roots = forest.roots(some)
        return pa.table([pa.array(ids[some]), pa.array(linked[some]), pa.array(ids[roots])], names=["id", "linked", "root"])

    found = saved(dealt.groupBy("dim", "block", "cell", "inside", "i", "j").applyInArrow(compare, "id long, linked long, root long"))
    linked = found.groupBy("id").agg(F.sum("linked").alias("linked")).withColumnRenamed("id", "_l")
    joined = components(found, "id", "root")
    rep = classes.select("digest", "id", "n")
    rep = rep.join(linked, rep.id == F.col("_l"), "left").join(joined, rep.id == F.col("node"), "left")
    rep = rep.select(
        F.col("digest").alias("_d"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    member = with_summary(known.where(usable).select("_id", "digest"), rep, "digest", "_d").select("_id", "n_links", "component_id")
    alone = known.where(~usable).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("component_id"))
    return member.unionByName(alone).select(
        F.col("_id").cast(vectors.schema[id_col].dataType).alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


_DEALT = ["dim", "block", "cell", "inside", "i", "j", "probe", "id", "n", "vec"]
_DEALT_SCHEMA = "dim long, block long, cell long, inside boolean, i long, j long, probe boolean, id long, n long, vec binary"
