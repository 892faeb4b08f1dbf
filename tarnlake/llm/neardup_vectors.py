"""Near-duplicate vectors by an exact metric range join.

On unit vectors, a cosine of at least t is a distance of at most
e = sqrt(2 - 2t). Pivots partition the vectors: each is at home in the cell of
its nearest pivot p. A vector v may have a partner in the cell of another pivot
q only if it is within e of the hyperplane between p and q, which by the
triangle inequality means

    (d(v,q)^2 - d(v,p)^2) / (2 d(p,q)) <= e,

and is replicated there in that case. So a cell holds all partners of the
vectors at home in it and is joined by itself: block by block, as products of
matrices, counting partners and joining trees instead of listing pairs. Both
sides ascend by their distance to the cell's pivot, and only those meet whose
distances differ by at most e, by the triangle inequality again. Equal vectors
are one row with a weight. A cell with many at home is dealt out in blocks of
them, each of which meets all that the cell holds. There are as many pivots as
blocks are expected, however many vectors there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import Forest, components, stage

LEAST_COSINE = 0.95
#: Vectors at home in a block, at most.
BLOCK = 8192
#: Vectors that meet a block at once, and cells of a matrix of distances to pivots.
MET, DISTANCES = 512, 1 << 22
#: Above the rounding of distances between unit vectors.
SLACK = 1e-9


def _unit(rows: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vec)``: doubles as bytes, scaled by the largest component; null if the vector links with nothing."""

    def run(batches):
        for batch in batches:
            out = []
            for x in batch.column("vec"):
                x = None if x.as_py() is None else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                usable = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append((x / np.abs(x).max()).astype("<f8").tobytes() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.mapInArrow(run, "vec_id long, vec binary")


class Pivots:
    """The pivots for vectors of one length."""

    def __init__(self, units: np.ndarray) -> None:
        self.units = units

    def cells(self, x: np.ndarray, most: float):
        """For some vectors at a time: which, the home cell of each, whether it is needed in each cell, and its distances to the pivots."""
        step = max(1, DISTANCES // len(self.units))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            square = np.maximum(2 - 2 * part @ self.units.T, 0)
            home = square.argmin(axis=1)
            row = np.arange(len(part))
            apart = np.sqrt(np.maximum(2 - 2 * self.units[home] @ self.units.T, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                needed = (square - square[row, home][:, None]) / (2 * apart) <= most + SLACK
            needed[row, home] = True
            yield slice(at, at + len(part)), home, needed, np.sqrt(square)


def _choose_pivots(classes: DataFrame, n: int, cell: int) -> dict[int, Pivots]:
    """Vectors with the smallest hashes, about one in ``cell`` of them."""
    k = max(1, -(-n // cell))
    by_length: dict[int, list[bytes]] = {}
    for (vec,) in classes.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(k).collect():
        by_length.setdefault(len(vec), []).append(bytes(vec))
    found = {}
    for length, rows in by_length.items():
        units = _unit(rows)
        found[length] = Pivots(units[np.sort(np.unique(np.round(units, 3), axis=0, return_index=True)[1])])
    return found


PLACED = "place int, replica boolean, far double, rep long, n long, vec binary"


def _place(classes: DataFrame, pivots: dict[int, Pivots], most: float, blocks: dict[tuple[int, int], int] | None) -> DataFrame:
    """Rows of ``classes(rep, n, vec)`` by place, one for each block of a cell; without ``blocks``, how many are at home in each cell."""
    cells = sorted(blocks or {})
    places = dict(zip(cells, np.cumsum([0, *(blocks[c] for c in cells)]).tolist(), strict=False))  # the first of each cell
    shared = classes.sparkSession.sparkContext.broadcast((pivots, blocks, places))  # a vector and two numbers for each cell

    def rows_of(batches):
        known, cut, _ = shared.value
        for batch in batches:
            reps, weights, vecs = (batch.column(x).to_pylist() for x in ("rep", "n", "vec"))
            sizes = np.array([len(v) for v in vecs])
            for length in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == length)
                x = _unit([vecs[i] for i in at])
                if length not in known:  # too few to have a pivot
                    yield length, at, reps, weights, vecs, np.zeros(len(at), np.int64), np.ones((len(at), 1), bool), np.zeros((len(at), 1)), cut
                    continue
                for part, home, needed, far in known[length].cells(x, most):
                    yield length, at[part], reps, weights, vecs, home, needed, far, cut

    def count(batches):
        for length, _, _, _, _, home, *_ in rows_of(batches):
            cells, n = np.unique(home, return_counts=True)
            yield pa.RecordBatch.from_pydict({"length": pa.array([length] * len(cells), pa.int32()), "cell": pa.array(cells, pa.int32()), "n": pa.array(n, pa.int64())})

    if blocks is None:
        return classes.mapInArrow(count, "length int, cell int, n long")

    def place(batches):
        for length, at, reps, weights, vecs, home, needed, far, cut in rows_of(batches):
            row, cell = np.nonzero(needed)
            parts = np.array([cut.get((length, c), 0) for c in range(needed.shape[1])])[cell]
            row, cell = np.repeat(row, parts), np.repeat(cell, parts)
            block = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
            own = np.array([hash(reps[i]) % cut[length, h] for i, h in zip(at.tolist(), home.tolist(), strict=True)], np.int64)
            row, cell, block = np.append(row, np.arange(len(at))), np.append(cell, home), np.append(block, own)
            replica = np.arange(len(row)) < len(row) - len(at)
            first = shared.value[2]
            spot = np.array([first.get((length, c), 0) for c in range(needed.shape[1])])[cell] + block
            for i in range(0, len(row), 20_000):
                cut_out = slice(i, i + 20_000)
                part = at[row[cut_out]].tolist()
                columns = (spot[cut_out], replica[cut_out], far[row[cut_out], cell[cut_out]], [reps[r] for r in part], [weights[r] for r in part], [vecs[r] for r in part])
                kinds = (pa.int32(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["place", "replica", "far", "rep", "n", "vec"])

    return classes.mapInArrow(place, PLACED)


class _Block:
    """What is at home in a block, and the partners met so far; all come by their distance to the pivot."""

    def __init__(self) -> None:
        self.reps: list[int] = []
        self.vecs: list[bytes] = []
        self.fars: list[float] = []
        self.units = None

    def close_home(self) -> None:
        self.units = _unit(self.vecs)
        self.ids, self.far = np.array(self.reps, np.int64), np.array(self.fars)
        self.links = np.zeros(len(self.ids), np.int64)
        self.trees = Forest(len(self.ids))

    def meet(self, reps: np.ndarray, weights: np.ndarray, far: np.ndarray, vecs: list[bytes], least: float) -> list[tuple[int, int]]:
        """Count the partners among these; the edges tie each of them to a vector at home."""
        if self.units is None:
            self.close_home()
        most = np.sqrt(2 - 2 * least) + SLACK
        low, high = np.searchsorted(self.far, [far[0] - most, far[-1] + most]).tolist()
        linked = self.units[low:high] @ _unit(vecs).T >= least
        linked &= self.ids[low:high, None] != reps[None, :]
        self.links[low:high] += linked @ weights
        edges = []
        for j in np.flatnonzero(linked.any(axis=0)).tolist():
            first, *rest = (low + np.flatnonzero(linked[:, j])).tolist()
            edges.append((int(reps[j]), int(self.ids[first])))
            for i in rest:
                self.trees.join(first, i)
        return edges

    def end(self) -> list[tuple[int, int, int]]:
        if self.units is None:
            self.close_home()
        return [(int(x), int(self.ids[self.trees.find(i)]), int(n)) for i, (x, n) in enumerate(zip(self.ids, self.links, strict=True))]


#: ``links`` is null in edges to vectors at home elsewhere.
JOINED = "rep long, other long, links long"


def _join_cells(placed: DataFrame, parts: int, least: float) -> DataFrame:
    def run(batches):
        now, block = None, _Block()
        schema = pa.schema([("rep", pa.int64()), ("other", pa.int64()), ("links", pa.int64())])
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3, schema=schema)
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("place", "replica")], axis=1)
            cuts = sorted({0, len(keys), *range(0, len(keys), MET), *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()})
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                *key, replica = keys[a].tolist()
                if key != now:
                    if now is not None:
                        yield made(block.end())
                    now, block = key, _Block()
                part = batch.slice(a, b - a)
                reps, vecs = part.column("rep"), part.column("vec").to_pylist()
                if not replica:
                    block.reps += reps.to_pylist()
                    block.vecs += vecs
                    block.fars += part.column("far").to_pylist()
                elif block.reps:
                    edges = block.meet(reps.to_numpy(), part.column("n").to_numpy(), part.column("far").to_numpy(), vecs, least)
                    yield made([(x, y, None) for x, y in edges])
        if now is not None:
            yield made(block.end())

    return placed.repartitionById(parts, F.col("place")).sortWithinPartitions("place", "replica", "far").mapInArrow(run, JOINED)


def vector_groups(vectors: DataFrame, least_cosine: float = LEAST_COSINE, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row per row of ``vectors(vec_id, embedding)``.

    Vectors that are null, empty, zero or hold null or non-finite components
    have no links and are their own component; so are rows without a vec_id,
    whose component is null and which are kept. Vectors of different lengths do
    not link. Rows that share a vec_id are one node: equal ones do not count as
    each other's links, and an id counts once for each vector that it has. Other
    columns may have any names and are left out.
    """
    spark = vectors.sparkSession
    most = float(np.sqrt(2 - 2 * least_cosine))
    rows = stage(_packed(vectors), "vectors")
    usable = rows.where("vec is not null and vec_id is not null")
    classes = stage(usable.distinct().groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).select("rep", "n", "vec"), "classes")
    pivots = _choose_pivots(classes, classes.count(), block)
    home = _place(classes, pivots, most, None).groupBy("length", "cell").agg(F.sum("n").alias("n")).collect()
    blocks = {(length, cell): -(-n // block) for length, cell, n in home}
    placed = _place(classes, pivots, most, blocks)
    joined = stage(_join_cells(placed, max(1, sum(blocks.values())), least_cosine), "joined")
    found = components(joined.select(F.col("rep").alias("u"), F.col("other").alias("v")))
    # a class may be met in several rows only if a vec_id has several vectors
    counts = joined.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    known = classes.join(counts, "rep").join(found, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("vec"), (F.col("links") + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    out = usable.join(known, "vec").select("vec_id", F.col("_links").alias("n_links"), F.col("_component").alias("component_id"))
    rest = rows.where("vec is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
