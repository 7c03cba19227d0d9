"""Cells of bounded size for searches in space: exact neighbours, pairs within a radius, nearest denser rows.

A partition is made from a sample and then counted: boxes of a k-d tree, whose overfull leaves are split again, or, where there
are many dimensions, the nearest of some pivots. Each cell has bounds (a tight box; distances from its pivot), so a
row need only be sent to cells that its search ball may touch. Rows of a cell are dealt in blocks; a
task never holds more than a block, and meets the rows that search it as a stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import map_in_arrow, materialize, ship

#: Rows of a cell, aimed at; cells of a partition, which is sent to the workers; sampled rows a cell.
CELL, MOST_CELLS, PER_CELL = 512, 8192, 32
#: Rows of a block, and searching rows that one task takes to it.
BLOCK, SEARCHERS = 4096, 65536
#: Dimensions up to which boxes are used; beyond, pivots.
BOX_DIMENSIONS = 3
#: Products that take as long as a row that travels, and copies of a row that may travel: beyond, all rows pass broadcast blocks.
ROW_WORK, COPIES = 200, 64
#: Bytes of a block that is broadcast, and its rows that are met at once.
BLOCK_BYTES, AT_ONCE = 64 << 20, 8192
#: Relative slack of bounds, for rounding.
_SLACK = 1e-9


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Boxes:
    """Leaves of a k-d tree over rows of `sample`, split at medians of the widest side. box: low and high of each node, from all rows."""

    def __init__(self, sample: np.ndarray, per_leaf: int):
        self.axis, self.at, self.child, self.leaf = [-1], [0.0], [(-1, -1)], [0]
        self.n_leaves = 1
        self._split(0, sample, per_leaf)
        self._freeze()

    def _split(self, node: int, rows: np.ndarray, per_leaf: int) -> None:
        work = [(node, rows)]
        while work:
            node, rows = work.pop()
            if len(rows) <= per_leaf or not (width := np.ptp(rows, axis=0)).max() > 0:
                continue
            axis = int(width.argmax())
            v = rows[:, axis]
            cut = float(np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2])
            if cut == v.max():  # equal values stay together
                cut = float(v[v < cut].max())
            low = v <= cut
            self.axis[node], self.at[node] = axis, cut
            self.child[node] = (len(self.axis), len(self.axis) + 1)
            # the first child keeps the leaf's number
            for number in (self.leaf[node], self.n_leaves):
                self.axis.append(-1), self.at.append(0.0), self.child.append((-1, -1)), self.leaf.append(number)
            self.n_leaves += 1
            self.leaf[node] = -1
            work += [(self.child[node][0], rows[low]), (self.child[node][1], rows[~low])]

    def _freeze(self) -> None:
        self._axis, self._at, self._child, self._leaf = (np.array(a) for a in (self.axis, self.at, self.child, self.leaf))

    def refine(self, samples: dict[int, np.ndarray], per_leaf: int) -> None:
        """Splits some leaves further by rows of their own."""
        node_of = {leaf: node for node, leaf in enumerate(self.leaf) if leaf >= 0}
        for leaf, rows in samples.items():
            self._split(node_of[leaf], rows, per_leaf)
        self._freeze()

    def assign(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(rows):
            rows = rows[self._axis[node[rows]] >= 0]
            n = node[rows]
            node[rows] = self._child[n, (x[rows, self._axis[n]] > self._at[n]).astype(int)]
        return self._leaf[node]

    def measure(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """What bounds are made of: for each row, values whose least (first half) and largest (second half) bound its cell."""
        return np.concatenate([x, x], axis=1)

    def bound(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        d = low.shape[1] // 2
        self.count = count
        self.low, self.high = np.full((len(self.leaf), d), np.inf), np.full((len(self.leaf), d), -np.inf)
        leaves = np.flatnonzero(self._leaf >= 0)
        self.low[leaves], self.high[leaves] = low[self._leaf[leaves], :d], high[self._leaf[leaves], d:]
        for node in range(len(self.leaf) - 1, -1, -1):  # children come after their parent
            if self.leaf[node] < 0:
                a, b = self.child[node]
                self.low[node], self.high[node] = np.minimum(self.low[a], self.low[b]), np.maximum(self.high[a], self.high[b])

    def single(self) -> np.ndarray:
        """Cells whose rows are all at one place."""
        flat = np.zeros(self.n_leaves, bool)
        leaves = np.flatnonzero(self._leaf >= 0)
        flat[self._leaf[leaves]] = (self.low[leaves] == self.high[leaves]).all(axis=1)
        return flat

    def reach(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells whose box is within r of a row."""
        rows, nodes, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(rows):
            gap = np.maximum(0, np.maximum(self.low[nodes] - x[rows], x[rows] - self.high[nodes]))
            near = (gap * gap).sum(axis=1) <= (r[rows] * (1 + _SLACK)) ** 2
            rows, nodes = rows[near], nodes[near]
            leaf = self._leaf[nodes]
            out.append((rows[leaf >= 0], leaf[leaf >= 0]))
            inner = leaf < 0
            rows, nodes = np.repeat(rows[inner], 2), self._child[nodes[inner]].ravel()
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def within(self, x: np.ndarray, k: int) -> np.ndarray:
        """For each row a radius that has k rows besides it, from the boxes' far corners."""
        leaves = np.flatnonzero(self._leaf >= 0)
        far = np.maximum(np.abs(x[:, None] - self.low[leaves]), np.abs(x[:, None] - self.high[leaves]))
        return _radius_of(np.sqrt((far * far).sum(axis=2)), self.count[self._leaf[leaves]], k)


def _radius_of(far: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    order = np.argsort(far, axis=1, kind="stable")
    enough = np.cumsum(count[order], axis=1) > k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), far.shape[1] - 1)
    return far[np.arange(len(far)), order[np.arange(len(far)), at]]


class Pivots:
    """Cells of the rows nearest to each of some sampled pivots; ties to the first."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = np.unique(pivots, axis=0)
        self.n_leaves = len(self.pivots)
        self.apart = np.sqrt(((self.pivots[:, None] - self.pivots[None]) ** 2).sum(axis=2)) if self.n_leaves <= 2048 else None

    def distances(self, x: np.ndarray) -> np.ndarray:
        norm = (self.pivots**2).sum(axis=1)[None] + (x**2).sum(axis=1)[:, None]
        return np.sqrt(np.maximum(0, norm - 2 * x @ self.pivots.T))

    def assign(self, x: np.ndarray) -> np.ndarray:
        return self.distances(x).argmin(axis=1)

    def measure(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        d = np.sqrt(((x - self.pivots[cell]) ** 2).sum(axis=1))[:, None]
        return np.concatenate([d, d], axis=1)

    def bound(self, low: np.ndarray, high: np.ndarray, count: np.ndarray) -> None:
        self.count, self.inner, self.outer = count, low[:, 0], high[:, 1]

    def single(self) -> np.ndarray:
        return self.outer == 0

    def reach(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By the triangle inequality: the ring of a cell's rows around its pivot, and the plane between it and the row's own pivot."""
        rows, cells = [], []
        for a in range(0, len(x), 512):
            d = self.distances(x[a : a + 512])
            # products of large values round; that is worth so much of a distance
            unsure = 1e-7 * (1 + d.max(initial=0))
            least = np.maximum(d - self.outer[None], self.inner[None] - d) - unsure
            if self.apart is not None:
                own = d.argmin(axis=1)
                apart = self.apart[own]
                plane = (d**2 - d.min(axis=1, keepdims=True) ** 2) / np.maximum(2 * apart, 1e-300)
                least = np.maximum(least, np.where(apart > 0, plane - unsure * (1 + d / np.maximum(apart, 1e-300)), 0))
            i, j = np.nonzero((least <= (r[a : a + 512] * (1 + _SLACK))[:, None]) & (self.count > 0)[None])
            rows.append(i + a), cells.append(j)
        return np.concatenate(rows), np.concatenate(cells)

    def within(self, x: np.ndarray, k: int) -> np.ndarray:
        d = self.distances(x)
        return _radius_of(d + self.outer[None] + 1e-7 * (1 + d.max(initial=0)), self.count, k)


@dataclass
class Partition:
    """cells on the driver and the workers; blocks: how many of them each cell's rows are dealt in."""

    cells: Boxes | Pivots
    blocks: np.ndarray
    n: int
    tasks: int


def _sampled(points: DataFrame, n: int, wanted: int) -> np.ndarray:
    part = points.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(max(1, n // wanted))) == 0) if n > wanted else points
    found = part.select("features").toArrow()["features"].combine_chunks()
    return matrix(found) if len(found) else np.empty((0, 0))


def _measured(points: DataFrame, cells: Boxes | Pivots, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, low, high) of each cell: a row for each task and cell comes from the tasks."""
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, count = shared.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(0))
            cell = cells.assign(x)
            m = cells.measure(x, cell)
            if count is None:
                count, low, high = np.zeros(cells.n_leaves, np.int64), np.full((cells.n_leaves, m.shape[1]), np.inf), np.full((cells.n_leaves, m.shape[1]), -np.inf)
            count += np.bincount(cell, minlength=cells.n_leaves)
            np.minimum.at(low, cell, m), np.maximum.at(high, cell, m)
        if count is not None:
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some]), pa.array(list(low[some]), pa.list_(pa.float64())), pa.array(list(high[some]), pa.list_(pa.float64()))], names=["cell", "n", "low", "high"])

    rows = map_in_arrow(points.select("features"), run, "cell long, n long, low array<double>, high array<double>")
    width = 2 * d if isinstance(cells, Boxes) else 2
    ends = [F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c) for f, c in ((F.min, "low"), (F.max, "high"))]
    found = rows.groupBy("cell").agg(F.sum("n").alias("n"), *ends).toArrow()
    count, low, high = np.zeros(cells.n_leaves, np.int64), np.full((cells.n_leaves, width), np.inf), np.full((cells.n_leaves, width), -np.inf)
    at = found["cell"].to_numpy()
    count[at] = found["n"].to_numpy()
    if len(at):
        low[at], high[at] = matrix(found["low"].combine_chunks()), matrix(found["high"].combine_chunks())
    return count, low, high


def partition(points: DataFrame, n: int, d: int, cell: int = CELL) -> Partition:
    """Cells of about `cell` of the n points (id, features of length d); more rows a cell beyond MOST_CELLS cells.

    Boxes: a leaf with twice as many rows as wanted is split by a sample of its own, until all its
    rows are at one place. Pivots: about 2 * sqrt(n), sampled rows.
    """
    spark = points.sparkSession
    ship(spark)
    cell = max(cell, -(-n // MOST_CELLS))
    if d > BOX_DIMENSIONS:
        cells: Boxes | Pivots = Pivots(_sampled(points, n, min(MOST_CELLS // 4, math.ceil(2 * math.sqrt(n))))[: MOST_CELLS // 2])
        cells.bound(*_bounds(_measured(points, cells, d)))
    else:
        wanted = max(1, -(-n // cell)) * PER_CELL
        sample = _sampled(points, n, wanted)
        cells = Boxes(sample, max(1, round(len(sample) * cell / n)))
        for _ in range(8):
            cells.bound(*_bounds(_measured(points, cells, d)))
            over = np.flatnonzero((cells.count > 2 * cell) & ~cells.single())
            if not len(over) or n <= wanted:
                break
            shared = spark.sparkContext.broadcast((cells, over))

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                cells, over = shared.value
                for batch in batches:
                    own = cells.assign(matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int64)
                    keep = np.flatnonzero(np.isin(own, over))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(own[keep])], names=["id", "features", "cell"])

            kept = map_in_arrow(points.select("id", "features"), run, "id long, features array<float>, cell long")
            kept = kept.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(max(1, cell // PER_CELL))) == 0).toArrow()
            own, x = kept["cell"].to_numpy(), matrix(kept["features"].combine_chunks()) if kept.num_rows else np.empty((0, d))
            before = cells.n_leaves
            cells.refine({int(o): x[own == o] for o in over if (own == o).any()}, PER_CELL)
            if cells.n_leaves == before:
                break
    blocks = np.maximum(1, -(-cells.count // BLOCK))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(spark.sparkContext.defaultParallelism, -(-n // 256)))
    return Partition(cells, blocks, n, tasks)


def _bounds(measured: tuple) -> tuple:
    count, low, high = measured
    return low, high, count


def _mixed(ids: np.ndarray) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def _own_block(ids: np.ndarray, cell: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (_mixed(ids) % blocks[cell].astype(np.uint64)).astype(np.int64)


@dataclass
class Reach:
    """Which cells a row must search: those its radius touches; with first (rho and id of each cell's first row in the order of descending rho, then id), only if that comes before the row."""

    cells: Boxes | Pivots
    first: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, ids: np.ndarray, x: np.ndarray, radius: np.ndarray, rho: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, cell = self.cells.reach(x, radius)
        if self.first is None:
            return row, cell
        before = _before(self.first[0][cell], self.first[1][cell], rho[row], ids[row])
        return row[before], cell[before]


def _before(rho: np.ndarray, ids: np.ndarray, than_rho: np.ndarray, than_id: np.ndarray) -> np.ndarray:
    return (rho > than_rho) | ((rho == than_rho) & (ids < than_id))


#: Columns of a row that searches or is searched, and those that say where it goes.
_ROW = "id long, features array<float>, value double, rho double"
_DEALT = f"cell long, part long, side int, {_ROW}"


def asking(rows: DataFrame, value: str | float = 0.0, rho: str | float = 0.0) -> DataFrame:
    """Rows with a search radius and a density, by column or all alike."""
    column = lambda v: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    return rows.select(F.col("id").cast("long").alias("id"), F.col("features").cast("array<float>").alias("features"), column(value).alias("value"), column(rho).alias("rho"))


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return batch.column(0).to_numpy(), matrix(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()


def visits(searchers: DataFrame, part: Partition, reach: Reach) -> np.ndarray:
    """How many of the searching rows each cell sees."""
    shared = searchers.sparkSession.sparkContext.broadcast(reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = shared.value
        count = np.zeros(reach.cells.n_leaves, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                count += np.bincount(reach(*_columns(batch.slice(at, 1024)))[1], minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["cell", "n"])

    found = map_in_arrow(searchers, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(part.cells.n_leaves, np.int64)
    count[found["cell"].to_numpy()] = found["n"].to_numpy()
    return count


def searched(rows: DataFrame, part: Partition, across: np.ndarray) -> DataFrame:
    """Side 0: each row in its block, once for each of the `across` parts of those that search its cell."""
    shared = rows.sparkSession.sparkContext.broadcast((part.cells, part.blocks, across))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, blocks, across = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                cell = cells.assign(x)
                times = across[cell]
                row = np.repeat(np.arange(len(x)), times)
                yield _dealt(batch, row, cell[row], _own_block(ids, cell, blocks)[row], np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times), 0)

    return map_in_arrow(rows, run, _DEALT)


def searching(rows: DataFrame, part: Partition, across: np.ndarray, reach: Reach | None = None, own_block: bool = True) -> DataFrame:
    """Side 1: each row in the block it lies in; with reach in all blocks of the cells it must search, without own_block but for that one."""
    shared = rows.sparkSession.sparkContext.broadcast((part.cells, part.blocks, across, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, blocks, across, reach = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                ids, x, radius, rho = _columns(batch)
                home = cells.assign(x)
                own = _own_block(ids, home, blocks)
                if reach is None:
                    row, cell, block = np.arange(len(x)), home, own
                else:
                    row, cell = reach(ids, x, radius, rho)
                    times = blocks[cell]
                    row, cell, block = np.repeat(row, times), np.repeat(cell, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    if not own_block:
                        other = (cell != home[row]) | (block != own[row])
                        row, cell, block = row[other], cell[other], block[other]
                yield _dealt(batch, row, cell, block, (_mixed(ids[row] + 1) % across[cell].astype(np.uint64)).astype(np.int64), 1)

    return map_in_arrow(rows, run, _DEALT)


def _dealt(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, block: np.ndarray, turn: np.ndarray, side: int) -> pa.RecordBatch:
    taken = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(block * (1 << 31) + turn), pa.array(np.full(len(row), side, np.int32)), *[c.take(taken) for c in batch.columns]], names=["cell", "part", "side", "id", "features", "value", "rho"])


@dataclass
class Side:
    ids: np.ndarray
    x: np.ndarray
    value: np.ndarray
    rho: np.ndarray


def meet(rows: DataFrame, part: Partition, work: Callable[[Side, Side], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work(searched, searching) for each block and run of rows that search it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, piece, side, ids, value, rho = (batch.column(i).to_numpy() for i in (0, 1, 2, 3, 5, 6))
            x = matrix(batch.column(4))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0) | (np.diff(side) != 0)) + 1
            bounds = [0, *cuts.tolist(), len(ids)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if at != (key := (cell[a], piece[a])):
                    at, held = key, []
                own = Side(ids[a:b], x[a:b], value[a:b], rho[a:b])
                if side[a] == 0:
                    held.append(own)
                elif held:
                    if len(held) > 1:
                        held = [Side(*(np.concatenate([getattr(h, f) for h in held]) for f in ("ids", "x", "value", "rho")))]
                    if (out := work(held[0], own)) is not None:
                        yield out

    return map_in_arrow(rows.repartition(part.tasks, "cell", "part").sortWithinPartitions("cell", "part", "side"), run, schema)


def costly(part: Partition, seen: np.ndarray, searchers: int | None = None) -> bool:
    """Whether pivots spare so little that it is cheaper to compare all rows than to deal them out. searchers: rows that search, if not all."""
    n = part.n if searchers is None else searchers
    copies = float((seen * part.blocks).sum())
    pairs = (seen.astype(float) * part.cells.count).sum()
    return isinstance(part.cells, Pivots) and (copies > COPIES * n or ROW_WORK * copies + pairs > float(n) * part.n)


def meet_all(targets: DataFrame, queries: DataFrame, part: Partition, d: int, work: Callable[[Side, Side], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work of all rows against all, without a shuffle of pairs: searched rows are broadcast in blocks of bounded size, searching ones stream past each."""
    spark = targets.sparkSession
    blocks = max(1, -(-part.n * (8 * d + 32) // BLOCK_BYTES))
    placed, out = targets.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))), None
    for b in range(blocks):
        rows = placed.where(F.col("block") == b).drop("block").toArrow().combine_chunks().to_batches()
        shared = spark.sparkContext.broadcast([Side(*_columns(r)) for r in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    own = Side(*_columns(batch.slice(at, 1024)))
                    for there in shared.value:
                        for a in range(0, len(there.ids), AT_ONCE):
                            some = Side(*(getattr(there, f)[a : a + AT_ONCE] for f in ("ids", "x", "value", "rho")))
                            if (found := work(some, own)) is not None:
                                yield found

        one = map_in_arrow(queries.repartition(part.tasks, "id"), run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def within(targets: Side, queries: Side, eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of queries, row of targets, distance) of pairs of different ids within eps."""
    out, norm = [], (targets.x**2).sum(axis=1)
    for a in range(0, len(queries.ids), 256):
        q = queries.x[a : a + 256]
        near = norm[None] - 2 * q @ targets.x.T + (q * q).sum(axis=1)[:, None]
        i, j = np.nonzero(near <= eps * eps + 1e-9 * (1 + np.abs(near).max(initial=0)))
        dist = np.sqrt(((q[i] - targets.x[j]) ** 2).sum(axis=1))
        keep = (dist <= eps) & (queries.ids[a + i] != targets.ids[j])
        out.append((a + i[keep], j[keep], dist[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def range_pairs(points: DataFrame, eps: float, n: int, d: int) -> DataFrame:
    """src, dst, dist of all ordered pairs within eps."""
    part = partition(points, n, d)
    rows = asking(points, float(eps))

    def work(targets: Side, queries: Side) -> pa.RecordBatch | None:
        i, j, dist = within(targets, queries, eps)
        return pa.RecordBatch.from_arrays([pa.array(queries.ids[i]), pa.array(targets.ids[j]), pa.array(dist)], names=["src", "dst", "dist"]) if len(i) else None

    return meet_near(rows, rows, part, d, work, "src long, dst long, dist double")


def near(targets: Side, queries: Side, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, mask of rows by targets) of runs of queries: what lies within eps, the row itself included."""
    norm = (targets.x**2).sum(axis=1)
    for a in range(0, len(queries.ids), 256):
        q = queries.x[a : a + 256]
        rough = norm[None] - 2 * q @ targets.x.T + (q * q).sum(axis=1)[:, None]
        slack = 1e-9 * (1 + np.abs(rough).max(initial=0))
        mask = rough <= eps * eps - slack
        i, j = np.nonzero(np.abs(rough - eps * eps) <= slack)
        mask[i, j] = np.sqrt(((q[i] - targets.x[j]) ** 2).sum(axis=1)) <= eps
        yield a, mask


def meet_near(targets: DataFrame, queries: DataFrame, part: Partition, d: int, work: Callable[[Side, Side], pa.RecordBatch | None], schema: str, searchers: int | None = None) -> DataFrame:
    """work of rows with those that their radius may touch: by cells, or past broadcast blocks where cells spare little."""
    reach = Reach(part.cells)
    seen = visits(queries, part, reach)
    if costly(part, seen, searchers):
        return meet_all(targets, queries, part, d, work, schema)
    across = np.maximum(1, -(-seen // SEARCHERS))
    return meet(searched(targets, part, across).unionByName(searching(queries, part, across, reach)), part, work, schema)


def meet_home(rows: DataFrame, part: Partition, work: Callable[[Side, Side], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work of rows with those of their own block only."""
    ones = np.ones(part.cells.n_leaves, np.int64)
    return meet(searched(rows, part, ones).unionByName(searching(rows, part, ones)), part, work, schema)


def compared(points: DataFrame, radius: float | str, n: int, d: int) -> float:
    """Share of all ordered pairs that a search by this radius compares."""
    part = partition(points, n, d)
    return float((visits(asking(points, radius), part, Reach(part.cells)).astype(float) * part.cells.count).sum()) / n**2


def graph_batch(own: np.ndarray, ids: np.ndarray, dist: np.ndarray, *more: tuple[str, pa.Array]) -> pa.RecordBatch:
    keep = ids >= 0
    offsets = pa.array(np.concatenate([[0], np.cumsum(keep.sum(axis=1))]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v[keep])) for v in (ids, dist)]
    return pa.RecordBatch.from_arrays([pa.array(own), *lists, *[a for _, a in more]], names=["id", "nbr", "dist", *[n for n, _ in more]])


def neighbours(points: DataFrame, k: int, n: int, d: int, top_k: Callable, most: float = 1.0) -> DataFrame | None:
    """id, nbr, dist (double) of the k nearest of each row, nearest first, ties by id; None if more than the share `most` of all pairs were to be compared.

    A row is searched for in its own block; the k-th distance there bounds what else it must see, which only
    the rows do that are near another cell. Rows at one place that fill a cell are searched by their k + 1 least ids.
    """
    part = partition(points, n, d, max(CELL, 4 * k))
    cells, across = part.cells, np.ones(part.cells.n_leaves, np.int64)
    same = cells.single() & (cells.count > BLOCK)
    rows = targets = asking(points)
    if same.any():
        part.blocks[same] = 1
        across[same] = -(-cells.count[same] // SEARCHERS)
        targets = _thinned(rows, part, same, k + 1)
    homes = searched(targets, part, across).unionByName(searching(rows, part, across))

    def home(there: Side, own: Side) -> pa.RecordBatch:
        i, dist = top_k(own.x, own.ids, there.x, there.ids, k)
        r = dist[:, -1].copy()
        short = np.isinf(r)
        if short.any():
            for at in np.array_split(np.flatnonzero(short), -(-int(short.sum()) // 64)):
                r[at] = shared.value.within(own.x[at], k)
        features = pa.ListArray.from_arrays(pa.array(np.arange(len(own.ids) + 1, dtype=np.int32) * own.x.shape[1]), pa.array(own.x.astype(np.float32).ravel()))
        return graph_batch(own.ids, i, dist, ("features", features), ("value", pa.array(r)))

    shared = points.sparkSession.sparkContext.broadcast(cells)
    lists = materialize(meet(homes, part, home, "id long, nbr array<long>, dist array<double>, features array<float>, value double"), "cell-lists")
    wide, reach = asking(lists, "value"), Reach(cells)
    seen = visits(wide, part, reach)
    if float((seen.astype(float) * cells.count).sum()) > most * n * n or (most < 1 and costly(part, seen)):
        return None
    across = np.maximum(1, -(-seen // SEARCHERS))
    rows = searched(targets, part, across).unionByName(searching(wide, part, across, reach, own_block=False))

    def more(there: Side, own: Side) -> pa.RecordBatch | None:
        i, dist = top_k(own.x, own.ids, there.x, there.ids, k)
        i = np.where(dist <= (own.value * (1 + _SLACK))[:, None], i, -1)
        some = (i >= 0).any(axis=1)
        return graph_batch(own.ids[some], i[some], dist[some]) if some.any() else None

    found = materialize(meet(rows, part, more, "id long, nbr array<long>, dist array<double>"), "cell-more")
    packed = F.slice(F.sort_array(F.flatten(F.collect_list(F.expr("arrays_zip(dist, nbr)")))), 1, k)
    touched = found.select("id").distinct()
    merged = lists.select("id", "nbr", "dist").join(touched, "id", "left_semi").unionByName(found).groupBy("id").agg(packed.alias("c"))
    merged = merged.select("id", F.col("c.nbr").alias("nbr"), F.col("c.dist").alias("dist"))
    return lists.select("id", "nbr", "dist").join(touched, "id", "left_anti").unionByName(merged)


def _thinned(rows: DataFrame, part: Partition, same: np.ndarray, keep: int) -> DataFrame:
    """rows without all but the least ids of cells whose rows are at one place: no other can be among the nearest of any row."""
    shared = rows.sparkSession.sparkContext.broadcast((part.cells, same))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, same = shared.value
        for batch in batches:
            cell = cells.assign(matrix(batch.column(1))) if batch.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(same[cell], cell, -1))], names=["id", "features", "value", "rho", "place"])

    placed = map_in_arrow(rows, run, f"{_ROW}, place long")
    crowd = placed.where("place >= 0").withColumn("at", F.row_number().over(Window.partitionBy("place").orderBy("id"))).where(F.col("at") <= keep)
    return placed.where("place < 0").drop("place").unionByName(crowd.drop("place", "at"))


@dataclass
class Masses:
    """Of each leaf of boxes: corners, rows (weight), and their sums and squares around the centre; group: leaves that one task searches for, neighbours in the tree."""

    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray
    total: np.ndarray
    square: np.ndarray
    group: np.ndarray

    def bracket(self, leaf: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Leaves all of whose rows are among the k + 1 nearest of every row of leaf, and those of which some may be."""
        gap = np.maximum(0, np.maximum(self.low - self.high[leaf], self.low[leaf] - self.high))
        reach = np.maximum(self.high - self.low[leaf], self.high[leaf] - self.low)
        near, far = np.sqrt((gap * gap).sum(axis=1)), np.sqrt((reach * reach).sum(axis=1))
        least, most = (v[o][np.searchsorted(np.cumsum(self.weight[o]), k + 1)] for v in (near, far) for o in [np.argsort(v, kind="stable")])
        inside = far < least * (1 - _SLACK)
        return inside, ~inside & (near <= most * (1 + _SLACK))


#: Leaves that a task searches for, groups of them at most, rows of a leaf at least, and distances that a task holds at once.
GROUP_LEAVES, MOST_GROUPS, LEAF, HELD = 16, 256, 32, 1 << 21


def near_sums(places: DataFrame, k: int, d: int) -> DataFrame:
    """id and total: the sum of squared distances from a row of each place to its k nearest other rows. places: id, features, weight (rows there).

    No list of neighbours is made. Boxes that lie wholly among the k nearest count by their rows' sums; rows of boxes that
    the k-th distance may cut are measured one by one, in tasks that search for neighbouring boxes. For few dimensions.
    """
    spark, n = places.sparkSession, places.count()
    boxes = partition(places, n, d, LEAF).cells
    leaves = np.flatnonzero(boxes._leaf >= 0)
    low, high = np.zeros((boxes.n_leaves, d)), np.zeros((boxes.n_leaves, d))
    low[boxes._leaf[leaves]], high[boxes._leaf[leaves]] = boxes.low[leaves], boxes.high[leaves]
    # leaves without rows have no corners: they are nowhere
    empty = ~np.isfinite(low).all(axis=1)
    low[empty], high[empty] = 1e150, 1e150
    order, todo = [], [0]
    while todo:
        node = todo.pop()
        if boxes.leaf[node] >= 0:
            order.append(boxes.leaf[node])
        else:
            todo += boxes.child[node]
    groups = max(1, min(MOST_GROUPS, boxes.n_leaves // GROUP_LEAVES))
    group = np.empty(boxes.n_leaves, np.int64)
    group[order] = np.arange(boxes.n_leaves) * groups // boxes.n_leaves
    shared = spark.sparkContext.broadcast((boxes, low, high))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes, low, high = shared.value
        sums = np.zeros((boxes.n_leaves, d + 2))
        for batch in batches:
            if batch.num_rows:
                x, w = matrix(batch.column(0)), batch.column(1).to_numpy().astype(float)
                leaf = boxes.assign(x)
                off = x - (low[leaf] + high[leaf]) / 2
                np.add.at(sums, leaf, w[:, None] * np.column_stack([np.ones(len(x)), off, (off * off).sum(axis=1)]))
        some = np.flatnonzero(sums[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["leaf", "sums"])

    found = map_in_arrow(places.select("features", "weight"), weigh, "leaf long, sums array<double>").groupBy("leaf").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(d + 2)]).alias("sums")).toArrow()
    sums = np.zeros((boxes.n_leaves, d + 2))
    sums[found["leaf"].to_numpy()] = matrix(found["sums"].combine_chunks())
    masses = Masses(low, high, sums[:, 0], sums[:, 1:-1], sums[:, -1], group)
    cut = np.zeros((groups, boxes.n_leaves), bool)
    for leaf in np.flatnonzero(masses.weight):
        cut[group[leaf]] |= masses.bracket(leaf, k)[1]
    known = spark.sparkContext.broadcast((masses, cut))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masses, cut = known.value
        for batch in batches:
            if batch.num_rows:
                leaf = shared.value[0].assign(matrix(batch.column(1)))
                at, row = np.nonzero(cut[:, leaf])
                row, to = np.concatenate([row, np.arange(len(leaf))]), np.concatenate([at, masses.group[leaf]])
                side = np.repeat(np.array([0, 1], np.int32), [len(at), len(leaf)])
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(side), pa.array(leaf[row]), *[c.take(pa.array(row)) for c in batch.columns]], names=["group", "side", "leaf", "id", "features", "weight"])

    def work(key: tuple, table: pa.Table) -> pa.Table:
        masses = known.value[0]
        table = table.sort_by("leaf").combine_chunks()
        side, leaf, ids, w = (table[c].to_numpy() for c in ("side", "leaf", "id", "weight"))
        x = matrix(table["features"].combine_chunks())
        own, w, theirs, there = side == 1, w.astype(float), leaf[side == 0], x[side == 0]
        heavy, out = w[side == 0], []
        for f in np.unique(leaf[own]):
            inside, some = masses.bracket(f, k)
            q = x[own & (leaf == f)]
            pick = np.flatnonzero(some[theirs])
            y, v = there[pick], heavy[pick]
            left = int(round(k + 1 - masses.weight[inside].sum()))
            off = q[:, None] - (masses.low[inside] + masses.high[inside])[None] / 2
            total = (masses.weight[inside] * (off * off).sum(axis=2) - 2 * (off * masses.total[inside][None]).sum(axis=2) + masses.square[inside]).sum(axis=1)
            for a in range(0, len(q), step := max(1, HELD // max(1, len(y)))):
                far = sum((q[a : a + step, i, None] - y[None, :, i]) ** 2 for i in range(d))
                if v.max(initial=1) == 1:
                    total[a : a + step] += np.partition(far, left - 1, axis=1)[:, :left].sum(axis=1)
                else:
                    by = np.argsort(far, axis=1)
                    rows = v[by]
                    taken = np.clip(left - (np.cumsum(rows, axis=1) - rows), 0, rows)
                    total[a : a + step] += (taken * np.take_along_axis(far, by, 1)).sum(axis=1)
            out.append(pa.table({"id": pa.array(ids[own & (leaf == f)]), "total": pa.array(total)}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})

    dealt = map_in_arrow(places.select("id", "features", "weight"), deal, "group long, side int, leaf long, id long, features array<float>, weight long")
    return dealt.repartition(max(groups, 1), "group").groupBy("group").applyInArrow(work, "id long, total double")


def nearest_before(rows: DataFrame, n: int, d: int, lists: DataFrame | None = None) -> tuple[DataFrame, float]:
    """(id, delta, parent: the nearest row that comes before in the order of descending rho, then id; the share of all pairs compared).

    rows: id, features, rho. lists: id, nbr, dist (ascending) of exact nearest rows, if there are such: a row with one
    before it there, nearer than the last, is done. The others look through their own block; what they find there, and the first rows of
    cells that come before them, bound their search, which leaves out cells without a row before them. Of rows equally near
    the one that comes first counts. The first row of all has no row in the result.
    """
    spark = rows.sparkSession
    part = partition(rows, n, d)
    cells, ones = part.cells, np.ones(part.cells.n_leaves, np.int64)
    told = asking(rows, rho="rho")
    done = None
    left = told
    if lists is not None:
        rho = rows.select(F.col("id").alias("dst"), F.col("rho").alias("rho_dst"))
        near = lists.select("id", F.element_at("dist", -1).alias("last"), F.posexplode(F.expr("arrays_zip(nbr, dist)")).alias("p", "e")).select("id", "last", F.col("e.nbr").alias("dst"), F.col("e.dist").cast("double").alias("dist"))
        near = near.join(rho, "dst").join(rows.select("id", "rho"), "id").where((F.col("rho_dst") > F.col("rho")) | ((F.col("rho_dst") == F.col("rho")) & (F.col("dst") < F.col("id"))))
        # lists may hold rounded distances: where two nearest ones are alike, the search decides
        alike = near.groupBy("id", "dist").agg(F.count("*").alias("n"), F.min("dst").alias("parent"), F.first("last").alias("last"))
        first = alike.groupBy("id").agg(F.min_by(F.struct("n", "parent", "last", "dist"), "dist").alias("b")).where("b.n = 1 AND b.dist < b.last").select("id", "b.parent")
        ends = first.join(rows.select("id", F.col("features").alias("a")), "id").join(rows.select(F.col("id").alias("parent"), F.col("features").alias("b")), "parent")
        gap = F.expr("sqrt(aggregate(zip_with(a, b, (x, y) -> (cast(x AS double) - y) * (cast(x AS double) - y)), 0D, (s, v) -> s + v))")
        done = materialize(ends.select("id", gap.alias("delta"), "parent"), "before-lists")
        left = materialize(told.join(done.select("id"), "id", "left_anti").select(*told.columns), "before-left")

    shared = spark.sparkContext.broadcast(cells)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(shared.value.assign(matrix(batch.column(1)))), *batch.columns], names=["cell", "id", "features", "value", "rho"])

    heads = map_in_arrow(told, named, f"cell long, {_ROW}").groupBy("cell").agg(F.max_by(F.struct("rho", "id", "features"), F.struct("rho", -F.col("id"))).alias("h")).select("cell", "h.*").toArrow()
    first_rho, first_id, first_x = np.full(cells.n_leaves, -np.inf), np.full(cells.n_leaves, np.iinfo(np.int64).max), np.zeros((cells.n_leaves, d))
    at = heads["cell"].to_numpy()
    first_rho[at], first_id[at], first_x[at] = heads["rho"].to_numpy(), heads["id"].to_numpy(), matrix(heads["features"].combine_chunks())
    witness = spark.sparkContext.broadcast((first_rho, first_id, first_x))

    def home(there: Side, own: Side) -> pa.RecordBatch:
        delta, parent, rank = _nearest_before(there, own, np.full(len(own.ids), np.inf))
        first_rho, first_id, first_x = witness.value
        bound = delta.copy()
        for a in range(0, len(bound), 256):
            some = slice(a, a + 256)
            far = np.sqrt(((own.x[some, None] - first_x[None]) ** 2).sum(axis=2)) if d <= 8 else np.sqrt(np.stack([((first_x - q) ** 2).sum(axis=1) for q in own.x[some]]))
            far[~_before(first_rho[None], first_id[None], own.rho[some, None], own.ids[some, None])] = np.inf
            bound[some] = np.minimum(bound[some], far.min(axis=1))
        features = pa.ListArray.from_arrays(pa.array(np.arange(len(own.ids) + 1, dtype=np.int32) * own.x.shape[1]), pa.array(own.x.astype(np.float32).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(own.ids), features, pa.array(bound), pa.array(own.rho), pa.array(delta), pa.array(parent), pa.array(rank)], names=["id", "features", "value", "rho", "delta", "parent", "rank"])

    own = meet(searched(told, part, ones).unionByName(searching(left, part, ones)), part, home, f"{_ROW}, delta double, parent long, rank double")
    own = materialize(own, "before-own").where("value < double('infinity')")
    wide, reach = own.select("id", "features", "value", "rho"), Reach(cells, (first_rho, first_id))
    seen = visits(wide, part, reach)
    across = np.maximum(1, -(-seen // SEARCHERS))

    def further(there: Side, own: Side) -> pa.RecordBatch | None:
        delta, parent, rank = _nearest_before(there, own, own.value * (1 + _SLACK))
        some = parent >= 0
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (own.ids, delta, parent, rank)], names=["id", "delta", "parent", "rank"]) if some.any() else None

    schema = "id long, delta double, parent long, rank double"
    if costly(part, seen):
        found = meet_all(told, wide, part, d, further, schema)
    else:
        found = meet(searched(told, part, across).unionByName(searching(wide, part, across, reach, own_block=False)), part, further, schema)
    both = own.where("parent >= 0").select("id", "delta", "parent", "rank").unionByName(found)
    out = both.groupBy("id").agg(F.min(F.struct("delta", "rank", "parent")).alias("b")).select("id", "b.delta", "b.parent")
    at_home = (cells.count.astype(float) * np.minimum(cells.count, BLOCK)).sum() * left.count() / n
    share = 1.0 if costly(part, seen) else float((seen.astype(float) * cells.count).sum() + at_home) / n**2
    return out if done is None else out.unionByName(done), share


def _nearest_before(there: Side, own: Side, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distance, id, -rho) of the nearest of `there` that comes before each of own within radius; inf, -1 and inf if there is none."""
    order = np.lexsort((there.ids, -there.rho))
    ids, rho, x = there.ids[order], there.rho[order], there.x[order]
    delta, parent, rank = np.full(len(own.ids), np.inf), np.full(len(own.ids), -1), np.full(len(own.ids), np.inf)
    norm = (x * x).sum(axis=1)
    for a in range(0, len(own.ids), 256):
        q = own.x[a : a + 256]
        rough = norm[None] - 2 * q @ x.T + (q * q).sum(axis=1)[:, None]
        rough[~_before(rho[None], ids[None], own.rho[a : a + 256, None], own.ids[a : a + 256, None])] = np.inf
        least = rough.min(axis=1)
        slack = 1e-9 * (1 + norm.max() + (q * q).sum(axis=1))
        i, j = np.nonzero((rough <= (least + slack)[:, None]) & np.isfinite(rough))
        exact = np.sqrt(((q[i] - x[j]) ** 2).sum(axis=1))
        by = np.lexsort((j, exact, i))
        i, j, exact = i[by], j[by], exact[by]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        near = exact[first] <= radius[a + i[first]]
        at, j, exact = a + i[first][near], j[first][near], exact[first][near]
        delta[at], parent[at], rank[at] = exact, ids[j], -rho[j]
    return delta, parent, rank
