"""Approximate nearest neighbours by inner product: cross-polytope hashing, several probes a table, exact reranking.

A vector on the unit sphere is turned by pseudo-rotations (random signs and a fast Hadamard transform, three times) and
hashed to the nearest of the signed axes. Vectors of different lengths get a further coordinate that brings
them all to one length, so nearness by inner product is nearness on that sphere. Equal vectors are hashed once.

How many tables, cells and probes there are is fitted: the exact neighbours of a sample of queries are found
among all vectors, and of the settings by which the wanted share of them meets its query the cheapest is taken.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import at_release, map_in_arrow, materialize, ship
from .common import join_hot, small

#: Different query vectors by which settings are fitted, and the share of their neighbours that probes must meet.
SAMPLE, RECALL = 128, 0.95
#: Probes a table at most; where they don't meet enough neighbours, queries are compared with all vectors in blocks.
MOST_PROBES = 1024
#: Products that take a task as long as a row that travels to it: 15 microseconds a row were measured, and 50 to 80 nanoseconds a product.
ROW_WORK = 200
#: Vectors of a block, and queries that meet a block in one task; buckets of more are split.
BLOCK, QUERY_BLOCK = 4096, 4096
#: Results a task gathers before it thins them out.
GATHER = 1_000_000


class Tables:
    """Hash tables of a setting: n_tables of about n_cells buckets each for vectors of dim components."""

    def __init__(self, dim: int, n_tables: int, n_cells: int, seed: int = 0):
        self.dim = 1 << (dim - 1).bit_length()
        # whole polytopes of 2 * dim cells, then one on fewer axes for what is left
        self.axes, left = [], max(2, n_cells)
        while left >= 2 * self.dim:
            self.axes.append(self.dim)
            left //= 2 * self.dim
        if left >= 2:
            self.axes.append(max(1, left // 2))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice(np.array([-1.0, 1.0]), (n_tables, len(self.axes), 3, self.dim))
        self.n_tables = n_tables

    @property
    def n_cells(self) -> int:
        return int(np.prod([2 * a for a in self.axes]))

    def turned(self, x: np.ndarray, table: int, function: int) -> np.ndarray:
        """The first axes of the function's pseudo-rotation of each row."""
        y = np.zeros((len(x), self.dim))
        y[:, : x.shape[1]] = x
        for signs in self.signs[table, function]:
            y *= signs
            h = 1
            while h < self.dim:
                pairs = y.reshape(len(y), -1, 2, h)
                y = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(y), self.dim)
                h *= 2
            y /= np.sqrt(self.dim)
        return y[:, : self.axes[function]]

    def buckets(self, x: np.ndarray, table: int) -> np.ndarray:
        cell = np.full(len(x), 0, np.int64)
        for f, axes in enumerate(self.axes):
            y = self.turned(x, table, f)
            nearest = np.abs(y).argmax(axis=1)
            cell = cell * (2 * axes) + nearest + axes * (y[np.arange(len(y)), nearest] < 0)
        return cell

    def probes(self, x: np.ndarray, table: int, n: int) -> np.ndarray:
        """The n buckets of each row that are the most likely to hold near vectors, best first: axes' squared distances to the nearest one's value are summed."""
        cell, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
        for f, axes in enumerate(self.axes):
            y = self.turned(x, table, f)
            y = np.concatenate([y, -y], axis=1)
            own = (y.max(axis=1, keepdims=True) - y) ** 2
            order = np.argsort(own, axis=1, kind="stable")[:, :n]
            both = (loss[:, :, None] + np.take_along_axis(own, order, 1)[:, None, :]).reshape(len(x), -1)
            cells = (cell[:, :, None] * (2 * axes) + order[:, None, :]).reshape(len(x), -1)
            best = np.argsort(both, axis=1, kind="stable")[:, :n]
            cell, loss = np.take_along_axis(cells, best, 1), np.take_along_axis(both, best, 1)
        return cell


@functools.lru_cache(maxsize=8)
def _tables(dim: int, n_tables: int, n_cells: int) -> Tables:
    return Tables(dim, n_tables, n_cells)


at_release.append(_tables.cache_clear)


def on_sphere(x: np.ndarray, longest: float, level: bool) -> np.ndarray:
    """Indexed vectors brought to one length; level: they have one already."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    if level:
        return x / norm
    return np.concatenate([x / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))], axis=1)


def direction(q: np.ndarray, level: bool) -> np.ndarray:
    """Queries on the same sphere; their length is of no account."""
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    return unit if level else np.concatenate([unit, np.zeros((len(q), 1))], axis=1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components whatever rows stand beside."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        total += q[:, j] * x[:, j]
    return total


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def best_pairs(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score) of the k largest products of each query, ties to smaller ids."""
    rough = q @ x.T
    if len(x) > k:
        floor = np.partition(rough, len(x) - k, axis=1)[:, len(x) - k]
        slack = 1e-12 * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        i, j = np.nonzero(rough >= (floor - slack)[:, None])
    else:
        i, j = (a.ravel() for a in np.indices(rough.shape))
    score = products(q[i], x[j])
    keep = _first(i, -score, ids[j], k)
    return i[keep], j[keep], score[keep]


def _first(group: np.ndarray, *order_and_k) -> np.ndarray:
    """Rows that are among the first k of their group."""
    *order, k = order_and_k
    by = np.lexsort((*reversed(order), group))
    starts = np.flatnonzero(np.diff(group[by], prepend=group[by[0]] - 1)) if len(by) else by
    place = np.arange(len(by)) - np.repeat(starts, np.diff(np.append(starts, len(by))))
    return by[place < k]


def valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id and vec of rows that take part: see nearest."""
    vec = F.col(embedding)
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(vec, lambda v: v != 0)
    rows = vectors.where(F.col(vec_id).isNotNull() & vec.isNotNull()).where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), vec.alias("vec"))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("vec") == (lengths[0] if lengths else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _neighbours(classes: DataFrame, sample: list[tuple[int, list[float]]], k: int) -> list[tuple[int, np.ndarray]]:
    """(row of sample, vector) of the exact nearest classes of each sampled query."""
    ids, q = np.array([i for i, _ in sample]), np.array([v for _, v in sample], float)
    shared = classes.sparkSession.sparkContext.broadcast((ids, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, x = batch.column("class_id").to_numpy(), _matrix(batch.column("vec"))
            i, j, score = best_pairs(q, x, own, k + 1)
            other = own[j] != ids[i]
            new = (i[other], own[j[other]], score[other], x[j[other]])
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new))
            keep = _first(held[0], -held[2], held[1], k)
            held = tuple(h[keep] for h in held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held[:3]] + [pa.array(list(held[3]), pa.list_(pa.float64()))], names=["q", "class_id", "score", "vec"])

    found = map_in_arrow(classes.select("class_id", "vec"), run, "q long, class_id long, score double, vec array<double>")
    top = Window.partitionBy("q").orderBy(F.desc("score"), "class_id")
    return [(r["q"], np.array(r["vec"])) for r in found.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k).collect()]


def fit(queries: np.ndarray, near: list[tuple[int, np.ndarray]], n_vectors: int, n_queries: int, longest: float, level: bool, recall: float) -> tuple[int, int, int] | None:
    """(tables, cells, probes) by which at least recall of the pairs meet, with the least work at these numbers; None if none do."""
    q, x = direction(queries, level), on_sphere(np.array([v for _, v in near]), longest, level)
    of, best = np.array([i for i, _ in near]), None
    cells = [c for e in range(5) if (c := n_vectors // (64 << 2 * e)) >= 16] or [16]
    for n_tables, n_cells in itertools.product((2, 4), cells):
        tables = _tables(q.shape[1], n_tables, n_cells)
        place = np.full(len(of), MOST_PROBES)
        for t in range(n_tables):
            probed = tables.probes(q, t, MOST_PROBES)
            hit = probed[of] == tables.buckets(x, t)[:, None]
            place = np.minimum(place, np.where(hit.any(axis=1), hit.argmax(axis=1), MOST_PROBES))
        n_probes = int(np.sort(place)[min(len(place) - 1, int(np.ceil(recall * len(place))) - 1)]) + 1
        if n_probes > MOST_PROBES:
            continue
        rows = n_tables * (n_vectors + n_queries * n_probes)
        work = ROW_WORK * rows + n_tables * n_queries * n_probes * n_vectors / tables.n_cells
        if best is None or work < best[0]:
            best = (work, n_tables, n_cells, n_probes)
    return best[1:] if best else None


def _hashed(df: DataFrame, id_column: str, kind: str, side: int, setting: tuple[int, int, int], longest: float, level: bool) -> DataFrame:
    """bucket, side, id, vec: vectors in their buckets (side 0) or queries in those they probe (side 1)."""
    n_tables, n_cells, n_probes = setting

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"))
            at = direction(x, level) if side else on_sphere(x, longest, level)
            tables = _tables(at.shape[1], n_tables, n_cells)
            for t in range(n_tables):
                found = tables.probes(at, t, n_probes) if side else tables.buckets(at, t)[:, None]
                for columns in np.array_split(np.arange(found.shape[1]), -(-found.shape[1] // 32)):
                    rows = np.repeat(np.arange(len(x)), len(columns))
                    bucket = pa.array(found[:, columns].ravel() * n_tables + t)
                    yield pa.RecordBatch.from_arrays([bucket, pa.array(np.full(len(rows), side, np.int32)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["bucket", "side", "id", "vec"])

    return map_in_arrow(df.select(F.col(id_column).alias("id"), "vec"), run, f"bucket long, side int, id long, vec {kind}")


def _blocks(rows: DataFrame, vectors: int, queries: int) -> DataFrame:
    """rows with block: buckets of more vectors or queries than these are split, and each part of the one side meets each of the other."""
    counts = materialize(rows.groupBy("bucket").agg(F.count_if(F.col("side") == 0).alias("nx"), F.count_if(F.col("side") == 1).alias("nq")), "polytope-counts")
    large = counts.where((F.col("nx") > vectors) | (F.col("nq") > queries)).where("nx > 0 AND nq > 0")
    parts = large.select("bucket", F.ceil(F.col("nx") / vectors).cast("int").alias("px"), F.ceil(F.col("nq") / queries).cast("int").alias("pq"))
    told = rows.join(small(parts), "bucket", "left").withColumns({p: F.coalesce(p, F.lit(1)) for p in ("px", "pq")})
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("px")).otherwise(F.col("pq")))
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("pq")).otherwise(F.col("px")) - 1))
    told = told.withColumn("own", own.cast("int")).withColumn("across", across)
    px = F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("across"))
    pq = F.when(F.col("side") == 0, F.col("across")).otherwise(F.col("own"))
    return told.select("bucket", (px.cast("long") * 2147483648 + pq).alias("block"), "side", "id", "vec")


def _meet(blocks: DataFrame, k: int) -> DataFrame:
    """query, class_id, score: the k nearest of each query among the vectors it meets, for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], []

        def thin() -> tuple[np.ndarray, ...]:
            q, c, s = (np.concatenate(p) for p in zip(*held))
            by = np.lexsort((c, q))
            new = np.ones(len(by), bool)
            new[1:] = (np.diff(q[by]) != 0) | (np.diff(c[by]) != 0)
            q, c, s = (v[by][new] for v in (q, c, s))
            keep = _first(q, -s, c, k)
            return q[keep], c[keep], s[keep]

        def out(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v) for v in rows], names=["query", "class_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, block, side = (batch.column(c).to_numpy() for c in ("bucket", "block", "side"))
            ids, vec = batch.column("id").to_numpy(), _matrix(batch.column("vec"))
            cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(block) != 0) | (np.diff(side) != 0)) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(ids)]):
                if at != (key := (bucket[a], block[a])):
                    at, parts = key, []
                if side[a] == 0:
                    parts.append((ids[a:b], vec[a:b]))
                    continue
                if not parts:
                    continue
                if len(parts) > 1:
                    parts = [tuple(np.concatenate(p) for p in zip(*parts))]
                own, x = parts[0]
                i, j, score = best_pairs(vec[a:b], x, own, k)
                held.append((ids[a:b][i], own[j], score))
                if sum(len(h[0]) for h in held[-64:]) > GATHER // 16 and sum(len(h[0]) for h in held) > GATHER:
                    held = [thin()]
                    if len(held[0][0]) > GATHER // 2:
                        yield out(held[0])
                        held = []
        if held:
            yield out(thin())

    dealt = blocks.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "side")
    return map_in_arrow(dealt, run, "query long, class_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that is_query (of vec_id) holds for, the k others found of largest inner product.

    Nearest first, ties to the smaller id; the score is computed from the given components in double precision. All, if there are
    fewer than k. Rows take no part whose id or vector is null, whose vector is zero or has a null or non-finite
    component, or another number of components than most (of equally frequent numbers the least counts). Rows
    of one id count once, with the least of their vectors. Other columns are ignored. Without rows: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = materialize(valid(vectors, vec_id, embedding).withColumn("asks", F.coalesce(is_query, F.lit(False))), "polytope-rows")
    kind = rows.schema["vec"].dataType.simpleString()
    # of equal vectors only the k + 1 least ids can be among the nearest of any row
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("at") <= k + 1)
    ids = first.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = rows.groupBy("vec").agg(F.min("vec_id").alias("class_id"), F.count_if("asks").alias("n"))
    classes = materialize(classes.join(ids, "vec"), "polytope-classes")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    n_vectors, n_queries, shortest, longest = classes.agg(F.count("*"), F.count_if(F.col("n") > 0), F.min(norm), F.max(norm)).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    level = bool(longest <= shortest * (1 + 1e-5))
    asking = classes.where("n > 0")
    sample = [(r["class_id"], r["vec"]) for r in asking.orderBy(F.xxhash64("class_id")).limit(SAMPLE).select("class_id", "vec").collect()]
    near = _neighbours(classes, sample, k)
    setting = fit(np.array([v for _, v in sample], float), near, n_vectors, n_queries, longest, level, recall) if near else None
    if setting:
        rows_in = [_hashed(classes, "class_id", kind, 0, setting, longest, level), _hashed(asking, "class_id", kind, 1, setting, longest, level)]
    else:
        rows_in = [df.select(F.lit(0).cast("long").alias("bucket"), F.lit(side).alias("side"), F.col("class_id").alias("id"), "vec") for side, df in enumerate((classes, asking))]
    met = _meet(_blocks(rows_in[0].unionByName(rows_in[1]), BLOCK, QUERY_BLOCK), k + 1)
    # a pair may be met in several tables, with the same score
    pairs = met.groupBy("query", "class_id").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    pairs = materialize(pairs.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1).drop("at"), "polytope-pairs")
    often = pairs.groupBy("class_id").agg(F.count("*").alias("n"))
    each = join_hot(pairs, classes.select("class_id", "ids").join(often, "class_id"), ["class_id"], "inner")
    each = each.select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    each = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    lists = each.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("at", "vec_id", "score"))).alias("found"))
    lists = materialize(lists.join(asking.select(F.col("class_id").alias("query"), "n"), "query"), "polytope-lists")
    asked = join_hot(rows.where("asks").select(F.col("vec_id").alias("query_id"), "vec"), asking.select("vec", F.col("class_id").alias("query"), "n"), ["vec"], "inner")
    told = join_hot(asked.select("query_id", "query"), lists, ["query"], "inner")
    others = F.slice(F.filter("found", lambda s: s["vec_id"] != F.col("query_id")), 1, k)
    told = told.select("query_id", F.posexplode(others).alias("at", "one"))
    return told.select("query_id", (F.col("at") + 1).alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))
