"""Approximate neighbour graphs by refinement: neighbours of neighbours are compared until lists hardly change.

Lists begin with rows of the same buckets of random splits. In a round each row brings together its
neighbours, those that came in since they were last compared and the others, and the rows that have it as their
neighbour; lists of the latter are bounded, whatever rows are popular. The members of such a meeting are near one another, and each
takes what is nearer than the last of its own list. A meeting is a bounded group of rows, so a round is two
shuffles of narrow rows and one of meetings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import map_in_arrow, materialize, ship
from .space import matrix

#: Rounds at most, and the share of all list entries that must change for another round.
ROUNDS, CHANGED = 12, 0.001
#: Members of a meeting that are new to it, from its own list and from those that point to it, each.
NEW = 16
#: Pairs a task holds before it drops what no list will take.
GATHER = 1_000_000

_LISTS = "id long, nbr array<long>, dist array<double>, fresh array<boolean>"


def _best(src: np.ndarray, dst: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, and of each src the k nearest."""
    by = np.lexsort((dst, dist, src))
    src, dst, dist = src[by], dst[by], dist[by]
    new = np.ones(len(src), bool)
    new[1:] = (np.diff(src) != 0) | (np.diff(dst) != 0)
    src, dst, dist = src[new], dst[new], dist[new]
    starts = np.flatnonzero(np.diff(src, prepend=src[0] - 1)) if len(src) else np.empty(0, np.int64)
    keep = np.arange(len(src)) - np.repeat(starts, np.diff(np.append(starts, len(src)))) < k
    return src[keep], dst[keep], dist[keep]


def _pairs(ids: np.ndarray, x: np.ndarray, size: np.ndarray, fresh: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, dist) of pairs of one meeting with a fresh member, if nearer than the last in src's list. size: members of each meeting, in order."""
    width, starts = int(size.max()), np.cumsum(size) - size
    at = starts[:, None] + np.arange(width)[None]
    there = np.arange(width)[None] < size[:, None]
    at = np.where(there, at, 0)
    p = x[at]
    norm = (p * p).sum(axis=2)
    near = norm[:, :, None] + norm[:, None, :] - 2 * p @ p.transpose(0, 2, 1)
    f = fresh[at]
    wanted = (f[:, :, None] | f[:, None, :]) & there[:, :, None] & there[:, None, :]
    limit = last[at][:, :, None]
    wanted &= (near < limit * limit + 1e-9 * (1 + norm.max(initial=0))) & ~np.eye(width, dtype=bool)[None]
    g, i, j = np.nonzero(wanted)
    a, b = at[g, i], at[g, j]
    dist = np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1))
    keep = (dist < last[a]) & (ids[a] != ids[b])
    return ids[a[keep]], ids[b[keep]], dist[keep]


def _meet(members: DataFrame, k: int) -> DataFrame:
    """src, dst, dist of what meetings find; a task gives each src's k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, held, n = None, [], 0

        def out(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["src", "dst", "dist"])

        def take(rows: tuple) -> None:
            nonlocal n
            at, ids, fresh, last, x = rows
            cuts = np.append(np.flatnonzero(np.diff(at)) + 1, len(at))
            size = np.diff(cuts, prepend=0)
            for some in np.array_split(np.arange(len(size)), max(1, len(size) // 128)):
                a, b = cuts[some[0]] - size[some[0]], cuts[some[-1]]
                held.append(_pairs(ids[a:b], x[a:b], size[some], fresh[a:b], last[a:b]))
                n += len(held[-1][0])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = (*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "id", "fresh", "last")), matrix(batch.column("features")))
            rows = rows if rest is None else tuple(np.concatenate(p) for p in zip(rest, rows))
            whole = int(np.searchsorted(rows[0][::-1] != rows[0][-1], True)) if len(rows[0]) else 0
            cut = len(rows[0]) - whole  # the last meeting may go on
            rest = tuple(r[cut:] for r in rows)
            if cut:
                take(tuple(r[:cut] for r in rows))
            if n > GATHER:
                best = _best(*(np.concatenate(p) for p in zip(*held)), k)
                held, n = [best], len(best[0])
                if n > GATHER // 2:
                    yield out(best)
                    held, n = [], 0
        if rest is not None and len(rest[0]):
            take(rest)
        if n:
            yield out(_best(*(np.concatenate(p) for p in zip(*held)), k))

    return map_in_arrow(members.repartition("at").sortWithinPartitions("at"), run, "src long, dst long, dist double")


def _lists(pairs: DataFrame, k: int) -> DataFrame:
    """Lists of the k nearest from src, dst, dist, fresh, where a pair that was there before isn't fresh."""
    once = pairs.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.expr("bool_and(fresh)").alias("fresh"))
    packed = F.slice(F.sort_array(F.collect_list(F.struct("dist", "dst", "fresh"))), 1, k)
    return once.groupBy(F.col("src").alias("id")).agg(packed.alias("c")).select("id", F.col("c.dst").alias("nbr"), F.col("c.dist").alias("dist"), F.col("c.fresh").alias("fresh"))


def _edges(lists: DataFrame) -> DataFrame:
    return lists.select("id", F.explode(F.expr("arrays_zip(nbr, dist, fresh)")).alias("e")).select(F.col("id").alias("src"), F.col("e.nbr").alias("dst"), F.col("e.dist").alias("dist"), F.col("e.fresh").alias("fresh"))


def refine(points: DataFrame, pairs: DataFrame, k: int, n: int, seed: int = 42) -> tuple[DataFrame, list[int]]:
    """(id, nbr, dist: lists of up to k near rows; entries that changed in each round).

    points: id, features; pairs: src, dst, dist to begin with, in any number. Lists are as long as what was met allows.
    """
    spark = points.sparkSession
    ship(spark)
    lists = materialize(_lists(pairs.withColumn("fresh", F.lit(True)), k), "descent-lists")
    changes = []
    for turn in range(ROUNDS):
        edges = _edges(lists)
        mixed = F.xxhash64(F.lit(seed + turn), "src", "dst")
        # of the fresh entries NEW take part in this round; the others stay fresh for a later one
        own = edges.withColumn("place", F.row_number().over(Window.partitionBy("src", "fresh").orderBy("dist", "dst")))
        own = materialize(own.withColumn("takes", ~F.col("fresh") | (F.col("place") <= NEW)).drop("place"), "descent-edges")
        back = own.where("takes").select(F.col("dst").alias("at"), F.col("src").alias("id"), "fresh", mixed.alias("order"))
        back = back.withColumn("place", F.row_number().over(Window.partitionBy("at", "fresh").orderBy("order"))).where(F.col("place") <= NEW).select("at", "id", "fresh")
        forth = own.where("takes").select(F.col("src").alias("at"), F.col("dst").alias("id"), "fresh")
        members = forth.unionByName(back).groupBy("at", "id").agg(F.expr("bool_or(fresh)").alias("fresh"))
        last = F.when(F.size("dist") >= k, F.element_at("dist", -1)).otherwise(float("inf"))
        rows = points.select("id", "features").join(lists.select("id", last.alias("last")), "id", "left").withColumn("last", F.coalesce("last", F.lit(float("inf"))))
        met = materialize(_meet(members.join(rows, "id").select("at", "id", "fresh", "last", "features"), k), "descent-met")
        kept = own.select("src", "dst", "dist", (F.col("fresh") & ~F.col("takes")).alias("fresh"))
        lists = materialize(_lists(kept.unionByName(met.withColumn("fresh", F.lit(True))), k), "descent-lists")
        before = own.select("src", "dst")
        changes.append(_edges(lists).where("fresh").join(before, ["src", "dst"], "left_anti").count())
        if changes[-1] <= CHANGED * n * k:
            break
    return lists.select("id", "nbr", "dist"), changes
