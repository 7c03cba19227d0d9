"""Connected components and global positions, on the driver where a checked size allows it, else distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import materialize

#: Edges up to which components are found on the driver.
LOCAL_EDGES = 2_000_000
#: Rows of a key that is joined by broadcast, and such keys at most.
HUB_ROWS, HUBS = 10_000, 1_000_000
#: Values that one task holds for an exact quantile.
EXACT_ROWS = 4_000_000


def label_edges(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each node. nodes: ascending; edges between them."""
    root = np.arange(len(nodes))
    x, y = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (jump := new[new]) is not new and (jump != new).any():
            new = jump
        if (new == root).all():
            return nodes[root]
        root = new


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and component, its smallest id. nodes: id, unique; edges: src, dst between nodes, direction ignored."""
    spark = nodes.sparkSession
    edges = edges.select("src", "dst")
    if edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES and nodes.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES:
        ids = np.sort(nodes.select("id").toArrow()["id"].to_numpy())
        found = edges.toArrow()
        labels = label_edges(found["src"].to_numpy(), found["dst"].to_numpy(), ids)
        import pyarrow as pa

        return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(labels, pa.int64())}))
    stars = star_edges(edges)
    return nodes.select("id").join(stars.select(F.col("high").alias("id"), "low"), "id", "left").select("id", F.coalesce("low", "id").alias("component"))


def star_edges(edges: DataFrame) -> DataFrame:
    """high and low: each node but its component's smallest, with that. edges: src, dst.

    Large and small stars by turns (each node's larger neighbours are tied to its smallest neighbour, then its smaller
    ones and itself are), until nothing changes: about log n rounds. A node's smallest neighbour comes from a
    grouping, which tasks combine beforehand, and reaches its edges by joined_to_hubs.
    """
    tied = edges.select(F.greatest("src", "dst").alias("high"), F.least("src", "dst").alias("low")).where("high != low").distinct()
    tied, known = materialize(tied, "star-edges"), None
    while True:
        state = tied.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first()
        if state == known or not state[0]:
            return tied
        known = state
        least = materialize(tied.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n")), "star-least")
        under = tied.groupBy("low").agg(F.count("*").alias("n"))
        large = joined_to_hubs(tied, least.select(F.col("high").alias("low"), "least").join(under, "low"), "low")
        tied = materialize(large.select("high", F.coalesce("least", "low").alias("low")).distinct(), "star-edges")
        least = materialize(tied.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n")), "star-least")
        small = joined_to_hubs(tied, least, "high").where("low != least").select(F.col("low").alias("high"), F.col("least").alias("low"))
        tied = materialize(small.union(least.select("high", "least")).distinct(), "star-edges")


def joined_to_hubs(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows left-joined to values, which has each key once and in n how many rows it has here.

    Keys of HUB_ROWS and more don't meet in one task: there is no more than one for so many rows, and they are broadcast
    while there are HUBS or fewer (beyond, a hub is less than a HUBS-th of all rows, and joins by shuffle).
    """
    given = [c for c in values.columns if c != "n"]
    hubs = materialize(values.where(F.col("n") >= HUB_ROWS).select(*given), "hubs")
    n = hubs.limit(HUBS + 1).count()
    if not n or n > HUBS:
        return rows.join(values.select(*given), key, "left")
    plain = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(values.where(F.col("n") < HUB_ROWS).select(*given), key, "left")
    return plain.unionByName(rows.join(F.broadcast(hubs), key))


def quantile(df: DataFrame, value: Column | str, q: float) -> float | None:
    """The exact quantile of all values, with linear interpolation; nulls and NaN don't count, and without values there is none.

    One task never holds more than EXACT_ROWS different values: beyond, passes narrow an interval around
    the wanted place by approximate quantiles and exact counts, until few enough are left.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    part = df.select(v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    inside, before = part.count(), 0
    if not inside:
        return None
    rank, reach = q * (inside - 1), 0.01
    while inside > EXACT_ROWS:
        at = (rank - before) / (inside - 1)
        low, high = part.approxQuantile("v", [max(0.0, at - reach), min(1.0, at + reach)], reach / 4)
        under, upto = part.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
        if before + under > int(rank) or before + upto <= min(int(rank) + 1, before + inside - 1):
            reach *= 2
            continue
        if low == high:
            return low
        if upto - under == inside:  # ties: few different values
            break
        part, before, inside = part.where(F.col("v").between(low, high)), before + under, upto - under
    return float(part.select(F.percentile("v", min(1.0, max(0.0, (rank - before) / max(1, inside - 1))))).first()[0])


def with_position(df: DataFrame, *order: Column | str, name: str = "pos") -> DataFrame:
    """df with its row's place in the order, from 0: range partitions are counted, then numbered; no task sorts all rows."""
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = materialize(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__part", F.spark_partition_id()), "position")
    counts = {r[0]: r[1] for r in placed.groupBy("__part").count().collect()}
    starts, at = [], 0
    for p in sorted(counts):
        starts.append((p, at))
        at += counts[p]
    if not starts:
        return df.withColumn(name, F.lit(None).cast("long"))
    base = df.sparkSession.createDataFrame(starts, "__part int, __start long")
    number = F.row_number().over(Window.partitionBy("__part").orderBy(*columns))
    return placed.join(F.broadcast(base), "__part").withColumn(name, F.col("__start") + number - 1).drop("__part", "__start")


def dense_labels(labels: DataFrame, column: str = "component", name: str = "label") -> DataFrame:
    """labels with the values of column numbered from 0 in ascending order."""
    numbers = with_position(labels.select(column).distinct(), column, name=name)
    return labels.join(numbers, column)
