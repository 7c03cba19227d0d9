"""Comparator clusterings on DataFrames: the DBSCAN family, shared neighbours, density peaks, X-shift, hierarchies, communities.

Each takes points (id, features) and gives (id, label); -1 is noise. Where a method is sequential by
definition (an ordering, a greedy merge of clusters), the driver works on a checked number of rows or on
one row a cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..runtime import materialize, ship
from . import density, knn, space
from .components import connected_components, dense_labels, label_edges, quantile, with_position

#: Rows that a sequential method takes at most.
SEQUENTIAL_ROWS = 200_000
#: Pairs within a radius that are written out: beyond both so many and so many a row, DBSCAN keeps none. Rows that tell how many there are.
MOST_PAIRS, PAIRS_A_ROW, PROBES = 4_000_000, 64, 256
#: Rows up to which the driver grows HDBSCAN's tree; beyond, tasks take any two of so many parts, in blocks of so many rows.
TREE_ROWS, TREE_PARTS, TREE_BLOCK = 4096, 10, 2048
#: Entries of density peaks' lists of the nearest 2 percent.
PEAK_ENTRIES = 8_000_000
#: Core rows that all others are held against first, to join most of them before pairs of components are looked for.
ANCHORS = 1024
PROFILES = ("low_dim", "high_dim")


@dataclass
class Clustering:
    labels: DataFrame
    parameters: dict = field(default_factory=dict)


def profile_of(points: DataFrame) -> str:
    return "low_dim" if knn.dimension(points) <= 2 else "high_dim"


def _graph(points: DataFrame, k: int) -> DataFrame:
    return materialize(knn.build_knn_graph(points, k=k), "comparator-graph")


def _rank_distances(points: DataFrame, rank: int) -> DataFrame:
    """id and d: the distance to the neighbour of that rank; a far one is counted from the farthest row, so no list is longer than half of all rows."""
    n = points.count()
    if rank > n - rank:
        return materialize(knn.far_distance(points, n - rank, n, knn.dimension(points)), "rank-distance")
    return materialize(knn.k_distance(_graph(points, rank), rank), "rank-distance")


def _quantile(d: DataFrame, q: float) -> float:
    return quantile(d, "d", q)


def _placed_values(d: DataFrame) -> tuple[DataFrame, int]:
    """d with its place in ascending order, and the number of rows."""
    placed = materialize(with_position(d.select("id", "d"), "d", "id").select("pos", "d"), "curve")
    return placed, placed.count()


def _values_at(placed: DataFrame, at: list[int]) -> list[float]:
    found = {r["pos"]: r["d"] for r in placed.where(F.col("pos").isin(at)).collect()}
    return [found[i] for i in at]


def _curve_knee(d: DataFrame) -> float:
    """special.polynomial_knee of all rows; beyond SEQUENTIAL_ROWS the fit's sums are made where the rows are."""
    if d.count() <= SEQUENTIAL_ROWS:
        return special.polynomial_knee(d.toArrow()["d"].to_numpy())
    return _placed_knee(*_placed_values(d))


def _placed_knee(placed: DataFrame, n: int, degree: int = 7) -> float:
    ship(placed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((degree + 1, degree + 2))
        for batch in batches:
            basis = np.polynomial.chebyshev.chebvander(2 * batch.column(0).to_numpy() / (n - 1) - 1, degree)
            total += basis.T @ np.column_stack([basis, batch.column(1).to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["sums"])

    sums = np.sum([r["sums"] for r in placed.mapInArrow(run, "sums array<double>").collect()], axis=0).reshape(degree + 1, degree + 2)
    fit = np.linalg.solve(sums[:, :-1], sums[:, -1])
    value = lambda i: np.polynomial.chebyshev.chebval(2 * i / (n - 1) - 1, fit)
    first, last = value(0), value(n - 1)
    best, at = -np.inf, 0
    for a in range(0, n, 1 << 20):
        i = np.arange(a, min(n, a + (1 << 20)))
        below = first + i / (n - 1) * (last - first) - value(i)
        if below.max() > best:
            best, at = below.max(), int(i[below.argmax()])
    return _values_at(placed, [at])[0]


def _placed_extrema(placed: DataFrame, n: int, window: int, part: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Places where the slope of the smoothed curve turns, or begins or ends to stay level, and both ends, ascending; the slope there."""
    ship(placed.sparkSession)
    half = window // 2
    reach = window + 3
    parts = max(1, n // part)
    own = F.least(F.floor(F.col("pos") / part), F.lit(parts - 1)).cast("long")
    # a part is sent its neighbours' rows within reach too
    near = F.array_distinct(F.array(*[F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("pos") + s) / part))).cast("long") for s in (-reach, 0, reach)], own))

    def turn(key: tuple, table: pa.Table) -> pa.Table:
        k = key[0].as_py()
        table = table.sort_by("pos")
        pos, y = table["pos"].to_numpy(), table["d"].to_numpy()
        slope = np.gradient(special.savitzky_golay(y, window, min(3, window - 2)))
        low, high = k * part, n if k == parts - 1 else (k + 1) * part
        # of a flat stretch its ends are enough
        before, after = np.sign(slope[1:-1] - slope[:-2]), np.sign(slope[2:] - slope[1:-1])
        mid = (before != after) & ((before * after < 0) | (before == 0) | (after == 0))
        keep = np.concatenate([[True], mid, [True]]) & (pos >= low) & (pos < high)
        keep[0] &= pos[0] == 0
        keep[-1] &= pos[-1] == n - 1
        return pa.table({"pos": pos[keep], "slope": slope[keep]})

    found = placed.withColumn("part", F.explode(near)).groupBy("part").applyInArrow(turn, "pos long, slope double").toArrow().sort_by("pos")
    return found["pos"].to_numpy(), found["slope"].to_numpy()


def _distributed_vdbscan_eps(placed: DataFrame, n: int, max_values: int, prominence: float) -> list[float]:
    """vdbscan_eps of all rows; the driver takes the turns of the slope only."""
    place, slope = _placed_extrema(placed, n, _window(n))
    scaled = (slope - slope.min()) / max(slope.max() - slope.min(), 1e-12)
    at = special.prominent_peaks(scaled, prominence, max(4, n // 100), place)
    values = _values_at(placed, [int(i) for i in at])
    return _thinned({*values, _placed_knee(placed, n)}, max_values)


def finish(points: DataFrame, cores: DataFrame, borders: DataFrame | None) -> DataFrame:
    """Labels of all points from those of core and border rows; the rest is noise."""
    both = cores.select("id", "label") if borders is None else cores.select("id", "label").unionByName(borders.select("id", "label"))
    return materialize(points.select("id").join(both, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label")), "comparator-labels")


def label_cores(core: DataFrame, edges: DataFrame, min_size: int = 1) -> DataFrame:
    """id and label of core rows: components of core-core edges, numbered by their smallest row."""
    a, b = core.select(F.col("id").alias("src")), core.select(F.col("id").alias("dst"))
    found = connected_components(core, edges.join(a, "src", "left_semi").join(b, "dst", "left_semi"))
    if min_size > 1:
        large = found.groupBy("component").count().where(F.col("count") >= min_size).select("component")
        found = found.join(large, "component", "left_semi")
    return materialize(dense_labels(found), "core-labels")


# --- range search ---------------------------------------------------------------------------


def dbscan(points: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """Density-connected components; a border row takes the lowest label among its core neighbours."""
    if eps <= 0:
        cores = points.select("id").limit(0).withColumn("label", F.lit(0).cast("long"))
        return finish(points, cores, None)
    n, d = points.count(), knn.dimension(points)
    if n and _expected_pairs(points, eps, n, d) > max(MOST_PAIRS, PAIRS_A_ROW * n):
        return _dbscan_without_pairs(points, eps, min_samples, n, d)
    pairs = materialize(knn.range_edges(points, eps).select("src", "dst"), "range-pairs")
    core = materialize(pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select("id"), "range-cores")
    labels = label_cores(core, pairs)
    outside = pairs.join(core.select(F.col("id").alias("src")), "src", "left_anti")
    borders = outside.join(labels.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("label"))
    return finish(points, labels, borders)


def _within_counts(there: space.Side, own: space.Side, eps: float) -> pa.RecordBatch:
    """How many of there lie within eps of each row, itself included."""
    n = np.concatenate([mask.sum(axis=1) for _, mask in space.near(there, own, eps)])
    return pa.RecordBatch.from_arrays([pa.array(own.ids), pa.array(n.astype(np.int64))], names=["id", "n"])


def _component_links(there: space.Side, own: space.Side, eps: float) -> pa.RecordBatch | None:
    """Links between components (in rho) with rows within eps: a forest of them, so no more than there are components."""
    theirs, mine = there.rho.astype(np.int64), own.rho.astype(np.int64)
    nodes, code = np.unique(np.concatenate([theirs, mine]), return_inverse=True)
    theirs, mine, root = code[: len(theirs)], code[len(theirs) :], np.arange(len(nodes))
    for a, mask in space.near(there, own, eps):
        x, y = root[mine[a : a + len(mask)]], root[theirs]
        i, j = np.nonzero(mask & (x[:, None] != y[None]))
        if len(i):
            pairs = np.unique(x[i] * len(nodes) + y[j])
            root = label_edges(pairs // len(nodes), pairs % len(nodes), np.arange(len(nodes)))[root]
    some = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[root[some]])], names=["src", "dst"]) if len(some) else None


def _least_labels(there: space.Side, own: space.Side, eps: float) -> pa.RecordBatch | None:
    """The least label (in rho) of there within eps of each row."""
    least = np.concatenate([np.where(mask, there.rho[None], np.inf).min(axis=1, initial=np.inf) for _, mask in space.near(there, own, eps)])
    some = np.isfinite(least)
    return pa.RecordBatch.from_arrays([pa.array(own.ids[some]), pa.array(least[some].astype(np.int64))], names=["id", "label"]) if some.any() else None


def _expected_pairs(points: DataFrame, eps: float, n: int, d: int) -> float:
    """About how many ordered pairs lie within eps, by PROBES rows held against all. It chooses a way, not a result."""
    ship(points.sparkSession)
    probes = points.where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(max(1, n // PROBES))) == 0)
    shared = points.sparkSession.sparkContext.broadcast(space.matrix(probes.select("features").toArrow()["features"].combine_chunks()) if probes.limit(1).count() else np.empty((0, d)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                q = space.matrix(batch.column(0).slice(at, 2048))
                close = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None] - 2 * q @ x.T <= eps * eps
                yield pa.RecordBatch.from_arrays([pa.array([int(close.sum())])], names=["n"])

    found = points.select(F.col("features").cast("array<float>").alias("features")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0]
    return (found or 0) / max(1, len(shared.value)) * n


def _dbscan_without_pairs(points: DataFrame, eps: float, min_samples: int, n: int, d: int) -> DataFrame:
    """The same clusters where the pairs within eps are too many to write: tasks count them, link components and take least labels, and give a row for a row.

    Rows with enough others in their own block need no further search; nor do those of the largest component, once its rows have been joined
    within their blocks and through ANCHORS of them: each link to another component has an end outside it.
    """
    eps = float(eps)
    placed = materialize(with_position(points.select("id", F.col("features").cast("array<float>").alias("features")), "id"), "dbscan-rows")
    rows = space.asking(placed.select(F.col("pos").alias("id"), "features"), eps)  # places stand for ids: a double holds them exactly
    part = space.partition(rows, n, d)
    at_home = materialize(space.meet_home(rows, part, lambda there, own: _within_counts(there, own, eps), "id long, n long"), "dbscan-home")
    sure = at_home.where(F.col("n") >= min_samples).select("id")
    left = materialize(rows.join(sure, "id", "left_anti").select(*rows.columns), "dbscan-unsure")
    counts = space.meet_near(rows, left, part, d, lambda there, own: _within_counts(there, own, eps), "id long, n long", left.count())
    more = counts.groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= min_samples).select("id")
    core = materialize(sure.unionByName(more), "range-cores")
    link = lambda there, own: _component_links(there, own, eps)
    links = "src long, dst long"

    def told(labels: DataFrame, column: str) -> DataFrame:
        return materialize(rows.drop("rho").join(labels.select("id", F.col(column).cast("double").alias("rho")), "id"), "dbscan-told")

    state = core.select("id", F.col("id").alias("component"))
    known = told(state, "component")
    for find in (
        lambda known: space.meet_home(known, part, link, links),
        lambda known: space.meet_all(materialize(known.orderBy(F.xxhash64(F.lit(3), "id")).limit(ANCHORS), "dbscan-anchors"), known, part, d, link, links),
        lambda known: _outer_links(known, part, d, link, links),
    ):
        edges = find(known)
        if edges is None:
            break
        nodes = state.select(F.col("component").alias("id")).distinct()
        merged = connected_components(nodes, materialize(edges, "component-links")).select(F.col("id").alias("component"), F.col("component").alias("to"))
        state = materialize(state.join(merged, "component").select("id", F.col("to").alias("component")), "dbscan-components")
        known = told(state, "component")
    labels = materialize(dense_labels(state), "core-labels")
    outside = materialize(rows.join(core, "id", "left_anti").select(*rows.columns), "dbscan-outside")
    borders = space.meet_near(told(labels, "label"), outside, part, d, lambda there, own: _least_labels(there, own, eps), "id long, label long", outside.count())
    both = labels.select("id", "label").unionByName(borders.groupBy("id").agg(F.min("label").alias("label"))).withColumnRenamed("id", "pos")
    return finish(points, placed.select("id", "pos").join(both, "pos"), None)


def _outer_links(known: DataFrame, part: space.Partition, d: int, link, schema: str) -> DataFrame | None:
    """Links of the rows outside the largest component."""
    largest = known.groupBy("rho").count().orderBy(F.desc("count"), "rho").first()
    outer = materialize(known.where(F.col("rho") != largest["rho"]), "dbscan-outer") if largest else None
    n = outer.count() if outer is not None else 0
    return space.meet_near(known, outer, part, d, link, schema, n) if n else None


def run_dbscan(points: DataFrame, profile: str) -> Clustering:
    d = _rank_distances(points, 4)
    if profile == "low_dim":
        base = _curve_knee(d)
        return Clustering(dbscan(points, 0.7 * base), {"min_samples": 5, "eps_multiplier": 0.7, "base_eps": base, "eps": 0.7 * base})
    eps = _quantile(d, 0.05)
    return Clustering(dbscan(points, eps), {"min_samples": 5, "eps_quantile": 0.05, "eps": eps})


def sequential_dbscan(points: DataFrame, eps_values: list[float], min_samples: int = 5) -> DataFrame:
    """DBSCAN on what the smaller radii before left as noise."""
    left, done, following = points, None, 0
    for eps in sorted(eps_values):
        if left.limit(min_samples).count() < min_samples:
            break
        found = dbscan(left, eps, min_samples)
        hit = found.where("label >= 0").select("id", (F.col("label") + following).alias("label"))
        done = hit if done is None else done.unionByName(hit)
        following += (found.agg(F.max("label")).first()[0]) + 1
        left = materialize(left.join(hit.select("id"), "id", "left_anti"), "sequential-left")
    if done is None:
        done = points.select("id").limit(0).withColumn("label", F.lit(0).cast("long"))
    return finish(points, done, None)


def vdbscan_eps(values: np.ndarray, max_values: int, prominence: float) -> list[float]:
    """Radii where the slope of the smoothed k-distance curve peaks, and its knee; thinned evenly to max_values."""
    y = np.sort(np.asarray(values, float))
    n = len(y)
    if n < 16:
        return [float(np.quantile(y, 0.9))]
    window = _window(n)
    slope = np.gradient(special.savitzky_golay(y, window, min(3, window - 2)))
    scaled = (slope - slope.min()) / max(slope.max() - slope.min(), 1e-12)
    at = special.prominent_peaks(scaled, prominence, max(4, n // 100)).tolist()
    at.append(int(np.searchsorted(y, special.polynomial_knee(y))))
    return _thinned({float(y[min(n - 1, max(0, i))]) for i in at}, max_values)


def _window(n: int) -> int:
    window = max(9, min(n // 2 * 2 - 1, 501))
    window = window if window < n else n - 1
    return window - (window % 2 == 0)


def _thinned(values: set[float], max_values: int) -> list[float]:
    out = sorted(values)
    if len(out) > max_values:
        out = [out[i] for i in np.unique(np.linspace(0, len(out) - 1, max_values).round().astype(int))]
    return out


def run_vdbscan(points: DataFrame, profile: str) -> Clustering:
    most, prominence = (3, 0.03) if profile == "low_dim" else (7, 0.08)
    d = _rank_distances(points, 4)
    if d.count() <= SEQUENTIAL_ROWS:
        eps = vdbscan_eps(d.toArrow()["d"].to_numpy(), most, prominence)
    else:
        eps = _distributed_vdbscan_eps(*_placed_values(d), most, prominence)
    return Clustering(sequential_dbscan(points, eps), {"min_samples": 5, "max_eps_values": most, "knee_prominence": prominence, "eps_values": eps})


def run_amd_dbscan(points: DataFrame, profile: str) -> Clustering:
    """Three density levels from quantiles of the distance to an adaptive rank."""
    n, d = points.count(), knn.dimension(points)
    rank = min(max(5, n - 10) if d > 8 else max(5, round(math.sqrt(n) / 2)), n - 1)
    kth = _rank_distances(points, rank)
    eps = [_quantile(kth, q) for q in ((0.25, 0.65, 0.90) if d > 8 else (0.08, 0.55, 0.85))]
    return Clustering(sequential_dbscan(points, eps), {"n_density_levels": 3, "adaptive_rank": rank, "eps_values": eps})


# --- graphs ---------------------------------------------------------------------------------


def _first_border(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The label of the first core neighbour by rank."""
    core = labels.select(F.col("id").alias("dst"), "label")
    outside = edges.join(labels.select(F.col("id").alias("src")), "src", "left_anti").join(core, "dst")
    return outside.groupBy(F.col("src").alias("id")).agg(F.min_by("label", "rank").alias("label"))


def knn_dbscan(graph: DataFrame, eps: float, min_samples: int = 5) -> DataFrame:
    """Core: the last of the min_samples - 1 nearest lies within eps. Edges are those neighbours."""
    m = min_samples - 1
    if graph.where(F.size("nbr") < m).limit(1).count():
        raise ValueError("graph too narrow for min_samples")
    edges = materialize(knn.edges(graph, 1, m), "knn-dbscan-edges")
    labels = label_cores(knn.k_distance(graph, m).where(F.col("d") <= eps).select("id"), edges)
    return finish(graph, labels, _first_border(edges.where(F.col("dist") <= eps), labels))


def run_knn_dbscan(points: DataFrame, profile: str) -> Clustering:
    q = 0.25 if profile == "low_dim" else 0.05
    graph = _graph(points, 4)
    eps = _quantile(knn.k_distance(graph, 4), q)
    return Clustering(knn_dbscan(graph, eps), {"k": 4, "min_samples": 5, "eps_quantile": q, "eps": eps})


def snn_dbscan(graph: DataFrame, shared: int = 13, min_samples: int = 5) -> DataFrame:
    """Edges whose ends share enough neighbours; core rows have enough of them."""
    edges = materialize(knn.shared_neighbours(graph).where(F.col("shared") >= shared), "snn-edges")
    core = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).where(F.col("n") >= min_samples).select("id")
    labels = label_cores(materialize(core, "snn-cores"), edges)
    return finish(graph, labels, _first_border(edges, labels))


def run_snn_dbscan(points: DataFrame, profile: str) -> Clustering:
    return Clustering(snn_dbscan(_graph(points, 20)), {"k": 20, "eps": 13, "min_samples": 5})


def symmetric_edges(graph: DataFrame, rank: int) -> DataFrame:
    """a < b, dist: undirected edges of the first `rank` neighbours, each once; of two, that of the smaller source."""
    e = knn.edges(graph, 1, rank).select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "rank", "dist")
    return e.groupBy("a", "b").agg(F.min_by("dist", F.struct("src", "rank")).alias("dist"))


def communities(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float, seed: int) -> np.ndarray:
    """Communities of a weighted graph by local moving, refinement and aggregation, until nothing moves."""
    rng = np.random.default_rng(seed)
    total = w.sum()
    if total <= 0:
        return np.arange(n)
    member = np.arange(n)
    start: np.ndarray | None = None
    while True:
        near: list[dict[int, float]] = [dict() for _ in range(n)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            if i == j:
                near[i][i] = near[i].get(i, 0.0) + 2 * x
            else:
                near[i][j] = near[i].get(j, 0.0) + x
                near[j][i] = near[j].get(i, 0.0) + x
        degree = np.array([sum(d.values()) for d in near])

        def moving(part: list[int], inside: list[int] | None) -> tuple[list[int], bool]:
            weight: dict[int, float] = {}
            for i, c in enumerate(part):
                weight[c] = weight.get(c, 0.0) + degree[i]
            queue = rng.permutation(n).tolist()
            waiting, moved = set(queue), False
            while queue:
                i = queue.pop()
                waiting.discard(i)
                links: dict[int, float] = {}
                for j, x in near[i].items():
                    if j != i and (inside is None or inside[j] == inside[i]):
                        links[part[j]] = links.get(part[j], 0.0) + x
                own = part[i]
                weight[own] -= degree[i]
                best, gain = own, links.get(own, 0.0) - resolution * degree[i] * weight[own] / (2 * total)
                for c in sorted(links):
                    g = links[c] - resolution * degree[i] * weight[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
                weight[best] = weight.get(best, 0.0) + degree[i]
                if best != own:
                    part[i], moved = best, True
                    for j in near[i]:
                        if part[j] != best and j not in waiting:
                            waiting.add(j)
                            queue.insert(0, j)
            return part, moved

        part, moved = moving(list(range(n)) if start is None else start.tolist(), None)
        if not moved and start is not None:
            break
        _, coarse = np.unique(part, return_inverse=True)
        refined, _ = moving(list(range(n)), coarse.tolist())
        _, fine = np.unique(refined, return_inverse=True)
        if fine.max() + 1 == n:
            _, fine = np.unique(coarse, return_inverse=True)
            if fine.max() + 1 == n:
                break
        upper = np.zeros(fine.max() + 1, int)
        upper[fine] = coarse
        member = fine[member]
        x, y = fine[a], fine[b]
        n = int(fine.max()) + 1
        key, code = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_inverse=True)
        a, b, w = key // n, key % n, np.bincount(code, weights=w)
        _, start = np.unique(upper, return_inverse=True)
    if start is not None:
        member = start[member]
    _, first, label = np.unique(member, return_index=True, return_inverse=True)
    size = np.bincount(label)
    order = np.lexsort((first, -size))
    rank = np.empty(len(order), int)
    rank[order] = np.arange(len(order))
    return rank[label]


def run_communities(points: DataFrame, profile: str, seed: int = 42) -> Clustering:
    graph = _graph(points, 20)
    ids = _checked_ids(points)
    e = symmetric_edges(graph, 15).orderBy("a", "b").toArrow()
    a, b = (np.searchsorted(ids, e[c].to_numpy()) for c in ("a", "b"))
    label = communities(len(ids), a, b, 1 / (1 + e["dist"].to_numpy().astype(float)), 0.5, seed)
    return Clustering(_frame(points, ids, label), {"k": 20, "edge_rank": 15, "resolution": 0.5, "symmetrization": "union", "weights": "1/(1+d)"})


def _checked_ids(points: DataFrame) -> np.ndarray:
    if points.limit(SEQUENTIAL_ROWS + 1).count() > SEQUENTIAL_ROWS:
        raise ValueError(f"this method is sequential and takes {SEQUENTIAL_ROWS} rows at most")
    return np.sort(points.select("id").toArrow()["id"].to_numpy())


def _frame(points: DataFrame, ids: np.ndarray, label: np.ndarray) -> DataFrame:
    return points.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(np.asarray(label), pa.int64())}))


def _dense(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    _checked_ids(points)
    t = points.select("id", "features").toArrow().sort_by("id").combine_chunks()
    return t["id"].to_numpy(), knn._matrix(t["features"].combine_chunks())


# --- density peaks --------------------------------------------------------------------------


def peak_graph(points: DataFrame) -> DataFrame:
    """The nearest 2 percent of each row."""
    n = points.count()
    return materialize(knn.block_graph(points, points, peak_k(n), n, knn.dimension(points)), "peak-graph")


def peak_k(n: int) -> int:
    return min(max(1, math.ceil(0.02 * n)), n - 1)


def peak_density(graph: DataFrame) -> DataFrame:
    """id and rho: exp of minus the mean squared distance to the rows of the graph's lists, scaled to a largest of 1."""
    log = materialize(graph.select("id", (-F.aggregate("dist", F.lit(0.0), lambda s, x: s + x.cast("double") * x) / F.size("dist")).alias("log_rho")), "peak-density")
    top = log.agg(F.max("log_rho")).first()[0]
    return log.select("id", F.exp(F.col("log_rho") - float(top)).alias("rho"))


def peak_state(points: DataFrame) -> DataFrame:
    """id, rho, delta, parent of all rows: see peak_density and peak_parents.

    Lists of the nearest 2 percent are made while they have PEAK_ENTRIES entries at most, or in many dimensions. Beyond, densities come from space.near_sums,
    and rows at one place are one place: they are as dense as each other, and all but the first of them have that one as their parent.
    """
    n, d = points.count(), knn.dimension(points)
    k = peak_k(n)
    if d > space.BOX_DIMENSIONS or n * k <= PEAK_ENTRIES:
        graph = peak_graph(points)
        return materialize(peak_parents(points, peak_density(graph), first_neighbours(graph)), "peaks")
    rows = points.select("id", F.col("features").cast("array<float>").alias("features"))
    places = materialize(rows.groupBy("features").agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "features", "weight"), "peak-places")
    log = materialize(space.near_sums(places, k, d).select("id", (-F.col("total") / k).alias("log_rho")), "peak-density")
    top = log.agg(F.max("log_rho")).first()[0]
    first = materialize(peak_parents(places, log.select("id", F.exp(F.col("log_rho") - float(top)).alias("rho"))), "peak-first")
    others = rows.join(places.select("features", F.col("id").alias("parent")), "features").where("id != parent")
    others = others.join(first.select(F.col("id").alias("parent"), "rho"), "parent").select("id", "rho", F.lit(0.0).alias("delta"), "parent")
    return materialize(first.unionByName(others), "peaks")


def first_neighbours(graph: DataFrame, k: int = 32) -> DataFrame:
    return graph.select("id", F.slice("nbr", 1, k).alias("nbr"), F.slice("dist", 1, k).alias("dist"))


def peak_parents(points: DataFrame, rho: DataFrame, graph: DataFrame | None = None) -> DataFrame:
    """id, rho, delta, parent: the nearest row that comes before in the order (rho descending, id); of the first, the farthest distance and -1.

    With a graph (exact nearest rows) most rows have theirs in it; the others search cells: see space.nearest_before.
    """
    n, d = points.count(), knn.dimension(points)
    rows = materialize(points.join(rho, "id").select("id", F.col("features").cast("array<float>").alias("features"), F.col("rho").cast("double").alias("rho")), "peak-rows")
    first = rows.orderBy(F.desc("rho"), "id").first()
    found, _ = space.nearest_before(rows, n, d, graph)
    gap = F.transform(F.arrays_zip("features", F.lit(first["features"]).cast("array<float>").alias("top")), lambda s: (s["features"].cast("double") - s["top"]) ** 2)
    far = rows.agg(F.max(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, v: a + v)))).first()[0]
    top = F.col("id") == first["id"]
    return rows.select("id", "rho").join(found, "id", "left").select("id", "rho", F.when(top, F.lit(far)).otherwise(F.col("delta")).alias("delta"), F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))


def peak_centers(state: DataFrame) -> tuple[list[int], float | None, bool]:
    """Centres by the last large gap of gamma = rho * delta among rows above both means; the mean gap; whether there were none."""
    means = state.agg(F.avg("rho"), F.avg("delta")).first()
    scored = state.withColumn("gamma", F.col("rho") * F.col("delta"))
    above = scored.where((F.col("rho") > means[0]) & (F.col("delta") > means[1]))
    n, high, low = above.agg(F.count("*"), F.max("gamma"), F.min("gamma")).first()
    fallback = not n
    top = (scored if fallback else above).orderBy(F.desc("gamma"), "id").limit(1).select("id").first()["id"]
    if n < 2:
        return [int(top)], None, fallback
    mean = (high - low) / n  # gaps add up to that
    placed = materialize(with_position(above.select("id", "gamma"), F.desc("gamma"), "id"), "peak-gammas")
    following = placed.select((F.col("pos") - 1).alias("pos"), F.col("gamma").alias("next"))
    last = placed.join(following, "pos").where(F.col("gamma") - F.col("next") >= mean).agg(F.max("pos")).first()[0]
    if last is None:
        return [int(top)], mean, True
    found = placed.where(F.col("pos") <= last).toArrow().sort_by("pos")
    return found["id"].to_pylist(), mean, fallback


def follow_parents(parents: DataFrame, name: str = "root") -> DataFrame:
    """id and the end of its chain of parents, by pointer doubling. parents: id, parent; roots have parent = id."""
    state = materialize(parents.select("id", F.col("parent").alias(name)), "chains")
    while True:
        step = state.join(state.select(F.col("id").alias(name), F.col(name).alias("far")), name).select("id", "far", name)
        new = materialize(step.select("id", F.col("far").alias(name), (F.col("far") != F.col(name)).alias("moved")), "chains")
        state = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return state


def run_density_peaks(points: DataFrame, profile: str | None = None) -> Clustering:
    """Every row gets the label of the centre its chain of nearest denser rows ends at."""
    bad = points.where(F.exists("features", lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))).limit(1).count()
    n = points.count()
    if n < 2 or bad:
        raise ValueError("density peaks need at least two rows of finite values")
    state = peak_state(points)
    centers, gap, fallback = peak_centers(state)
    numbers = points.sparkSession.createDataFrame(list(zip(centers, range(len(centers)), strict=True)), "id long, label long")
    # the densest row of all is a root even where it is no centre; it then has no label to give
    rooted = state.join(numbers.select("id", F.lit(True).alias("is_center")), "id", "left").select("id", F.when(F.col("is_center") | (F.col("parent") < 0), F.col("id")).otherwise(F.col("parent")).alias("parent"))
    ends = follow_parents(rooted).join(numbers.select(F.col("id").alias("root"), "label"), "root", "left")
    if ends.where("label IS NULL").limit(1).count():
        raise RuntimeError("a chain ends at a row that is no centre")
    return Clustering(materialize(ends.select("id", "label"), "peak-labels"), {"k": peak_k(n), "centers": centers, "gap_threshold": gap, "fallback": fallback})


# --- X-shift --------------------------------------------------------------------------------


def run_xshift(points: DataFrame, profile: str, density_k: int = 62, candidates: int = 32, threshold: float = 2.0) -> Clustering:
    """Rows climb to their nearest denser neighbour; modes without a valley between them join; near clusters merge."""
    n, d = points.count(), knn.dimension(points)
    if n < 3:
        return Clustering(finish(points, dense_labels(points.select("id"), "id"), None), {"density_k_including_self": n, "n_size_including_self": n})
    k = min(density_k, n)
    near = max(1, k - 1)
    size = min(n, max(2, max(math.ceil(0.5 * (d + 1)), -math.ceil(math.log(0.01 / n) / math.log(2)))))
    unit = points.select("id", density.unit_vectors(F.col("features")).cast("array<float>").alias("features"))
    unit = materialize(unit, "xshift-unit")
    graph = materialize(knn.build_knn_graph(unit, k=max(near, size - 1)), "xshift-graph")
    angles = F.aggregate(F.slice("dist", 1, near), F.lit(0.0), lambda s, x: s + density.angle(x.cast("double")))
    dense = materialize(graph.select("id", (-angles).alias("density")), "xshift-density")
    e = knn.edges(graph, 1, size - 1).join(dense.select(F.col("id").alias("src"), F.col("density").alias("own")), "src").join(dense.select(F.col("id").alias("dst"), F.col("density").alias("other")), "dst")
    up = e.where("other > own").groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "rank").alias("parent"))
    parents = materialize(dense.join(up, "id", "left").select("id", F.coalesce("parent", "id").alias("parent"), "density"), "xshift-parents")
    modes = materialize(parents.where("parent = id").join(unit, "id"), "xshift-modes")
    if (n_modes := modes.count()) > SEQUENTIAL_ROWS:
        raise ValueError(f"modes are merged one by one, {SEQUENTIAL_ROWS} at most")
    joined = _valley_links(unit, modes, n, d, k, candidates)
    rooted = parents.join(joined, "id", "left").select("id", F.coalesce("link", "parent").alias("parent"))
    ends = materialize(follow_parents(rooted), "xshift-ends")
    labels, before, merges = _merge_near(points, ends, threshold)
    return Clustering(labels, {"density_k_including_self": k, "n_size_including_self": size, "initial_roots": n_modes, "pre_merge_clusters": before, "merges": merges, "merge_threshold": threshold})


def _valley_links(unit: DataFrame, modes: DataFrame, n: int, d: int, k: int, candidates: int) -> DataFrame:
    """id and link: from the less dense to the denser of two modes with no row sparser than either on the way; of several, the most similar, then the least link.

    modes: id, density, features. Pairs of near modes, whose middle has no third mode nearer, and what lies on the way between them stay in Spark.
    """
    m = modes.count()
    if m < 2:
        return modes.select("id", F.lit(None).cast("long").alias("link")).limit(0)
    rows = modes.select("id", "density", "features")
    near = knn.edges(knn.build_knn_graph(rows.select("id", "features"), k=min(m - 1, max(1, candidates)), backend="block")) if m > 1 else None
    pairs = near.select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).distinct()
    ends = [rows.select(F.col("id").alias(c), F.col("density").alias(f"density_{c}"), F.col("features").alias(f"x_{c}")) for c in ("i", "j")]
    pairs = pairs.join(ends[0], "i").join(ends[1], "j").where("density_i != density_j")
    rising = F.col("density_i") < F.col("density_j")
    column = lambda name: [F.when(rising, F.col(f"{name}_{a}")).otherwise(F.col(f"{name}_{b}")) for a, b in (("i", "j"), ("j", "i"))]
    pairs = pairs.select(F.when(rising, F.col("i")).otherwise(F.col("j")).alias("low"), F.when(rising, F.col("j")).otherwise(F.col("i")).alias("high"), column("density")[0].alias("least"), column("x")[0].alias("x"), column("x")[1].alias("y"))
    pairs = materialize(with_position(pairs, "low", "high", name="test"), "xshift-pairs")
    total = F.zip_with("x", "y", lambda a, b: a.cast("double") + b)
    norm = F.sqrt(F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v))
    middle = pairs.select("test", "low", "high", total.alias("total")).withColumn("norm", norm).where(F.col("norm") > float(np.finfo(float).eps))
    middle = middle.select((-1 - F.col("test")).alias("id"), F.transform("total", lambda v: v / F.col("norm")).alias("features"), "test", "low", "high")
    closest = knn.block_graph(middle, rows, min(2, m), m, d).select((-1 - F.col("id")).alias("test"), "nbr")
    direct = closest.join(middle.select("test", "low", "high"), "test").where(F.array_contains("nbr", F.col("low")) & F.array_contains("nbr", F.col("high"))).select("test")
    pairs = materialize(pairs.join(direct, "test", "left_semi"), "xshift-tests")
    angles = F.aggregate("dist", F.lit(0.0), lambda s, v: s + density.angle(v.cast("double")))
    # the middle first: where it is sparser than both, as in most pairs, the rest of the way need not be seen
    for steps in ([10], [i for i in range(1, 20) if i != 10]):
        way = pairs.select("test", "x", "y", F.posexplode(F.array(*[F.lit(i * 0.05) for i in steps])).alias("step", "f")).withColumn("total", F.zip_with("x", "y", lambda a, b: F.col("f") * a + (1 - F.col("f")) * b))
        way = way.withColumn("norm", F.greatest(norm, F.lit(float(np.finfo(float).eps))))
        probe = materialize(way.select((-1 - F.col("test") * 19 - F.col("step")).alias("id"), F.transform("total", lambda v: (v / F.col("norm")).cast("float")).alias("features"), "test"), "xshift-probes")
        found = knn.block_graph(probe.select("id", "features"), unit, k, n, d).select("id", (-angles).alias("density")).join(probe.select("id", "test"), "id")
        worst = found.groupBy("test").agg(F.min("density").alias("sparsest"))
        pairs = materialize(pairs.join(worst, "test").where("sparsest >= least").drop("sparsest"), "xshift-tests")
    alike = F.aggregate(F.zip_with("x", "y", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    good = pairs.select("low", "high", alike.alias("alike"))
    return materialize(good.groupBy(F.col("low").alias("id")).agg(F.max_by("high", F.struct("alike", -F.col("high"))).alias("link")), "xshift-links")


def _merge_near(points: DataFrame, ends: DataFrame, threshold: float) -> tuple[DataFrame, int, int]:
    """Greedy merging of the nearest two clusters by diagonal Mahalanobis distance; clusters of one row stay."""
    d = knn.dimension(points)
    both = points.join(ends, "id")
    sums = [f(F.col("features")[i].cast("double")) for i in range(d) for f in (F.sum, lambda c: F.sum(c * c))]
    named = [f.alias(f"s{i}") for i, f in enumerate(sums)]
    table = both.groupBy("root").agg(F.min("id").alias("first"), F.count("*").alias("n"), *named).toArrow().sort_by("first")
    values = np.column_stack([table[f"s{i}"].to_numpy() for i in range(2 * d)]).reshape(len(table), d, 2)
    m = len(table)
    # merged clusters follow those that were there
    first, size = np.zeros(2 * m, np.int64), np.zeros(2 * m, np.int64)
    total, square, mean, dev = (np.zeros((2 * m, d)) for _ in range(4))
    first[:m], size[:m], total[:m], square[:m] = table["first"].to_numpy(), table["n"].to_numpy(), values[:, :, 0], values[:, :, 1]
    into, live = np.full(2 * m, -1), np.zeros(2 * m, bool)
    least, nearest = np.full(2 * m, np.inf), np.full(2 * m, -1)

    def measure(at):
        n = size[at][:, None]
        mean[at], dev[at] = total[at] / n, np.sqrt(np.maximum(square[at] - total[at] ** 2 / n, 0) / (n - 1)) / 1.03

    def distances(c, to):
        scale = (dev[c] + dev[to]) / 2
        ok = (np.isfinite(scale) & (scale > 0)).all(1)
        out = np.full(len(to), np.inf)
        out[ok] = np.sqrt((((mean[c] - mean[to[ok]]) / scale[ok]) ** 2).sum(1))
        return out

    def look(c, end):
        """The nearest of the clusters after c; the first of several."""
        least[c], nearest[c] = np.inf, -1
        for a in range(c + 1, end, 4096):
            to = a + np.flatnonzero(live[a : min(end, a + 4096)])
            if len(to) and (dist := distances(c, to)).min() < least[c]:
                least[c], nearest[c] = dist.min(), to[dist.argmin()]

    some = np.flatnonzero(size > 1)
    measure(some)
    live[some] = True
    for c in some.tolist():
        look(c, m)
    before, merges = m, 0
    while len(some) and (a := int(np.where(live, least, np.inf).argmin())) is not None and live[a] and least[a] < threshold:
        b, c = int(nearest[a]), m + merges
        first[c], size[c], total[c], square[c] = min(first[a], first[b]), size[a] + size[b], total[a] + total[b], square[a] + square[b]
        into[[a, b]], live[[a, b]] = c, False
        measure(np.array([c]))
        old = np.flatnonzero(live)
        live[c], merges = True, merges + 1
        lost = np.isin(nearest[old], (a, b))
        for i in old[lost].tolist():
            look(i, c + 1)
        kept = old[~lost]
        dist = distances(c, kept) if len(kept) else np.empty(0)
        closer = dist < least[kept]
        least[kept[closer]], nearest[kept[closer]] = dist[closer], c
    end = np.arange(m + merges)
    for c in range(m + merges - 1, -1, -1):  # clusters come after those they are made of
        if into[c] >= 0:
            end[c] = end[into[c]]
    kept = np.unique(end[:m])
    number = np.empty(m + merges, np.int64)
    number[kept[np.argsort(first[kept], kind="stable")]] = np.arange(len(kept))
    numbers = points.sparkSession.createDataFrame(pa.table({"root": table["root"], "label": pa.array(number[end[:m]])}))
    return materialize(ends.join(numbers, "root").select("id", "label"), "xshift-labels"), before, merges


# --- hierarchies ----------------------------------------------------------------------------


def reachability_tree(points: DataFrame, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and the edges (a, b, weight) of a minimum spanning tree of mutual reachability, lightest first.

    Beyond TREE_ROWS rows the tree is that of the trees of any two blocks of rows, which tasks grow and join: an edge that is the
    heaviest on a cycle of some rows is so among all.
    """
    ids = _checked_ids(points)
    n, k = len(ids), min(len(ids) - 1, max(1, min_samples - 1))
    if n <= TREE_ROWS:
        _, x = _dense(points)
        _, dist = knn.top_k(x, np.arange(n), x, np.arange(n), k)
        return ids, grown_tree(x, dist[:, -1])
    edges = _tree_edges(points, n, k).toArrow()
    keep = light_edges(edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy())
    return ids, np.column_stack([edges[c].to_numpy()[keep] for c in ("a", "b", "w")])


def grown_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree of mutual reachability of some rows, lightest first."""
    n = len(x)
    norm = (x * x).sum(1)
    apart = x @ x.T
    apart *= -2
    apart += norm[:, None]
    apart += norm[None]
    np.sqrt(np.maximum(apart, 0, out=apart), out=apart)
    np.maximum(apart, core[None], out=apart)
    np.maximum(apart, core[:, None], out=apart)
    # reach: of rows in the tree never again the least
    reach, source, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n)
    edges = np.empty((max(0, n - 1), 3))
    at = 0
    for i in range(n - 1):
        done[at] = np.inf
        d = apart[at]
        better = d < reach
        np.copyto(reach, d, where=better)
        source[better] = at
        at = int((reach + done).argmin())
        edges[i] = source[at], at, reach[at]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def light_edges(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Places of the edges of a minimum spanning forest, lightest first, ties by a and b."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, parent, keep = code[: len(a)].tolist(), code[len(a) :].tolist(), list(range(len(nodes))), []
    for e in np.lexsort((b, a, w)).tolist():
        i, j = x[e], y[e]
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        while parent[j] != j:
            parent[j] = j = parent[parent[j]]
        if i != j:
            parent[i] = j
            keep.append(e)
    return np.array(keep, np.int64)


def _tree_edges(points: DataFrame, n: int, k: int) -> DataFrame:
    """a, b, w: edges between places of rows by id, of the trees of any two of TREE_PARTS parts; each task takes two parts, and joins the trees of any two of their blocks."""
    d = knn.dimension(points)
    rows = points.select("id", F.col("features").cast("array<float>").alias("features"))
    graph = knn.build_knn_graph(rows, k=k, backend="grid" if d <= 2 else "block")
    # lists hold rounded distances: the last one is measured again
    last = graph.select("id", F.element_at("nbr", -1).alias("last")).join(rows, "id").join(rows.select(F.col("id").alias("last"), F.col("features").alias("there")), "last")
    gap = F.expr("sqrt(aggregate(zip_with(features, there, (x, y) -> (cast(x AS double) - y) * (cast(x AS double) - y)), 0D, (s, v) -> s + v))")
    placed = materialize(with_position(last.select("id", "features", gap.alias("core")), "id"), "tree-rows")
    part = F.pmod(F.col("pos"), F.lit(TREE_PARTS))
    pairs = F.transform(F.sequence(F.lit(0), F.lit(TREE_PARTS - 1)), lambda p: F.least(p, part) * TREE_PARTS + F.greatest(p, part))
    dealt = placed.select("pos", "features", "core", part.alias("part"), F.explode(pairs).alias("pair"))

    def work(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        pos, core, own = (table[c].to_numpy() for c in ("pos", "core", "part"))
        x = space.matrix(table["features"].combine_chunks())
        blocks = [[np.asarray(v) for v in np.array_split(at, max(1, -(-len(at) // TREE_BLOCK)))] for at in (np.flatnonzero(own == p) for p in np.unique(own))]
        if len(blocks) == 1:
            some = [(a, b) for i, a in enumerate(blocks[0]) for b in blocks[0][i + 1 :]] or [(blocks[0][0], blocks[0][0][:0])]
        else:
            some = [(a, b) for a in blocks[0] for b in blocks[1]]
        found = []
        for a, b in some:
            at = np.concatenate([a, b])
            tree = grown_tree(x[at], core[at])
            ends = pos[at[tree[:, :2].astype(int)]]
            found.append(np.column_stack([ends.min(axis=1), ends.max(axis=1)]).astype(np.int64)), found.append(tree[:, 2])
        ends, w = np.concatenate(found[::2]), np.concatenate(found[1::2])
        keep = light_edges(ends[:, 0], ends[:, 1], w)
        return pa.table({"a": ends[keep, 0], "b": ends[keep, 1], "w": w[keep]})

    ship(points.sparkSession)
    return materialize(dealt.repartition(TREE_PARTS * (TREE_PARTS + 1) // 2, "pair").groupBy("pair").applyInArrow(work, "a long, b long, w double"), "tree-edges")


def stable_clusters(n: int, edges: np.ndarray, min_size: int) -> np.ndarray:
    """Labels of the clusters of the condensed tree with the largest excess of mass; the whole is none of them."""
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for t, (a, b, w) in enumerate(edges):
        x, y = find(int(a)), find(int(b))
        node = n + t
        parent[x] = parent[y] = node
        size[node] = size[x] + size[y]
        kids[node] = (x, y, float(w))
    root = 2 * n - 2 if n > 1 else 0
    cluster_of, birth, stability, tree, points_of = {root: 0}, [0.0], [0.0], {0: []}, {0: []}
    stack = [root]

    def leaves(node):
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += kids[v][:2]
        return out

    while stack:
        node = stack.pop()
        c = cluster_of[node]
        if node < n:
            points_of[c].append(node)
            continue
        x, y, w = kids[node]
        lam = 1 / w if w > 0 else np.finfo(float).max / 1e6
        large = [v for v in (x, y) if size[v] >= min_size]
        for v in (x, y):
            if len(large) == 2:
                new = len(birth)
                birth.append(lam)
                stability.append(0.0)
                tree[c].append(new)
                tree[new], points_of[new] = [], []
                cluster_of[v] = new
                stability[c] += (lam - birth[c]) * size[v]
                stack.append(v)
            elif v in large:
                cluster_of[v] = c
                stack.append(v)
            else:
                fallen = leaves(v)
                points_of[c] += fallen
                stability[c] += (lam - birth[c]) * len(fallen)
    chosen = [False] * len(birth)
    total = list(stability)
    for c in range(len(birth) - 1, 0, -1):
        below = sum(total[k] for k in tree[c])
        if tree[c] and below > stability[c]:
            total[c] = below
        else:
            chosen[c] = True
            todo = list(tree[c])
            while todo:
                k = todo.pop()
                chosen[k] = False
                todo += tree[k]
    labels = np.full(n, -1)
    following = 0
    for c in range(1, len(birth)):
        if chosen[c]:
            todo = [c]
            while todo:
                k = todo.pop()
                labels[points_of[k]] = following
                todo += tree[k]
            following += 1
    return labels


def run_hdbscan(points: DataFrame, profile: str) -> Clustering:
    size = 40 if profile == "low_dim" else 8
    ids, edges = reachability_tree(points, 5)
    return Clustering(_frame(points, ids, stable_clusters(len(ids), edges, size)), {"min_samples": 5, "min_cluster_size": size})


def optics_order(x: np.ndarray, min_samples: int, max_eps: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, reachability and predecessor of each row."""
    n = len(x)
    norm = (x * x).sum(1)
    reach, before, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    _, dist = knn.top_k(x, np.arange(n), x, np.arange(n), min(n - 1, min_samples - 1))
    core = np.where(dist[:, -1] <= max_eps, dist[:, -1], np.inf)
    order = np.empty(n, int)
    for i in range(n):
        at = int(np.where(done, np.inf, reach).argmin())
        if done[at]:
            at = int(np.flatnonzero(~done)[0])
        done[at] = True
        order[i] = at
        if np.isfinite(core[at]):
            d = np.sqrt(np.maximum(norm - 2 * x @ x[at] + norm[at], 0))
            new = np.maximum(d, core[at])
            better = ~done & (d <= max_eps) & (new < reach)
            reach[better], before[better] = new[better], at
    return order, reach, before


def xi_clusters(reach: np.ndarray, before: np.ndarray, order: np.ndarray, xi: float, min_samples: int, min_size: int) -> np.ndarray:
    """Labels of the innermost clusters between steep descents and ascents of the reachability plot."""
    n = len(order)
    r = np.append(reach[order], np.inf)
    pred = before[order]
    with np.errstate(invalid="ignore", divide="ignore"):
        ratio = r[:-1] / r[1:]
    keep = 1 - xi
    steep_up, steep_down, down, up = ratio <= keep, ratio >= 1 / keep, ratio > 1, ratio < 1

    def extend(steep, other, start):
        end, soft, i = start, 0, start
        while i < n:
            if steep[i]:
                soft, end = 0, i
            elif not other[i]:
                soft += 1
                if soft > min_samples:
                    break
            else:
                break
            i += 1
        return end

    areas: list[dict] = []
    found: list[tuple[int, int]] = []
    index, mib = 0, 0.0
    for steep in np.flatnonzero(steep_up | steep_down):
        if steep < index:
            continue
        mib = max(mib, r[index : steep + 1].max())
        if steep_down[steep]:
            areas = [] if np.isinf(mib) else [a for a in areas if mib <= r[a["start"]] * keep]
            for a in areas:
                a["mib"] = max(a["mib"], mib)
            end = extend(steep_down, up, steep)
            areas.append({"start": int(steep), "end": int(end), "mib": 0.0})
            index, mib = end + 1, r[end + 1]
        else:
            areas = [] if np.isinf(mib) else [a for a in areas if mib <= r[a["start"]] * keep]
            for a in areas:
                a["mib"] = max(a["mib"], mib)
            end = extend(steep_up, down, steep)
            index, mib = end + 1, r[end + 1]
            own = []
            for a in areas:
                s, e = a["start"], end
                if r[e + 1] * keep < a["mib"]:
                    continue
                top = r[s]
                if top * keep >= r[e + 1]:
                    while r[s + 1] > r[e + 1] and s < a["end"]:
                        s += 1
                elif r[e + 1] * keep >= top:
                    while e > steep and r[e - 1] > top:
                        e -= 1
                # the last rows must have been reached from inside
                while s < e:
                    if r[s] > r[e] or pred[e] in order[s:e]:
                        break
                    e -= 1
                if e - s + 1 < min_size or s > a["end"] or e < steep:
                    continue
                own.append((s, e))
            found += reversed(own)
    labels = np.full(n, -1)
    following = 0
    for s, e in found:
        if (labels[s : e + 1] == -1).all():
            labels[s : e + 1] = following
            following += 1
    out = np.empty(n, int)
    out[order] = labels
    return out


def run_optics(points: DataFrame, profile: str) -> Clustering:
    size, xi, q = (40, 0.1, 0.98) if profile == "low_dim" else (8, 0.03, 0.1)
    eps = _quantile(_rank_distances(points, 4), q)
    ids, x = _dense(points)
    order, reach, before = optics_order(x, 5, eps)
    return Clustering(_frame(points, ids, xi_clusters(reach, before, order, xi, 5, size)), {"min_samples": 5, "min_cluster_size": size, "xi": xi, "max_eps_quantile": q, "max_eps": eps})


METHODS = {
    "dbscan": run_dbscan, "hdbscan": run_hdbscan, "optics": run_optics, "knn_dbscan": run_knn_dbscan, "snn_dbscan": run_snn_dbscan,
    "vdbscan_2007": run_vdbscan, "amd_dbscan": run_amd_dbscan, "knn_leiden": run_communities, "xshift": run_xshift,
}


def dispatch(method: str, points: DataFrame, profile: str, *, seed: int = 42) -> Clustering:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile!r}")
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")
    return run_communities(points, profile, seed) if method == "knn_leiden" else METHODS[method](points, profile)
