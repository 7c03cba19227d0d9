"""Clusters from strata: threshold sweeps, supported components, a scan of the background, growth and borders."""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import special
from ..runtime import materialize, ship
from . import density, knn
from .components import LOCAL_EDGES, connected_components, dense_labels, label_edges, with_position


@dataclass(frozen=True)
class ExtractionConfig:
    core_rank: int = 4
    connectivity_rank: int = 4
    signal_strata: str = "gamma"
    core_threshold_rule: str = "event_sweep"
    fixed_core_quantile: float = 0.95
    background_recovery: bool = True

    def __post_init__(self):
        if self.core_rank < 1 or self.connectivity_rank < 1:
            raise ValueError("ranks must be positive")
        if self.signal_strata not in ("gamma", "single_layer"):
            raise ValueError("signal_strata must be 'gamma' or 'single_layer'")
        if self.core_threshold_rule not in ("event_sweep", "fixed_quantile"):
            raise ValueError("core_threshold_rule must be 'event_sweep' or 'fixed_quantile'")
        if not 0 < self.fixed_core_quantile <= 1:
            raise ValueError("fixed_core_quantile must lie in (0, 1]")

    def check(self, k: int) -> None:
        if self.core_rank > k or 2 * self.connectivity_rank > k:
            raise ValueError("core_rank and twice connectivity_rank must lie within the graph")


@dataclass
class Extraction:
    """labels: id, label (-1 noise), is_core. groups: a row for each stratum. events: of the background scan."""

    labels: DataFrame
    groups: list[dict]
    events: list[dict] = field(default_factory=list)
    profile: dict = field(default_factory=dict)


# --- the sweep ------------------------------------------------------------------------------


def prefix_sums(rows: DataFrame, group: str, order: list[str], values: dict[str, Column], next_of: str) -> DataFrame:
    """rows with running sums of values within group, the place from 1, the group's size, and next_of in the row after.

    Rows are range-partitioned by group and order; each partition sums its own, and starts from what
    those before it hold, so no task gets a whole group.
    """
    keys = [F.col(group), *[F.col(o) for o in order]]
    typed = rows.withColumns({f"__{n}": c for n, c in values.items()})
    placed = materialize(typed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()), "prefix-sums")
    totals = placed.groupBy("__part", group).agg(F.count("*").alias("n"), F.min_by(next_of, F.struct(*order)).alias("first"), *[F.sum(f"__{n}").alias(n) for n in values]).orderBy("__part").collect()
    held: dict = {}
    starts = []
    for r in totals:
        g = r[group]
        starts.append([r["__part"], g, *held.get(g, [0] + [0.0] * len(values)), None])
        held[g] = [a + b for a, b in zip(held.get(g, [0] + [0.0] * len(values)), [r["n"], *[float(r[n] or 0) for n in values]], strict=True)]
    after: dict = {}
    for s, r in zip(reversed(starts), reversed(totals), strict=True):
        s[-1] = after.get(r[group])
        after[r[group]] = r["first"]
    kind = f"__part int, {group} int, __n long, {', '.join(f'__s_{n} double' for n in values)}, __next double"
    sizes = rows.sparkSession.createDataFrame([(g, h[0]) for g, h in held.items()], f"{group} int, group_size long")
    base = rows.sparkSession.createDataFrame([tuple(s) for s in starts], kind)
    w = Window.partitionBy("__part", group).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(base), ["__part", group]).join(F.broadcast(sizes), group)
    made = {f"run_{n}": F.sum(f"__{n}").over(running) + F.col(f"__s_{n}") for n in values} | {"place": F.row_number().over(w) + F.col("__n"), "next_value": F.coalesce(F.lead(next_of).over(w), "__next")}
    return out.withColumns(made).drop("__part", "__n", "__next", *[f"__s_{n}" for n in values], *[f"__{n}" for n in values])


def stratum_events(graph: DataFrame, places: DataFrame, rank: int, offset: int | None = None) -> DataFrame:
    """group, src, dst, step: edges of the ranks after the first `rank` (or after offset) inside a stratum, active from step on.

    places: id, group, pos.
    """
    first = (rank if offset is None else offset) + 1
    e = knn.edges(graph, first, first + rank - 1)
    a = places.select(F.col("id").alias("src"), F.col("group").alias("group"), F.col("pos").alias("pa"))
    b = places.select(F.col("id").alias("dst"), F.col("group").alias("gb"), F.col("pos").alias("pb"))
    return e.join(a, "src").join(b, "dst").where("group = gb").select("group", "src", "dst", F.greatest("pa", "pb").alias("step"))


def threshold_sweep(ordered: DataFrame, events: DataFrame, n_reference: int, rank: int) -> DataFrame:
    """group, size, threshold, gain: the prefix of each stratum with the largest positive gain; strata without one have no row.

    ordered: id, group, pos (from 0 in the group), d, u. A prefix may not end inside a tie of d.
    """
    active = events.groupBy("group", F.col("step").alias("pos")).agg(F.count("*").alias("s"))
    rows = ordered.join(active, ["group", "pos"], "left").withColumn("s", F.coalesce("s", F.lit(0)))
    run = prefix_sums(rows, "group", ["d", "id"], {"u": F.col("u"), "s": F.col("s").cast("double")}, "d")
    ends = run.where(F.col("next_value").isNull() | (F.col("next_value") != F.col("d")))
    factor = special.topology_log_bayes_factor(F.col("place"), F.round("run_s").cast("long"), n_reference, rank)
    scored = ends.withColumn("gain", F.col("run_u") + factor - F.log("group_size")).where("gain > 0")
    best = F.max_by(F.struct("place", "d", "gain"), F.struct("gain", -F.col("place"))).alias("b")
    return scored.groupBy("group").agg(best).select("group", F.col("b.place").alias("size"), F.col("b.d").alias("threshold"), F.col("b.gain").alias("gain"))


def fixed_quantile(ordered: DataFrame, q: float) -> DataFrame:
    """group, size, threshold, gain: rows up to the q quantile of d (linear between rows, so all rows as near as the one before it); there is no gain.

    Places come from prefix_sums, so no task sorts a group.
    """
    run = prefix_sums(ordered.where("d IS NOT NULL"), "group", ["d", "id"], {"one": F.lit(1.0)}, "d")
    ends = run.where(F.col("next_value").isNull() | (F.col("next_value") != F.col("d")))
    at = ends.where(F.col("place") > F.floor(F.lit(q) * (F.col("group_size") - 1)))
    first = F.min(F.struct("place", "d")).alias("b")
    return at.groupBy("group").agg(first).select("group", F.col("b.place").alias("size"), F.col("b.d").alias("threshold"), F.lit(float("nan")).alias("gain"))


def component_statistics(graph: DataFrame, candidates: DataFrame, rank: int, n_reference: int) -> tuple[DataFrame, DataFrame]:
    """(id, group, component) and (component, group, size, successes, unary, gain).

    candidates: id, group, u. Components come from the first `rank` neighbours, their evidence from the next.
    """
    inside = _inside(knn.edges(graph, 1, rank), candidates)
    labelled = materialize(candidates.join(connected_components(candidates, inside), "id"), "candidate-components")
    second = knn.edges(graph, rank + 1, 2 * rank).join(labelled.select(F.col("id").alias("src"), "component"), "src").join(labelled.select(F.col("id").alias("dst"), F.col("component").alias("other")), "dst")
    hits = second.where("component = other").groupBy("component").agg(F.count("*").alias("successes"))
    stats = labelled.groupBy("component").agg(F.min("group").alias("group"), F.count("*").alias("size"), F.sum("u").alias("unary")).join(hits, "component", "left").withColumn("successes", F.coalesce("successes", F.lit(0)))
    gain = F.col("unary") + special.topology_log_bayes_factor(F.col("size"), F.col("successes"), n_reference, rank) - math.log(n_reference)
    return labelled, stats.withColumn("gain", F.coalesce(gain, F.lit(float("-inf"))))


def _inside(edges: DataFrame, rows: DataFrame, group: str | None = "group") -> DataFrame:
    """Edges with both ends among rows, and in one group."""
    extra = [group] if group else []
    a = rows.select(F.col("id").alias("src"), *[F.col(g).alias("__a") for g in extra])
    b = rows.select(F.col("id").alias("dst"), *[F.col(g).alias("__b") for g in extra])
    out = edges.join(a, "src").join(b, "dst")
    return out.where("__a = __b").drop("__a", "__b") if group else out


# --- the background scan --------------------------------------------------------------------


def window_component_sizes(graph: DataFrame, ordered: DataFrame, width: int, rank: int) -> DataFrame:
    """window and size: the largest component of the edges inside each run of `width` rows. ordered: id, pos."""
    rows = ordered.select("id", F.floor(F.col("pos") / width).cast("long").alias("window"))
    inside = _inside(knn.edges(graph, 1, rank), rows, "window")
    labelled = rows.join(connected_components(rows, inside), "id")
    return labelled.groupBy("window", "component").agg(F.count("*").alias("size")).groupBy("window").agg(F.max("size").alias("size"))


def placed_edges(edges: DataFrame, order: DataFrame) -> DataFrame:
    """a and b: the places of both ends of each edge (src, dst) among the rows of order (id, pos)."""
    ends = [order.select(F.col("id").alias(end), F.col("pos").alias(c)) for end, c in (("src", "a"), ("dst", "b"))]
    return materialize(edges.join(ends[0], "src").join(ends[1], "dst").select("a", "b"), "scan-places")


#: Rows of a window whose components one task finds, with those of all narrower ones; wider ones are joined from them.
TASK_WINDOW = 1 << 16


def window_ranks(placed: DataFrame, n: int, widths: list[int]) -> list[tuple[int, int, int]]:
    """(width, windows after the first whose component is as large as its or larger, windows) of each width. placed: a and b, places of the ends of edges among n rows; widths double.

    Windows nest, so a task takes a window of TASK_WINDOW rows with all narrower ones in it; components of wider ones are unions
    of those, whose number is all that is left to join.
    """
    spark = placed.sparkSession
    ship(spark)
    low = [w for w in widths if w <= TASK_WINDOW] or widths[:1]
    top = low[-1]
    home = F.floor(F.col("a") / top).cast("long")
    crosses = F.floor(F.col("b") / top).cast("long") != home

    def run(key: tuple, table: pa.Table) -> pa.Table:
        first = key[0].as_py() * top
        size = min(top, n - first)
        x, y = (table[c].to_numpy() - first for c in ("a", "b"))
        out, every = [], np.arange(size)
        for w in low:
            same = x // w == y // w
            root = label_edges(x[same], y[same], every)
            most = np.zeros(-(-size // w), np.int64)
            np.maximum.at(most, every // w, np.bincount(root, minlength=size))
            out.append(pa.table({"width": np.full(len(most), w), "at": first // w + np.arange(len(most)), "value": most}))
        far = np.flatnonzero(root != every)
        out.append(pa.table({"width": np.zeros(len(far), np.int64), "at": far + first, "value": root[far] + first}))
        return pa.concat_tables(out)

    found = materialize(placed.where(~crosses).groupBy(home.alias("home")).applyInArrow(run, "width long, at long, value long"), "window-sizes")
    held = found.where("width > 0")
    if len(low) < len(widths):
        # place and root of rows that aren't the first of their component
        state = found.where("width = 0").select("at", "value")
        edges = materialize(placed.where(crosses).select("a", "b"), "window-edges")
        for w in widths[len(low) :]:
            inner = edges.where(F.floor(F.col("a") / w) == F.floor(F.col("b") / w))
            for c in ("a", "b"):
                inner = inner.join(state.select(F.col("at").alias(c), F.col("value").alias(f"root_{c}")), c, "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"root_{c}")
            links = materialize(inner.where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "window-links")
            joined = connected_components(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct(), links).where("id != component")
            joined = materialize(joined.select(F.col("id").alias("value"), "component"), "window-joined")
            moved = state.join(joined, "value", "left").select("at", F.coalesce("component", "value").alias("value"))
            state = materialize(moved.unionByName(joined.select(F.col("value").alias("at"), F.col("component").alias("value"))), "window-roots")
            sizes = state.groupBy("value").agg((F.count("*") + 1).alias("n")).groupBy(F.floor(F.col("value") / w).cast("long").alias("at")).agg(F.max("n").alias("value"))
            held = held.unionByName(sizes.select(F.lit(w).cast("long").alias("width"), "at", "value"))
    held = materialize(held, "window-largest")
    first = {r["width"]: r["value"] for r in held.where("at = 0").collect()}
    known = spark.createDataFrame([(w, first.get(w, 1)) for w in widths], "width long, first long")
    counted = {r["width"]: (r["seen"], r["later"]) for r in held.join(F.broadcast(known), "width").groupBy("width").agg(F.count("*").alias("seen"), F.count_if((F.col("at") > 0) & (F.col("value") >= F.col("first"))).alias("later")).collect()}
    out = []
    for w in widths:
        windows, (seen, later) = -(-n // w), counted.get(w, (0, 0))
        # windows without an edge have components of one row
        alone = windows - seen - (w not in first)
        out.append((w, later + alone if first.get(w, 1) <= 1 else later, windows))
    return out


def _window_sizes(order: np.ndarray, place: np.ndarray, src: np.ndarray, dst: np.ndarray, width: int) -> np.ndarray:
    """The same on arrays. order: rows; place: of each row in order, -1 outside; src, dst: rows."""
    a, b = place[src], place[dst]
    keep = (a >= 0) & (b >= 0)
    a, b = a[keep], b[keep]
    same = a // width == b // width
    root = label_edges(a[same], b[same], np.arange(len(order)))
    size = np.bincount(root, minlength=len(order))
    out = np.zeros(-(-len(order) // width), int)
    np.maximum.at(out, np.arange(len(order)) // width, size)
    return out


def background_scan(graph: DataFrame, rows: DataFrame, k: int, rank: int) -> tuple[DataFrame | None, list[dict], float]:
    """(id, event) of rows in finite clusters of the background, the events, and the intrinsic dimension.

    rows: id, d of one stratum. Widths rank * 2^j are compared by where the largest component of the
    densest window ranks among all windows; a component must repay the codes of width, activation, root
    and edges with that and with the evidence of its boundary. Repeats without the component's rows.
    """
    n = rows.count()
    if n < 2 * rank:
        return None, [], 1.0
    own = graph.join(rows.select("id"), "id", "left_semi")
    dimension = density.intrinsic_dimension(own)
    terms = density.boundary_log_terms(own, dimension, rank, k)
    table = rows.select("id", "d").join(terms, "id")
    edges = _inside(knn.edges(own, 1, rank), rows, None).select("src", "dst")
    if n * rank <= LOCAL_EDGES:
        return _scan_local(table, edges, rank, dimension)
    return _scan_in_spark(graph, table, rank, dimension)


def _scan_local(table: DataFrame, edges: DataFrame, rank: int, dimension: float):
    spark = table.sparkSession
    t = table.toArrow().sort_by("id")
    ids, d, term = t["id"].to_numpy(), t["d"].to_numpy(), t["term"].to_numpy()
    e = edges.toArrow()
    src, dst = np.searchsorted(ids, e["src"].to_numpy()), np.searchsorted(ids, e["dst"].to_numpy())
    active = np.ones(len(ids), bool)
    event_of = np.full(len(ids), -1)
    events: list[dict] = []
    while True:
        rows = np.flatnonzero(active)
        widths = _widths(len(rows), rank)
        if not widths:
            break
        order = rows[np.argsort(d[rows], kind="stable")]
        place = np.full(len(ids), -1)
        place[order] = np.arange(len(order))
        sizes = [(w, _window_sizes(order, place, src, dst, w)) for w in widths]
        best = _best_window([(w, int((s[1:] >= s[0]).sum()), len(s)) for w, s in sizes])
        if best is None or best[0] - math.log(2) <= 0:
            break
        gain, width, p, windows = best
        prefix = place[src] < width
        prefix &= (place[src] >= 0) & (place[dst] >= 0) & (place[dst] < width)
        # labels by the smallest row, so of equal components the first in the order of the prefix counts
        root = label_edges(place[src[prefix]], place[dst[prefix]], np.arange(width))
        size = np.bincount(root, minlength=width)
        component = order[:width][root == int(size.argmax())]
        event = _judge(len(component), float(term[component].sum()), gain, len(rows), rank, len(widths))
        if event is None:
            break
        active[component] = False
        event_of[component] = len(events)
        events.append(event | {"width": width, "window_pvalue": p, "window_count": windows})
    hit = event_of >= 0
    found = spark.createDataFrame(pa.table({"id": pa.array(ids[hit], pa.int64()), "event": pa.array(event_of[hit], pa.int64())})) if hit.any() else None
    return found, events, dimension


def _scan_in_spark(graph: DataFrame, table: DataFrame, rank: int, dimension: float):
    active, selected, events = materialize(table, "scan-rows"), None, []
    edges = materialize(knn.edges(graph, 1, rank).select("src", "dst"), "scan-edges")
    while True:
        n = active.count()
        widths = _widths(n, rank)
        if not widths:
            break
        order = materialize(with_position(active, "d", "id"), "scan-order")
        placed = placed_edges(edges, order)
        best = _best_window(window_ranks(placed, n, widths))
        if best is None or best[0] - math.log(2) <= 0:
            break
        gain, width, p, windows = best
        prefix = order.where(F.col("pos") < width)
        found = connected_components(prefix.select(F.col("pos").alias("id")), placed.where((F.col("a") < width) & (F.col("b") < width)).select(F.col("a").alias("src"), F.col("b").alias("dst")))
        labelled = materialize(prefix.join(found.withColumnRenamed("id", "pos"), "pos"), "scan-prefix")
        top = labelled.groupBy("component").agg(F.count("*").alias("n"), F.sum("term").alias("term"), F.min("pos").alias("at")).orderBy(F.desc("n"), "at").first()
        event = _judge(top["n"], top["term"], gain, n, rank, len(widths))
        if event is None:
            break
        part = materialize(labelled.where(F.col("component") == top["component"]).select("id", F.lit(len(events)).cast("long").alias("event")), "scan-component")
        selected = part if selected is None else selected.unionByName(part)
        active = materialize(active.join(part.select("id"), "id", "left_anti"), "scan-rows")
        events.append(event | {"width": width, "window_pvalue": p, "window_count": windows})
    return selected, events, dimension


def _widths(n: int, rank: int) -> list[int]:
    out, w = [], rank
    while 2 * w <= n:
        out.append(w)
        w *= 2
    return out


def _best_window(ranks: list[tuple[int, int, int]]) -> tuple[float, int, float, int] | None:
    """(gain, width, p, windows) of window_ranks: the first of the widths with the largest gain. The first window counts in the denominator only."""
    scored = [(-math.log((1 + later) / windows) - math.log(len(ranks)), w, (1 + later) / windows, windows) for w, later, windows in ranks if windows >= 2]
    return max(scored, key=lambda x: x[0]) if scored else None


def _judge(size: int, terms: float, window_gain: float, n: int, rank: int, widths: int) -> dict | None:
    boundary = special.uniform_lower_tail_log_bayes_factor(size, terms)
    code = math.log(n) + max(size - 1, 0) * math.log(rank) + math.log(widths)
    gain = window_gain - math.log(2) + boundary - code
    if not math.isfinite(gain) or gain <= 0:
        return None
    return {"component_size": size, "window_gain": window_gain, "boundary_gain": boundary, "graph_code": code, "gain": gain}


# --- growth and borders ---------------------------------------------------------------------


def grow(graph: DataFrame, core: DataFrame) -> DataFrame:
    """id and label: components of core rows, stratum by stratum from the densest, that start clusters or join those they touch.

    core: id, group, radius. Inside a stratum an edge counts within its source's radius; contact with an
    older cluster within the neighbour's. A component in contact is dealt to the clusters by least graph
    distance from its rows in contact.
    """
    wide = core.join(graph, "id").select("id", "group", "radius", "nbr", "dist")
    k = graph.select(F.max(F.size("nbr"))).first()[0] or 0
    n = core.count()
    if n * max(k, 1) <= 4 * LOCAL_EDGES:
        return _grow_local(wide)
    return _grow_in_spark(wide)


def _grow_local(wide: DataFrame) -> DataFrame:
    spark = wide.sparkSession
    t = wide.toArrow().sort_by("id").combine_chunks()
    ids, group, radius = t["id"].to_numpy(), t["group"].to_numpy(), t["radius"].to_numpy()
    labels = np.full(len(ids), -1, np.int64)
    if len(ids):
        lists = t["nbr"].combine_chunks()
        src = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        raw = lists.flatten().to_numpy()
        dist = t["dist"].combine_chunks().flatten().to_numpy().astype(float)
        at = np.minimum(np.searchsorted(ids, raw), len(ids) - 1)
        known = ids[at] == raw
        src, dst, dist = src[known], at[known], dist[known]
        following = 0
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            inner = (group[src] == g) & (group[dst] == g) & (dist <= radius[src])
            root = label_edges(src[inner], dst[inner], np.arange(len(ids)))
            contact = (group[src] == g) & (labels[dst] >= 0) & (dist <= radius[dst])
            # the nearest contact of each row, the first by rank on ties
            order = np.lexsort((np.arange(len(src))[contact], dist[contact], src[contact]))
            s, d = src[contact][order], dst[contact][order]
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            seeds = dict(zip(s[first].tolist(), labels[d[first]].tolist(), strict=True))
            touched = {int(root[i]) for i in seeds}
            for c in np.unique(root[rows]):
                if int(c) not in touched:
                    labels[rows[root[rows] == c]] = following
                    following += 1
            if seeds:
                near: dict[int, list[tuple[int, float]]] = {}
                for a, b, w in zip(src[inner].tolist(), dst[inner].tolist(), dist[inner].tolist(), strict=True):
                    near.setdefault(a, []).append((b, w))
                    near.setdefault(b, []).append((a, w))
                heap = [(0.0, i, label) for i, label in sorted(seeds.items())]
                heapq.heapify(heap)
                done: dict[int, int] = {}
                while heap:
                    far, i, label = heapq.heappop(heap)
                    if i in done:
                        continue
                    done[i] = label
                    for j, w in near.get(i, ()):
                        if j not in done:
                            heapq.heappush(heap, (far + w, j, label))
                for i, label in done.items():
                    labels[i] = label
    return spark.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "label": pa.array(labels, pa.int64())}))


def _grow_in_spark(wide: DataFrame) -> DataFrame:
    spark = wide.sparkSession
    wide = materialize(wide, "grow")
    rows = wide.select("id", "group", "radius")
    e = wide.select(F.col("id").alias("src"), F.col("group").alias("ga"), F.col("radius").alias("ra"), F.posexplode(F.arrays_zip("nbr", "dist")).alias("rank", "e"))
    e = e.select("src", "ga", "ra", "rank", F.col("e.nbr").alias("dst"), F.col("e.dist").cast("double").alias("dist"))
    e = materialize(e.join(rows.select(F.col("id").alias("dst"), F.col("group").alias("gb"), F.col("radius").alias("rb")), "dst"), "grow-edges")
    labels = spark.createDataFrame([], "id long, label long")
    following = 0
    for (g,) in rows.select("group").distinct().orderBy("group").collect():
        own = rows.where(F.col("group") == g)
        inner = e.where((F.col("ga") == g) & (F.col("gb") == g) & (F.col("dist") <= F.col("ra")))
        parts = materialize(connected_components(own, inner), "grow-components")
        touch = e.where((F.col("ga") == g) & (F.col("dist") <= F.col("rb"))).join(labels.select(F.col("id").alias("dst"), "label"), "dst")
        seeds = materialize(touch.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct("dist", "rank")).alias("label")), "grow-seeds")
        touched = parts.join(seeds, "id").select("component").distinct()
        fresh = dense_labels(parts.join(touched, "component", "left_anti")).select("id", (F.col("label") + following).alias("label"))
        both = inner.select("src", "dst", "dist").union(inner.select("dst", "src", "dist"))
        state = materialize(seeds.select("id", "label", F.lit(0.0).alias("far")), "grow-state")
        while True:
            step = both.join(state.select(F.col("id").alias("src"), "label", "far"), "src").select(F.col("dst").alias("id"), "label", (F.col("far") + F.col("dist")).alias("far"))
            new = materialize(state.unionByName(step).groupBy("id").agg(F.min(F.struct("far", "label")).alias("m")).select("id", "m.label", "m.far"), "grow-state")
            if not new.join(state.select("id", F.col("far").alias("was")), "id", "left").where("was IS NULL OR far < was").limit(1).count():
                break
            state = new
        labels = materialize(labels.unionByName(fresh).unionByName(state.select("id", "label")), "grow-labels")
        last = labels.agg(F.max("label")).first()[0]
        following = 0 if last is None else last + 1
    return labels


def attach_borders(graph: DataFrame, labels: DataFrame, radii: DataFrame, rank: int, excluded: DataFrame | None = None) -> DataFrame:
    """id, label, ratio of rows that aren't core but lie within the radius of a core row among their first neighbours.

    labels: id, label of core rows; radii: id, radius of core rows; excluded: ids that stay noise. The
    smallest ratio of distance to radius counts, then the lowest rank; labels don't pass on.
    """
    core = labels.join(radii, "id").select(F.col("id").alias("dst"), "label", "radius")
    outside = knn.edges(graph, 1, rank).join(labels.select(F.col("id").alias("src")), "src", "left_anti")
    if excluded is not None:
        outside = outside.join(excluded.select(F.col("id").alias("src")), "src", "left_anti")
    ratio = F.col("dist").cast("double") / F.greatest(F.col("radius"), F.lit(float(np.finfo(np.float32).tiny)))
    found = outside.join(core, "dst").withColumn("ratio", ratio).groupBy(F.col("src").alias("id")).agg(F.min_by(F.struct("label", "ratio"), F.struct("ratio", "rank")).alias("b"))
    return found.select("id", "b.label", "b.ratio").where("ratio <= 1")


# --- the whole ------------------------------------------------------------------------------


def single_layer(strata: DataFrame, background_group: int | None) -> tuple[DataFrame, int | None]:
    """strata with all signal in group 0 and the background in group 1; and the background's group."""
    is_background = F.lit(False) if background_group is None else F.col("group") == background_group
    return strata.withColumn("group", is_background.cast("int")), None if background_group is None else 1


def extract(graph: DataFrame, strata: DataFrame, background_group: int | None, config: ExtractionConfig | None = None) -> Extraction:
    """Labels from a graph and its strata (id, group, p_background)."""
    config = config or ExtractionConfig()
    spark = graph.sparkSession
    n, k = graph.select(F.count("*"), F.max(F.size("nbr"))).first()
    config.check(k)
    if strata.where("p_background IS NULL OR group IS NULL").limit(1).count() or strata.count() != n:
        raise ValueError("every row needs a stratum and a background probability")
    rank = config.connectivity_rank
    if config.signal_strata == "single_layer":
        strata, background_group = single_layer(strata, background_group)
    d = F.get("dist", F.lit(config.core_rank - 1)).cast("double")
    rows = materialize(graph.select("id", d.alias("d")).join(strata, "id").withColumn("u", density.signal_log_odds(F.col("p_background"))), "extract-rows")
    is_background = F.lit(False) if background_group is None else F.col("group") == background_group
    signal = rows.where(~is_background)

    sizes = {r[0]: r[1] for r in rows.groupBy("group").count().collect()}
    chosen: list = []
    core = radius = None
    if any(g != background_group for g in sizes):
        if config.core_threshold_rule == "event_sweep":
            starts = with_position(signal, "group", "d", "id")
            base = starts.groupBy("group").agg(F.min("pos").alias("base"))
            placed = starts.join(F.broadcast(base), "group").withColumn("pos", F.col("pos") - F.col("base")).drop("base")
            placed = materialize(placed, "extract-places")
            best = threshold_sweep(placed, stratum_events(graph, placed, rank), n, rank)
        else:
            best = fixed_quantile(signal, config.fixed_core_quantile)
        chosen = best.collect()
    kept_components: dict[int, tuple[int, float]] = {}
    if chosen:
        cut = spark.createDataFrame([(r["group"], r["threshold"]) for r in chosen], "group int, threshold double")
        candidates = materialize(signal.join(F.broadcast(cut), "group").where("d <= threshold"), "extract-candidates")
        labelled, stats = component_statistics(graph, candidates.select("id", "group", "u"), rank, n)
        good = materialize(stats.where("gain > 0"), "extract-good")
        kept_components = {r[0]: (r[1], r[2]) for r in good.groupBy("group").agg(F.count("*"), F.sum("gain")).collect()}
        core = labelled.join(good.select("component"), "component", "left_semi").join(F.broadcast(cut), "group").select("id", "group", F.col("threshold").alias("radius"))
    events: list[dict] = []
    dimension = float("nan")
    if background_group is not None and config.background_recovery and sizes.get(background_group):
        found, events, dimension = background_scan(graph, rows.where(is_background).select("id", "d"), k, rank)
        if found is not None:
            part = found.join(rows, "id").select("id", "group", F.col("d").alias("radius"))
            core = part if core is None else core.unionByName(part)
    if core is None:
        core = spark.createDataFrame([], "id long, group int, radius double")
    core = materialize(core, "extract-core")
    labels = materialize(grow(graph, core), "extract-labels")
    barred = rows.where(is_background) if background_group is not None and not config.background_recovery else None
    borders = materialize(attach_borders(graph, labels, core.select("id", "radius"), rank, barred), "extract-borders")
    everything = labels.select("id", "label", F.lit(True).alias("is_core")).unionByName(borders.select("id", "label", F.lit(False).alias("is_core")))
    out = rows.select("id").join(everything, "id", "left").select("id", F.coalesce("label", F.lit(-1)).cast("long").alias("label"), F.coalesce("is_core", F.lit(False)).alias("is_core"))
    out = materialize(out, "extract-result")
    by_group = {r["group"]: r for r in chosen}
    groups = []
    for g in sorted(sizes):
        if g == background_group:
            groups.append({"group": g, "rows": sizes[g], "is_background": True, "size": sum(e["component_size"] for e in events), "threshold": None, "gain": sum(e["gain"] for e in events), "components": len(events)})
        else:
            r = by_group.get(g)
            groups.append({"group": g, "rows": sizes[g], "is_background": False, "size": r["size"] if r else 0, "threshold": r["threshold"] if r else 0.0, "gain": r["gain"] if r else 0.0, "components": kept_components.get(g, (0, 0.0))[0]})
    attached = borders.agg(F.count("*"), F.coalesce(F.sum(-F.log(F.greatest("ratio", F.lit(special.TINY)))), F.lit(0.0))).first()
    n_core, clusters = labels.agg(F.count("*"), F.count_distinct("label")).first()
    profile = {
        "description_gain": sum(v for _, v in kept_components.values()) + sum(e["gain"] for e in events) + attached[1], "clusters": clusters, "core_fraction": n_core / n,
        "border_fraction": attached[0] / n, "noise_fraction": 1 - (n_core + attached[0]) / n, "background_dimension": dimension, "evidence_ranks": [rank + 1, 2 * rank],
    }
    return Extraction(out, groups, events, profile)
