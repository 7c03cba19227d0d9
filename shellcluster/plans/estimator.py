"""The main estimator: graph, strata, extraction."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extract, knn, mixture
from ..runtime import materialize


@dataclass
class FittedModel:
    """labels: id, label (-1 noise), is_core. strata: id, group, p_background. profile: what was found and how long it took."""

    labels: DataFrame
    strata: DataFrame
    graph: DataFrame
    stratification: mixture.Stratification
    extraction: extract.Extraction
    profile: dict = field(default_factory=dict)

    @property
    def n_clusters(self) -> int:
        return int(self.labels.where("label >= 0").select("label").distinct().count())

    def core_sample_ids(self) -> DataFrame:
        return self.labels.where("is_core").select("id")


@dataclass
class StrataClusterer:
    """Clusters of points whose density stands out from strata around them.

    fit takes points (id, features); fit_from_graph takes a graph (id, nbr, dist) and, for shell volumes,
    the dimension of the space (1 if unknown).
    """

    k: int = 32
    backend: str = "auto"
    ambient_dimension: float | None = None
    lsh_config: knn.LSHConfig | None = None
    mixture_config: mixture.MixtureConfig = field(default_factory=mixture.MixtureConfig)
    extraction_config: extract.ExtractionConfig = field(default_factory=extract.ExtractionConfig)

    def fit(self, points: DataFrame) -> FittedModel:
        began = time.time()
        graph = materialize(knn.build_knn_graph(points.select("id", F.col("features").cast("array<float>").alias("features")), k=self.k, backend=self.backend, config=self.lsh_config), "graph")
        seconds = time.time() - began
        model = self.fit_from_graph(graph, self.ambient_dimension or knn.dimension(points))
        model.profile["graph_seconds"] = seconds
        return model

    def fit_predict(self, points: DataFrame) -> DataFrame:
        return self.fit(points).labels

    def fit_from_graph(self, graph: DataFrame, ambient_dimension: float | None = None) -> FittedModel:
        began = time.time()
        config = self.mixture_config
        found = mixture.stratify(graph, dimension=float(ambient_dimension or self.ambient_dimension or 1.0), config=config, roles=graph_roles(graph, config))
        strata = materialize(found.strata, "strata")
        middle = time.time()
        out = extract.extract(graph, strata, found.background_group, self.extraction_config)
        profile = {"stratification": found.diagnostics, "groups": out.groups, "background_events": out.events, "stratification_seconds": middle - began, "extraction_seconds": time.time() - middle} | out.profile
        return FittedModel(out.labels, strata, graph, found, out, profile)

    def fit_predict_from_graph(self, graph: DataFrame, ambient_dimension: float | None = None) -> DataFrame:
        return self.fit_from_graph(graph, ambient_dimension).labels


def graph_roles(graph: DataFrame, config: mixture.MixtureConfig):
    """The role rules that need the graph; None for those that don't."""
    rule = config.component_roles
    if rule in ("largest_rate_gap", "rate_changepoint_mdl"):
        return None
    n, k = graph.select(F.count("*"), F.max(F.size("nbr"))).first()
    rank = config.role_rank
    if rank > k or (rule == "topology_mdl" and 3 * rank > k):
        raise ValueError("role_rank lies outside the graph")
    distance = knn.k_distance(graph, rank)

    def assigned(rows: mixture.Shells, fit: mixture.Fit) -> DataFrame:
        components = len(fit.parameters.mu)
        # every component as a group of its own; no background
        return materialize(rows.assignment(fit.parameters, np.arange(components), np.zeros(components, bool)).join(distance, "id"), "roles")

    def background_scan(rows, fit):
        table, out = assigned(rows, fit), []
        for c in range(len(fit.parameters.mu) - 1):
            _, events, _ = extract.background_scan(graph, table.where(F.col("group") == c).select("id", "d"), k, rank)
            if sum(e["gain"] for e in events) > 0:
                out.append(c)
        return np.array(out, int)

    def rate_prefix(rows, fit):
        proposed, _ = mixture.rate_changepoint(fit.parameters, rows.n, float(rows.shapes.sum()))
        if not len(proposed):
            return proposed
        own = assigned(rows, fit).where(F.col("group") < len(proposed)).select("id", "d")
        order = extract.with_position(own, "d", "id")
        size = order.count()
        best = extract._best_window(extract.window_ranks(extract.placed_edges(knn.edges(graph, 1, rank), order), size, extract._widths(size, rank)))
        return proposed if best is not None and best[0] - float(np.log(2)) > 0 else np.empty(0, int)

    def topology(rows, fit):
        table = assigned(rows, fit)
        p = _component_probability(rows, fit)
        scored = table.join(p, "id").withColumn("u", F.log(F.col("p")) - F.log1p(-F.col("p"))).where(F.col("group") < len(fit.parameters.mu) - 1)
        placed = extract.with_position(scored, "group", "d", "id")
        base = placed.groupBy("group").agg(F.min("pos").alias("base"))
        placed = materialize(placed.join(F.broadcast(base), "group").withColumn("pos", F.col("pos") - F.col("base")).drop("base"), "roles-places")
        best = extract.threshold_sweep(placed, extract.stratum_events(graph, placed, rank, 2 * rank), n, rank).collect()
        return np.array(sorted(r["group"] for r in best if r["gain"] > 0), int)

    return {"background_scan_mdl": background_scan, "validated_rate_prefix": rate_prefix, "topology_mdl": topology}[rule]


def _component_probability(rows: mixture.Shells, fit: mixture.Fit) -> DataFrame:
    """id and p: the probability of a row's own component, within (0, 1)."""
    eps = float(np.finfo(float).eps)
    k = len(fit.parameters.mu)
    parts = None
    for c in range(k):
        others = np.arange(k) != c
        one = rows.assignment(fit.parameters, np.arange(k), others).where(F.col("group") == c).select("id", (1 - F.col("p_background")).alias("p"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.select("id", F.greatest(F.least("p", F.lit(1 - eps)), F.lit(eps)).alias("p"))
