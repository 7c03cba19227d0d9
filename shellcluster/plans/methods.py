"""The method catalogue of benchmarks: the main estimator, its ablations, density peaks and the comparators."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..operators import comparators, extract
from .estimator import StrataClusterer

MAIN = {
    "strata": {},
    "strata_fixed_quantile": {"core_threshold_rule": "fixed_quantile"},
    "strata_no_background_recovery": {"background_recovery": False},
    "strata_single_layer": {"signal_strata": "single_layer"},
}
STOCHASTIC = {"knn_leiden"}
METHODS = (*MAIN, "density_peaks", *comparators.METHODS)


@dataclass
class MethodResult:
    labels: DataFrame
    parameters: dict = field(default_factory=dict)
    profile: dict = field(default_factory=dict)


def run_method(method: str, points: DataFrame, *, seed: int = 42) -> MethodResult:
    """Labels (id, label) of points by a method of METHODS."""
    profile = comparators.profile_of(points)
    began = time.time()
    if method in MAIN:
        estimator = StrataClusterer(extraction_config=replace(extract.ExtractionConfig(), **MAIN[method]))
        estimator = replace(estimator, mixture_config=replace(estimator.mixture_config, random_state=seed))
        model = estimator.fit(points)
        return MethodResult(model.labels.select("id", "label"), {"k": estimator.k} | MAIN[method], model.profile | {"seconds": time.time() - began})
    found = comparators.run_density_peaks(points) if method == "density_peaks" else comparators.dispatch(method, points, profile, seed=seed)
    return MethodResult(found.labels, found.parameters, {"seconds": time.time() - began, "profile": profile})
