"""Synthetic point families, generated on the executors in seeded chunks.

A family says how many rows each label has and draws points of a label; row ids are spread over labels
by a seeded permutation, so counts are exact and any number of tasks gives the same table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

CHUNK = 4096
POINTS = "id long, features array<float>, y long"
Draw = Callable[[int, np.random.Generator, np.ndarray], np.ndarray]


@dataclass
class Family:
    """counts: rows of labels 0.. and last of the background; draw: from a label (-1 background), a generator and places within the label to points.

    With a margin the background is uniform in the box of all other rows, that much wider on each side; draw isn't asked for it.
    """

    counts: list[int]
    draw: Draw
    metadata: dict = field(default_factory=dict)
    margin: float | None = None

    @property
    def names(self) -> list[str]:
        return [f"cluster_{i}" for i in range(len(self.counts) - 1)]


def generate(spark: SparkSession, family: Family, seed: int) -> DataFrame:
    """id, features and y. A box that follows from the other rows is measured on them, in a pass before."""
    if family.margin is None or not family.counts[-1]:
        return _generated(spark, family, seed)
    d = family.draw(0, np.random.default_rng(0), np.array([0])).shape[1]
    hollow = replace(family, draw=lambda c, rng, place: family.draw(c, rng, place) if c >= 0 else np.zeros((len(place), d)))
    rows = _generated(spark, hollow, seed).where("y >= 0")
    box = rows.agg(*[f(F.col("features")[i]) for f in (F.min, F.max) for i in range(d)]).first()
    if box[0] is None:
        raise ValueError("a background by the box of the other rows needs some")
    noise = _uniform(np.array(box[:d]) - family.margin, np.array(box[d:]) + family.margin)
    return _generated(spark, replace(family, draw=lambda c, rng, place: family.draw(c, rng, place) if c >= 0 else noise(rng, len(place))), seed)


def _generated(spark: SparkSession, family: Family, seed: int) -> DataFrame:
    ship(spark)
    n, ends = sum(family.counts), np.cumsum(family.counts)
    step = next(a for a in range(max(1, int(n * 0.6180339887)), 2 * n + 2) if math.gcd(a, n) == 1) if n > 1 else 1
    shift = int(np.random.default_rng(seed).integers(0, max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                ids = np.arange(chunk * CHUNK, min(n, (chunk + 1) * CHUNK))
                place = (ids * step + shift) % n
                label = np.searchsorted(ends, place, "right")
                rng = np.random.default_rng([seed, chunk])
                x = None
                for c in np.unique(label):
                    own = np.flatnonzero(label == c)
                    y = int(c) if c < len(family.counts) - 1 else -1
                    drawn = family.draw(y, rng, place[own] - (ends[c] - family.counts[c]))
                    if x is None:
                        x = np.empty((len(ids), drawn.shape[1]), np.float32)
                    x[own] = drawn
                label = np.where(label == len(family.counts) - 1, -1, label)
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(x.reshape(-1))), pa.array(label.astype(np.int64))], names=["id", "features", "y"])

    chunks = -(-n // CHUNK)
    return spark.range(chunks, numPartitions=max(1, min(chunks, spark.sparkContext.defaultParallelism))).mapInArrow(run, POINTS)


def _equal(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def _dealt(n: int, weights: np.ndarray, seed: int) -> list[int]:
    return np.random.default_rng([seed, 1 << 20]).multinomial(n, weights / weights.sum()).tolist()


def _uniform(low, high) -> Callable[[np.random.Generator, int], np.ndarray]:
    return lambda rng, m: rng.uniform(low, high, (m, len(low)))


def density_contrast(n: int, *, dimension: int, density_ratio: float, shape: str = "gaussian", noise_fraction: float = 0.25, n_clusters: int = 6, seed: int = 42) -> Family:
    """Clusters of equal mass on a circle; peak densities fall geometrically by density_ratio from the first to the last."""
    for value, name in ((n, "n"), (dimension, "dimension"), (n_clusters, "n_clusters")):
        if isinstance(value, bool) or not isinstance(value, (int, np.integer)):
            raise TypeError(f"{name} must be an integer")
    if dimension < 2 or n_clusters < 3:
        raise ValueError("at least two dimensions and three clusters are needed")
    if not math.isfinite(density_ratio) or density_ratio < 1 or not 0 <= noise_fraction < 1:
        raise ValueError("density_ratio must be at least 1 and noise_fraction in [0, 1)")
    if shape not in ("gaussian", "anisotropic"):
        raise ValueError("shape must be 'gaussian' or 'anisotropic'")
    signal = round((1 - noise_fraction) * n)
    if signal < 20 * n_clusters:
        raise ValueError("every cluster needs 20 rows")
    counts = _equal(signal, n_clusters)
    peak = np.geomspace(density_ratio, 1, n_clusters)
    scales = 0.75 * (np.array(counts) / counts[-1] / peak) ** (1 / dimension)
    angles = 2 * np.pi * np.arange(n_clusters) / n_clusters
    noise = _uniform([-12.0] * 2 + [-3.0] * (dimension - 2), [12.0] * 2 + [3.0] * (dimension - 2))

    def draw(c, rng, place):
        if c < 0:
            return noise(rng, len(place))
        x = rng.normal(size=(len(place), dimension))
        if shape == "anisotropic":
            x[:, :2] *= (2.0, 0.5)
            t = angles[c] + 0.31
            x[:, :2] = x[:, :2] @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        x *= scales[c]
        x[:, :2] += 8 * np.array([math.cos(angles[c]), math.sin(angles[c])])
        return x

    return Family([*counts, n - signal], draw)


def multidensity_2d(n: int, *, seed: int = 42) -> Family:
    """Six stretched clusters in a wide uniform background of 75 percent."""
    signal = round(0.25 * n)
    centers = np.array([(-9, -7), (-1.5, -7.5), (7.5, -6), (-7, 5.5), (0.5, 6.5), (8, 5)], float)
    noise = _uniform([-55.0, -48.0], [55.0, 48.0])

    def draw(c, rng, place):
        if c < 0:
            return noise(rng, len(place))
        s, t = 0.25 * (1 + 0.35 * (c % 3)), 0.37 * (c + 1)
        x = rng.normal(size=(len(place), 2)) * (s, s * (1.8 + 0.2 * (c % 2)))
        return x @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]]) + centers[c]

    return Family([*_dealt(signal, np.array([0.12, 0.16, 0.18, 0.14, 0.19, 0.21]), seed), n - signal], draw)


def ultrasparse_16d(n: int, *, seed: int = 42) -> Family:
    """Twelve clusters on a grid in two of sixteen dimensions, in 95 percent noise."""
    signal = round(0.05 * n)
    centers = np.zeros((12, 16))
    centers[:, :2] = [(a, b) for a in (-10.0, -3.3, 3.3, 10.0) for b in (-8.0, 0.0, 8.0)]
    centers[:, 2:] = np.random.default_rng(seed).normal(0, 3.5, (12, 14))
    noise = _uniform(centers.min(0) - 8, centers.max(0) + 8)
    stretch = np.ones(16)
    stretch[:2] = (1.6, 0.8)

    def draw(c, rng, place):
        return noise(rng, len(place)) if c < 0 else rng.normal(size=(len(place), 16)) * (0.34, 0.50, 0.72)[c % 3] * stretch + centers[c]

    return Family([*_equal(signal, 12), n - signal], draw)


def overlapping_density_16d(n: int, *, seed: int = 42, signal_fraction: float = 0.20) -> Family:
    """Eight overdensities of growing radius in four informative dimensions, twelve of nuisance."""
    if not 0 < signal_fraction < 1:
        raise ValueError("signal_fraction must lie in (0, 1)")
    signal = round(signal_fraction * n)
    if n < 160 or signal < 160:
        raise ValueError("every cluster needs 20 rows")
    weights = np.array([0.075, 0.0875, 0.10, 0.1125, 0.125, 0.1375, 0.1625, 0.20])
    scales = (0.45, 0.60, 0.80, 1.05, 1.35, 1.70, 2.10, 2.60)
    centers = np.array([(-6, -6, -4, 0), (-6, 6, 4, 0), (6, -6, 4, 0), (6, 6, -4, 0), (-2, -2, 5, 0), (-2, 2, -5, 0), (2, -2, -5, 0), (2, 2, 5, 0)], float)

    def draw(c, rng, place):
        m = len(place)
        four = rng.uniform(-10, 10, (m, 4)) if c < 0 else rng.normal(size=(m, 4)) * scales[c] * (1.0, 0.8, 1.2, 0.9) + centers[c]
        return np.column_stack([four, rng.normal(size=(m, 12))])

    return Family([*_dealt(signal, weights, seed), n - signal], draw)


#: How much wider than the other rows the box of a background is.
MARGIN = 2.5


def moons_or_rings(family: str, n: int, *, noise_fraction: float, seed: int = 42) -> Family:
    """Two half circles, or a ring within a ring, with Gaussian jitter and a uniform box."""
    signal = round(n * (1 - noise_fraction))
    if signal < 10:
        raise ValueError("the signal is too small")
    counts = [signal // 2, signal - signal // 2]

    def draw(c, rng, place):
        if family == "moons":
            t = np.pi * place / max(1, counts[c] - 1)
            x = np.column_stack([np.cos(t), np.sin(t)]) if c == 0 else np.column_stack([1 - np.cos(t), 0.5 - np.sin(t)])
            return x + rng.normal(0, 0.08, x.shape)
        t = 2 * np.pi * place / counts[c]
        return (0.35 if c else 1.0) * np.column_stack([np.cos(t), np.sin(t)]) + rng.normal(0, 0.04, (len(place), 2))

    return Family([*counts, n - signal], draw, margin=MARGIN)


def gaussians(family: str, n: int, *, dimension: int, noise_fraction: float, seed: int = 42) -> Family:
    """Six overlapping or eight imbalanced Gaussians of random scales."""
    overlap = family == "gaussian_overlap"
    k = 6 if overlap else 8
    signal = round(n * (1 - noise_fraction))
    if signal < 20 * k:
        raise ValueError("every cluster needs 20 rows")
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 4, (k, dimension)) * (0.55 if overlap else 1)
    scales = rng.uniform(0.35, 1.1, (k, dimension)) * (1.45 if overlap else 1)
    weights = np.ones(k) if overlap else np.geomspace(1, 10, k)
    draw = lambda c, r, place: r.normal(size=(len(place), dimension)) * scales[c] + centers[c]
    return Family([*_dealt(signal, weights, seed), n - signal], draw, margin=MARGIN)


def contamination(n: int, *, signal_size: int, noise_fraction: float, background_intensity: float = 12.0, background_strip_height: float = 10.0, background_inner_edge: float = 6.0, dimension: int = 2, seed: int = 42) -> Family:
    """Three fixed targets; more noise lengthens two remote strips of constant density."""
    if dimension != 2 or signal_size < 120:
        raise ValueError("two dimensions and 40 rows a target are needed")
    if not 0 < noise_fraction < 1:
        raise ValueError("noise_fraction must lie in (0, 1)")
    if n != signal_size + round(signal_size * noise_fraction / (1 - noise_fraction)):
        raise ValueError("n must follow from signal_size and noise_fraction")
    if not all(math.isfinite(v) and v > 0 for v in (background_intensity, background_strip_height)) or not background_inner_edge >= 5:
        raise ValueError("the background's intensity, height and inner edge are out of range")
    centers = np.array([(-3.0, -2.0), (3.0, -2.0), (0.0, 3.0)])
    root = np.linalg.cholesky(np.array([(0.35, 0.08), (0.08, 0.22)]))

    def draw(c, rng, place):
        if c >= 0:
            return rng.normal(size=(len(place), 2)) @ root.T + centers[c]
        # by its place alone, so a larger background begins with the smaller one
        own = np.array([np.random.default_rng([seed, 7, int(j)]).random(2) for j in place]).reshape(-1, 2)
        side = np.where(place % 2 == 0, 1.0, -1.0)
        x = side * (background_inner_edge + (place // 2 + own[:, 0]) / (background_intensity * background_strip_height))
        return np.column_stack([x, (own[:, 1] - 0.5) * background_strip_height])

    return Family([*_equal(signal_size, 3), n - signal_size], draw, {"signal_size": signal_size, "background_size": n - signal_size, "background_support_area": (n - signal_size) / background_intensity})


def family_of(spec: dict, n: int, seed: int) -> Family:
    """The family that a benchmark case names."""
    name, given = spec["family"], {k: v for k, v in spec.items() if k not in ("family", "id", "tier", "sizes", "seeds")}
    pick = lambda *keys: {k: given[k] for k in keys if k in given}
    if name == "density_contrast":
        return density_contrast(n, seed=seed, **pick("dimension", "density_ratio", "shape", "noise_fraction", "n_clusters"))
    if name == "multidensity":
        return multidensity_2d(n, seed=seed)
    if name == "ultrasparse":
        return ultrasparse_16d(n, seed=seed)
    if name == "overlapping_density":
        return overlapping_density_16d(n, seed=seed, **pick("signal_fraction"))
    if name in ("moons", "rings"):
        return moons_or_rings(name, n, seed=seed, **pick("noise_fraction"))
    if name in ("gaussian_overlap", "gaussian_imbalanced"):
        return gaussians(name, n, seed=seed, **pick("dimension", "noise_fraction"))
    if name == "global_contamination_invariance":
        return contamination(n, seed=seed, **pick("signal_size", "noise_fraction", "background_intensity", "background_strip_height", "background_inner_edge", "dimension"))
    raise ValueError(f"unknown family {name!r}")
