"""Density profiles of neighbourhoods as column expressions over a graph (id, nbr, dist)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from .components import quantile

RANKS = (4, 8, 16, 32)
_TINY32 = float(np.finfo(np.float32).tiny)


def check_ranks(ranks: Sequence[int], k: int, least: int = 2) -> None:
    if len(ranks) < least:
        raise ValueError("at least two ranks are required" if least == 2 else "at least one rank is required")
    if ranks[0] < 1 or ranks[-1] > k or any(b <= a for a, b in zip(ranks, ranks[1:], strict=False)):
        raise ValueError("ranks must ascend strictly within the graph")


def _log_distance(rank: int, least: float) -> Column:
    return F.log(F.greatest(F.get("dist", F.lit(rank - 1)).cast("double"), F.lit(least)))


def log_distances(graph: DataFrame, ranks: Sequence[int] = RANKS) -> DataFrame:
    """id and the logs of the distances at ranks."""
    return graph.select("id", F.array(*[_log_distance(r, _TINY32).cast("float") for r in ranks]).alias("signature"))


def multiscale_signatures(graph: DataFrame, ranks: Sequence[int] = RANKS) -> DataFrame:
    """id and [ln d at the first rank, and what it exceeds each other ln d by]."""
    first = _log_distance(ranks[0], _TINY32)
    return graph.select("id", F.array(first.cast("float"), *[(first - _log_distance(r, _TINY32)).cast("float") for r in ranks[1:]]).alias("signature"))


def shell_volumes(graph: DataFrame, ranks: Sequence[int] = RANKS, dimension: float = 1.0) -> tuple[DataFrame, np.ndarray]:
    """(id, shells, data_term) and the shapes: increments of volume between ranks, which are Gamma in a Poisson process.

    Volumes are centred on the median of the first rank, their exponents cut at 60. data_term: the part
    of a row's log density that no component changes.
    """
    shapes = np.diff(np.concatenate([[0], ranks])).astype(float)
    center = quantile(graph, _log_distance(ranks[0], special.TINY), 0.5) or 0.0
    volume = [F.exp(F.greatest(F.least(F.lit(float(dimension)) * (_log_distance(r, special.TINY) - float(center)), F.lit(60.0)), F.lit(-60.0))) for r in ranks]
    shells = F.array(*[F.greatest(b - a, F.lit(special.TINY)) for a, b in zip([F.lit(0.0), *volume], volume, strict=False)])
    constant = -sum(float(special.math.lgamma(a)) for a in shapes)
    term = F.lit(constant)
    for i, a in enumerate(shapes):
        term = term + (float(a) - 1.0) * F.log(F.col("shells")[i])
    return graph.select("id", shells.alias("shells")).withColumn("data_term", term), shapes


def signal_log_odds(p_background: Column) -> Column:
    eps = float(np.finfo(np.float64).eps)
    p = F.greatest(F.least(p_background, F.lit(1.0 - eps)), F.lit(eps))
    return F.log1p(-p) - F.log(p)


def intrinsic_dimension(graph: DataFrame) -> float:
    """Median over rows of the nearest-neighbour maximum-likelihood dimension; 1 without usable rows."""
    logs = F.expr(f"aggregate(slice(dist, 1, size(dist) - 1), 0D, (s, d) -> s + ln(greatest(cast(element_at(dist, -1) AS double), {special.TINY!r}) / greatest(cast(d AS double), {special.TINY!r})))")
    local = (F.size("dist") - 1.0) / F.greatest(logs, F.lit(special.TINY))
    found = quantile(graph.select(local.alias("m")).where((F.col("m") > 0) & (F.col("m") < float("inf"))), "m", 0.5)
    return found if found is not None else 1.0


def boundary_log_terms(graph: DataFrame, dimension: float, rank: int, k: int) -> DataFrame:
    """id and -ln of the null probability that a row's inner volume is so small a part of its outer one."""
    inner, outer = F.get("dist", F.lit(rank - 1)).cast("double"), F.greatest(F.element_at("dist", -1).cast("double"), F.lit(special.TINY))
    v = F.pow(F.greatest(F.least(inner / outer, F.lit(1.0)), F.lit(0.0)), F.lit(float(dimension)))
    p = special.binomial_tail(v, rank, k - 1)
    return graph.select("id", (-F.log(F.greatest(p, F.lit(special.TINY)))).alias("term"))


def unit_vectors(features: Column) -> Column:
    """Rows scaled to length 1; null vectors stay."""
    norm = F.sqrt(F.aggregate(features, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > float(np.finfo(np.float64).eps), F.transform(features, lambda x: x / norm)).otherwise(F.transform(features, lambda x: x.cast("double")))


def angle(chord: Column) -> Column:
    """Angle of a chord between unit vectors."""
    return 2 * F.asin(F.greatest(F.least(chord / 2, F.lit(1.0)), F.lit(0.0)))
