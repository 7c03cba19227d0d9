"""Density strata: Gamma mixtures over shell volumes, fitted by EM and chosen by an information criterion.

Rates follow ln rate(component, shell) = mu + slope * ln rank. One EM pass needs a row's shells and the
parameters only, so responsibilities are never stored: a pass broadcasts the parameters and sums
partial statistics. Rows up to a checked size are held on the driver, where a pass costs milliseconds;
more rows stay in Spark, one job a pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..runtime import materialize, ship
from . import density
from .components import with_position

#: Rows whose shells the driver holds at most.
LOCAL_ROWS = 4_000_000
#: Slopes that a profile may have, and how often the interval is halved.
SLOPES = (-20.0, 20.0)
HALVINGS = 60
BACKGROUNDS = ("gamma_components", "gamma_rate_mixture", "lognormal_rate_mixture", "inverse_gamma_rate_mixture")
ROLES = ("largest_rate_gap", "rate_changepoint_mdl", "background_scan_mdl", "validated_rate_prefix", "topology_mdl")


@dataclass(frozen=True)
class MixtureConfig:
    """Search limits and numerical settings of stratification."""

    ranks: tuple[int, ...] = density.RANKS
    min_components: int = 1
    max_components: int = 8
    hard_max_components: int = 24
    adaptive_components: bool = True
    expansion_step: int = 4
    boundary_margin: int = 1
    criterion: str = "icl"
    entropy_scope: str = "semantic"
    background_distribution: str = "gamma_components"
    split_warm_start: bool = True
    component_roles: str = "largest_rate_gap"
    role_rank: int = 4
    n_init: int = 1
    max_iter: int = 300
    tolerance: float = 1e-4
    confirm_ambiguous_model: bool = True
    confirmation_min_components: int = 12
    confirmation_n_init: int = 2
    confirmation_tolerance: float = 1e-5
    confirmation_min_duplicate_profiles: int = 3
    confirmation_profile_tolerance: float = 1e-8
    min_rate: float = 1e-14
    max_rate: float = 1e14
    min_background_shape: float = 1e-3
    max_background_shape: float = 1e6
    min_background_scale: float = 1e-3
    max_background_scale: float = 3.0
    max_background_abs_slope: float = 4.0
    background_quadrature_order: int = 24
    background_m_step_max_iter: int = 40
    random_state: int = 42

    def __post_init__(self):
        checks = (
            (len(self.ranks) >= 1 and self.ranks[0] >= 1 and all(b > a for a, b in zip(self.ranks, self.ranks[1:])), "ranks must ascend from 1 or more"),
            (1 <= self.min_components <= self.max_components <= self.hard_max_components, "component limits must ascend"),
            (self.expansion_step >= 1, "expansion_step must be positive"),
            (self.boundary_margin >= 0, "boundary_margin must not be negative"),
            (self.criterion in ("bic", "aicc", "icl"), "unknown criterion"),
            (self.entropy_scope in ("semantic", "basis"), "unknown entropy_scope"),
            (self.background_distribution in BACKGROUNDS, "unknown background_distribution"),
            (self.component_roles in ROLES, "unknown component_roles"),
            (self.role_rank >= 1, "role_rank must be positive"),
            (self.n_init >= 1 and self.confirmation_n_init >= 1, "starts must be positive"),
            (self.max_iter >= 1 and self.background_m_step_max_iter >= 1, "iteration limits must be positive"),
            (self.tolerance > 0 and self.confirmation_tolerance > 0, "tolerances must be positive"),
            (self.confirmation_min_components >= 1 and self.confirmation_min_duplicate_profiles >= 1, "confirmation limits must be positive"),
            (self.confirmation_profile_tolerance >= 0, "confirmation_profile_tolerance must not be negative"),
            (0 < self.min_rate < self.max_rate, "rate bounds must ascend"),
            (0 < self.min_background_shape < self.max_background_shape and 0 < self.min_background_scale < self.max_background_scale, "background bounds must ascend"),
            (self.max_background_abs_slope > 0 and self.background_quadrature_order >= 2, "background slope and quadrature must be positive"),
        )
        for ok, message in checks:
            if not ok:
                raise ValueError(message)


@dataclass
class Parameters:
    """Weights, mu and slopes of components, densest first; rates follow from them."""

    weights: np.ndarray
    mu: np.ndarray
    slopes: np.ndarray
    rates: np.ndarray

    def sorted(self) -> Parameters:
        order = np.argsort(self.rates[:, 0], kind="stable")[::-1]
        return Parameters(self.weights[order], self.mu[order], self.slopes[order], self.rates[order])


@dataclass
class Fit:
    parameters: Parameters
    log_likelihood: float
    iterations: int
    converged: bool


def responsibilities(shells: np.ndarray, data_term: np.ndarray, p: Parameters, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows by components, log likelihood of each row)."""
    z = data_term[:, None] + np.log(np.maximum(p.weights, special.TINY)) + np.log(p.rates) @ shapes - shells @ p.rates.T
    top = z.max(1, keepdims=True)
    r = np.exp(z - top)
    total = r.sum(1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def profiles(weighted: np.ndarray, effective: np.ndarray, shapes: np.ndarray, ranks: tuple[int, ...], config: MixtureConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """M step: slopes, mu and rates of ln rate = mu + slope * ln rank.

    The likelihood in a component's slope is stationary where ln rank, averaged with weights w * rank **
    slope, is what it is when averaged with the shapes. That average rises with the slope, so the slope is
    found by halving SLOPES, for all components at once; mu then follows in closed form.
    """
    place = np.log(np.asarray(ranks, float))
    log_w = np.log(np.maximum(weighted, special.TINY))
    excess = place - shapes @ place / shapes.sum()
    ends = np.tile(np.asarray(SLOPES), (len(log_w), 1))
    for _ in range(HALVINGS):
        middle = ends.mean(1)
        tilted = log_w + middle[:, None] * place
        pull = np.exp(tilted - tilted.max(1, keepdims=True)) @ excess
        ends[np.arange(len(ends)), (pull > 0).astype(int)] = middle
    slope = ends.mean(1)
    tilted = log_w + slope[:, None] * place
    top = tilted.max(1)
    log_mass = top + np.log(np.exp(tilted - top[:, None]).sum(1))
    mu = np.log(np.maximum(effective * shapes.sum(), special.TINY)) - log_mass
    return mu, slope, np.clip(np.exp(mu[:, None] + slope[:, None] * place), config.min_rate, config.max_rate)


def _widest(spread: np.ndarray, n: np.ndarray, mean: np.ndarray) -> int:
    """The component of the largest spread, the first of equal ones; what rounding alone may give counts as none."""
    noise = n * (8 * np.finfo(float).eps * np.maximum(1, np.abs(mean))) ** 2
    return int(np.where(spread > noise, spread, 0.0).argmax())


@dataclass
class Statistics:
    effective: np.ndarray
    weighted: np.ndarray
    log_likelihood: float = 0.0
    entropy: dict = field(default_factory=dict)


class Shells:
    """The rows a mixture is fitted to: (id, shells, data_term)."""

    def __init__(self, frame: DataFrame, shapes: np.ndarray, config: MixtureConfig):
        self.frame, self.shapes, self.config = frame, shapes, config
        self.n = frame.count()
        self.local = self.n <= LOCAL_ROWS
        if self.local:
            table = frame.select("id", "shells", "data_term").toArrow().sort_by("id").combine_chunks()
            self.ids = table["id"].to_numpy()
            self.shells = table["shells"].combine_chunks().flatten().to_numpy().reshape(self.n, -1)
            self.data_term = table["data_term"].to_numpy()
            self.score = np.log(self.shells.sum(1))
            self.order = np.lexsort((self.ids, self.score))
        else:
            ship(frame.sparkSession)
            self.frame = materialize(frame.withColumn("score", F.log(F.aggregate("shells", F.lit(0.0), lambda s, x: s + x))), "shells")

    def _partial(self, make: Callable[[np.ndarray, np.ndarray, np.ndarray], dict], columns: str = "score", frame: DataFrame | None = None) -> dict:
        """Sums over rows, or those of frame, of what make gives of (shells, data_term, a column)."""
        if self.local:
            raise RuntimeError("for rows in Spark")
        import pickle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
                for k, v in make(x, batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)).items():
                    total[k] = total[k] + v if k in total else v
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)])], names=["sums"])

        out: dict = {}
        for row in (self.frame if frame is None else frame).select("shells", "data_term", columns).mapInArrow(run, "sums binary").collect():
            for k, v in pickle.loads(row[0]).items():
                out[k] = out[k] + v if k in out else v
        return out

    def statistics(self, p: Parameters) -> Statistics:
        """One E step."""
        return self.statistics_of([p])[0]

    def statistics_of(self, models: list[Parameters]) -> list[Statistics]:
        """An E step of several models, in one pass over the rows."""
        shapes = self.shapes

        def make(x, term, _):
            out = {}
            for i, p in enumerate(models):
                r, ll = responsibilities(x, term, p, shapes)
                out |= {(i, "effective"): r.sum(0), (i, "weighted"): r.T @ x, (i, "ll"): float(ll.sum())}
            return out

        s = make(self.shells, self.data_term, None) if self.local else self._partial(make)
        return [Statistics(s[i, "effective"], s[i, "weighted"], s[i, "ll"]) for i in range(len(models))]

    def entropy(self, p: Parameters, merge: np.ndarray | None) -> float:
        """Of responsibilities; merge: components that count as one background."""
        shapes = self.shapes

        def make(x, term, _):
            r, _ = responsibilities(x, term, p, shapes)
            if merge is not None:
                r = np.column_stack([r[:, ~merge], r[:, merge].sum(1)])
            return {"e": -float((r * np.log(np.maximum(r, special.TINY))).sum())}

        return (make(self.shells, self.data_term, None) if self.local else self._partial(make))["e"]

    def cold(self, components: int, restart: int) -> Statistics:
        """Equal parts by total volume, or for later restarts along a random direction."""
        rng = np.random.default_rng(self.config.random_state + restart)
        if self.local:
            if restart:
                x = np.log(np.maximum(self.shells, special.TINY))
                x = (x - x.mean(0)) / np.maximum(x.std(0), 1e-8)
                order = np.lexsort((self.ids, x @ rng.normal(size=x.shape[1])))
            else:
                order = self.order
            label = np.empty(self.n, int)
            label[order] = np.minimum(components - 1, np.arange(self.n) * components // self.n)
            return Statistics(np.bincount(label, minlength=components).astype(float), np.stack([np.bincount(label, weights=c, minlength=components) for c in self.shells.T], axis=1))
        ordered = self.frame
        if restart:
            d = rng.normal(size=len(self.shapes))
            logs = [F.log(F.col("shells")[i]) for i in range(len(d))]
            moments = ordered.agg(*[f(c) for c in logs for f in (F.avg, F.stddev_pop)]).first()
            value = F.lit(0.0)
            for i, c in enumerate(logs):
                value = value + float(d[i]) * (c - moments[2 * i]) / max(moments[2 * i + 1], 1e-8)
            ordered = ordered.withColumn("score", value)
        placed = with_position(ordered.select("id", "shells", "score"), "score", "id")
        label = F.least(F.lit(components - 1), F.floor(F.col("pos") * components / F.lit(self.n)))
        rows = placed.groupBy(label.alias("c")).agg(F.count("*"), *[F.sum(F.col("shells")[i]) for i in range(len(self.shapes))]).orderBy("c").collect()
        return Statistics(np.array([r[1] for r in rows], float), np.array([list(r)[2:] for r in rows]))

    def split(self, p: Parameters) -> Statistics:
        """The component of the largest weighted variance of score, cut at its weighted median."""
        shapes = self.shapes
        if self.local:
            r, _ = responsibilities(self.shells, self.data_term, p, shapes)
            n = r.sum(0)
            mean = self.score @ r / np.maximum(n, special.TINY)
            spread = np.array([(r[:, k] * (self.score - mean[k]) ** 2).sum() for k in range(r.shape[1])])
            k = _widest(spread, n, mean)
            running = np.cumsum(r[self.order, k])
            at = min(int(np.searchsorted(running, n[k] / 2)), self.n - 1)
            left = np.where(self.score <= self.score[self.order[at]], r[:, k], 0.0)
            if min(left.sum(), (r[:, k] - left).sum()) <= np.finfo(float).eps:
                left = np.where(np.arange(self.n) % 2 == 0, r[:, k], 0.0)
            grown = np.column_stack([r, r[:, k] - left])
            grown[:, k] = left
            return Statistics(grown.sum(0), grown.T @ self.shells)

        def moments(x, term, score):
            r, _ = responsibilities(x, term, p, shapes)
            return {"n": r.sum(0), "s": score @ r, "w": r.T @ x}

        m = self._partial(moments)
        mean = m["s"] / np.maximum(m["n"], special.TINY)

        def around(x, term, score):  # squares about the mean don't cancel
            r, _ = responsibilities(x, term, p, shapes)
            return {"q": (r * (score[:, None] - mean) ** 2).sum(0)}

        k = _widest(self._partial(around)["q"], m["n"], mean)
        cut = self._weighted_median(p, k, m["n"][k])

        def halves(x, term, score):
            r, _ = responsibilities(x, term, p, shapes)
            left = np.where(score <= cut, r[:, k], 0.0)
            return {"n": np.array([left.sum()]), "w": left @ x}

        part = self._partial(halves)
        if min(part["n"][0], m["n"][k] - part["n"][0]) <= np.finfo(float).eps:  # one score has all the weight

            def alternate(x, term, pos):
                r, _ = responsibilities(x, term, p, shapes)
                left = np.where(pos % 2 == 0, r[:, k], 0.0)
                return {"n": np.array([left.sum()]), "w": left @ x}

            part = self._partial(alternate, "pos", with_position(self.frame, "id"))
        effective, weighted = np.append(m["n"], m["n"][k] - part["n"][0]), np.vstack([m["w"], m["w"][k] - part["w"]])
        effective[k], weighted[k] = part["n"][0], part["w"]
        return Statistics(effective, weighted)

    def _weighted_median(self, p: Parameters, k: int, total: float) -> float:
        """The least score up to which rows have half the weight of component k: bins within bins, until one holds a single number."""
        shapes = self.shapes
        least, most = self.frame.agg(F.min("score"), F.max("score")).first()
        low, high, below = least, float(np.nextafter(most, np.inf)), 0.0
        while np.nextafter(low, np.inf) < high:
            edges = np.unique(np.linspace(low, high, 4097))

            def bins(x, term, score, edges=edges):
                r, _ = responsibilities(x, term, p, shapes)
                return {"h": np.bincount(np.searchsorted(edges, score, "right") - 1, weights=r[:, k], minlength=len(edges) - 1)}

            h = self._partial(bins, frame=self.frame.where((F.col("score") >= float(low)) & (F.col("score") < float(high)))).get("h", np.zeros(len(edges) - 1))
            # sums are rounded, so the last bin with weight may stay a little under the half
            last = int(np.flatnonzero(h)[-1]) if h.any() else 0
            at = min(int(np.searchsorted(below + np.cumsum(h), total / 2)), last)
            below += float(h[:at].sum())
            low, high = float(edges[at]), float(edges[at + 1])
        return low

    def assignment(self, p: Parameters, groups: np.ndarray, background: np.ndarray) -> DataFrame:
        """id, group and p_background of each row; groups: of each component."""
        shapes = self.shapes
        spark = self.frame.sparkSession
        if self.local:
            r, _ = responsibilities(self.shells, self.data_term, p, shapes)
            table = pa.table({"id": pa.array(self.ids, pa.int64()), "group": pa.array(groups[r.argmax(1)].astype(np.int32)), "p_background": r[:, background].sum(1)})
            return spark.createDataFrame(table)
        ship(spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
                r, _ = responsibilities(x, batch.column(2).to_numpy(), p, shapes)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(groups[r.argmax(1)].astype(np.int32)), pa.array(r[:, background].sum(1))], names=["id", "group", "p_background"])

        return self.frame.select("id", "shells", "data_term").mapInArrow(run, "id long, group int, p_background double")


def m_step(s: Statistics, n: int, shapes: np.ndarray, config: MixtureConfig) -> Parameters:
    effective = np.maximum(s.effective, special.TINY)
    mu, slopes, rates = profiles(s.weighted, effective, shapes, config.ranks, config)
    return Parameters(effective / n, mu, slopes, rates)


def em(rows: Shells, starts: list[Statistics], config: MixtureConfig) -> list[Fit]:
    """EM from each of some first statistics, until the log likelihood moves by less than tolerance of itself. A round of all that aren't done is one pass over the rows."""
    stats, before, fits = dict(enumerate(starts)), dict.fromkeys(range(len(starts)), -math.inf), {}
    for i in range(1, config.max_iter + 1):
        models = {j: m_step(s, rows.n, rows.shapes, config) for j, s in stats.items()}
        stats = dict(zip(models, rows.statistics_of(list(models.values()))))
        for j, s in list(stats.items()):
            done = math.isfinite(before[j]) and abs(s.log_likelihood - before[j]) <= config.tolerance * (1 + abs(before[j]))
            before[j] = s.log_likelihood
            if done or i == config.max_iter:
                fits[j] = Fit(models[j].sorted(), s.log_likelihood, i, done)
                del stats[j]
        if not stats:
            break
    return [fits[j] for j in sorted(fits)]


def fit_components(rows: Shells, components: int, config: MixtureConfig, previous: Fit | None = None) -> Fit:
    """The best of n_init starts; a split of the previous size's fit counts as one."""
    starts = []
    if config.split_warm_start and previous is not None and len(previous.parameters.mu) + 1 == components:
        starts.append(rows.split(previous.parameters))
    starts += [rows.cold(components, r) for r in range(config.n_init - len(starts))]
    return max(em(rows, starts, config), key=lambda f: f.log_likelihood)


def largest_rate_gap(p: Parameters, least: float) -> np.ndarray:
    """Components before the widest gap of ln rate; none of a single one."""
    if len(p.mu) == 1:
        return np.empty(0, int)
    logs = np.log(np.maximum(p.rates[:, 0], least))
    return np.arange(int((logs[:-1] - logs[1:]).argmax()) + 1)


def rate_changepoint(p: Parameters, n: int, total_shape: float) -> tuple[np.ndarray, np.ndarray]:
    """Components before the boundary whose gap best repays its code, if any does; and the evidence of each boundary."""
    k = len(p.mu)
    if k <= 1:
        return np.empty(0, int), np.zeros(k)
    effective = np.maximum(n * p.weights, 1.0)
    logs = np.log(np.maximum(p.rates[:, 0], special.TINY))
    variance = (1 / effective[:-1] + 1 / effective[1:]) / total_shape
    evidence = 0.5 * (logs[:-1] - logs[1:]) ** 2 / np.maximum(variance, special.TINY) - 0.5 * math.log(n) - math.log(k - 1)
    best = int(evidence.argmax())
    return (np.arange(best + 1) if evidence[best] > 0 else np.empty(0, int)), evidence


def needs_expansion(selected: int, cap: int, hard: int, margin: int) -> bool:
    return cap < hard and selected >= cap - margin


def duplicate_profiles(p: Parameters, components: np.ndarray, tolerance: float) -> int:
    """Most signal components that share nearly one (mu, slope)."""
    if not len(components):
        return 0
    x = np.column_stack([p.mu, p.slopes])[components]
    return int((np.abs(x[:, None] - x[None]).max(2) <= tolerance).sum(1).max())


@dataclass
class Stratification:
    """strata: id, group (0 densest, the last the background), p_background."""

    strata: DataFrame
    signal_groups: int
    fit: Fit
    diagnostics: dict

    @property
    def background_group(self) -> int:
        return self.signal_groups


def stratify(graph: DataFrame, *, dimension: float, config: MixtureConfig | None = None, roles: Callable | None = None) -> Stratification:
    """Chooses the number of components, tells signal from background, and assigns every row.

    roles: from (Shells, Fit) to the signal components, for the roles that look at the graph.
    """
    config = config or MixtureConfig()
    if dimension <= 0:
        raise ValueError("dimension must be positive")
    frame, shapes = density.shell_volumes(graph, config.ranks, dimension)
    if config.background_distribution != "gamma_components":
        from .background import stratify_with_background

        return stratify_with_background(frame, shapes, config)
    rows = Shells(frame, shapes, config)
    return _search(rows, config, roles)


def _search(rows: Shells, config: MixtureConfig, roles: Callable | None) -> Stratification:
    total = float(rows.shapes.sum())
    found: list[tuple[int, Fit, np.ndarray, float]] = []
    cap, start, previous = config.max_components, config.min_components, None
    while True:
        for k in range(start, cap + 1):
            fit = fit_components(rows, k, config, previous)
            if roles is not None:
                signal = np.asarray(roles(rows, fit), int)
            elif config.component_roles == "rate_changepoint_mdl":
                signal, _ = rate_changepoint(fit.parameters, rows.n, total)
            else:
                signal = largest_rate_gap(fit.parameters, config.min_rate)
            merge = np.ones(k, bool)
            merge[signal] = False
            e = rows.entropy(fit.parameters, merge if config.entropy_scope == "semantic" else None) if config.criterion == "icl" else 0.0
            found.append((k, fit, signal, special.information_score(fit.log_likelihood, e, 3 * k - 1, rows.n, config.criterion)))
            previous = fit
        best = min(found, key=lambda f: f[3])
        if not config.adaptive_components or not needs_expansion(best[0], cap, config.hard_max_components, config.boundary_margin):
            break
        start, cap = cap + 1, min(config.hard_max_components, cap + config.expansion_step)
    k, fit, signal, score = best
    if config.confirm_ambiguous_model and k >= config.confirmation_min_components:
        again = None
        if duplicate_profiles(fit.parameters, signal, config.confirmation_profile_tolerance) >= config.confirmation_min_duplicate_profiles:
            low, high = max(config.min_components, k - 1), min(config.hard_max_components, k + 1)
            again = replace(config, min_components=low, max_components=high, hard_max_components=high, adaptive_components=False, n_init=1)
            reason = "duplicate_signal_profiles"
        elif k < found[-1][0] - config.boundary_margin and (len(signal) <= 1 or k >= config.hard_max_components - 2):
            again = replace(config, n_init=config.confirmation_n_init if len(signal) <= 1 else 1)
            reason = "single_signal_high_order_interior" if len(signal) <= 1 else "near_hard_bound_interior"
        if again is not None:
            out = _search(rows, replace(again, split_warm_start=False, tolerance=config.confirmation_tolerance, confirm_ambiguous_model=False), roles)
            out.diagnostics |= {"confirmed": reason, "initial_components": k}
            return out
    groups = np.full(k, len(signal), int)
    groups[signal] = np.arange(len(signal))
    background = groups == len(signal)
    diagnostics = {
        "components": k, "grid": [f[0] for f in found], "scores": [f[3] for f in found], "score": score, "iterations": fit.iterations, "converged": fit.converged,
        "bic": special.information_score(fit.log_likelihood, 0.0, 3 * k - 1, rows.n, "bic"), "rates": fit.parameters.rates[:, 0].tolist(), "background_fraction": float(fit.parameters.weights[background].sum()),
    }
    return Stratification(rows.assignment(fit.parameters, groups, background), len(signal), fit, diagnostics)
