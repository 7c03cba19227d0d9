"""Strata with one background of continuous rate.

A background row's shells are Gamma with rate lambda * rank^slope, and its lambda is drawn from a Gamma,
lognormal or inverse Gamma law; integrating it out gives one heavy-tailed component for a continuum of
intensities. Signal components are those of mixture.py.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from ..functions import special
from . import mixture
from .components import quantile
from .mixture import MixtureConfig, Parameters, Shells


@dataclass
class Background:
    """kind: of mixture.BACKGROUNDS; theta: (log shape, log rate, slope), of the lognormal (mean, log deviation, slope)."""

    kind: str
    theta: np.ndarray
    order: int = 24

    def log_density(self, x: np.ndarray, data_term: np.ndarray, shapes: np.ndarray, logs: np.ndarray) -> np.ndarray:
        a, b, slope = self.theta
        total = shapes.sum()
        exposure = np.maximum(x @ np.exp(np.clip(slope * logs, -50, 50)), special.TINY)
        out = data_term + slope * float(shapes @ logs)
        if self.kind == "gamma_rate_mixture":
            shape, rate = math.exp(a), math.exp(b)
            return out + shape * b - math.lgamma(shape) + math.lgamma(shape + total) - (shape + total) * np.log(rate + exposure)
        if self.kind == "lognormal_rate_mixture":
            nodes, weights = special.gauss_hermite(self.order)
            rates = a + math.sqrt(2) * math.exp(b) * nodes
            z = total * rates - exposure[:, None] * np.exp(np.minimum(rates, 700)) + np.log(weights) - 0.5 * math.log(math.pi)
            top = z.max(1, keepdims=True)
            return out + top[:, 0] + np.log(np.exp(z - top).sum(1))
        shape, scale = math.exp(a), math.exp(b)
        kernel = special.log_bessel_k(np.full(len(exposure), total - shape), 2 * np.sqrt(scale * exposure))
        return out + shape * b - math.lgamma(shape) + math.log(2) + 0.5 * (total - shape) * (b - np.log(exposure)) + kernel

    def bounds(self, config: MixtureConfig) -> list[tuple[float, float]]:
        slope = (-config.max_background_abs_slope, config.max_background_abs_slope)
        if self.kind == "lognormal_rate_mixture":
            return [(math.log(config.min_rate), math.log(config.max_rate)), (math.log(config.min_background_scale), math.log(config.max_background_scale)), slope]
        shape = (math.log(config.min_background_shape), math.log(config.max_background_shape))
        return [shape, (math.log(config.min_background_shape / config.max_rate), math.log(config.max_background_shape / config.min_rate)), slope]

    def at_bound(self, config: MixtureConfig, margin: float = 1e-6) -> list[str]:
        """Parameters that the fit has pushed to a limit."""
        names = ("location", "scale", "slope") if self.kind == "lognormal_rate_mixture" else ("shape", "rate", "slope")
        return [n for n, v, (low, high) in zip(names, self.theta, self.bounds(config), strict=True) if min(v - low, high - v) <= margin * max(1.0, high - low)]


def first_background(kind: str, weight: float, mean: float, square: float, config: MixtureConfig) -> Background:
    """By moments of the local rate: sums of weights, of weighted rates and of their squares."""
    mean = mean / max(weight, special.TINY)
    variance = max(square / max(weight, special.TINY) - mean * mean, 0.0)
    if kind == "lognormal_rate_mixture":
        sd = math.sqrt(math.log1p(variance / max(mean * mean, special.TINY)))
        theta = [math.log(max(mean, config.min_rate)) - sd * sd / 2, math.log(min(max(sd, config.min_background_scale), config.max_background_scale)), 0.0]
    else:
        shape = mean * mean / max(variance, mean * mean / config.max_background_shape)
        shape = min(max(shape if kind == "gamma_rate_mixture" else shape + 2, config.min_background_shape), config.max_background_shape)
        rate = shape / max(mean, config.min_rate) if kind == "gamma_rate_mixture" else max(shape - 1, config.min_background_shape) * max(mean, config.min_rate)
        theta = [math.log(shape), math.log(rate), 0.0]
    out = Background(kind, np.array(theta), config.background_quadrature_order)
    out.theta = np.clip(out.theta, *np.array(out.bounds(config)).T)
    return out


@dataclass
class HeterogeneousFit:
    signal: Parameters | None
    weight: float
    background: Background
    log_likelihood: float
    iterations: int
    converged: bool


def _probabilities(x, term, signal: Parameters | None, weight: float, background: Background, shapes, logs):
    """(rows by signal components and the background, log likelihoods)."""
    columns = [math.log(max(weight, special.TINY)) + background.log_density(x, term, shapes, logs)]
    if signal is not None:
        z = term[:, None] + np.log(np.maximum(signal.weights, special.TINY)) + np.log(signal.rates) @ shapes - x @ signal.rates.T
        columns = [*z.T, columns[0]]
    z = np.stack(columns, axis=1)
    top = z.max(1, keepdims=True)
    r = np.exp(z - top)
    total = r.sum(1, keepdims=True)
    return r / total, (top + np.log(total))[:, 0]


def _minimize(value, theta: np.ndarray, bounds, steps: int) -> np.ndarray:
    """Projected BFGS with central differences; value takes a list of points, so that one pass serves a gradient."""
    low, high = np.array(bounds).T
    h = np.eye(len(theta))
    f = value([theta])[0]
    eps = 1e-4

    def slope(at):
        shifts = [np.clip(at + s * eps * e, low, high) for e in np.eye(len(at)) for s in (1, -1)]
        v = value(shifts)
        return np.array([(v[2 * i] - v[2 * i + 1]) / max((shifts[2 * i] - shifts[2 * i + 1])[i], 1e-12) for i in range(len(at))])

    g = slope(theta)
    for _ in range(steps):
        move = -h @ g
        tries = [np.clip(theta + t * move, low, high) for t in (1.0, 0.3, 0.1, 0.02, 0.002)]
        values = value(tries)
        best = int(np.argmin(values))
        if not values[best] < f - 1e-10 * (1 + abs(f)):
            break
        s, theta, f = tries[best] - theta, tries[best], values[best]
        new = slope(theta)
        y, g = new - g, new
        if (sy := float(s @ y)) > 1e-12:
            v = np.eye(len(s)) - np.outer(s, y) / sy
            h = v @ h @ v.T + np.outer(s, s) / sy
    return theta


class _Model:
    """EM for one number of components over Shells on the driver or in Spark."""

    def __init__(self, rows: Shells, config: MixtureConfig):
        self.rows, self.config, self.logs = rows, config, np.log(np.asarray(config.ranks, float))

    def sums(self, make) -> dict:
        return make(self.rows.shells, self.rows.data_term, self.rows.score) if self.rows.local else self.rows._partial(make)

    def fit(self, assign, components: int) -> HeterogeneousFit:
        """assign: from (shells, data_term, score) to first responsibilities, the background last."""
        config, shapes, logs, kind = self.config, self.rows.shapes, self.logs, self.config.background_distribution
        total = shapes.sum()

        def moments(x, term, score):
            r = assign(x, term, score)
            rate = total / np.maximum(x.sum(1), special.TINY)
            return {"n": r.sum(0), "w": r[:, :-1].T @ x, "m": np.array([r[:, -1].sum(), r[:, -1] @ rate, r[:, -1] @ rate**2])}

        s = self.sums(moments)
        background, before, converged, i = first_background(kind, *s["m"], config), -math.inf, False, 0
        signal, ll = None, -math.inf
        for i in range(1, config.max_iter + 1):
            n = np.maximum(s["n"], special.TINY)
            if components > 1:
                mu, slopes, rates = mixture.profiles(s["w"], n[:-1], shapes, config.ranks, config)
                signal = Parameters(n[:-1] / self.rows.n, mu, slopes, rates)
            own = assign

            def value(points, own=own, background=background):
                def make(x, term, score):
                    r = own(x, term, score)[:, -1]
                    return {"v": np.array([-(r * Background(kind, p, background.order).log_density(x, np.zeros(len(x)), shapes, logs)).sum() for p in points])}

                return self.sums(make)["v"]

            steps = config.background_m_step_max_iter if i == 1 else min(5, config.background_m_step_max_iter)
            background = Background(kind, _minimize(value, background.theta, background.bounds(config), steps), background.order)
            state = (signal, float(n[-1] / self.rows.n), background)
            assign = lambda x, term, _, state=state: _probabilities(x, term, *state, shapes, logs)[0]

            def step(x, term, _, state=state):
                r, each = _probabilities(x, term, *state, shapes, logs)
                return {"n": r.sum(0), "w": r[:, :-1].T @ x, "ll": float(each.sum())}

            s = self.sums(step)
            ll = s["ll"]
            if math.isfinite(before) and abs(ll - before) <= config.tolerance * (1 + abs(before)):
                converged = True
                break
            before = ll
        order = np.argsort(signal.rates[:, 0], kind="stable")[::-1] if signal is not None else []
        if signal is not None:
            signal = Parameters(signal.weights[order], signal.mu[order], signal.slopes[order], signal.rates[order])
        return HeterogeneousFit(signal, state[1], background, ll, i, converged)

    def cold(self, components: int, restart: int):
        """The sparsest part is background; the others are equal parts by total volume."""
        share = (restart + 1) / (self.config.n_init + 1)
        cuts = [(1 - share) * j / (components - 1) for j in range(1, components)] if components > 1 else []
        edges = np.array(self.quantiles(cuts)) if cuts else np.empty(0)

        def assign(x, term, score):
            return np.eye(components)[np.searchsorted(edges, score, "left")]

        return assign

    def quantiles(self, at: list[float]) -> list[float]:
        if self.rows.local:
            return np.quantile(self.rows.score, at).tolist()
        return [quantile(self.rows.frame, "score", q) for q in at]

    def split(self, fit: HeterogeneousFit):
        """The component of the largest weighted variance of score, cut at its mean; the background stays one component, of its sparser half."""
        shapes, logs = self.rows.shapes, self.logs
        state = (fit.signal, fit.weight, fit.background)

        def moments(x, term, score):
            r, _ = _probabilities(x, term, *state, shapes, logs)
            return {"n": r.sum(0), "s": score @ r, "q": score**2 @ r}

        m = self.sums(moments)
        mean = m["s"] / np.maximum(m["n"], special.TINY)
        k = int((m["q"] - m["n"] * mean**2).argmax())
        cut = mean[k]

        def assign(x, term, score):
            r, _ = _probabilities(x, term, *state, shapes, logs)
            dense = np.where(score <= cut, r[:, k], 0.0)
            rest = r[:, k] - dense
            if k == r.shape[1] - 1:
                return np.column_stack([r[:, :-1], dense, rest])
            out = r[:, :-1].copy()
            out[:, k] = dense
            return np.column_stack([out, rest, r[:, -1]])

        return assign


def stratify_with_background(frame: DataFrame, shapes: np.ndarray, config: MixtureConfig) -> mixture.Stratification:
    """As mixture.stratify: all but the last component are signal; 3 parameters for the background and 3 for each other."""
    rows = Shells(frame, shapes, config)
    model = _Model(rows, config)
    found: list[tuple[int, HeterogeneousFit, float]] = []
    start, cap, previous = config.min_components, config.max_components, None
    while True:
        for k in range(start, cap + 1):
            starts = [model.split(previous)] if config.split_warm_start and previous is not None else []
            starts += [model.cold(k, r) for r in range(config.n_init - len(starts))]
            fit = max((model.fit(s, k) for s in starts), key=lambda f: f.log_likelihood)
            state = (fit.signal, fit.weight, fit.background)

            def entropy(x, term, _, state=state):
                r, _ = _probabilities(x, term, *state, shapes, model.logs)
                return {"e": -float((r * np.log(np.maximum(r, special.TINY))).sum())}

            e = model.sums(entropy)["e"] if config.criterion == "icl" else 0.0
            found.append((k, fit, special.information_score(fit.log_likelihood, e, 3 + 3 * (k - 1), rows.n, config.criterion)))
            previous = fit
        k, fit, score = min(found, key=lambda f: f[2])
        if not config.adaptive_components or not mixture.needs_expansion(k, cap, config.hard_max_components, config.boundary_margin):
            break
        start, cap = cap + 1, min(config.hard_max_components, cap + config.expansion_step)
    state = (fit.signal, fit.weight, fit.background)
    strata = _assign(rows, state, shapes, model.logs)
    diagnostics = {"components": k, "grid": [f[0] for f in found], "scores": [f[2] for f in found], "score": score, "background": fit.background.theta.tolist(), "at_bound": fit.background.at_bound(config), "background_fraction": fit.weight, "iterations": fit.iterations, "converged": fit.converged}
    parameters = fit.signal or Parameters(*(np.empty(0),) * 3, np.empty((0, len(shapes))))
    return mixture.Stratification(strata, k - 1, mixture.Fit(parameters, fit.log_likelihood, fit.iterations, fit.converged), diagnostics)


def _assign(rows: Shells, state, shapes, logs) -> DataFrame:
    import pyarrow as pa

    from ..runtime import ship

    def columns(x, term):
        r, _ = _probabilities(x, term, *state, shapes, logs)
        return pa.array(r.argmax(1).astype(np.int32)), pa.array(r[:, -1])

    spark = rows.frame.sparkSession
    if rows.local:
        group, p = columns(rows.shells, rows.data_term)
        return spark.createDataFrame(pa.table({"id": pa.array(rows.ids, pa.int64()), "group": group, "p_background": p}))
    ship(spark)

    def run(batches):
        for batch in batches:
            group, p = columns(batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1), batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), group, p], names=["id", "group", "p_background"])

    return rows.frame.select("id", "shells", "data_term").mapInArrow(run, "id long, group int, p_background double")
