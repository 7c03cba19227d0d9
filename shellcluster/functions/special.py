"""Special functions the engine needs: as Spark columns where rows need them, in numpy or plain Python on the driver."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = float(np.finfo(np.float64).tiny)


def lgamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series after a shift by 8; relative error about 1e-14."""
    shift = F.lit(1.0)
    for i in range(8):
        shift = shift * (x + i)
    y = x + 8.0
    r = 1.0 / (y * y)
    series = (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r * (1.0 / 1680 - r / 1188)))) / y
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(shift)


def topology_log_bayes_factor(size: Column, successes: Column, n_reference: Column | int, rank: int) -> Column:
    """Jeffreys beta-binomial against a binomial null of (size - 1) / (n - 1), over size * rank trials; null where there is no support for more edges than chance."""
    n = F.lit(n_reference) if isinstance(n_reference, int) else n_reference
    trials = (size * rank).cast("double")
    s = successes.cast("double")
    p0 = (size - 1.0) / (n - 1.0)
    f = trials - s
    alternative = lgamma(s + 0.5) + lgamma(f + 0.5) - lgamma(trials + 1.0) - math.log(math.pi)
    null = s * F.log(p0) + F.when(f > 0, f * F.log1p(-p0)).otherwise(0.0)
    valid = (size >= 2) & (successes >= 1) & (n >= 2) & (s <= trials) & (s / trials > p0)
    return F.when(valid, alternative - null)


def topology_log_bayes_factor_value(size: int, successes: int, n: int, rank: int) -> float:
    trials = size * rank
    if size < 2 or successes < 1 or n < 2 or successes > trials:
        return -math.inf
    p0 = (size - 1) / (n - 1)
    if successes / trials <= p0:
        return -math.inf
    f = trials - successes
    null = successes * math.log(p0) + (f * math.log1p(-p0) if f else 0.0)
    return math.lgamma(successes + 0.5) + math.lgamma(f + 0.5) - math.lgamma(trials + 1) - math.log(math.pi) - null


def component_gain(size: int, successes: int, unary: float, n: int, rank: int) -> float:
    """Unary gain and topology evidence less the code of a root."""
    factor = topology_log_bayes_factor_value(size, successes, n, rank)
    return unary + factor - math.log(n) if math.isfinite(factor) else -math.inf


def binomial_tail(v: Column, r: int, n: int) -> Column:
    """P(Binomial(n, v) >= r), which is the regularised incomplete beta of (r, n - r + 1) at v."""
    x = F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))
    terms = [float(math.comb(n, j)) * F.pow(x, F.lit(float(j))) * F.pow(1 - x, F.lit(float(n - j))) for j in range(r, n + 1)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.least(total, F.lit(1.0))


def log_gammainc(a: float, x: float) -> float:
    """ln of the regularised lower incomplete gamma, by series or continued fraction."""
    if x <= 0:
        return -math.inf
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        return a * math.log(x) - x - math.lgamma(a) + math.log(total)
    tiny, b = 1e-300, x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (tiny if abs(d) < tiny else d)
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    q = math.exp(min(0.0, a * math.log(x) - x - math.lgamma(a))) * h
    return math.log1p(-q) if q < 1 else -math.inf


def uniform_lower_tail_log_bayes_factor(count: int, total: float) -> float:
    """Evidence that `count` null probabilities with -sum of logs `total` crowd near zero: Beta(q, 1), q uniform, against uniform."""
    if count == 0:
        return -math.inf
    if total <= np.finfo(float).eps:
        return -math.log(count + 1.0)
    share = log_gammainc(count + 1.0, total)
    return total + math.lgamma(count + 1.0) + share - (count + 1.0) * math.log(total) if math.isfinite(share) else -math.inf


def information_score(log_likelihood: float, entropy: float, parameters: int, n: int, criterion: str) -> float:
    """bic, aicc or icl, in nats, lower is better."""
    deviance = -2.0 * log_likelihood
    if criterion == "bic":
        return deviance + parameters * math.log(n)
    if criterion == "aicc":
        room = n - parameters - 1
        return math.inf if room <= 0 else deviance + 2.0 * parameters + 2.0 * parameters * (parameters + 1) / room
    if criterion != "icl":
        raise ValueError(f"unknown criterion {criterion!r}")
    return deviance + parameters * math.log(n) + 2.0 * entropy


@lru_cache(maxsize=8)
def gauss_hermite(order: int) -> tuple[np.ndarray, np.ndarray]:
    return np.polynomial.hermite.hermgauss(order)


def log_bessel_k(order: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln K of real order and positive argument, from its integral over cosh, on a grid around the integrand's peak."""
    v, x = np.broadcast_arrays(np.abs(np.asarray(order, float)), np.maximum(np.asarray(x, float), 1e-300))
    # the integrand exp(-x cosh t) cosh(v t) peaks where x sinh t = v tanh(v t)
    peak = np.arcsinh(v / x)
    width = 1 / np.sqrt(np.maximum(np.sqrt(v * v + x * x), 1e-12))
    low, high = np.maximum(peak - 12 * width - 1, 0), peak + 12 * width + 1
    t = low[..., None] + (high - low)[..., None] * np.linspace(0, 1, 401)
    value = -x[..., None] * np.cosh(np.minimum(t, 700)) + v[..., None] * t + np.log1p(np.exp(-2 * v[..., None] * t)) - math.log(2)
    top = value.max(-1, keepdims=True)
    weight = np.ones(401)
    weight[1:-1:2], weight[2:-1:2] = 4, 2
    area = (np.exp(value - top) * weight).sum(-1) * (high - low) / 1200
    return top[..., 0] + np.log(area)


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least cost of the smaller side, in cubic time; (row, column) pairs by row."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in hungarian(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, via, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[owner[j0] - 1, free - 1] - u[owner[j0]] - v[free]
            better = reduced < least[free]
            least[free[better]], via[free[better]] = reduced[better], j0
            j1 = free[least[free].argmin()]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[via[j0]]
            j0 = via[j0]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j])


_SMALL_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])


def log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k! of whole numbers: a table, and beyond Stirling's series, exact to rounding there."""
    k = np.asarray(k, float)
    x = np.maximum(k, 255)
    series = x * np.log(x) - x + 0.5 * np.log(2 * np.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(k < 256, _SMALL_FACTORIALS[np.minimum(k, 255).astype(int)], series)


def expected_overlap_information(x: int, y: int, n: int, stretch: int = 1 << 20) -> float:
    """What a class of x and one of y of n rows add to the mutual information, expected under random permutation."""
    total = 0.0
    low, high = max(1, x + y - n), min(x, y)
    fixed = log_factorial(np.array([x, y, n - x, n - y, n])) @ np.array([1, 1, 1, 1, -1])
    for a in range(low, high + 1, stretch):
        k = np.arange(a, min(high + 1, a + stretch), dtype=float)
        p = np.exp(fixed - log_factorial(k) - log_factorial(x - k) - log_factorial(y - k) - log_factorial(n - x - y + k))
        total += float((k / n * np.log(n * k / (float(x) * y)) * p).sum())
    return total


def expected_mutual_information(a: np.ndarray, b: np.ndarray) -> float:
    """Of two labelings with these class sizes, under random permutation."""
    n = int(a.sum())
    return sum(expected_overlap_information(int(x), int(y), n) for x in a for y in b)


def polynomial_knee(values: np.ndarray, degree: int = 7) -> float:
    """Of an ascending curve: where a fitted polynomial lies farthest below its chord; the 0.9 quantile of fewer than 8 values."""
    y = np.sort(np.asarray(values, float))
    n = len(y)
    if n < 8:
        return float(np.quantile(y, 0.9))
    x = np.linspace(0, 1, n)
    curve = np.polyval(np.polyfit(x, y, min(degree, max(2, n - 1))), x)
    return float(y[int((curve[0] + x * (curve[-1] - curve[0]) - curve).argmax())])


def savitzky_golay(y: np.ndarray, window: int, order: int) -> np.ndarray:
    """Local polynomial smoothing; the ends are read off the polynomial of the first and last window."""
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    kernel = np.linalg.pinv(design)[0]
    out = np.convolve(y, kernel[::-1], "same")
    x = np.arange(window)
    for part, at in ((y[:window], slice(0, half)), (y[-window:], slice(len(y) - half, None))):
        fit = np.polynomial.Polynomial.fit(x, part, order)(x)
        out[at] = fit[:half] if at.start == 0 else fit[-half:]
    return out


def prominent_peaks(y: np.ndarray, prominence: float, distance: int, place: np.ndarray | None = None) -> np.ndarray:
    """Local maxima (middles of flat ones) at least `distance` apart, higher ones first, of at least this prominence. place: where the values stand, if only turns and the ends of flat stretches are given."""
    place = np.arange(len(y)) if place is None else place
    found, i = [], 1
    while i < len(y) - 1:
        if y[i - 1] < y[i]:
            j = i
            while j + 1 < len(y) and y[j + 1] == y[i]:
                j += 1
            if j < len(y) - 1 and y[j + 1] < y[i]:
                found.append((i, (place[i] + place[j]) // 2))
            i = j
        i += 1
    kept = np.ones(len(found), bool)
    peaks, middle = np.array(found, int).reshape(-1, 2).T
    for k in np.argsort(y[peaks], kind="stable")[::-1] if len(peaks) else []:
        if kept[k]:
            near = np.abs(middle - middle[k]) < distance
            near[k] = False
            kept &= ~near
    out = []
    for p, at in zip(peaks[kept], middle[kept]):
        left = p
        low_left = y[p]
        while left >= 0 and y[left] <= y[p]:
            low_left = min(low_left, y[left])
            left -= 1
        right, low_right = p, y[p]
        while right < len(y) and y[right] <= y[p]:
            low_right = min(low_right, y[right])
            right += 1
        if y[p] - max(low_left, low_right) >= prominence:
            out.append(int(at))
    return np.array(out, int)
