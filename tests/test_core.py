import hashlib
import json
"""The engine's operators against brute force and closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shellcluster.functions import special
from shellcluster.operators import comparators, components, density, extract, knn, metrics, mixture
from shellcluster.plans import benchmark, estimator, methods
from shellcluster.sources import files, synthetic


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.asarray(x, np.float32))], "id long, features array<float>")


def labels_frame(spark, y, p):
    return spark.createDataFrame(list(zip(map(int, y), map(int, p))), "y long, p long")


def blobs(seed=42, n=120, noise=360, d=2, spread=0.18, box=8, centers=((-2.5,), (2.5,))):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(np.resize(c, d), spread, (n, d)) for c in centers]
    return np.vstack([*parts, rng.uniform(-box, box, (noise, d))])


def brute(x, k):
    d = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, 1)


# --- graphs ---------------------------------------------------------------------------------


@pytest.mark.parametrize("d,how", [(2, "block"), (2, "grid"), (1, "grid"), (16, "block")])
def test_exact_graphs(spark, d, how):
    x = np.random.default_rng(d).normal(size=(300, d)).astype(np.float32)
    x[7] = x[8]
    g = knn.build_knn_graph(frame(spark, x), k=6, backend=how)
    knn.validate(g, 6, deep=True)
    ids, dist = brute(x, 6)
    for r in g.collect():
        assert r["nbr"] == ids[r["id"]].tolist() and np.allclose(r["dist"], dist[r["id"]], atol=1e-6)


def test_blocks_give_the_same_graph(spark):
    x = np.random.default_rng(1).normal(size=(200, 4)).astype(np.float32)
    p = frame(spark, x)
    got = {r["id"]: r["nbr"] for r in knn.block_graph(p, p, 5, 200, 4, block_bytes=2000).collect()}
    assert got == dict(enumerate(brute(x, 5)[0].tolist()))


def test_approximate_graph_recall(spark):
    x = np.random.default_rng(42).normal(size=(1000, 16)).astype(np.float32)
    p = frame(spark, x)
    approx = knn.build_knn_graph(p, k=16, backend="lsh")
    knn.validate(approx, 16, deep=True)
    assert knn.recall(approx, knn.build_knn_graph(p, k=16, backend="block"), 4) >= 0.99


@pytest.mark.parametrize("tables, kept", [(16, True), (1, False)])
def test_auto_keeps_an_approximate_graph_only_of_measured_recall(spark, monkeypatch, tables, kept):
    monkeypatch.setattr(knn, "AUTO_EXACT_ROWS", 500)
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(40, 1, 5)) * 50 + rng.normal(size=(40, 25, 5))).reshape(-1, 5).astype(np.float32)
    p = frame(spark, x)
    config = knn.LSHConfig(tables=tables, bucket=64 if kept else 8)
    exact = knn.build_knn_graph(p, k=8, backend="block")
    found, plain = (knn.build_knn_graph(p, k=8, backend=b, config=config) for b in ("auto", "lsh"))
    knn.validate(found, 8, deep=True)
    assert (knn.recall(plain, exact, 8) >= 0.985) == kept
    assert knn.recall(found, exact, 8) >= (0.985 if kept else 1.0)
    assert knn.recall(exact.limit(0), exact, 8) is None


def test_graph_errors(spark):
    p = frame(spark, [[0.0], [1.0], [3.0]])
    for k in (0, 3):
        with pytest.raises(ValueError):
            knn.build_knn_graph(p, k=k)
    with pytest.raises(ValueError):
        knn.build_knn_graph(p, k=1, backend="other")
    with pytest.raises(ValueError):
        knn.validate(knn.build_knn_graph(p, k=1), 2)


def test_range_pairs(spark):
    for d in (2, 5):
        x = np.random.default_rng(3).normal(size=(150, d)).astype(np.float32)
        full = np.sqrt(((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(2))
        expected = {(i, j) for i in range(150) for j in range(150) if i != j and full[i, j] <= 0.7}
        assert {(r["src"], r["dst"]) for r in knn.range_edges(frame(spark, x), 0.7).collect()} == expected
    assert {(r["src"], r["dst"]) for r in knn.range_edges(frame(spark, x[:, :2]), 0.7).collect()}


# --- special functions ----------------------------------------------------------------------


def test_columns_of_special_functions(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 1.0, 3.25, 40.0, 1e4)], "x double")
    for r in df.select("x", special.lgamma(F.col("x")).alias("g")).collect():
        assert abs(r["g"] - math.lgamma(r["x"])) < 1e-9 * max(1, abs(r["g"]))
    cells = [(s, k) for s in (1, 2, 5, 30) for k in (0, 1, 4, 20, 120)]
    df = spark.createDataFrame(cells, "s long, k long")
    for r in df.select("s", "k", special.topology_log_bayes_factor(F.col("s"), F.col("k"), 50, 4).alias("b")).collect():
        expected = special.topology_log_bayes_factor_value(r["s"], r["k"], 50, 4)
        assert (r["b"] is None and expected == -math.inf) or abs(r["b"] - expected) < 1e-7
    df = spark.createDataFrame([(v,) for v in (0.0, 0.1, 0.5, 1.0)], "v double")
    for r in df.select("v", special.binomial_tail(F.col("v"), 2, 7).alias("p")).collect():
        v = r["v"]
        assert abs(r["p"] - (1 - (1 - v) ** 7 - 7 * v * (1 - v) ** 6)) < 1e-12


def test_driver_special_functions():
    assert abs(math.exp(special.log_gammainc(1.0, 2.0)) - (1 - math.exp(-2))) < 1e-12
    assert abs(math.exp(special.log_gammainc(3.0, 9.0)) - (1 - math.exp(-9) * (1 + 9 + 40.5))) < 1e-12
    assert special.uniform_lower_tail_log_bayes_factor(0, 0) == -math.inf
    assert special.uniform_lower_tail_log_bayes_factor(3, 0) == -math.log(4)
    assert special.uniform_lower_tail_log_bayes_factor(20, 100.0) > 0 > special.uniform_lower_tail_log_bayes_factor(20, 20.0)
    half = special.log_bessel_k(np.array([0.5]), np.array([2.0]))[0]
    assert abs(half - (0.5 * math.log(math.pi / 4) - 2)) < 1e-6
    cost = np.random.default_rng(0).random((5, 7))
    import itertools

    best = min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(7), 5))
    assert abs(sum(cost[i, j] for i, j in special.hungarian(cost)) - best) < 1e-12
    assert len(special.hungarian(cost.T)) == 5
    y = np.arange(50.0) ** 2
    assert np.allclose(special.savitzky_golay(y, 9, 3), y)
    assert special.prominent_peaks(np.array([0, 1, 0, 3, 3, 0, 0.5, 0]), 0.9, 1).tolist() == [1, 3]
    rng = np.random.default_rng(0)
    for _ in range(50):  # the ends of flat stretches are enough
        y = np.repeat(rng.integers(0, 5, 30), rng.integers(1, 5, 30)).astype(float)
        before, after = np.sign(y[1:-1] - y[:-2]), np.sign(y[2:] - y[1:-1])
        some = np.flatnonzero(np.concatenate([[True], (before != after) & ((before * after < 0) | (before == 0) | (after == 0)), [True]]))
        assert special.prominent_peaks(y, 1, 3).tolist() == special.prominent_peaks(y[some], 1, 3, some).tolist()


def test_information_scores():
    assert special.information_score(-10, 0.0, 5, 100, "icl") == special.information_score(-10, 0.0, 5, 100, "bic")
    assert special.information_score(-10, 1.4, 5, 100, "icl") > special.information_score(-10, 0.0, 5, 100, "bic")
    assert special.information_score(-10, 0, 5, 6, "aicc") == math.inf


# --- the mixture ----------------------------------------------------------------------------


def shells_of(spark, x, d, k=32):
    graph = knn.build_knn_graph(frame(spark, x), k=k)
    return graph, *density.shell_volumes(graph, density.RANKS, d)


def test_em_raises_the_likelihood_and_paths_agree(spark, monkeypatch):
    _, rows, shapes = shells_of(spark, blobs(), 2)
    config = mixture.MixtureConfig()
    local = mixture.Shells(rows, shapes, config)
    one, two = mixture.fit_components(local, 1, config), mixture.fit_components(local, 2, config)
    assert two.log_likelihood > one.log_likelihood
    monkeypatch.setattr(mixture, "LOCAL_ROWS", 10)
    spread = mixture.Shells(rows, shapes, config)
    assert not spread.local
    for a, b in ((local.cold(3, 0), spread.cold(3, 0)), (local.statistics(two.parameters), spread.statistics(two.parameters))):
        assert np.allclose(a.effective, b.effective) and np.allclose(a.weighted, b.weighted)
    a, b = local.split(two.parameters), spread.split(two.parameters)
    assert len(b.effective) == 3 and np.allclose(a.effective, b.effective) and np.allclose(a.weighted, b.weighted)
    assert abs(local.entropy(two.parameters, None) - spread.entropy(two.parameters, None)) < 1e-6


def test_split_of_equal_scores_and_of_ties(spark, monkeypatch):
    config, shapes = mixture.MixtureConfig(), np.array([4.0, 4, 8, 16])
    rng = np.random.default_rng(5)
    same = np.tile([1.0, 2, 4, 9], (41, 1)) + rng.permuted(np.tile([-0.5, 0.5, 0, 0], (41, 1)), axis=1)
    tied = np.repeat(rng.uniform(0.5, 3, (9, 4)), [1, 20, 3, 1, 1, 9, 2, 2, 2], axis=0)
    for x in (same, tied):
        rows = spark.createDataFrame([(3 * i, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, shells array<double>, data_term double")
        p = mixture.Parameters(np.array([0.6, 0.4]), np.zeros(2), np.zeros(2), np.array([[4.0, 2, 2, 1], [2, 2, 1, 1]]))
        local = mixture.Shells(rows, shapes, config)
        monkeypatch.setattr(mixture, "LOCAL_ROWS", 10)
        spread = mixture.Shells(rows, shapes, config)
        monkeypatch.undo()
        a, b = local.split(p), spread.split(p)
        assert not spread.local and min(a.effective) > 0
        assert np.allclose(a.effective, b.effective) and np.allclose(a.weighted, b.weighted)


def test_rate_profile_meets_its_target():
    config = mixture.MixtureConfig()
    shapes, ranks = np.array([4.0, 4, 8, 16]), (4, 8, 16, 32)
    w = np.array([[5.0, 4, 9, 20], [1, 2, 3, 4]])
    _, slope, rates = mixture.profiles(w, np.array([3.0, 2.0]), shapes, ranks, config)
    logs = np.log(ranks)
    scaled = w * np.exp(slope[:, None] * logs)
    assert np.allclose(scaled @ logs / scaled.sum(1), shapes @ logs / shapes.sum(), atol=1e-9)
    assert rates.shape == (2, 4)


def test_one_component_has_no_signal(spark):
    x = np.random.default_rng(7).uniform(-1, 1, (120, 2))
    graph, _, _ = shells_of(spark, x, 2)
    found = mixture.stratify(graph, dimension=2, config=mixture.MixtureConfig(max_components=1, hard_max_components=1))
    assert found.signal_groups == 0
    assert found.strata.where("group = 0 AND p_background > 0.999999").count() == 120


def test_expansion_and_duplicates():
    assert [mixture.needs_expansion(*a) for a in ((8, 8, 16, 1), (7, 8, 16, 1), (6, 8, 16, 1), (16, 16, 16, 1))] == [True, True, False, False]
    p = mixture.Parameters(np.ones(5) / 5, np.array([3.0, 2, 2, 2, 1]), np.array([0.2, -0.1, -0.1, -0.1, 0.2]), np.ones((5, 4)))
    assert mixture.duplicate_profiles(p, np.array([1, 2, 3, 4]), 1e-8) == 3
    assert mixture.duplicate_profiles(p, np.array([0, 1, 4]), 1e-8) == 1


def test_config_errors():
    for bad in ({"min_components": 0}, {"criterion": "x"}, {"ranks": (4, 4)}, {"n_init": 0}, {"min_rate": 0.0}, {"component_roles": "x"}):
        with pytest.raises(ValueError):
            mixture.MixtureConfig(**bad)
    for bad in ({"core_rank": 0}, {"core_threshold_rule": "x"}, {"fixed_core_quantile": 0.0}, {"signal_strata": "x"}):
        with pytest.raises(ValueError):
            extract.ExtractionConfig(**bad)
    with pytest.raises(ValueError):
        extract.ExtractionConfig(core_rank=9).check(8)


# --- extraction -----------------------------------------------------------------------------


def sweep(spark, unary, score, steps, n_ref, rank):
    rows = [(i, 0, i, float(d), float(u)) for i, (u, d) in enumerate(zip(unary, score))]
    ordered = spark.createDataFrame(rows, "id long, group int, pos long, d double, u double")
    events = spark.createDataFrame([(0, s) for s in steps], "group int, step long")
    return extract.threshold_sweep(ordered, events, n_ref, rank).collect()


def test_sweep_fixtures(spark):
    (r,) = sweep(spark, [3, 3, 3, -20], [1, 1, 1, 2], [1, 2, 2], 10, 1)
    assert r["size"] == 3 and r["gain"] > 0
    (r,) = sweep(spark, [2, 2, 2], [1, 2, 3], [1, 2, 2], 10, 1)
    assert r["size"] == 3 and abs(r["gain"] - (6 + special.topology_log_bayes_factor_value(3, 3, 10, 1) - math.log(3))) < 1e-9
    assert sweep(spark, [-9, -9], [1, 2], [], 10, 1) == []


def test_growth_fixture(spark):
    # two dense pairs, and a sparser node in contact with each
    nbr = {0: [1, 4], 1: [0, 4], 2: [3, 5], 3: [2, 5], 4: [0, 1], 5: [2, 3]}
    rows = [(i, v, [1.0, 1.5]) for i, v in nbr.items()]
    graph = spark.createDataFrame(rows, "id long, nbr array<long>, dist array<float>")
    core = spark.createDataFrame([(i, 1 if i in (2, 3) else 0, 2.0) for i in range(6)], "id long, group int, radius double")
    expected = None
    for grow in (extract._grow_local, extract._grow_in_spark):
        wide = core.join(graph, "id").select("id", "group", "radius", "nbr", "dist")
        got = {r["id"]: r["label"] for r in grow(wide).collect()}
        groups = sorted(sorted(i for i in got if got[i] == c) for c in set(got.values()))
        assert groups == [[0, 1, 4], [2, 3, 5]]
        expected = expected or groups
        assert groups == expected


@pytest.mark.parametrize("seed", range(2))
def test_growth_paths_agree_on_random_graphs(spark, seed):
    rng = np.random.default_rng(seed)
    n, k = 24, 2
    place = np.sort(rng.uniform(0, 8, n))  # a line with gaps, so strata touch in some places only
    far = np.abs(place[:, None] - place[None, :])
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :k]
    graph = spark.createDataFrame([(i, [int(j) for j in near[i]], [float(far[i, j]) for j in near[i]]) for i in range(n)], "id long, nbr array<long>, dist array<float>")
    core = spark.createDataFrame([(i, int(rng.integers(0, 3)), float(rng.uniform(0.1, 0.7))) for i in range(n) if i % 9], "id long, group int, radius double")
    wide = core.join(graph, "id").select("id", "group", "radius", "nbr", "dist")
    local, spread = ({r["id"]: r["label"] for r in grow(wide).collect()} for grow in (extract._grow_local, extract._grow_in_spark))
    assert local == spread and len(set(local.values())) > 3


def test_growth_of_separate_strata(spark):
    # one cluster in each stratum, without contact
    graph = spark.createDataFrame([(0, [1], [0.1]), (1, [0], [0.1]), (2, [3], [1.0]), (3, [2], [1.0])], "id long, nbr array<long>, dist array<float>")
    core = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 2.0), (3, 1, 2.0)], "id long, group int, radius double")
    wide = core.join(graph, "id").select("id", "group", "radius", "nbr", "dist")
    for grow in (extract._grow_local, extract._grow_in_spark):
        assert {r["id"]: r["label"] for r in grow(wide).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}


def test_scan_paths_agree(spark, monkeypatch):
    x = np.vstack([np.random.default_rng(1).normal(0, 0.01, (12, 2)), np.random.default_rng(2).uniform(-6, 6, (160, 2))])
    graph = knn.build_knn_graph(frame(spark, x), k=16)
    rows = knn.k_distance(graph, 4)
    a, events, dim = extract.background_scan(graph, rows, 16, 4)
    monkeypatch.setattr(extract, "LOCAL_EDGES", 1)
    b, again, _ = extract.background_scan(graph, rows, 16, 4)
    assert dim > 1 and len(events) == len(again) >= 1
    assert {r["id"] for r in a.collect()} == {r["id"] for r in b.collect()}
    assert abs(events[0]["gain"] - again[0]["gain"]) < 1e-9


def test_estimator_finds_blobs(spark):
    x = blobs(n=160, noise=180, d=4, spread=0.25, box=8, centers=((-3,), (3,)))
    model = estimator.StrataClusterer().fit(frame(spark, x))
    again = estimator.StrataClusterer().fit(frame(spark, x))
    got = {r["id"]: r["label"] for r in model.labels.collect()}
    assert got == {r["id"]: r["label"] for r in again.labels.collect()}
    assert model.n_clusters >= 2 and len(got) == 500
    assert len({got[i] for i in range(160)} - {-1}) >= 1 and not ({got[i] for i in range(160)} - {-1}) & ({got[i] for i in range(160, 320)} - {-1})


def test_ablations_run(spark):
    p = frame(spark, blobs())
    for name in ("strata_fixed_quantile", "strata_no_background_recovery", "strata_single_layer"):
        assert methods.run_method(name, p).labels.count() == 600


@pytest.mark.parametrize("rule", ["background_scan_mdl", "rate_changepoint_mdl", "validated_rate_prefix", "topology_mdl"])
def test_roles_run(spark, rule):
    graph = knn.build_knn_graph(frame(spark, blobs(n=60, noise=80)), k=32)
    config = mixture.MixtureConfig(component_roles=rule, max_components=3, hard_max_components=3)
    assert estimator.StrataClusterer(mixture_config=config).fit_from_graph(graph, 2.0).labels.count() == 200


# --- comparators ----------------------------------------------------------------------------


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault(r["label"], set()).add(r["id"])
    noise = out.pop(-1, set())
    return {frozenset(v) for v in out.values()}, noise


@pytest.mark.parametrize("method", list(comparators.METHODS))
def test_comparators_separate_blobs(spark, method):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal((-4, 0), 0.3, (70, 2)), rng.normal((4, 1), 0.3, (70, 2))])
    found = comparators.dispatch(method, frame(spark, x), "low_dim")
    rows = found.labels.collect()
    assert len(rows) == 140
    clusters, _ = partition(rows)
    assert clusters and all(max(c) < 70 or min(c) >= 70 for c in clusters)


def test_dispatch_errors(spark):
    p = frame(spark, [[0.0], [1.0]])
    with pytest.raises(ValueError):
        comparators.dispatch("dbscan", p, "other")
    with pytest.raises(ValueError):
        comparators.dispatch("other", p, "low_dim")


def test_approximate_graph_finds_neighbours_in_a_dense_clump(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1200, 6)) * 3, rng.normal(size=(600, 6)) * 0.001])
    p = frame(spark, x)
    config = knn.LSHConfig(bucket=64, max_bucket=128)
    clump = p.where("id >= 1200").select("id")
    approx, exact = (knn.build_knn_graph(p, k=8, backend=b, config=config).join(clump, "id", "left_semi") for b in ("lsh", "block"))
    assert knn.recall(approx, exact, 8) > 0.99


@pytest.mark.parametrize("kind", ["spread", "ties", "mixed"])
def test_quantiles_by_narrowing(spark, monkeypatch, kind):
    rng = np.random.default_rng(3)
    x = {"spread": rng.lognormal(0, 3, 3000), "ties": rng.integers(0, 3, 3000) * 1.0, "mixed": np.concatenate([np.full(1500, 2.0), rng.normal(2, 1, 1500)])}[kind]
    rows = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "d double").repartition(5).cache()
    monkeypatch.setattr(components, "EXACT_ROWS", 40)
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        assert components.quantile(rows, "d", q) == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
    assert components.quantile(rows.limit(0), "d", 0.5) is None


def test_curve_is_whole_at_every_size(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.gamma(9, 0.02 * s, m) for s, m in ((1, 90_000), (8, 2_000), (30, 60_000), (80, 700), (200, 30_000))])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, d double").repartition(4)
    for most, prominence in ((3, 0.03), (7, 0.08), (50, 0.001)):
        found = comparators._distributed_vdbscan_eps(*comparators._placed_values(d), most, prominence)
        assert np.allclose(found, comparators.vdbscan_eps(y, most, prominence), rtol=1e-9)
    monkeypatch.setattr(comparators, "SEQUENTIAL_ROWS", 1000)
    assert abs(comparators._curve_knee(d) - comparators.special.polynomial_knee(y)) < 1e-9


def test_vdbscan_radii_do_not_depend_on_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.gamma(9, 0.02 * s, m) for s, m in ((1, 20_000), (8, 600), (30, 15_000), (80, 300), (200, 5_000))])
    d = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "id long, d double")
    monkeypatch.setattr(comparators, "SEQUENTIAL_ROWS", 1000)
    monkeypatch.setattr(comparators, "_rank_distances", lambda points, rank: d)
    monkeypatch.setattr(comparators, "sequential_dbscan", lambda points, eps: None)
    for profile, most, prominence in (("low_dim", 3, 0.03), ("high_dim", 7, 0.08)):
        found = comparators.run_vdbscan(None, profile).parameters["eps_values"]
        expected = comparators.vdbscan_eps(y, most, prominence)
        assert len(found) == len(expected) and np.allclose(found, expected)


def test_peak_centers_beyond_the_sequential_bound(spark, monkeypatch):
    rng = np.random.default_rng(7)
    gamma = np.concatenate([np.full(2000, 0.01), 100 + rng.random(300), [400, 500, 500, 900]])
    state = spark.createDataFrame([(i, float(g), 1.0 + float(g > 1)) for i, g in enumerate(gamma)], "id long, rho double, delta double").repartition(5)
    above = sorted(((-2 * g, i) for i, g in enumerate(gamma) if g > gamma.mean() and g > 1))
    gaps = np.diff([-g for g, _ in above])
    mean = -gaps.sum() / len(above)
    last = np.flatnonzero(-gaps >= mean)[-1]
    expected = [i for _, i in above[: last + 1]]
    monkeypatch.setattr(comparators, "SEQUENTIAL_ROWS", 2)
    centers, gap, fallback = comparators.peak_centers(state)
    assert centers == expected and len(expected) == 4 and abs(gap - mean) < 1e-9 and not fallback


def test_density_peaks(spark):
    rho = {r["id"]: r["rho"] for r in comparators.peak_density(comparators.peak_graph(frame(spark, [[0.0], [1.0], [3.0], [10.0]]))).collect()}
    assert max(rho.values()) == 1
    state = spark.createDataFrame([(i, float(v), float(v), 0) for i, v in enumerate([10, 9, 8, 1, 1])], "id long, rho double, delta double, parent long")
    assert comparators.peak_centers(state) == ([0, 1], 12.0, False)
    rows = comparators.run_density_peaks(frame(spark, [[0, 0], [0, 0.1], [0.1, 0], [9, 9], [9, 9.1], [9.1, 9]])).labels.collect()
    assert all(r["label"] >= 0 for r in rows)
    x = np.random.default_rng(2).normal(size=(80, 3)).astype(np.float32)
    p = frame(spark, x)
    graph = comparators.peak_graph(p)
    rho = comparators.peak_density(graph)
    whole = {r["id"]: (r["parent"], r["delta"]) for r in comparators.peak_parents(p, rho).collect()}
    assert whole == {r["id"]: (r["parent"], r["delta"]) for r in comparators.peak_parents(p, rho, comparators.first_neighbours(graph)).collect()}
    assert [r for r in whole.values() if r[0] < 0] == [(-1, max(np.sqrt(((x.astype(float) - q) ** 2).sum(1)).max() for i, q in enumerate(x.astype(float)) if whole[i][0] < 0))]


def test_xshift_modes_are_bounded(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(2).normal(0, 0.05, (30, 2)) + c for c in ((1, 0), (0, 1), (-1, 0))])
    assert comparators.run_xshift(frame(spark, x), "low_dim").labels.count() == 90
    monkeypatch.setattr(comparators, "SEQUENTIAL_ROWS", 1)
    with pytest.raises(ValueError, match="modes"):
        comparators.run_xshift(frame(spark, x), "low_dim")


def test_xshift_tiny(spark):
    assert sorted(r["label"] for r in comparators.run_xshift(frame(spark, [[0.0, 1], [1, 0]]), "low_dim").labels.collect()) == [0, 1]


# --- metrics --------------------------------------------------------------------------------


def test_metric_fixtures(spark):
    m = metrics.clustering_metrics(labels_frame(spark, [0, 1, -1, -1], [7, -1, 7, -1]))
    assert all(abs(m[k] - 0.5) < 1e-12 for k in ("signal_precision", "signal_recall", "signal_f1", "noise_precision", "noise_recall", "noise_f1"))
    m = metrics.clustering_metrics(labels_frame(spark, [0, 1, -1, -1], [-1] * 4))
    assert m["signal_f1"] == 0 and abs(m["noise_f1"] - 2 / 3) < 1e-12 and abs(m["binary_macro_f1"] - 1 / 3) < 1e-12
    m = metrics.clustering_metrics(labels_frame(spark, [10**9, 10**9, 5, 5], [10**9, 10**9, 3, 3]))
    assert m["pairwise_f1"] == 1 and m["n_clusters"] == 2


def evaluated(spark, y, p, names):
    return metrics.evaluate(labels_frame(spark, y, p), "synthetic", names)


def test_evaluation_fixtures(spark):
    e = evaluated(spark, [0, 0, 1, 1], [8] * 4, ["a", "b"])
    assert abs(e["macro_target_f1"] - 1 / 3) < 1e-12 and e["matched_predicted_cluster_count"] == 1
    e = evaluated(spark, [0] * 10, [4] * 6 + [9] * 4, ["a"])
    assert abs(e["macro_target_f1"] - 0.75) < 1e-12 and e["target_matches"][0]["fragments"] == 2
    e = evaluated(spark, [0, 0, 1, 1, -1, -1, -1], [1, 1, 2, 2, 8, 9, 9], ["a", "b"])
    assert e["macro_target_f1"] == 1 and e["background_only_predicted_clusters"] == 2 and e["ari_signal"] == 1
    assert abs(e["ami_signal"] - 1) < 1e-9
    wide = metrics.pivot_contingency(labels_frame(spark, [10, 10, 30, -1], [7, -1, 9, 12]), [7, 9, 12]).orderBy("y").collect()
    assert [list(r)[1:] for r in wide] == [[1, 0, 0], [0, 1, 0]]
    assert abs(metrics.harmonic(0.8, 0.5) - 0.8 / 1.3) < 1e-12 and metrics.harmonic(0.6, 0, 0.2) == 0
    with pytest.raises(ValueError):
        metrics.clustering_metrics(labels_frame(spark, [0, -2], [0, 0]))
    with pytest.raises(TypeError):
        metrics.check_labels(spark.createDataFrame([(0.5,)], "y double"), "y")
    with pytest.raises(ValueError):
        metrics.EvaluationConfig.resolve({"other": 1}, "synthetic")


# --- sources and jobs -----------------------------------------------------------------------


def test_families_are_deterministic_and_exact(spark):
    specs = [{"family": f, "dimension": d, "noise_fraction": 0.5, "signal_fraction": 0.2, "density_ratio": 64.0} for f, d in (("density_contrast", 2), ("multidensity", 2), ("ultrasparse", 16), ("overlapping_density", 16), ("moons", 2), ("rings", 2), ("gaussian_overlap", 8), ("gaussian_imbalanced", 16))]
    specs.append({"family": "global_contamination_invariance", "signal_size": 1000, "noise_fraction": 0.5})
    for spec in specs:
        family = synthetic.family_of(spec, 2000, 42)
        rows = synthetic.generate(spark, family, 42).collect()
        assert len(rows) == 2000
        again = {r["id"]: r["features"] for r in synthetic.generate(spark, family, 42).repartition(3).collect()}
        assert again == {r["id"]: r["features"] for r in rows}
        counts = np.bincount([r["y"] + 1 for r in rows], minlength=len(family.counts))
        assert counts[1:].tolist() == family.counts[:-1] and counts[0] == family.counts[-1]


def test_robust_scale_and_positions(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0), (4, None)], "k long, v double")
    got = {r["k"]: r["v"] for r in files.robust_scale(df, ["v"]).collect()}
    assert got[2] == 0 and abs(got[3] - 2 / 1.4826) < 1e-12 and got[4] is None
    placed = components.with_position(spark.range(1000), F.pmod(F.xxhash64("id"), F.lit(7)), "id")
    assert sorted(r["pos"] for r in placed.collect()) == list(range(1000))


def test_quantiles_of_groups(spark):
    """Also with ties at the cut and in groups of one row."""
    rng = np.random.default_rng(6)
    rows = [(int(i), int(g), float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 4, 300), np.round(rng.random(300), 1)))] + [(900, 7, 2.5)]
    df = spark.createDataFrame(rows, "id long, group int, d double").repartition(5)
    for q in (0.0, 0.31, 0.5, 1.0):
        found = {r["group"]: (r["size"], r["threshold"]) for r in extract.fixed_quantile(df, q).collect()}
        for g in (0, 1, 2, 3, 7):
            d = np.array([v for _, h, v in rows if h == g])
            kept = d[d <= np.quantile(d, q)]
            assert found[g] == (len(kept), kept.max())


def test_stars(spark, monkeypatch):
    """Hubs at either end, paths and loops, with few rows a key."""
    monkeypatch.setattr(components, "LOCAL_EDGES", 1)
    monkeypatch.setattr(components, "HUB_ROWS", 5)
    hub = [(i, 1000) for i in range(200, 260)] + [(i, 100) for i in range(300, 360)] + [(5, 5)] + [(i, i + 1) for i in range(20, 60)] + [(60, 20), (359, 259)]
    nodes = spark.createDataFrame([(i,) for i in sorted({i for e in hub for i in e} | {7})], "id long")
    found = {r["id"]: r["component"] for r in components.connected_components(nodes, spark.createDataFrame(hub, "src long, dst long")).collect()}
    assert found == {i: 5 if i == 5 else 7 if i == 7 else 20 if i <= 60 else 100 for i in found} and len(found) == nodes.count()


def test_components_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(4)
    edges = spark.createDataFrame([tuple(map(int, e)) for e in rng.integers(0, 300, (200, 2))], "src long, dst long")
    nodes = spark.range(300)
    a = {r["id"]: r["component"] for r in components.connected_components(nodes, edges).collect()}
    monkeypatch.setattr(components, "LOCAL_EDGES", 1)
    assert a == {r["id"]: r["component"] for r in components.connected_components(nodes, edges).collect()}


def test_jobs(spark, tmp_path):
    jobs = benchmark.expand_jobs(spark, benchmark.QUERY_PROTOCOL, "synthetic")
    assert len(jobs) == 16 and len({j["job_id"] for j in jobs}) == 16
    fixed = dict(benchmark.QUERY_PROTOCOL, synthetic=dict(benchmark.QUERY_PROTOCOL["synthetic"], size_mode="fixed_signal_count"))
    assert {j["dataset"]["n"] for j in benchmark.expand_jobs(spark, fixed, "synthetic")} == {1000, 2000}
    assert benchmark.select_jobs(jobs, ["# all", jobs[0]["job_id"]]) == [jobs[0]]
    with pytest.raises(ValueError):
        benchmark.select_jobs(jobs, ["other"])
    job = next(j for j in jobs if j["method"] == "dbscan")
    result = benchmark.run_with_limit(spark, job, 300, str(tmp_path / "state"))
    assert result["status"] == "ok", result
    assert benchmark.complete(result, job, spark)
    report = benchmark.validate(spark, [job], [result])
    assert report["complete"] and report["statuses"] == {"ok": 1}
    assert not benchmark.validate(spark, jobs, [result])["complete"]
    spoiled = dict(result, evaluation_artifact=dict(result["evaluation_artifact"], fingerprint="x"))
    assert not benchmark.validate(spark, [job], [spoiled])["complete"]
    frame_ = benchmark.results_frame(spark, [result])
    assert benchmark.compare(frame_, frame_)["verdict"].startswith("unchanged")
    assert "| synthetic | dbscan | 1 |" in benchmark.report(frame_, report)
    assert result["resources"]["peak_resident_mb"] > 0
    assert benchmark.run_with_limit(spark, job, 300, memory_mb=1)["status"] == "memory_limit"
    assert benchmark.missing_modules(["dbscan", "other"]) == {"other": ["unknown method"]}
    assert benchmark.drift(spark, {"a": "1", "b": "2"}, {"b": "3", "c": "4"}) == {"added": ["c"], "removed": ["a"], "changed": ["b"]}


RESULT = "suite string, dataset_id string, method string, seed long, status string, quality double, runtime_seconds double"


def test_verdicts(spark):
    rows = [("synthetic", f"d{i}", "strata", 42, "ok" if i % 5 else "error", i / 10, 1.0 + i) for i in range(10)]
    rows += [("gaia", "g", "strata", 42, "ok", 0.5, 0.0)]
    a = spark.createDataFrame(rows, RESULT)
    b = spark.createDataFrame([(*r[:5], r[5] + 0.01, r[6] * 2) for r in rows], RESULT)
    found = benchmark.compare(a, b)
    assert found["verdict"] == "improved_slower" and found["paired_jobs"] == 9
    assert found["by_suite"]["gaia"] == {"pairs": 1, "median_quality_delta": pytest.approx(0.01), "worst_quality_delta": pytest.approx(0.01), "improved_pairs": 1, "regressed_pairs": 0, "median_runtime_ratio": None}
    assert benchmark.compare(b, a)["verdict"] == "regressed"
    less = benchmark.compare(a, b.where("suite = 'synthetic'"))
    assert less["verdict"] == "incomparable" and less["missing_current_jobs"] == ["gaia / g / strata / 42"]
    failed = benchmark.compare(a, a.withColumn("status", F.when(F.col("dataset_id") == "d0", "ok").when(F.col("dataset_id") == "d1", "timeout").otherwise(F.col("status"))))
    assert failed["verdict"] == "regressed" and failed["new_failures"] == ["synthetic / d1 / strata / 42"] and failed["recovered_jobs"] == ["synthetic / d0 / strata / 42"]
    none = a.limit(0)
    assert benchmark.compare(none, none)["verdict"] == "incomparable"


def test_jobs_of_all_suites(spark, tmp_path):
    for name in ("b", "a", "c d"):
        (tmp_path / f"gaia_cone_{name}.csv").write_text("source_id\n1\n")
    for i in (1, 2):
        (tmp_path / f"ocfinder_table{i}.csv").write_text("Cluster,x\na,1\nb,2\nc d,3\nz,4\n")
    protocol = benchmark.QUERY_PROTOCOL | {
        "cytometry": {"datasets": [{"id": "cells", "path": "x.csv", "cofactor": 5}], "seeds": [1, 2]},
        "gaia": {"data_root": str(tmp_path), "profiles": ["field", "catalog"], "seeds": [41, 42], "ruwe_max": 1.4, "field_selection": {"strategy": "stable_hash", "count": 2, "salt": "s"}},
    }
    evaluation = {
        "schema_version": 1, "protocol_version": "1.0", "matching": {"strategy": "hungarian", "objective": "pairwise_f1", "unmatched_target_score": 0}, "aggregation": {}, "discovery_thresholds": {"purity": 0.9, "coverage": 0.1},
        "fragment_min_target_fraction": 0.05, "failure_policy": "zero", "suites": {"synthetic": {"mode": "full_partition"}, "cytometry": {}, "gaia": {"dataset_overrides": {"a__field": {"mode": "full_partition"}}}},
    }
    jobs = benchmark.expand_jobs(spark, protocol, "all", evaluation)
    by = {s: [j for j in jobs if j["suite"] == s] for s in benchmark.SUITES}
    assert len(by["synthetic"]) == 16
    # what draws runs with each seed, the rest once
    assert {(j["method"], j["seed"]) for j in by["cytometry"]} == {("strata", 1), ("strata", 2), ("dbscan", 1)}
    wanted = sorted(["a", "b", "c d"], key=lambda f: hashlib.sha256(f"s:{f}".encode()).hexdigest())[:2]
    assert {j["dataset"]["field_id"] for j in by["gaia"]} == set(wanted) and len(by["gaia"]) == 2 * 2 * 3
    for j in jobs:
        bare = {k: v for k, v in j.items() if k != "job_id"}
        digest = hashlib.sha256(json.dumps(bare, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
        assert j["job_id"].endswith(f"__{j['seed']}__{digest}") and " " not in j["job_id"]
        assert metrics.EvaluationConfig.resolve(j["evaluation"], j["suite"]).discovery_purity == 0.9
    assert all((j["evaluation"].get("mode") == "full_partition") == (j["dataset_id"] == "a__field") for j in by["gaia"])
    with pytest.raises(ValueError):
        benchmark.expand_jobs(spark, benchmark.QUERY_PROTOCOL, "gaia")
    with pytest.raises(ValueError):
        benchmark.check_protocol({"schema_version": 1})
    with pytest.raises(TypeError):
        benchmark.check_evaluation_protocol(evaluation | {"fragment_min_target_fraction": "x"})
    with pytest.raises(ValueError):
        benchmark.check_evaluation_protocol(evaluation | {"suites": {}})
    (tmp_path / "p.json").write_text(json.dumps(protocol))
    assert benchmark.main(["--protocol", str(tmp_path / "p.json"), "--output", str(tmp_path / "out"), "--dry-run"]) == 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).limit(1).count() == 1


def test_trees_of_blocks_are_the_tree(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.5, (90, 5)) for c in (0, 4)] + [rng.uniform(-3, 8, (60, 5))])
    points = spark.createDataFrame([(7 * i + 3, [float(v) for v in r]) for i, r in enumerate(x.astype(np.float32))], "id long, features array<float>")
    ids, edges = comparators.reachability_tree(points, 5)
    whole = {r["id"]: r["label"] for r in comparators.run_hdbscan(points, "high_dim").labels.collect()}
    for name, v in (("TREE_ROWS", 10), ("TREE_PARTS", 3), ("TREE_BLOCK", 30)):
        monkeypatch.setattr(comparators, name, v)
    monkeypatch.setattr(comparators, "_dense", None)  # the rows may not come to the driver
    again, spread = comparators.reachability_tree(points, 5)
    assert np.array_equal(ids, again) and len(spread) == 239 and np.allclose(edges[:, 2], spread[:, 2], atol=1e-9)
    found = {r["id"]: r["label"] for r in comparators.run_hdbscan(points, "high_dim").labels.collect()}
    assert len(set(whole.values())) > 2
    # rows whose reachabilities are alike may fall either way
    assert metrics.adjusted_rand(spark.createDataFrame([(whole[i], found[i]) for i in whole], "y long, p long")) > 0.97


@pytest.mark.parametrize("n", [1, 150, 200])
@pytest.mark.parametrize("edges", [0, 60, 400])
def test_all_widths_of_windows_at_once(spark, monkeypatch, n, edges):
    n = max(n, 16)
    rng = np.random.default_rng(n + edges)
    a = rng.integers(0, n, edges)
    b = np.clip(a + rng.integers(-12, 13, edges), 0, n - 1)
    widths = extract._widths(n, 2)
    sizes = [(w, extract._window_sizes(np.arange(n), np.arange(n), a, b, w)) for w in widths]
    expected = [(w, int((s[1:] >= s[0]).sum()), len(s)) for w, s in sizes]
    monkeypatch.setattr(extract, "TASK_WINDOW", 8)
    placed = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    assert extract.window_ranks(placed, n, widths) == expected


def test_xshift_modes_stay_in_spark(spark, monkeypatch):
    x = np.concatenate([np.random.default_rng(4).normal(0, 0.05, (30, 2)) + c for c in ((1, 0), (0, 1), (-1, 0))])
    points = frame(spark, x)

    def no(*a, **k):
        raise AssertionError("modes came to the driver")

    monkeypatch.setattr(type(points), "toPandas", no)
    clusters, noise = partition(comparators.run_xshift(points, "low_dim").labels.collect())
    assert sum(map(len, clusters)) == 90 and not noise
