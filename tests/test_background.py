import numpy as np
import pytest
from pyspark.sql import functions as F

from shellcluster.functions import special
from shellcluster.operators import background, density, knn, mixture
from shellcluster.streaming import assign


@pytest.mark.parametrize("kind", mixture.BACKGROUNDS[1:])
def test_continuous_backgrounds(spark, kind):
    x = np.random.default_rng(19).uniform(-1, 1, (100, 2)).astype(np.float32)
    graph = knn.build_knn_graph(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>"), k=32)
    config = mixture.MixtureConfig(background_distribution=kind, max_components=1, hard_max_components=1)
    found = mixture.stratify(graph, dimension=2, config=config)
    assert found.signal_groups == 0 and found.strata.where(F.col("p_background") > 1 - 1e-9).count() == 100
    two = mixture.stratify(graph, dimension=2, config=mixture.MixtureConfig(background_distribution=kind, max_components=2, hard_max_components=2, max_iter=30))
    assert two.strata.count() == 100 and np.isfinite(two.fit.log_likelihood)


def test_integrated_densities_match_quadrature():
    x, term = np.array([[0.2, 0.3], [1.0, 1.4], [4.0, 5.0]]), np.zeros(3)
    shapes, logs = np.array([4.0, 4.0]), np.log([4.0, 8.0])
    grid = np.exp(np.linspace(-12, 8, 40_001))
    step = np.gradient(grid)
    slope = 0.1
    exposure = x @ np.exp(slope * logs)
    body = slope * shapes @ logs + shapes.sum() * np.log(grid)[None] - exposure[:, None] * grid[None]
    laws = {
        "gamma_rate_mixture": (np.array([0.5, 0.2, slope]), lambda a, b: np.exp(a) * b - special.math.lgamma(np.exp(a)) + (np.exp(a) - 1) * np.log(grid) - np.exp(b) * grid),
        "inverse_gamma_rate_mixture": (np.array([0.5, 0.2, slope]), lambda a, b: np.exp(a) * b - special.math.lgamma(np.exp(a)) - (np.exp(a) + 1) * np.log(grid) - np.exp(b) / grid),
        "lognormal_rate_mixture": (np.array([0.1, -0.8, slope]), lambda a, b: -np.log(grid) - b - 0.5 * np.log(2 * np.pi) - 0.5 * ((np.log(grid) - a) / np.exp(b)) ** 2),
    }
    for kind, (theta, law) in laws.items():
        expected = np.log((np.exp(body + law(*theta[:2])[None]) * step).sum(1))
        got = background.Background(kind, theta, 48).log_density(x, term, shapes, logs)
        assert np.allclose(got, expected, atol=2e-3), kind


def test_quantiles_of_both_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(rng.uniform(0.1, 5, (101, 2)))], "id long, shells array<double>, data_term double")
    config, shapes = mixture.MixtureConfig(background_distribution=mixture.BACKGROUNDS[1]), np.array([4.0, 4.0])
    local = background._Model(mixture.Shells(rows, shapes, config), config)
    monkeypatch.setattr(mixture, "LOCAL_ROWS", 10)
    spread = background._Model(mixture.Shells(rows, shapes, config), config)
    assert np.allclose(local.quantiles([0.0, 0.31, 0.5, 0.995]), spread.quantiles([0.0, 0.31, 0.5, 0.995]))


def test_assignment(spark):
    cores = spark.createDataFrame([(7, [0.0, 0.0], 0.5), (8, [3.0, 3.0], 0.4)], "label long, features array<float>, radius double")
    rows = spark.createDataFrame([(1, [0.1, 0.1]), (2, [2.8, 3.1]), (3, [1.5, 1.5])], "id long, features array<float>")
    assert {(r["id"], r["label"]) for r in assign.assign(rows, cores, 0.5).collect()} == {(1, 7), (2, 8)}


def test_density_columns(spark):
    graph = spark.createDataFrame([(0, [1, 2], [0.0, 2.0]), (1, [0, 2], [1.0, 3.0])], "id long, nbr array<long>, dist array<float>")
    rows = {r["id"]: r["signature"] for r in density.multiscale_signatures(graph, (1, 2)).collect()}
    assert abs(rows[1][1] + np.log(3)) < 1e-6 and np.isfinite(rows[0][0])
    with pytest.raises(ValueError):
        density.check_ranks((2, 2), 3)
