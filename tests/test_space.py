"""Cells against brute force: exact neighbours, pairs within a radius, nearest denser rows; bounds on what a task holds."""

import numpy as np
import pytest

from shellcluster.operators import comparators, descent, knn, space
from shellcluster.plans import queries


def shapes():
    """A clump of half the rows, a crowd at one place, few and many dimensions."""
    rng = np.random.default_rng(0)
    return {
        "clump": np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(400, 2)) * 1e-3]),
        "crowd": np.concatenate([rng.normal(size=(300, 2)), np.zeros((400, 2)), np.round(rng.normal(size=(200, 2)), 1)]),
        "line": rng.normal(size=(500, 1)),
        "flat": rng.normal(size=(600, 8)) * np.array([3, 2, 1, 0.1, 0.1, 0.1, 0.1, 0.1]),
        "even": rng.normal(size=(300, 16)),
    }


@pytest.fixture(params=[*shapes(), "flat in blocks", "flat dealt"])
def rows(request, spark, monkeypatch):
    for name, v in (("CELL", 64), ("BLOCK", 200), ("SEARCHERS", 300), ("AT_ONCE", 150)):
        monkeypatch.setattr(space, name, v)
    name, _, how = request.param.partition(" ")
    if how:  # beyond three dimensions either way may be the cheaper one
        monkeypatch.setattr(space, "costly", lambda *a: how == "in blocks")
        monkeypatch.setattr(space, "BLOCK_BYTES", 20_000)
    x = shapes()[name].astype(np.float32).astype(float)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(dist, np.inf)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>").repartition(3).cache()
    return df, x, dist


def nearest(dist, k):
    return np.lexsort((np.broadcast_to(np.arange(len(dist)), dist.shape), dist), axis=1)[:, :k]


def test_neighbours(rows):
    df, x, dist = rows
    found = {r["id"]: (r["nbr"], r["dist"]) for r in space.neighbours(df, 5, *x.shape, knn.top_k).collect()}
    wanted = nearest(dist, 5)
    assert len(found) == len(x)
    for i, (ids, far) in found.items():
        assert ids == wanted[i].tolist() and np.allclose(far, dist[i, wanted[i]])


def test_too_many_pairs_are_told(rows):
    df, x, _ = rows
    assert space.neighbours(df, 5, *x.shape, knn.top_k, most=0.0001) is None


def test_pairs_within_a_radius(rows):
    df, x, dist = rows
    for eps in (float(np.quantile(dist[np.isfinite(dist)], 0.02)) + 1e-9, 1e-12):
        found = [(r["src"], r["dst"]) for r in space.range_pairs(df, eps, *x.shape).collect()]
        assert sorted(found) == sorted(zip(*(a.tolist() for a in np.nonzero(dist <= eps))))
        assert 0 < space.compared(df, eps, *x.shape) <= 1


def test_nearest_denser_rows(spark, rows):
    df, x, dist = rows
    n = len(x)
    rho = np.round(np.random.default_rng(1).random(n), 2)  # many are alike
    dense = df.join(spark.createDataFrame([(i, float(r)) for i, r in enumerate(rho)], "id long, rho double"), "id").cache()
    wanted = {}
    for i in range(n):
        before = np.flatnonzero((rho > rho[i]) | ((rho == rho[i]) & (np.arange(n) < i)))
        if len(before):
            wanted[i] = min(before.tolist(), key=lambda j: (dist[i, j], -rho[j], j))
    near = nearest(dist, 6)
    lists = spark.createDataFrame([(i, near[i].tolist(), dist[i, near[i]].tolist()) for i in range(n)], "id long, nbr array<long>, dist array<float>")
    for given in (None, lists):
        found, share = space.nearest_before(dense, *x.shape, given)
        found = {r["id"]: (r["parent"], r["delta"]) for r in found.collect()}
        assert {i: p for i, (p, _) in found.items()} == wanted and share > 0
        assert all(np.isclose(d, dist[i, p]) for i, (p, d) in found.items())


def test_clumps_are_split_after_they_are_counted(spark):
    """A sample of a thirtieth doesn't show a clump's inner; its cells are split by samples of their own."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.uniform(size=(12_000, 2)), 0.5 + rng.normal(size=(12_000, 2)) * 1e-6]).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>")
    part = space.partition(df, len(x), 2)
    assert part.cells.count.sum() == len(x) and part.cells.count[~part.cells.single()].max() <= 2 * space.CELL
    boxes = part.cells
    assert (boxes.assign(x.astype(float)) < boxes.n_leaves).all()


def test_bounds_hold_every_row(rows):
    """No cell that holds a row within the radius is left out, and enough rows are within the far bound."""
    df, x, dist = rows
    for cells in (space.Boxes(x, 20), space.Pivots(x[::9])):
        own = cells.assign(x)
        m = cells.measure(x, own)
        low, high = np.full((cells.n_leaves, m.shape[1]), np.inf), np.full((cells.n_leaves, m.shape[1]), -np.inf)
        np.minimum.at(low, own, m), np.maximum.at(high, own, m)
        cells.bound(low, high, np.bincount(own, minlength=cells.n_leaves))
        radius = np.sort(dist, axis=1)[:, 7]
        seen = set(zip(*(a.tolist() for a in cells.reach(x, radius))))
        assert all((i, own[j]) in seen for i, j in zip(*np.nonzero(dist <= radius[:, None])))
        far = cells.within(x, 7)
        assert ((dist <= far[:, None]).sum(axis=1) >= 7).all()


def graph_frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.asarray(x, np.float32))], "id long, features array<float>").repartition(4).cache()


@pytest.mark.parametrize("d", [2, 16])
def test_refined_graph(spark, d):
    """Lists that begin with few buckets find nearly all neighbours; each row has k of them."""
    x = np.random.default_rng(42).normal(size=(3000, d))
    df = graph_frame(spark, x)
    graph = knn.build_knn_graph(df, k=12, backend="descent").cache()
    knn.validate(graph, 12, deep=True)
    exact = knn.block_graph(df, df, 12, 3000, d).cache()
    assert knn.recall(graph, exact, 4) >= 0.99 and knn.recall(graph, exact, 12) >= 0.98


def test_refinement_of_crowds_and_hubs(spark):
    """Rows at one place, one row near all others, and rows that no bucket brings together with others."""
    rng = np.random.default_rng(1)
    sphere = rng.normal(size=(500, 6))
    x = np.concatenate([np.zeros((300, 6)), sphere / np.linalg.norm(sphere, axis=1, keepdims=True), 50 * rng.normal(size=(20, 6))])
    df = graph_frame(spark, x)
    graph = knn.build_knn_graph(df, k=5, backend="descent", config=knn.LSHConfig(max_bucket=64, bucket=32)).cache()
    knn.validate(graph, 5, deep=True)
    told = {r["id"]: r["dist"] for r in graph.collect()}
    full = np.sqrt(((x[:, None].astype(np.float32) - x[None].astype(np.float32)) ** 2).sum(axis=2))
    np.fill_diagonal(full, np.inf)
    best = np.sort(full, axis=1)[:, :5]
    assert np.mean([np.allclose(told[i], best[i], atol=1e-5) for i in range(len(x))]) >= 0.95


def test_meetings_against_all_pairs():
    """What a meeting gives is each fresh pair that is nearer than the list's last, with its distance."""
    rng = np.random.default_rng(2)
    size = np.array([3, 1, 5, 2])
    ids, x, fresh, last = np.arange(11) * 7, rng.normal(size=(11, 3)), rng.random(11) < 0.5, rng.uniform(0.5, 3, 11)
    src, dst, dist = descent._pairs(ids, x, size, fresh, last)
    group = np.repeat(np.arange(4), size)
    wanted = {(ids[i], ids[j]) for i in range(11) for j in range(11) if i != j and group[i] == group[j] and (fresh[i] or fresh[j]) and np.linalg.norm(x[i] - x[j]) < last[i]}
    assert set(zip(src, dst)) == wanted and len(src) == len(wanted)
    assert np.allclose(dist, np.linalg.norm(x[src // 7] - x[dst // 7], axis=1))


@pytest.mark.parametrize("d,eps", [(2, 0.5), (2, 3.0), (12, 3.2), (12, 5.0)])
def test_dbscan_without_pairs_is_dbscan(spark, monkeypatch, d, eps):
    x = np.vstack([np.random.default_rng(d).normal(c, 1, (110, d)) for c in (0, 4)]).astype(np.float32)
    points = spark.createDataFrame([(1000 - 3 * i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>")
    whole = {r["id"]: r["label"] for r in comparators.dbscan(points, eps).collect()}
    monkeypatch.setattr(comparators, "MOST_PAIRS", 0)
    monkeypatch.setattr(comparators, "PAIRS_A_ROW", 0)
    monkeypatch.setattr(comparators, "ANCHORS", 3)
    monkeypatch.setattr(knn, "range_edges", None)  # no pair may be written
    assert whole == {r["id"]: r["label"] for r in comparators.dbscan(points, eps).collect()}


@pytest.mark.parametrize("bytes_", [1 << 26, 4000])
def test_far_ranks_come_from_the_far_end(spark, monkeypatch, bytes_):
    x = np.random.default_rng(8).normal(size=(90, 12)).astype(np.float32)
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>")
    found = {r["id"]: r["d"] for r in knn.far_distance(points, 10, 90, 12, bytes_).collect()}
    y = x.astype(float)
    expected = np.sort(np.sqrt(((y[:, None] - y[None]) ** 2).sum(2)), axis=1)[:, -10]
    assert np.array_equal([found[i] for i in range(90)], expected.astype(np.float32).astype(float))
    monkeypatch.setattr(comparators, "_graph", None)  # no list of nearest rows may be made
    comparators.run_amd_dbscan(points, "high_dim")


@pytest.mark.parametrize("kind", ["apart", "copies"])
@pytest.mark.parametrize("d", [1, 2, 3])
def test_density_peaks_without_lists(spark, monkeypatch, kind, d):
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(350, d)), rng.normal(size=(250, d)) * 0.05 + 3])
    x = np.repeat(np.round(x[:200], 1), 3, axis=0) if kind == "copies" else x
    points = spark.createDataFrame([(5000 - i, r.tolist()) for i, r in enumerate(x)], "id long, features array<float>").repartition(3)
    by_lists = {r["id"]: r for r in comparators.peak_state(points).collect()}
    monkeypatch.setattr(comparators, "PEAK_ENTRIES", 0)
    monkeypatch.setattr(comparators, "peak_graph", None)  # no list may be made
    monkeypatch.setattr(space, "LEAF", 8)
    monkeypatch.setattr(space, "GROUP_LEAVES", 4)
    found = {r["id"]: r for r in comparators.peak_state(points).collect()}
    assert found.keys() == by_lists.keys() and len(found) == 600
    near = [i for i in found if abs(found[i]["rho"] - by_lists[i]["rho"]) < 1e-6]
    assert len(near) == 600
    if kind == "apart":
        assert all(found[i]["parent"] == by_lists[i]["parent"] and abs(found[i]["delta"] - by_lists[i]["delta"]) < 1e-9 for i in found)
    # by brute force, in the order of the densities found
    y = x.astype(np.float32).astype(float)
    for i in range(0, 600, 7):
        own = found[5000 - i]
        before = [j for j in range(600) if (-found[5000 - j]["rho"], 5000 - j) < (-own["rho"], 5000 - i)]
        far = np.sqrt(((y - y[i]) ** 2).sum(axis=1))
        assert abs(own["delta"] - (min(far[before]) if before else far.max())) < 1e-9
        assert own["parent"] == (5000 - min(before, key=lambda j: (far[j], -found[5000 - j]["rho"], 5000 - j)) if before else -1)


def test_the_query_of_peak_centers_makes_no_lists_beyond_the_bound(spark, monkeypatch):
    whole = sorted(r["center"] for r in queries.peak_centers(spark, "/root/testdata/sf0.01").collect())
    monkeypatch.setattr(comparators, "PEAK_ENTRIES", 0)
    monkeypatch.setattr(comparators, "peak_graph", None)
    assert sorted(r["center"] for r in queries.peak_centers(spark, "/root/testdata/sf0.01").collect()) == whole
