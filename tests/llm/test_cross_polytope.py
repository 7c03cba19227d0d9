"""Nearest neighbours by cross-polytope hashing against brute force, and what hashing and fitting promise."""

import numpy as np
import pytest

pytest.importorskip("shellcluster.llm")

from pyspark.sql import functions as F

from shellcluster.llm import cross_polytope, queries

SCHEMA = "vec_id long, embedding array<double>, label string, bucket int, vec string"


def table(seed=0, n=1200, d=24):
    """Clusters, copies of one vector (a third of the rows), lengths from 0.1 to 30, and rows that take no part."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)) + 3 * rng.normal(size=(20, d))[rng.integers(0, 20, n)], 3) * rng.choice([0.1, 1, 1, 1, 2, 5], n)[:, None]
    x[n // 2 : n // 2 + n // 3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[3], rows[20], (20, [9.0] * d)]  # rows and ids twice
    bad = [(None, [1.0] * d), (5000, None), (5020, [0.0] * d), (5040, [None] + [1.0] * (d - 1)), (5060, [float("nan")] * d), (5080, [float("inf")] + [0.0] * (d - 1)), (5100, [1.0] * (d + 1)), (5120, [])]
    return rows, bad


def kept(rows):
    found = {}
    for i, v in rows:
        found[i] = min(found.get(i, v), v)
    return found


def brute(found, k):
    ids = np.array(sorted(found))
    x = np.array([found[i] for i in ids])
    out = {}
    for q in ids[ids % 20 == 0]:
        score = cross_polytope.products(np.broadcast_to(found[q], x.shape), x)
        score[ids == q] = -np.inf
        order = np.lexsort((ids, -score))[: min(k, len(ids) - 1)]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows, bad = table()
    return rows, spark.createDataFrame([(i, v, "x", 1, None) for i, v in rows + bad], SCHEMA).repartition(4).cache()


def check(found, wanted, least):
    assert set(found) == set(wanted)
    hits = total = 0
    for q, rows in found.items():
        assert [r for r, _, _ in rows] == list(range(1, len(wanted[q]) + 1))
        assert [(i, s) for _, i, s in rows] == sorted(((i, s) for _, i, s in rows), key=lambda x: (-x[1], x[0]))
        assert all(i != q for _, i, _ in rows)
        hits += len({i for _, i, _ in rows} & {i for i, _ in wanted[q]})
        total += len(wanted[q])
    assert hits >= least * total


def test_recall_and_scores(data):
    """Scores are exact, copies stand in order of ids, and rows that take no part are neither asked nor found."""
    rows, df = data
    wanted = brute(kept(rows), 20)
    found = answers(cross_polytope.nearest(df, F.col("vec_id") % 20 == 0))
    check(found, wanted, 0.9)
    whole = kept(rows)
    for q, told in found.items():
        for _, i, s in told:
            assert s == cross_polytope.products(np.array([whole[q]]), np.array([whole[i]]))[0]
    assert [i for _, i, _ in found[600]] == [i for i, _ in wanted[600]]  # one of the copies: nearest are long vectors or its copies


@pytest.mark.parametrize("block", [(50, 7), (4096, 4096)])
def test_blocks_of_buckets_and_exact_way(data, monkeypatch, block):
    """Where no setting reaches the recall all vectors are compared, in blocks of any size: nothing is missed."""
    rows, df = data
    monkeypatch.setattr(cross_polytope, "BLOCK", block[0])
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", block[1])
    monkeypatch.setattr(cross_polytope, "fit", lambda *a: None)
    found = answers(cross_polytope.nearest(df, F.col("vec_id") % 20 == 0, k=5))
    assert {q: [(i, s) for _, i, s in r] for q, r in found.items()} == brute(kept(rows), 5)


def test_large_buckets_are_split(data, monkeypatch):
    rows, df = data
    asked = F.col("vec_id") % 20 == 0
    whole = answers(cross_polytope.nearest(df, asked, k=7))
    monkeypatch.setattr(cross_polytope, "BLOCK", 10)
    monkeypatch.setattr(cross_polytope, "QUERY_BLOCK", 3)
    monkeypatch.setattr(cross_polytope, "GATHER", 100)
    assert answers(cross_polytope.nearest(df, asked, k=7)) == whole


def test_query_over_the_given_table(spark):
    at = "/root/testdata/sf0.001"
    found = answers(queries.op11_cross_polytope(spark, at))
    rows = {r["vec_id"]: [float(v) for v in r["embedding"]] for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()}
    check(found, brute(rows, 20), 0.9)


def test_few_rows(spark, data):
    _, df = data
    asked = F.col("vec_id") % 20 == 0
    assert cross_polytope.nearest(df.limit(0), asked).collect() == []
    assert cross_polytope.nearest(df.where("vec_id = 20"), asked).collect() == []
    assert cross_polytope.nearest(df.where("vec_id IN (1, 2)"), asked).collect() == []
    assert {q: [i for _, i, _ in r] for q, r in answers(cross_polytope.nearest(df.where("vec_id IN (7, 40, 41)"), asked)).items()} == {40: [i for i, _ in brute(kept([x for x in table()[0] if x[0] in (7, 40, 41)]), 20)[40]]}


def test_hashing():
    """Turns keep lengths; the first probe is the bucket itself, and all probes together are all buckets."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cells in (2, 16, 40, 200, 2000):
        tables = cross_polytope.Tables(10, 2, cells)
        for t in range(2):
            probes = tables.probes(x, t, tables.n_cells)
            assert (probes[:, 0] == tables.buckets(x, t)).all()
            assert all(len(set(p)) == len(p) == min(tables.n_cells, len(p)) for p in probes.tolist())
            assert probes.max() < tables.n_cells
    assert np.allclose(np.linalg.norm(cross_polytope.Tables(16, 1, 64).turned(np.eye(16), 0, 0), axis=1), 1)


def test_lengths_on_the_sphere():
    """Nearness there is nearness by inner product."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(40, 6)) * rng.uniform(0.1, 9, (40, 1)), rng.normal(size=(5, 6))
    at = cross_polytope.on_sphere(x, np.linalg.norm(x, axis=1).max(), False)
    assert np.allclose(np.linalg.norm(at, axis=1), 1)
    assert (np.argsort(cross_polytope.direction(q, False) @ at.T) == np.argsort(q @ x.T)).all()
