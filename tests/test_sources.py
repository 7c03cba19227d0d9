"""Backgrounds that follow from the other rows, and what is kept of labelings."""

import numpy as np
import pytest

from shellcluster.sources import files, synthetic


@pytest.mark.parametrize("family", ["moons", "rings", "gaussian_overlap", "gaussian_imbalanced"])
def test_background_fills_the_box_of_the_signal(spark, family):
    spec = {"family": family, "noise_fraction": 0.5} | ({"dimension": 3} if family.startswith("gaussian") else {})
    made = synthetic.family_of(spec, 9000, 7)
    rows = synthetic.generate(spark, made, 7).collect()
    x, y = np.array([r["features"] for r in rows]), np.array([r["y"] for r in rows])
    assert np.bincount(y + 1).tolist() == [made.counts[-1], *made.counts[:-1]]
    low, high = x[y >= 0].min(axis=0) - 2.5, x[y >= 0].max(axis=0) + 2.5
    noise = (x[y < 0] - low) / (high - low)
    assert noise.min() >= -1e-6 and noise.max() <= 1 + 1e-6
    assert (np.abs(noise.mean(axis=0) - 0.5) < 0.02).all() and noise.min(axis=0).max() < 0.01 and noise.max(axis=0).min() > 0.99
    again = synthetic.generate(spark, made, 7).repartition(3).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_signal_does_not_depend_on_the_box(spark):
    with_noise = synthetic.moons_or_rings("moons", 400, noise_fraction=0.5)
    points = {r["id"]: r["features"] for r in synthetic.generate(spark, with_noise, 3).where("y >= 0").collect()}
    with_noise.margin = 9.0
    assert points == {r["id"]: r["features"] for r in synthetic.generate(spark, with_noise, 3).where("y >= 0").collect()}


def test_state_and_its_contingency(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 2), (1, 1, 2), (2, -1, 2), (3, 0, -1)], "id long, y long, p long")
    path = f"{tmp_path}/state"
    files.write_state(rows.withColumn("y", rows["y"]), path)
    told = {tuple(r) for r in spark.read.parquet(f"{path}-contingency").collect()}
    assert told == {(1, 2, 2), (-1, 2, 1), (0, -1, 1)} and files.check_state(spark, path)
    rows.where("id > 0").write.mode("overwrite").parquet(path)
    assert not files.check_state(spark, path)
