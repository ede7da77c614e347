"""The joint fit: gradients against differences, the best state, and storage."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from marketloom.operators import joint as jt
from marketloom.operators import models as md


def samples(spark, n, seed, noise):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        x = rng.normal(size=3)
        gain = float(0.5 * x[0] - 0.2 * x[1] + 0.1 + noise * rng.normal())
        rows.append((k, Vectors.dense(x), int(gain > 0), gain))
    return spark.createDataFrame(rows, ["id", "features", "target_direction", "target_return"])


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, up, gain = rng.normal(size=(40, 3)), (rng.random(40) > 0.5) * 1.0, rng.normal(size=40)
    at = jt.JointModel(rng.normal(size=4), rng.normal(size=4))
    got = jt.sums(x, up, gain, at, at)
    assert got[0] == 40 and got[3] == pytest.approx((x * x).sum() + 40)
    for head in (0, 1):
        for slot in range(4):
            moved = []
            for h in (1e-6, -1e-6):
                w = [at.direction.copy(), at.returns.copy()]
                w[head][slot] += h
                moved.append(jt.sums(x, up, gain, jt.JointModel(*w), at)[1 + head])
            assert got[4 + 4 * head + slot] == pytest.approx((moved[0] - moved[1]) / 2e-6, rel=1e-5, abs=1e-6)


def test_extreme_scores_stay_finite():
    state = jt.JointModel(np.array([1e6, 0.0]), np.array([0.0, 0.0]))
    got = jt.sums(np.array([[1.0], [-1.0]]), np.array([0.0, 1.0]), np.zeros(2), state, state)
    assert np.isfinite(got).all() and got[1] == 200


def test_fit_approaches_the_generating_line_and_keeps_the_best(spark, tmp_path):
    train, held = samples(spark, 600, 1, 0.0), samples(spark, 200, 2, 0.0)
    model, losses = jt.fit(train, held, iterations=40)
    rows = losses.orderBy("iteration").collect()
    assert rows[0]["direction_loss"] == pytest.approx(np.log(2))
    best = min(rows, key=lambda r: r["total_loss"])
    assert [r["iteration"] for r in rows if r["chosen"]] == [best["iteration"]]
    assert best["total_loss"] < 0.5 * rows[0]["total_loss"]
    assert model.returns == pytest.approx([0.5, -0.2, 0.0, 0.1], abs=0.02)
    again = md.combined_loss(model.predict(held)).first()
    assert again["total_loss"] == pytest.approx(best["total_loss"])
    model.save(spark, str(tmp_path / "m"))
    loaded = jt.JointModel.load(spark, str(tmp_path / "m"))
    assert (loaded.direction == model.direction).all() and (loaded.returns == model.returns).all()


def test_validation_that_only_gets_worse_keeps_the_first_state(spark):
    train = samples(spark, 300, 1, 0.0)
    held = train.withColumn("target_return", -F.col("target_return")).withColumn(
        "target_direction", 1 - F.col("target_direction")
    )
    model, losses = jt.fit(train, held, iterations=30, patience=3)
    assert losses.count() == 4 and losses.filter("chosen").first()["iteration"] == 0
    assert not model.direction.any()


def test_missing_targets_and_missing_parts(spark):
    train = samples(spark, 30, 1, 0.1)
    bare = train.withColumn("target_return", F.lit(None).cast("double"))
    totals = [
        [r["total_loss"] for r in jt.fit(rows, train, iterations=2)[1].orderBy("iteration").collect()]
        for rows in (train.unionByName(bare), train)
    ]
    assert totals[0] == pytest.approx(totals[1])
    for a, b in ((bare, train), (train, bare), (bare, bare)):
        with pytest.raises(ValueError):
            jt.fit(a, b)
