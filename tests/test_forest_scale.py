"""The forest that is grown from packed rows: bytes kept, splits, draws and passes."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from netweave.operators import forest as FO
from netweave.operators import ml as ML


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(6000).select(F.round(F.randn(1)).alias("a"), F.randn(2).alias("b"), F.randn(3).alias("c"), F.lit(7.0).alias("d"), F.rand(4).alias("u"))
    odds = 1 / (1 + F.exp(-(2 * F.col("a") + 3 * F.col("b") * F.col("c"))))
    df = df.withColumn("label", (F.col("u") < odds).cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features").transform(df).select("features", "label").cache()


def grown(model):
    return [t.toDebugString.split("\n", 1)[1] for t in model.trees]


def test_a_row_is_kept_as_a_byte_a_feature(rows, monkeypatch):
    """Before, a row took some 500 bytes and 400 more for its nodes, for 100 trees."""
    assert isinstance(ML.attack_pipeline().getStages()[-1], FO.ForestClassifier)
    seen, grow = [], FO.ForestClassifier._grow

    def spied(self, blocks, splits, classes):
        seen.append(blocks.agg(F.sum(F.length("codes")), F.sum("n"), F.max("n")).first())
        return grow(self, blocks, splits, classes)

    monkeypatch.setattr(FO.ForestClassifier, "_grow", spied)
    model = FO.ForestClassifier(numTrees=2, maxDepth=1, seed=5).fit(rows)
    assert seen[0][:2] == (5 * 6000, 6000) and seen[0][2] <= FO.BLOCK
    assert model.getNumTrees == 2 and all(t.depth <= 1 for t in model.trees)


def test_forest_is_as_good_as_sparks(rows):
    fit = dict(numTrees=20, maxDepth=6, seed=3)
    right = {}
    for cls in (RandomForestClassifier, FO.ForestClassifier):
        model = cls(**fit).fit(rows)
        right[cls] = model.transform(rows).where("prediction = label").count() / 6000
        size, weight = model.totalNumNodes, model.featureImportances.toArray()
        right[cls] = (right[cls], size, weight)
    (a, n, w), (b, m, v) = right.values()
    assert abs(a - b) < 0.02 and abs(n - m) < 0.15 * n and np.abs(w - v).max() < 0.1 and v[3] == 0


def test_trees_do_not_depend_on_the_passes(rows, monkeypatch):
    fit = lambda: grown(FO.ForestClassifier(numTrees=4, maxDepth=9, seed=8).fit(rows))
    one = fit()
    monkeypatch.setattr(FO, "HISTOGRAM_MB", 0)  # as many passes as CHUNK nodes at a time need
    assert fit() == one and len(set(one)) == 4


def test_splits_and_draws():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 9, (40, 3, 6, 2))
    counts[:, 1:] = 0
    for f in (1, 2):  # every feature splits the same rows
        for i in range(40):
            whole = counts[i, 0].sum(axis=0)
            counts[i, f] = np.array([rng.multinomial(whole[c], [1 / 6] * 6) for c in range(2)]).T
    n_splits = np.tile([5, 3, 0], (40, 1))
    gini = lambda c: 1 - ((c / c.sum()) ** 2).sum()
    feature, at, gain, left, right = FO.best_splits(counts, n_splits, 2, 0.0)
    for i in range(40):
        best = (-1.0, 0, 0)
        for f in range(3):
            for b in range(n_splits[i, f]):
                x, y = counts[i, f, :b + 1].sum(axis=0), counts[i, f, b + 1:].sum(axis=0)
                if min(x.sum(), y.sum()) >= 2:
                    n = x.sum() + y.sum()
                    best = max(best, (gini(x + y) - x.sum() / n * gini(x) - y.sum() / n * gini(y), -f, -b))
        assert gain[i] == pytest.approx(best[0]) and (feature[i], at[i]) == (-best[1], -best[2])
        assert (left[i] + right[i] == counts[i, 0].sum(axis=0)).all()
    draws = FO.poisson_draws(1.0)
    assert draws.mean() == pytest.approx(1, abs=1e-3) and (draws == 0).mean() == pytest.approx(np.exp(-1), abs=1e-4)
    assert FO.continuous_splits(np.array([3.0, 1.0, 1.0, 2.0]), 31).tolist() == [1.5, 2.5]
    cut = FO.continuous_splits(rng.normal(size=5000), 31)
    assert len(cut) == 31 and (np.diff(cut) > 0).all() and len(FO.continuous_splits(np.ones(9), 31)) == 0


def test_odd_training_rows(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        FO.ForestClassifier(numTrees=2).fit(rows.limit(0))
    with pytest.raises(ValueError, match="invalid label"):
        FO.ForestClassifier(numTrees=2).fit(rows.withColumn("label", F.lit(None).cast("double")))
    one = FO.ForestClassifier(numTrees=2).fit(rows.withColumn("label", F.lit(0.0)))
    assert one.numClasses == 1 and one.totalNumNodes == 2
    three = FO.ForestClassifier(numTrees=3).fit(rows.withColumn("label", F.col("label") * 2))
    assert three.numClasses == 3
    assert one.transform(rows).first().probability.toArray().tolist() == [1.0]
