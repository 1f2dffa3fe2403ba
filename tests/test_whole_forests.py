"""Forests are fitted on all rows, however many, and trees in parts are the trees in one piece."""

import numpy as np
import pytest

from stagelens.operators import forest as FO
from stagelens.operators import improve as I


def table(spark, n):
    rng = np.random.default_rng(3)
    x = rng.random((n, 2)).round(4)
    y = x[:, 0] + x[:, 1] ** 2 + rng.random(n)
    return x, y, spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, a double, b double, y double")


def test_a_forest_is_fitted_on_all_rows(spark):
    x, y, df = table(spark, 12_000)
    forest = FO.fit_forest(df.repartition(5), ["a", "b"], "y", ["k"], 2, 4)
    plain = [FO.grow(x, y, FO.drawn(12_000, k, 42), 4) for k in range(2)]
    assert forest.rows == 12_000
    assert np.allclose(forest.importances, np.mean([g / g.sum() for _, g in plain], 0))
    assert np.allclose(forest.predict(x), np.mean([t.predict(x) for t, _ in plain], 0))


def test_folds_are_fitted_on_all_other_rows(spark, monkeypatch):
    _, _, df = table(spark, 13_000)
    seen, fit = [], FO.fit_forest
    monkeypatch.setattr(I, "fit_forest", lambda *a, **b: seen.append(fit(*a, **b)) or seen[-1])
    got = I.cross_validate(df, ["a", "b"], "y", ["k"], trees=1, depth=2).collect()
    assert sum(r.n for r in got) == 13_000 and [f.rows for f in seen] == [13_000 - r.n for r in sorted(got)]


def test_training_takes_all_rows_of_its_share(spark):
    _, _, df = table(spark, 13_000)
    forest = I.training_forest(df, ["a", "b"], "y", ["k"], trees=1, depth=2)
    assert forest.rows == df.filter(I.in_training(0.8, "k")).count() > 10_000


@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("depth", [2, 30])
def test_a_tree_in_parts_is_the_tree_in_one_piece(spark, ties, depth):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(400, 3)).round(1 if ties else 6)
    y = 3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=400)
    w = FO.drawn(400, 1, 7)

    def blocks():
        for i in range(0, 400, 64):
            yield i, x[i : i + 64], y[i : i + 64]

    def ordered(f):
        order = np.argsort(x[:, f], kind="stable")
        for i in range(0, 400, 50):
            yield order[i : i + 50], x[order[i : i + 50], f], y[order[i : i + 50]]

    whole, gains = FO.grow(x, y, w, depth)
    tree, parts = FO.grow_in_parts(blocks, ordered, w, 3, depth, 30)
    points = np.vstack([x, rng.normal(size=(100, 3))])
    assert np.allclose(tree.predict(points), whole.predict(points)) and np.allclose(parts, gains)
    assert len(tree.feature) == len(whole.feature)


def test_a_forest_from_files_by_feature_is_the_same(spark):
    x, _, df = table(spark, 900)
    whole = FO.fit_forest(df, ["a", "b"], "y", ["k"], 3)
    parts = FO.fit_forest(df.repartition(3), ["a", "b"], "y", ["k"], 3, part=100)
    assert np.allclose(whole.importances, parts.importances) and np.isclose(whole.unseen_r2, parts.unseen_r2)
    assert np.allclose(whole.predict(x), parts.predict(x))
