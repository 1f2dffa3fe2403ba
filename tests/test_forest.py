"""Trees, the search over a fitted forest, and clusters, against plain loops."""

import itertools

import numpy as np
import pytest

from stagelens.operators import cluster as CL
from stagelens.operators import forest as FO
from stagelens.operators import improve as I


def plain_tree(x, y, w, depth):
    """(predict, gains) of a tree by recursion over all cuts."""
    gains = np.zeros(x.shape[1])

    def sse(rows):
        m = np.average(y[rows], weights=w[rows])
        return (w[rows] * (y[rows] - m) ** 2).sum()

    def grow(rows, depth):
        best = None
        if depth and sse(rows) > 1e-9:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for a, b in zip(values, values[1:]):
                    cut = (a + b) / 2
                    low = rows[x[rows, f] <= cut]
                    high = rows[x[rows, f] > cut]
                    gain = sse(rows) - sse(low) - sse(high)
                    if best is None or gain > best[0] * (1 + 1e-9):
                        best = gain, f, cut, low, high
        if best is None:
            mean = np.average(y[rows], weights=w[rows])
            return lambda p: mean
        gain, f, cut, low, high = best
        gains[f] += gain
        left, right = grow(low, depth - 1), grow(high, depth - 1)
        return lambda p: left(p) if p[f] <= cut else right(p)

    return grow(np.flatnonzero(w), depth), gains


@pytest.mark.parametrize("depth", [1, 3, 30])
@pytest.mark.parametrize("ties", [False, True])
def test_trees_against_recursion(depth, ties):
    rng = np.random.default_rng(depth + ties)
    x = rng.normal(size=(60, 3)).round(1 if ties else 6)
    y = 3 * x[:, 0] + x[:, 1] ** 2 + rng.normal(size=60)
    for number in range(3):
        w = FO.drawn(60, number, 7)
        tree, gains = FO.grow(x, y, w, depth)
        predict, expected = plain_tree(x, y, w.astype(float), depth)
        assert np.allclose(gains, expected, atol=1e-6)
        points = np.vstack([x, rng.normal(size=(50, 3))])
        assert np.allclose(tree.predict(points), [predict(p) for p in points])


def test_constant_target_and_constant_feature():
    x = np.column_stack([np.ones(10), np.arange(10.0)])
    tree, gains = FO.grow(x, np.full(10, 4.0), np.ones(10, int), 30)
    assert len(tree.feature) == 1 and gains.sum() == 0 and (tree.predict(x) == 4).all()
    tree, gains = FO.grow(x, np.arange(10.0), np.ones(10, int), 30)
    assert gains[0] == 0 and np.allclose(tree.predict(x), np.arange(10.0))


def pairs(spark, n=80):
    rng = np.random.default_rng(5)
    rows = [(i, "Paid" if i % 2 else "Free", float(u), float(s), float(a), float(50 * u + 30 * s - 10 * a + rng.normal()), 70.0 + i % 5)
            for i, (u, s, a) in enumerate(rng.random((n, 3)).round(3))]
    return spark.createDataFrame(rows, "pair int, segment string, U_AB double, S_AB double, A_AB double, DPI_AB double, baseline double")


def test_forest_is_the_mean_of_its_trees(spark):
    df = pairs(spark)
    forest = FO.fit_forest(df, I.AXES, "DPI_AB", ["pair"], 12)
    rows = df.orderBy("pair").collect()
    x, y = np.array([[r[c] for c in I.AXES] for r in rows]), np.array([r.DPI_AB for r in rows])
    plain = [plain_tree(x, y, FO.drawn(80, k, 42).astype(float), 30) for k in range(12)]
    assert np.allclose(forest.importances, np.mean([g / g.sum() for _, g in plain], 0))
    said = {r.pair: r.prediction for r in FO.with_prediction(df, forest).collect()}
    assert np.allclose([said[i] for i in range(80)], [np.mean([p(v) for p, _ in plain]) for v in x])
    unseen = [[p(v) for k, (p, _) in enumerate(plain) if FO.drawn(80, k, 42)[i] == 0] for i, v in enumerate(x)]
    keep = [i for i, u in enumerate(unseen) if u]
    error = np.array([y[i] - np.mean(unseen[i]) for i in keep])
    assert np.isclose(forest.unseen_r2, 1 - (error**2).sum() / ((y[keep] - y[keep].mean()) ** 2).sum())


def test_forest_on_a_bounded_sample(spark):
    df = pairs(spark, 400)
    forest = FO.fit_forest(df, I.AXES, "DPI_AB", ["pair"], 5, most=100, keep=False)
    assert 60 < forest.rows < 150 and forest.trees == [] and np.isclose(forest.importances.sum(), 1)
    again = FO.fit_forest(df.repartition(7), I.AXES, "DPI_AB", ["pair"], 5, most=100, keep=False)
    assert np.array_equal(forest.importances, again.importances)


def test_forest_without_rows(spark):
    df = pairs(spark).filter("pair < 0")
    forest = FO.fit_forest(df, I.AXES, "DPI_AB", ["pair"], 5)
    assert forest.rows == 0 and forest.trees == []
    assert FO.first_split(df, I.AXES, "DPI_AB", ["pair"]).collect() == []


def plain_rise(forest, base, goal, use_a):
    """All 21 ** 3 rises, one after the other by cost."""
    steps = range(I.STEPS + 1)
    grid = [(u, s, a) for u, s, a in itertools.product(steps, steps, steps if use_a else (0,))]
    said = forest.predict(np.clip(base + np.array(grid) * I.STEP, 0, 1))
    good = [(sum(g), g, p) for g, p in zip(grid, said) if p >= goal]
    if good:
        _, g, p = min(good)
        return *g, p, True
    _, g = min((-p, g) for g, p in zip(grid, said))
    return *g, said.max(), False


def test_cheapest_rise_against_the_whole_grid(spark):
    df = pairs(spark).withColumn("baseline", df_baseline())
    forest = FO.fit_forest(df, I.AXES, "DPI_AB", ["pair"], 8)
    got = {r.pair: r for r in I.minimal_improvement_fitted(df, forest, ["pair"]).collect()}
    assert len(got) == 80 and {r.converted for r in got.values()} == {True, False}
    for r in df.collect():
        u, s, a, said, ok = plain_rise(forest, np.array([r[c] for c in I.AXES]), r.baseline, True)
        g = got[r.pair]
        assert g.converted == ok and np.isclose(g.predicted, said)
        assert [round(100 * g[c]) for c in ("dU", "dS", "dA")] == [u, s, a]


def df_baseline():
    from pyspark.sql import functions as F

    return F.col("DPI_AB") + (F.col("pair") % 7) * 4 - 2


def test_axis_that_is_constant_stays(spark):
    from pyspark.sql import functions as F

    df = pairs(spark).withColumn("A_AB", F.lit(0.5))
    forest = FO.fit_forest(df, I.AXES, "DPI_AB", ["pair"], 4)
    assert {r.dA for r in I.minimal_improvement_fitted(df, forest, ["pair"]).collect()} == {0.0}


# --- clusters -----------------------------------------------------------------------------------


def plain_kmeans(x, centres, passes):
    for _ in range(passes):
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c for i, c in enumerate(centres)])
        if np.allclose(new, centres, rtol=0, atol=1e-12):
            break
        centres = new
    return centres, ((x[:, None] - centres[None]) ** 2).sum(2).min(1).sum()


def plain_silhouette(x, centres):
    near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    far = ((x[:, None] - x[None]) ** 2).sum(2)
    out = []
    for i in range(len(x)):
        own = far[i, near == near[i]].sum() / max((near == near[i]).sum() - 1, 1)
        other = min(far[i, near == c].mean() for c in set(near.tolist()) - {near[i]})
        out.append(0.0 if (near == near[i]).sum() == 1 else (other - own) / max(own, other))
    return np.mean(out)


def points(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 0.5, size=(60, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    return x, spark.createDataFrame([tuple(map(float, p)) for p in x], "z_a double, z_b double")


def test_fits_side_by_side_against_one_after_the_other(spark):
    x, df = points(spark)
    first = {(k, s): CL.first_centres(x, k, s) for k in (2, 3, 5) for s in range(3)}
    got = CL.kmeans(df, (2, 3, 5), first=first)
    for k in (2, 3, 5):
        plain = [plain_kmeans(x, first[k, s], CL.PASSES) for s in range(3)]
        best = min(plain, key=lambda p: p[1])
        assert np.isclose(got[k].inertia, best[1])
    said = CL.silhouettes(df, list(got.values()))
    assert np.allclose(said, [plain_silhouette(x, f.centres) for f in got.values()])


def test_clusters_of_repeated_points(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 20 + [(2.0, 2.0)] * 20, "z_a double, z_b double")
    got = CL.kmeans(df, (2, 3))
    assert np.isclose(got[2].inertia, 0) and np.isclose(got[3].inertia, 0)
    assert all(-1 <= s <= 1 for s in CL.silhouettes(df, list(got.values())))


def test_elbow_and_profiles(spark):
    _, df = points(spark)
    rows = CL.standardized(df.withColumnsRenamed({"z_a": "a", "z_b": "b"}), ["a", "b"])
    elbow = {r.k: r for r in CL.elbow(rows, ["a", "b"], (2, 3, 4)).collect()}
    assert elbow[2].inertia > elbow[3].inertia > elbow[4].inertia and elbow[3].silhouette > elbow[2].silhouette
    got = CL.cluster_profiles(rows, ["a", "b"], (3,), [("a > 3", "right")], "other").collect()
    assert sorted(r.n for r in got) == [60, 60, 60] and [r.profile for r in got].count("right") == 1
    nothing = rows.filter("a > 100")
    assert CL.elbow(nothing, ["a", "b"]).collect() == [] and CL.cluster_profiles(nothing, ["a", "b"], (2,), [("a > 3", "right")]).collect() == []
