"""The prototype index and the first centres of clusters come from all rows."""

import numpy as np

from stagelens.operators import cluster as CL
from stagelens.operators import forest as FO
from stagelens.operators import improve as I
from tests.test_whole_forests import table


def test_the_prototype_index_comes_from_all_rows(spark):
    x, y, df = table(spark, 21_000)
    unit = (x - x.min(0)) / (x.max(0) - x.min(0)), (y - y.min()) / (y.max() - y.min())
    gains = [FO.grow(*unit, FO.drawn(21_000, k, 42), 6)[1] for k in range(2)]
    share = np.mean([g / g.sum() for g in gains], 0)
    got = I.importance_weighted_index(df, "y", ["a", "b"], ["k"], trees=2, depth=6).orderBy("k").collect()
    assert np.allclose([r.PI for r in got], 0.3 * unit[1] + 0.7 * unit[0] @ share)


def test_first_centres_come_from_all_rows(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(0, 0.1, (6000, 2)), [[900.0, 0.0], [0.0, 900.0]]])  # a sample of 2,000 seldom has both
    df = spark.createDataFrame(x.tolist(), "z_a double, z_b double")
    got = CL.spread_centres(df.repartition(4), 3, 10, 42)
    assert got.shape == (10, 3, 2)
    assert all({(900.0, 0.0), (0.0, 900.0)} <= {tuple(c) for c in start} for start in got.tolist())
    assert np.array_equal(got, CL.spread_centres(df.coalesce(1), 3, 10, 42))
    assert len({tuple(start[0]) for start in got.tolist()}) > 5


def test_first_centres_are_drawn_by_their_squared_distance(spark):
    x = [[0.0]] * 50 + [[1.0], [2.0], [3.0]]
    got = CL.spread_centres(spark.createDataFrame(x, "z_a double"), 2, 400, 0)
    after = [b for a, b in got[:, :, 0].tolist() if a == 0.0]
    assert 60 < len(after) < 140 and 0.0 not in after
    assert abs(np.mean([b == 3.0 for b in after]) - 9 / 14) < 0.15
