"""A pass over the rows for all fits side by side gives the sums of plain loops, in lines that stay small."""

import numpy as np
import pytest

from stagelens.operators import cluster as CL


def test_lines_of_all_fits_stay_small():
    centres = CL.STARTS * sum(range(2, 8))
    assert CL.BLOCK * centres * 8 <= 4 << 20


def test_sums_of_a_pass_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(-3, 4, (CL.BLOCK + 300, 2)).astype(float)  # whole numbers: many rows lie between centres
    df = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    fits = [CL.Fit(k, s, x[rng.choice(len(x), k)]) for k in (1, 2, 5) for s in range(2)]
    for fit, (sums, counts, (norms, far)) in zip(fits, CL.one_pass(df, fits)):
        want = np.zeros((fit.k, 5))
        for row in x:
            d = ((row - fit.centres) ** 2).sum(1)
            i = int(d.argmin())
            want[i] += [1, (row**2).sum(), d[i], *row]
        assert np.column_stack([counts, norms, far, sums]) == pytest.approx(want)
