"""Bootstrap sums are made without a row per event and block."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from stagelens.operators import summaries as SU


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_replicates_are_summed_up_without_a_row_per_block(spark):
    rng = random.Random(3)
    rows = [(None if i % 17 == 0 else i // 2, rng.choice(["x", "y", None]), i % 2 == 0, None if i % 11 == 0 else rng.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "k long, g string, h boolean, v double").repartition(3)
    out = SU.mean_interval(df, ["g", "h"], "v", ["k"], replicates=40)
    assert "explode(sequence(" not in plan(out) and "MapInArrow" in plan(out)
    got = {(r.g, r.h): (r.n, r.low, r.high) for r in out.collect()}
    assert set(got) == {(g, h) for _, g, h, v in rows if v is not None}
    for cell, (n, low, high) in got.items():
        members = [(k, v) for k, g, h, v in rows if (g, h) == cell and v is not None]
        means = []
        for block in range(5):
            drawn = [[0.0, 0] for _ in range(SU.PER_HASH)]
            for k, v in members:
                digest = hashlib.md5((f"{block}" if k is None else f"{k}\x1f{block}").encode()).hexdigest()
                for i, sums in enumerate(drawn):
                    c = sum(int(digest[4 * i:4 * i + 4], 16) >= limit for limit in SU.POISSON)
                    sums[0], sums[1] = sums[0] + c * v, sums[1] + c
            means += [s / c for s, c in drawn if c]
        means.sort()
        for end, p in ((low, 0.025), (high, 0.975)):
            at = p * (len(means) - 1)
            a, b = means[math.floor(at)], means[math.ceil(at)]
            assert end == pytest.approx(a + (b - a) * (at - math.floor(at)))
        assert n == len(members)


def test_replicates_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(30)], "k long, v double")
    one = SU.mean_interval(df, [], "v", ["k"], replicates=80).first()
    assert one.n == 30 and one.low < one.mean < one.high
    assert SU.mean_interval(df.filter("k < 0"), [], "v", ["k"]).first().n == 0
