"""Ranks and quantiles: hand-made values, and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stagelens.operators import adjust as A
from stagelens.operators import ranks as R
from stagelens.operators import score as S


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 6000
    x = rng.normal(size=n)
    x[: n // 3] = 0.0  # a third of all rows share one value
    y = rng.integers(0, 7, n).astype(float)
    y[rng.random(n) < 0.1] = np.nan
    g = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    g[:50] = None
    return pd.DataFrame({"id": np.arange(n), "g": g, "x": x, "y": y})


def spark_frame(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))


def test_small_examples(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, 4.0), (5, None)], "id long, v double")
    out = R.percent_ranks(df, ["id"], {"a": R.Rank(F.col("v"))})
    got = {r["id"]: r["a"] for r in out.collect()}
    assert got == {1: 0.25, 2: 0.625, 3: 0.625, 4: 1.0, 5: None}
    out = R.percent_ranks(df, ["id"], {"a": R.Rank(F.col("v"), ties="max")})
    assert {r["id"]: r["a"] for r in out.collect()} == {1: 0.25, 2: 0.75, 3: 0.75, 4: 1.0, 5: None}
    four = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "v double")
    assert R.quantiles(four, {"q": F.col("v")}, [0.25]).first()["q"] == [1.75]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_ranks_match_pandas(spark, skewed, by):
    df = spark_frame(spark, skewed)
    out = R.percent_ranks(
        df, ["id"],
        {"rx": R.Rank(F.col("x")), "ry": R.Rank(F.col("y"), ties="max"), "rw": R.Rank(F.col("x"), winsor=(0.05, 0.95))},
        by,
    ).select("id", "rx", "ry", "rw").toPandas().sort_values("id", ignore_index=True)
    groups = skewed.groupby("g", dropna=False) if by else skewed.groupby(lambda _: 0)

    def winsor(s):
        return s.clip(s.quantile(0.05), s.quantile(0.95)).rank(pct=True)

    np.testing.assert_allclose(out["rx"], groups["x"].rank(pct=True) if by != ["g"] else
                               groups["x"].transform(lambda s: s.rank(pct=True)))
    np.testing.assert_allclose(out["ry"].astype(float), groups["y"].transform(lambda s: s.rank(pct=True, method="max")))
    np.testing.assert_allclose(out["rw"], groups["x"].transform(winsor))


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_match_pandas(spark, skewed, by):
    probs = [0.0, 0.05, 0.25, 0.5, 0.777, 0.95, 1.0]
    df = spark_frame(spark, skewed)
    out = R.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, probs, by)
    for row in out.collect():
        part = skewed
        if by:
            part = skewed[skewed["g"].isna()] if row["g"] is None else skewed[skewed["g"] == row["g"]]
        np.testing.assert_allclose(row["x"], part["x"].quantile(probs))
        np.testing.assert_allclose(row["y"], part["y"].quantile(probs))


def test_rank_corr_matches_pandas(spark, skewed):
    pdf = skewed.dropna(subset=["y"]).reset_index(drop=True)
    df = spark_frame(spark, pdf)
    want = pdf["x"].corr(pdf["y"].rank(), method="pearson")
    want = pdf["x"].rank().corr(pdf["y"].rank())
    got = R.rank_corr(df, ["id"], F.col("x"), [F.col("y")]).first()["corr"]
    assert got == pytest.approx(want)


def test_no_single_partition_window(spark, skewed, capsys):
    df = spark_frame(spark, skewed)
    R.percent_ranks(df, ["id"], {"rx": R.Rank(F.col("x"))}).explain()
    assert "SinglePartition" not in capsys.readouterr().out


def test_mean_of_percent_ranks(spark, skewed):
    out = R.percent_ranks(spark_frame(spark, skewed), ["id"], {"rx": R.Rank(F.col("x"))})
    n = len(skewed)
    assert out.agg(F.avg("rx")).first()[0] == pytest.approx((n + 1) / (2 * n))


def test_adjustment_lowers_the_group_effect_and_caps(spark, skewed):
    df = spark_frame(spark, skewed).withColumn("s", F.col("x") * 10 + F.length(F.coalesce("g", F.lit("zzzzz"))) * 5)
    before = A.effect(df, "s", "g").first()["eta2"]
    after = A.effect(A.region_adjust(df, "s", "g", [], 30, 4.0), "adjusted", "g").first()["eta2"]
    assert after < before
    tiny = spark.createDataFrame([("a", 10.0)] * 30 + [("b", -30.0)] * 30, "g string, s double")
    out = A.region_adjust(tiny, "s", "g", [], 30, 4.0)
    assert {r["g"]: r["adjusted"] for r in out.distinct().collect()} == {"a": 6.0, "b": -26.0}


def test_group_without_known_values_and_hot_rows(spark):
    rows = [("none", None)] * 5 + [("hot", float(i % 3)) for i in range(900)] + [("one", 4.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, v double")
    got = {r["g"]: r["q"] for r in R.quantiles(df, {"q": F.col("v")}, [0.0, 0.5, 1.0], ["g"]).collect()}
    assert got == {"none": [None] * 3, "hot": [0.0, 1.0, 2.0], "one": [4.0] * 3}
    out = R.percent_ranks(df, ["id"], {"a": R.Rank(F.col("v"), winsor=(0.05, 0.95))}, ["g"]).collect()
    assert len(out) == len(rows)
    want = pd.DataFrame(rows, columns=["g", "v"]).groupby("g")["v"].rank(pct=True)
    np.testing.assert_allclose([r["a"] for r in sorted(out, key=lambda r: r["id"]) if r["v"] is not None], want.dropna())


def test_clipping_to_a_single_value(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 99 else 5.0) for i in range(100)], "id long, v double")
    out = R.percent_ranks(df, ["id"], {"a": R.Rank(F.col("v"), winsor=(0.05, 0.95))})
    assert {r["a"] for r in out.collect()} == {0.505}


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(i, float(i), 2.0) for i in range(30)], "id long, x double, y double")
    got = {r["m"]: r["corr"] for r in R.rank_corr(df, ["id"], F.col("x"), [F.col("y"), -F.col("x")]).collect()}
    assert got[0] is None and got[1] == pytest.approx(-1.0)
