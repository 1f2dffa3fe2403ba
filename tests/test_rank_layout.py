"""Ranks move only the rows that are not hot, and tables per group come to the rows."""

import pytest
from pyspark.sql import functions as F

from stagelens.operators import adjust as A
from stagelens.operators import ranks as R
from stagelens.operators import score as S
from stagelens.session import clustered, materialize, write_clustered


@pytest.fixture(scope="module")
def laid_out(spark):
    rows = spark.range(20000).select(
        "id", F.when(F.col("id") % 5 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 7).cast("double").alias("few"),
        F.hash("id").cast("double").alias("many"))
    return spark.table(write_clustered(clustered(rows, ["id"]), "rank_rows", ["id"]))


def test_values_that_many_rows_share_are_not_exchanged(laid_out):
    placed = R._placed(laid_out, ["id"], [F.col("few"), F.col("many")])
    cold = {r["m"]: r["n"] for r in placed.filter("NOT hot").groupBy("m").agg(F.count("*").alias("n")).collect()}
    assert 0 not in cold and cold[1] > 15000
    biggest = placed.filter("NOT hot").groupBy("m", "pos").count().agg(F.max("count")).first()[0]
    assert biggest < 20000 / 20


def test_ranks_of_one_value_share_a_ranking():
    cols = R._columns([R.Rank(F.col("a"), winsor=(0.05, 0.95)), R.Rank(F.col("b")), R.Rank(F.col("a"), ties="max"), R.Rank(F.col("a"), winsor=(0.1, 0.9))])
    assert [(c.winsor, c.ranks) for c in cols] == [((0.05, 0.95), [0, 2]), (None, [1]), ((0.1, 0.9), [3])]


def test_bounds_of_groups_come_to_the_rows(spark, laid_out, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        S.iqr_filter(laid_out, "many", ["g"]).explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_repeated_and_unknown_keys(spark):
    rows = [(1, 1.0), (1, 3.0), (2, 2.0), (None, 4.0), (3, None)]
    df = materialize(spark.createDataFrame(rows, "id long, v double"))
    out = R.percent_ranks(df, ["id"], {"a": R.Rank(F.col("v"))}).collect()
    assert sorted((r["id"] or 0, r["a"] or 0) for r in out) == [(0, 0), (1, 0.75), (1, 0.75), (2, 0.5), (3, 0)]


def test_overlap_of_the_best_shifts_few_rows(spark, monkeypatch):
    rows = spark.range(3000).select(
        "id", F.lit("s").alias("seg"), F.concat(F.lit("r"), (F.col("id") % 3).cast("string")).alias("region"),
        (F.pmod(F.hash("id"), F.lit(1000)) / 50 + F.col("id") % 3 * 4).alias("y"))
    rows = materialize(rows)
    written = {}

    def recorded(df, name="table", **more):
        written[name] = materialize(df, name, **more)
        return written[name]

    monkeypatch.setattr(A, "materialize", recorded)
    got = {r["cfg"]: r["top_overlap"] for r in A.grid_top_overlap(rows, "y", "region", ["seg"], ["id"]).collect()}
    assert written["best"].count() < 300
    pdf = rows.toPandas()
    mean = pdf.groupby("region")["y"].transform("mean")
    n = pdf.groupby("region")["y"].transform("size")
    top = set(pdf.assign(y=pdf["y"].round(9)).sort_values(["y", "id"], ascending=[False, True])["id"][:10])
    for i, (k, cap) in enumerate(A.GRID):
        shifted = (pdf["y"] - (n / (n + k) * (mean - pdf["y"].mean())).clip(-cap, cap)).round(9)
        best = set(pdf.assign(a=shifted).sort_values(["a", "id"], ascending=[False, True])["id"][:10])
        assert got.get(i, 0.0) == pytest.approx(len(top & best) / 10)
