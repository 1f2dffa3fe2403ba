"""Tickets are dealt out with their names; the cells that repeat them are made afterwards, and are the same."""

import pytest

from stagelens.plans import fixtures as fx


@pytest.fixture
def tables(spark, tmp_path):
    line = [(o, o % 3, o % 2, n, 1.0, 10.0, 0.0, 0.0, "N", "O", "2020-01-01") for o in range(6) for n in (1, 2, 3)]
    spark.createDataFrame(line, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                                "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    part = [(0, "red ring", "B#1", "SMALL"), (1, None, "B#2", "LARGE"), (2, "hot bolt", None, "PROMO")]
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, "S#0"), (1, "S#1")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


def test_cells_are_made_after_the_exchange(spark, tables):
    dealt, plain = fx.ticket_cells(spark, tables, ["performance_id"]), fx.ticket_cells(spark, tables)
    assert dealt.columns == plain.columns
    assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect())) and plain.count() == 18
    (moved,) = [line for line in dealt._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    below = dealt._jdf.queryExecution().optimizedPlan().toString().split(moved)[1]
    assert "s_name" in below and "cast_txt" not in below and "crew_txt" not in below and "org_txt" not in below
