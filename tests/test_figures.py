"""Figures of the fitted models, on the smallest data."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def rows(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_linear_regression_has_sql():
    assert "linreg_figures" in entry.queries() and "linreg_figures" in entry.oracle_sql()


def test_index_of_each_paid_event(spark):
    got = rows(spark, "dpi_prototype_paid_events")
    counts = rows(spark, "dpi_prototype_paid")
    assert len({g["performance_id"] for g in got}) == len(got) == sum(c["paid"] for c in counts)
    assert sum(g["PI"] is not None for g in got) == sum(c["scored"] for c in counts)


def test_clusters(spark):
    elbow = {e["k"]: e for e in rows(spark, "kmeans_elbow_figures")}
    assert sorted(elbow) == [2, 3, 4, 5, 6, 7] and elbow[7]["inertia"] < elbow[2]["inertia"]


def test_logistic_head(spark):
    (got,) = rows(spark, "sgc_logreg_figures")
    assert 0 <= got["top1_acc"] <= got["top2_acc"] <= 1 and 0 <= got["micro_f1"] <= 1
