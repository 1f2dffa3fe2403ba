"""Queries on fitted models return what needs the model, not only the rows that it would be fitted on."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("name, figures", [
    ("rf_regression", {"importances", "better_than_mean"}), ("rf_whatif", {"not_lower"}), ("rf_cross_validation", {"valid"}),
    ("sgc_logreg", {"top2_not_below", "valid", "sums_to_one"}),
])
def test_figures_of_the_model_are_there(spark, name, figures):
    out = entry.queries()[name](spark, SF)
    assert figures <= set(out.columns)
    assert all(row[c] in (True, 1.0) for row in out.collect() for c in figures)
