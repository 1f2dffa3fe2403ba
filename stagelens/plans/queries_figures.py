"""Figures of the fitted models that SQL has no words for, beside the queries on what holds for any right fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelens.functions import conditions as C
from stagelens.operators import compare as P
from stagelens.operators import graph as G
from stagelens.operators import improve as I
from stagelens.plans import queries_compare as QC
from stagelens.plans import queries_graph as QG
from stagelens.plans import stages

QUERIES_FIGURES = {}


def register(fn):
    QUERIES_FIGURES[fn.__name__] = fn
    return fn


@register
def rf_regression_figures(spark, sf):
    """Forest of the pair score per segment: importance of each feature, R2 and MSE on the test rows, R2 on rows unseen by a tree."""
    def use(forest, rows):
        figures = I.forest_figures(forest, rows, "DPI_AB", QC.PAIR_KEY)
        weights = [F.col("weights")[i].alias(f) for i, f in enumerate(QC.PAIR_FEATURES)]
        return figures.select("train_rows", "test_rows", *weights, "r2", "mse", "unseen_r2")

    return QC._with_forest(spark, sf, use)


@register
def rf_whatif_figures(spark, sf):
    """Mean rise of the forest's score of the failing pairs per axis."""
    def use(forest, rows):
        fails = rows.filter(F.col("verdict") == P.FAIL)
        return I.predicted_what_if(forest, fails.select(*QC.PAIR_KEY, *QC.PAIR_FEATURES)).select("axis", "uplift")

    return QC._with_forest(spark, sf, use)


@register
def min_improvement_model(spark, sf):
    """Cheapest rise of each failing pair with which the forest of its segment predicts the baseline."""
    def use(forest, rows):
        return I.minimal_improvement_fitted(rows.filter(F.col("verdict") == P.FAIL), forest, ["size", "pair"])

    return QC._with_forest(spark, sf, use).select("segment", "size", "pair", "converted", "dU", "dS", "dA", "gap", "predicted", "margin")


@register
def rf_cross_validation_figures(spark, sf):
    """R2 of each of five folds per segment."""
    return QC.cross_validation(spark, sf).select("segment", "fold", "r2")


@register
def dpi_prototype_paid_events(spark, sf):
    """Prototype index of each paid event, null where a figure is missing."""
    paid = stages.metrics(spark, sf).filter(~C.is_free("price", "rev_per_session", "both_zero"))
    return paid.join(QC.prototype_index(spark, sf), "performance_id", "left").select("performance_id", "kind", "PI")


@register
def kmeans_elbow_figures(spark, sf):
    """Inertia and silhouette for two to seven clusters."""
    return QC.elbow(spark, sf)


@register
def kmeans_profile_figures(spark, sf):
    """Size, means and label of each cluster, for three to six clusters."""
    return QC.profiles(spark, sf)


@register
def sgc_logreg_figures(spark, sf):
    """Logistic head on the propagated scores: its metrics on held-out events."""
    test, probs = QG.head_probabilities(spark, sf)
    return G.multilabel_metrics(test, probs)
