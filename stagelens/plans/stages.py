"""Intermediate tables of the analysis, each written once per session and data folder.

As in any batch flow the steps hand over tables: the metrics feed the score, the
score feeds every comparison. They live in the shared scratch folder; what a step writes
on its way goes when its table is written.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stagelens.operators import metrics as M
from stagelens.operators.adjust import adjust_by_grid, grid_search
from stagelens.operators.graph import participations
from stagelens.operators.score import score
from stagelens.plans import fixtures as fx
from stagelens.session import clustered as dealt
from stagelens.session import step, tune, write_clustered, write_scratch

_BUILT: dict[tuple[str, str, str], tuple[str, StructType]] = {}
_LAID_OUT: dict[tuple[str, str, str], str] = {}
_FITTED: dict[tuple[str, str, str], object] = {}

# Tables with rows per event lie by event: its rows meet in one exchange, when the participants are named.
EVENT = ("performance_id",)


def stage(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _BUILT:
        tune(spark)
        with step(spark):
            df = build()
            _BUILT[slot] = write_scratch(df, name, rebalance=True, keep=True), df.schema
    path, schema = _BUILT[slot]
    return spark.read.schema(schema).parquet(path)


def clustered(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], by: Sequence[str] = EVENT) -> DataFrame:
    """A stage whose rows lie by the hash of a key, so that no later step by that key exchanges them again."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _LAID_OUT:
        tune(spark)
        with step(spark):
            _LAID_OUT[slot] = write_clustered(build(), name, by, keep=True)
    return spark.table(_LAID_OUT[slot])


def fitted(spark: SparkSession, sf_dir: str, name: str, fit: Callable[[], object]) -> object:
    """A model that several queries use, fitted once per session and data folder."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _FITTED:
        _FITTED[slot] = fit()
    return _FITTED[slot]


def clear() -> None:
    """Forget all stages and models (they are built again on next use)."""
    _BUILT.clear()
    _LAID_OUT.clear()
    _FITTED.clear()


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(
        spark, sf_dir, "metrics",
        lambda: M.event_metrics(dealt(fx.ticket(spark, sf_dir), EVENT), dealt(fx.performance(spark, sf_dir), EVENT)),
    )


def _score(spark: SparkSession, sf_dir: str, variant: str, guard: bool) -> DataFrame:
    """The score before it is adjusted for regions."""
    return clustered(
        spark, sf_dir, f"score_{variant}{'_guard' if guard else ''}",
        lambda: score(metrics(spark, sf_dir), variant, guard=guard),
    )


def grid(spark: SparkSession, sf_dir: str, variant: str = "as_run", guard: bool = False) -> DataFrame:
    """All settings of the region adjustment with their figures."""
    return stage(
        spark, sf_dir, f"grid_{variant}{'_guard' if guard else ''}",
        lambda: grid_search(_score(spark, sf_dir, variant, guard), "DPI_plus", "region", ["kind", "segment"], ["performance_id"]),
    )


def scored(spark: SparkSession, sf_dir: str, variant: str = "as_run", guard: bool = False) -> DataFrame:
    return clustered(
        spark, sf_dir, f"scored_{variant}{'_guard' if guard else ''}",
        lambda: adjust_by_grid(
            _score(spark, sf_dir, variant, guard), "DPI_plus", "region", ["kind", "segment"], ["performance_id"],
            grid=grid(spark, sf_dir, variant, guard),
        ),
    )


def genre_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir, "genre_mix", lambda: fx.line_genre(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir, "predictions", lambda: fx.prediction(genre_mix(spark, sf_dir)))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.label(genre_mix(spark, sf_dir))


def namings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir, "namings", lambda: fx.namings(spark, sf_dir))


def participation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return participations(namings(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "cells", lambda: fx.cells(spark, sf_dir))


def hop(spark: SparkSession, sf_dir: str, number: int, build: Callable[[], DataFrame]) -> DataFrame:
    """Scores after so many steps of propagation, each step a table."""
    return clustered(spark, sf_dir, f"hop_{number}", build)
