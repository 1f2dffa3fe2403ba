"""What would lift a failing group: formula based what-ifs, search and regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.functions.numeric import geo_score
from stagelens.operators.forest import Forest, fit_forest, with_prediction
from stagelens.operators.keys import hash_part, in_training
from stagelens.operators.score import WEIGHTS_FREE, WEIGHTS_PAID
from stagelens.session import materialize

# Fixed values of the search.
STEP, STEPS = 0.01, 20
# Fixed values of the models: trees, share of the target in the prototype index.
TREES, DEPTH = 200, 30
PROTOTYPE_TREES, TARGET_SHARE = 300, 0.3
AXES = ("U_AB", "S_AB", "A_AB")


def formula(segment: Column, u: Column, s: Column, a: Column, variant: str = "as_run") -> Column:
    """Score by its own formula for a row of either segment."""
    return F.when(segment == "Free", geo_score([u, s], WEIGHTS_FREE)).otherwise(
        geo_score([u, s, a], WEIGHTS_PAID[variant])
    )


def raised(col: str, by: Column) -> Column:
    return F.least(F.col(col) + by, F.lit(1.0))


def minimal_improvement(fails: DataFrame, key: Sequence[str], baseline: str = "baseline",
                        segment: str = "segment", variant: str = "as_run") -> DataFrame:
    """Cheapest rise of U, S and A on a fixed grid that reaches the baseline.

    Costs are whole steps, ties go to the smallest rise of U, then S, then A. Where
    nothing reaches the baseline the best reachable score is given. The affordability
    axis is left out for free events and where it is constant within a segment.

    Every failing row is expanded over the grid by a generator and reduced again in the
    same stage; the input has one row per group and pair, never one per event.
    """
    spread = fails.groupBy(segment).agg((F.min("A_AB") != F.max("A_AB")).alias("use_a"))
    rows = fails.join(spread, segment)
    steps = F.sequence(F.lit(0), F.lit(STEPS))
    a_steps = F.when(F.col("use_a") & (F.col(segment) != "Free"), steps).otherwise(F.array(F.lit(0)))
    grid = rows.select(*key, segment, baseline, "DPI_AB", *AXES, "use_a", F.explode(steps).alias("iu"))
    grid = grid.select("*", F.explode(steps).alias("isc")).select("*", F.explode(a_steps).alias("ia"))
    u, s, a = (raised(c, F.col(i) * STEP) for c, i in zip(AXES, ("iu", "isc", "ia")))
    grid = grid.withColumn("pred", formula(F.col(segment), u, s, a, variant))
    place = ("iu", "isc", "ia")
    cost = F.col("iu") + F.col("isc") + F.col("ia")
    cheapest = F.min(F.when(F.col("pred") >= F.col(baseline), F.struct(cost.alias("cost"), *place, "pred")))
    highest = F.min(F.struct((-F.col("pred")).alias("cost"), *place, "pred"))
    best = grid.groupBy(*key, segment, baseline, "DPI_AB").agg(cheapest.alias("ok"), highest.alias("far"))

    def pick(f: str) -> Column:
        return F.coalesce(F.col(f"ok.{f}"), F.col(f"far.{f}"))

    return best.select(
        *key, segment, baseline, "DPI_AB",
        (F.col(baseline) - F.col("DPI_AB")).alias("gap"),
        *[(pick(i) * STEP).alias(n) for n, i in (("dU", "iu"), ("dS", "isc"), ("dA", "ia"))],
        pick("pred").alias("predicted"),
        (pick("pred") - F.col(baseline)).alias("margin"),
        F.col("ok").isNotNull().alias("converted"),
    )


def what_if(fails: DataFrame, rise: float = 0.1, segment: str = "segment", variant: str = "as_run") -> DataFrame:
    """Mean change of the formula score when one axis rises, per segment and axis."""
    base = formula(F.col(segment), *[F.col(c) for c in AXES], variant)
    aggs = []
    for c in AXES:
        moved = [raised(x, F.lit(rise)) if x == c else F.col(x) for x in AXES]
        aggs.append(F.avg(formula(F.col(segment), *moved, variant) - base).alias(c))
    wide = fails.groupBy(segment).agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).alias("uplift")) for c in AXES])
    return wide.select(segment, "n", F.inline(rows))


def minimal_improvement_fitted(fails: DataFrame, forest: Forest, key: Sequence[str], baseline: str = "baseline",
                               segment: str = "segment") -> DataFrame:
    """Cheapest rise of the axes on the fixed grid with which a fitted forest predicts the baseline.

    A forest is constant between its splits, so of all steps of an axis only those count that take the
    row over a split; a step in between costs more and predicts the same. The rises are tried in order of
    their cost, as many at once as numpy likes, until one reaches the baseline; where none does the
    highest prediction counts. Costs are whole steps, ties go to the smallest rise of U, then S, then A.
    The affordability axis is left out where it is constant within a segment. Rows with an unknown axis or baseline are left out.
    """
    known = fails.dropna(subset=[*AXES, baseline])
    spread = known.groupBy(segment).agg((F.min("A_AB") != F.max("A_AB")).alias("use_a"))
    rows = known.join(spread, segment).select(segment, *key, F.col(baseline).cast("double").alias(baseline), "DPI_AB",
                                              *[F.col(c).cast("double") for c in AXES], "use_a")
    limits = [np.unique(np.concatenate([t.threshold[t.feature == i] for t in forest.trees] or [np.zeros(0)])) for i in range(len(AXES))]
    dealt = rows.sparkSession.sparkContext.broadcast((forest, limits))
    kept = [segment, *key, baseline, "DPI_AB"]
    schema = T.StructType([*[rows.schema[c] for c in kept], *T.StructType.fromDDL(
        "iu int, isc int, ia int, predicted double, converted boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = dealt.value
        for batch in batches:
            found = [cheapest_rise(model, limits, np.array([r[c] for c in AXES]), r[baseline], r["use_a"]) for r in batch.to_pylist()]
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 3 + (pa.float64(), pa.bool_()))],
                names=schema.names)

    out = rows.repartition(*key).mapInArrow(run, schema)
    return out.select(
        *kept, (F.col(baseline) - F.col("DPI_AB")).alias("gap"),
        *[(F.col(i) * STEP).alias(n) for n, i in (("dU", "iu"), ("dS", "isc"), ("dA", "ia"))],
        "predicted", (F.col("predicted") - F.col(baseline)).alias("margin"), "converted",
    )


def cheapest_rise(forest: Forest, limits: Sequence[np.ndarray], base: np.ndarray, goal: float, use_a: bool,
                  at_once: int = 512) -> tuple[int, int, int, float, bool]:
    """Steps of each axis, the prediction with them, and whether it reaches the goal."""
    grid = np.arange(STEPS + 1)
    steps = []
    for i, limit in enumerate(limits):
        values = np.clip(base[i] + grid * STEP, 0, 1)
        places = np.searchsorted(limit, values, "left")  # splits that lie below
        moves = np.append(True, places[1:] > places[:-1])
        steps.append(grid[moves] if use_a or AXES[i] != "A_AB" else grid[:1])
    rises = np.stack(np.meshgrid(*steps, indexing="ij"), -1).reshape(-1, len(base))
    rises = rises[np.lexsort((*rises.T[::-1], rises.sum(1)))]
    top, best = -np.inf, rises[0]
    for i in range(0, len(rises), at_once):
        part = rises[i : i + at_once]
        said = forest.predict(np.clip(base + part * STEP, 0, 1))
        ok = np.flatnonzero(said >= goal)
        if len(ok):
            return *part[ok[0]].tolist(), float(said[ok[0]]), True
        for k in np.flatnonzero(said >= max(top, said.max())):
            if said[k] > top or tuple(part[k]) < tuple(best):
                top, best = said[k], part[k]
    return *best.tolist(), float(top), False


def vectors(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str]) -> DataFrame:
    """Known rows with their features as a vector and the target as label."""
    known = df.dropna(subset=[*features, y]).select(*key, *[F.col(f).cast("double") for f in features], F.col(y).cast("double").alias("label"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(known)


def training_forest(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str], share: float = 0.8,
                    trees: int = TREES, depth: int = DEPTH) -> Forest:
    """The forest of the rows that a hash split takes for training."""
    return fit_forest(df.filter(in_training(share, *key)), features, y, key, trees, depth)


def error_figures(predicted: DataFrame, y: str) -> DataFrame:
    """One row: rows, R2 and MSE of a prediction."""
    err = F.col(y) - F.col("prediction")
    return predicted.dropna(subset=["prediction", y]).agg(
        F.count("*").alias("test_rows"), (1 - F.try_divide(F.sum(err * err), F.var_pop(y) * F.count("*"))).alias("r2"),
        F.avg(err * err).alias("mse"),
    )


def forest_figures(forest: Forest, df: DataFrame, y: str, key: Sequence[str], share: float = 0.8) -> DataFrame:
    """One row: rows, importances, R2 and MSE on the rows left for testing, R2 by trees that have not seen a training row."""
    test = df.filter(~in_training(share, *key))
    figures = error_figures(with_prediction(test.select(*key, *forest.features, y), forest), y)
    return figures.withColumns({
        "train_rows": F.lit(forest.rows).cast("long"), "unseen_r2": F.lit(forest.unseen_r2),
        "weights": F.array(*[F.lit(float(w)) for w in forest.importances]),
    })


def regress(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str], share: float = 0.8):
    """Least squares on a hash split; returns the model and a one-row frame of test figures."""
    rows = vectors(df, features, y, key)
    train, test = rows.filter(in_training(share, *key)), rows.filter(~in_training(share, *key))
    fitted = LinearRegression(solver="normal").fit(train)
    weights = [*fitted.coefficients.toArray().tolist(), fitted.intercept]
    return fitted, error_figures(fitted.transform(test), "label").withColumns({
        "train_rows": F.lit(train.count()), "weights": F.array(*[F.lit(float(w)) for w in weights])})


def predicted_what_if(forest: Forest, df: DataFrame, rise: float = 0.1) -> DataFrame:
    """Mean change of a forest's prediction when one feature rises, and the rows that it is the mean of."""
    out = with_prediction(df.dropna(subset=list(forest.features)), forest, "_base")
    for f in forest.features:
        moved = out.withColumn("_keep", F.col(f)).withColumn(f, F.col(f) + rise)
        out = with_prediction(moved, forest, f"_up_{f}").withColumn(f, F.col("_keep")).drop("_keep")
    aggs = out.agg(F.count("*").alias("n"), *[F.avg(F.col(f"_up_{f}") - F.col("_base")).alias(f) for f in forest.features])
    return aggs.select("n", F.inline(F.array(*[F.struct(F.lit(f).alias("axis"), F.col(f).alias("uplift")) for f in forest.features])))


def cross_validate(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str], folds: int = 5,
                   trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Rows and R2 per hash fold of a forest fitted on the other folds."""
    rows = df.dropna(subset=[*features, y]).withColumn("fold", hash_part(folds, *key).cast("int"))
    out = None
    for k in range(folds):
        forest = fit_forest(rows.filter(F.col("fold") != k), features, y, key, trees, depth)
        said = with_prediction(rows.filter(F.col("fold") == k).select(*key, *features, y), forest)
        row = error_figures(said, y).select(F.lit(k).alias("fold"), F.col("test_rows").alias("n"), "r2")
        out = row if out is None else out.unionByName(row)
    return out


def importance_weighted_index(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str],
                              fixed: float = TARGET_SHARE, trees: int = PROTOTYPE_TREES,
                              depth: int = DEPTH) -> DataFrame:
    """Prototype index of paid events: a fixed share for the target, the rest by importance in trees of full depth, grown on all rows."""
    cols = [target, *features]
    known = df.dropna(subset=cols)
    ends = known.agg(*[e for c in cols for e in (F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"))]).first()

    def unit(c: str) -> Column:
        lo, hi = ends[f"lo_{c}"], ends[f"hi_{c}"]
        return (F.lit(0.0) if lo == hi else (F.col(c).cast("double") - lo) / (hi - lo)).alias(c)

    scaled = known.select(*key, *[unit(c) for c in cols])
    index = F.col(target) * fixed
    forest = fit_forest(materialize(scaled, "scaled"), features, target, key, trees, depth, keep=False)
    for f, w in zip(features, forest.importances.tolist()):
        index = index + F.col(f) * ((1 - fixed) * w)
    return scaled.select(*key, index.alias("PI"))

