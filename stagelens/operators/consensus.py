"""Agreement of repeated prediction runs and the classes that follow from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelens.functions.text import pair_key

THRESHOLDS = (0.0, 0.1, 0.3, 0.5)
PAIR, MAIN, NONE = "pair fixed", "main fixed", "undecided"


def top2_pairs(pred: DataFrame) -> DataFrame:
    """Predictions with the ordered pair as displayed and the order-free pair."""
    return pred.withColumns({"shown": F.concat_ws("+", "genre1", "genre2"), "pair": pair_key("genre1", "genre2")})


def run_agreement(pred: DataFrame, key: str = "performance_id", run: str = "run_id") -> DataFrame:
    """Share of events with the same first label, and the same pair, for any two runs.

    The runs of an event meet in one small array (one entry per run), from which the
    ordered pairs of runs are read; events are never paired with each other.
    """
    runs = F.array_sort(F.collect_list(F.struct(F.col(run).alias("r"), F.col("genre1").alias("g"), F.col("pair").alias("p"))))
    per_event = top2_pairs(pred).groupBy(key).agg(runs.alias("runs"))
    pairs = F.flatten(F.transform("runs", lambda a: F.transform(
        F.filter("runs", lambda b: b["r"] > a["r"]),
        lambda b: F.struct(
            a["r"].alias("run_a"), b["r"].alias("run_b"),
            F.coalesce(a["g"] == b["g"], F.lit(False)).alias("same_first"),
            a["p"].eqNullSafe(b["p"]).alias("same_pair"),
        ),
    )))
    return per_event.select(F.inline(pairs)).groupBy("run_a", "run_b").agg(
        F.count("*").alias("n"), F.avg(F.col("same_first").cast("int")).alias("first_agreement"),
        F.avg(F.col("same_pair").cast("int")).alias("pair_agreement"),
    )


def saved_agreement(pred: DataFrame, saved: DataFrame, key: str = "performance_id") -> DataFrame:
    """Agreement of one run with predictions saved earlier."""
    a = top2_pairs(pred).select(key, F.col("genre1").alias("g_a"), F.col("pair").alias("p_a"))
    b = top2_pairs(saved).select(key, F.col("genre1").alias("g_b"), F.col("pair").alias("p_b"))
    return a.join(b, key).agg(
        F.count("*").alias("n"),
        F.avg(F.col("g_a").eqNullSafe(F.col("g_b")).cast("int")).alias("same_first"),
        F.avg(F.col("p_a").eqNullSafe(F.col("p_b")).cast("int")).alias("same_pair"),
    )


def consensus(pred: DataFrame, key: str = "performance_id") -> DataFrame:
    """Per event over all runs: stable first label, stable pair, second probability.

    A pair is stable if every run names the same one; a missing pair is a value too.
    """
    rows = top2_pairs(pred).withColumn("_p", F.coalesce("pair", F.lit("")))
    return rows.groupBy(key).agg(
        (F.min("genre1") == F.max("genre1")).alias("main_stable"),
        (F.min("_p") == F.max("_p")).alias("pair_stable"),
        F.min("genre1").alias("main"),
        F.min("pair").alias("pair"),
        F.min("p2").alias("min_p2"), F.avg("p2").alias("mean_p2"), F.avg("p1").alias("mean_p1"),
    )


def classify(tau: Column | float) -> Column:
    """Class of an event at a threshold for the second probability."""
    tau = tau if isinstance(tau, Column) else F.lit(float(tau))
    sure = F.col("pair_stable") & F.coalesce(F.col("min_p2") >= tau, F.lit(False))
    return F.when(sure, PAIR).when(F.col("main_stable"), MAIN).otherwise(NONE)


def threshold_sweep(events: DataFrame, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Events per class at several thresholds, in one pass over the events."""
    aggs = []
    for i, tau in enumerate(thresholds):
        for j, name in enumerate((PAIR, MAIN, NONE)):
            aggs.append(F.count_if(classify(tau) == name).alias(f"c{i}_{j}"))
    wide = events.agg(F.count("*").alias("n"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("tau"), *[F.col(f"c{i}_{j}").alias(n) for j, n in enumerate(("pair_fixed", "main_fixed", "undecided"))])
        for i, t in enumerate(thresholds)
    ])
    return wide.select("n", F.inline(rows)).withColumn("pair_share", F.col("pair_fixed") / F.col("n")).drop("n")


def confident_at(comp: DataFrame, events: DataFrame, thresholds: Sequence[float] = THRESHOLDS, key: str = "performance_id") -> DataFrame:
    """Mixed events whose pair is fixed, once per threshold they pass, with that pair as genres."""
    taus = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("min_p2") >= t)
    sure = events.filter("pair_stable AND min_p2 IS NOT NULL AND pair IS NOT NULL").select(key, "pair", F.explode(taus).alias("tau"))
    sides = F.split("pair", r"\+")
    return comp.drop("genre1", "genre2").join(
        sure.select(key, "tau", sides[0].alias("genre1"), sides[1].alias("genre2")), key
    )


def ablation_table(results: DataFrame, step: str, protocol: str, value: str, protocols: Sequence[str]) -> DataFrame:
    """Mean over repetitions per step and protocol side by side, with their spread."""
    aggs = []
    for p in protocols:
        v = F.when(F.col(protocol) == p, F.col(value))
        aggs += [F.avg(v).alias(p), F.min(v).alias(f"{p}_min"), F.max(v).alias(f"{p}_max")]
    return results.groupBy(step).agg(*aggs)
