"""Mixed-genre events against their single-genre baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagelens.functions.text import pair_key, pair_side
from stagelens.session import materialize

SUCCESS, FAIL, UNDECIDABLE = "success", "fail", "undecidable"
AXES = {"DPI": "DPI_plus", "U": "U_participation", "S": "S_scale", "A": "A_afford"}


def verdict(score: Column, first: Column, second: Column) -> Column:
    """Success if at least the mean of both baselines; undecidable if a baseline is missing.

    A pair without a mean of its own does not reach its baseline.
    """
    known = first.isNotNull() & second.isNotNull()
    return F.when(~known, UNDECIDABLE).when(score >= (first + second) / 2, SUCCESS).otherwise(FAIL)


def lookup_twice(df: DataFrame, table: DataFrame, on: Sequence[str], genre: str, sides: dict[str, str],
                 values: Sequence[str]) -> DataFrame:
    """Left-join one aggregate table once per side; ``sides`` maps a suffix to the label column.

    The table has one row per key; it is evaluated once; adaptive execution broadcasts
    it by its real size or splits hot keys.
    """
    table = materialize(table, "lookup")
    out = df
    for suffix, label in sides.items():
        side = table.select(
            *on, F.col(genre).alias(label), *[F.col(v).alias(f"{v}_{suffix}") for v in values]
        )
        out = out.join(side, [*on, label], "left")
    return out


def pair_table(comp: DataFrame, single: DataFrame, by: Sequence[str] = ("segment", "size"),
               genres: Sequence[str] = ("genre1", "genre2"), genre: str = "genre") -> DataFrame:
    """Per group and genre pair: means of the mixed events, of both baselines, and the verdict.

    The baseline is the plain mean of the two genre means within the same group.
    """
    by = list(by)
    known = comp.filter(F.col(genres[0]).isNotNull() & F.col(genres[1]).isNotNull())
    mixed = known.withColumn("pair", pair_key(*genres)).groupBy(*by, "pair").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"{a}_AB") for a, c in AXES.items()]
    )
    base = single.groupBy(*by, genre).agg(*[F.avg(c).alias(a) for a, c in AXES.items()])
    mixed = mixed.withColumns({"genre_A": pair_side("pair", 0), "genre_B": pair_side("pair", 1)})
    out = lookup_twice(mixed, base, by, genre, {"A": "genre_A", "B": "genre_B"}, list(AXES))
    return out.withColumns(
        {
            "baseline": (F.col("DPI_A") + F.col("DPI_B")) / 2,
            "verdict": verdict(F.col("DPI_AB"), F.col("DPI_A"), F.col("DPI_B")),
        }
    )


def success_rate(pairs: DataFrame, by: Sequence[str] = ("segment",), min_n: int = 5) -> DataFrame:
    """Rows that can be decided, successes, their rate, events behind them."""
    decided = pairs.filter(F.col("verdict") != UNDECIDABLE)
    ok = F.count_if(F.col("verdict") == SUCCESS)
    return decided.groupBy(*by).agg(
        F.count("*").alias("rows"), ok.alias("successes"), (ok * 100.0 / F.count("*")).alias("rate"),
        F.sum("n").alias("events"), F.count_if(F.col("n") >= min_n).alias("rows_min_n"),
    )


def audit(pairs: DataFrame, stored: str, by: Sequence[str] = ("segment",)) -> DataFrame:
    """Recompute every verdict and compare with a stored one."""
    rule = verdict(F.col("DPI_AB"), F.col("DPI_A"), F.col("DPI_B"))
    rows = pairs.withColumn("_same", rule == F.col(stored))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(stored) == SUCCESS).alias("successes"),
        F.count_if(F.col(stored) == FAIL).alias("failures"),
        F.avg(F.col("_same").cast("int")).alias("rule_matches"),
        F.count_distinct("pair").alias("pairs"),
    )


def which_rate(audited: DataFrame, reported: float, tol: float = 0.06) -> Column:
    """Which of the two rates a reported percentage equals."""
    n = F.col("successes") + F.col("failures")
    return (
        F.when(F.abs(F.col("failures") * 100.0 / n - reported) < tol, "failure rate")
        .when(F.abs(F.col("successes") * 100.0 / n - reported) < tol, "success rate")
        .otherwise("neither")
    )


def against_singles(comp: DataFrame, single: DataFrame, score: str, place: str, genre: str = "genre",
                    genres: Sequence[str] = ("genre1", "genre2"), by: Sequence[str] = ()) -> DataFrame:
    """Each mixed event with the mean single score of both genres at the same place.

    ``wins`` holds where it beats either; ``gain`` is against the better of the two.
    """
    need = [place, score, *genres]
    rows = comp.dropna(subset=need)
    base = single.dropna(subset=[place, genre, score]).groupBy(*by, place, genre).agg(F.avg(score).alias("base"))
    out = lookup_twice(rows, base, [*by, place], genre, {"1": genres[0], "2": genres[1]}, ["base"])
    own, a, b = F.col(score), F.col("base_1"), F.col("base_2")
    best = F.greatest(a, b)
    return out.withColumns(
        {
            "comparable": a.isNotNull() | b.isNotNull(),
            "wins": F.coalesce(own > a, F.lit(False)) | F.coalesce(own > b, F.lit(False)),
            "best_single": best,
            "gain": own - best,
            "gain_ratio": F.try_divide(own, best),
        }
    )


def wins_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    valid, wins = F.count_if("comparable"), F.count_if("wins")
    return rows.groupBy(*by).agg(
        valid.alias("comparable"), wins.alias("wins"),
        F.coalesce(F.try_divide(wins * 100.0, valid), F.lit(0.0)).alias("rate"),
    )


def gains(rows: DataFrame, by: Sequence[str], min_n: int = 1) -> DataFrame:
    """Win rate, events and mean gain over comparable events per group."""
    return (
        rows.filter("comparable").groupBy(*by)
        .agg(F.count("*").alias("n"), (F.avg(F.col("wins").cast("int")) * 100).alias("win_rate"), F.avg("gain").alias("mean_gain"))
        .filter(F.col("n") >= min_n)
    )


def best_and_worst(rows: DataFrame, col: str, key: Sequence[str], n: int = 10) -> DataFrame:
    """The n largest and the n smallest values, ties by key."""
    known = rows.filter(F.col(col).isNotNull())
    top = known.orderBy(F.col(col).desc(), *key).limit(n).withColumn("side", F.lit("top"))
    low = known.orderBy(F.col(col).asc(), *key).limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def group_means(rows: DataFrame, group: str, value: str, split: str, sides: Sequence[str]) -> DataFrame:
    """Count and mean per group, and the mean on each side of a split."""
    aggs = [F.avg(F.when(F.col(split) == s, F.col(value))).alias(s) for s in sides]
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *aggs)


def in_top_groups(rows: DataFrame, group: str, value: str, n: int = 10) -> DataFrame:
    """Rows of the n groups with the highest mean."""
    best = rows.groupBy(group).agg(F.avg(value).alias("_m")).filter("_m IS NOT NULL")
    best = best.orderBy(F.col("_m").desc(), group).limit(n).select(group)
    return rows.join(F.broadcast(best), group, "left_semi")  # n rows

