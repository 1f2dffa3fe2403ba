"""Shrink-and-cap adjustment of a score for the effect of its group, with grid search.

The shift of a row depends on its group alone, so every figure of the search except
the rank correlation comes from one row per group: count, mean and sum of squares.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.operators.ranks import join_null_safe, rank_corr
from stagelens.session import materialize

# Fixed values of the search.
K_GRID = (30, 60, 80, 100, 150)
CAP_GRID = (2.0, 3.0, 4.0, 5.0, 6.0)
W_ETA, W_RMS, W_DIST, W_RANK = 0.40, 0.30, 0.15, 0.15
RANK_FLOOR, RANK_PENALTY = 0.90, 0.20

GRID = [(k, cap) for k in K_GRID for cap in CAP_GRID]


def group_stats(df: DataFrame, y: str, by: str, within: Sequence[str] = ()) -> DataFrame:
    """Per group: rows (unknown y included), mean, squared deviations; plus those of all.

    A missing group value is a group of its own.
    """
    within = list(within)
    n = F.count(y)
    stats = df.groupBy(*within, by).agg(
        F.count("*").alias("n"),
        n.alias("n_known"),
        F.avg(y).alias("mu"),
        (F.var_pop(y) * n).alias("ss_within"),
    )
    all_rows = W.partitionBy(*(within or [F.lit(0)]))
    known = F.coalesce(F.col("n_known") * F.col("mu"), F.lit(0.0))
    grand = F.sum(known).over(all_rows) / F.sum("n_known").over(all_rows)
    return stats.withColumn("grand", grand)


def _between(mean: Column, grand: Column, n: str = "n") -> Column:
    return F.sum(F.col(n) * (mean - grand) * (mean - grand))


def effect(df: DataFrame, y: str, by: str, within: Sequence[str] = ()) -> DataFrame:
    """Explained share (eta2) and weighted spread of group means (rms), one pass over rows."""
    stats = group_stats(df, y, by, within)
    mu, grand = F.col("mu"), F.col("grand")
    total = F.sum("ss_within") + _between(mu, grand, "n_known")
    return stats.groupBy(*within).agg(
        F.sum("n").alias("n"),
        F.count("*").alias("groups"),
        F.coalesce(F.try_divide(_between(mu, grand), total), F.lit(0.0)).alias("eta2"),
        F.sqrt(_between(mu, grand) / F.sum("n")).alias("rms"),
    )


def shift(n: Column, mu: Column, grand: Column, k: Column, cap: Column) -> Column:
    """n/(n+k) of the distance of the group mean, capped on both sides."""
    raw = n / (n + k) * (mu - grand)
    return F.greatest(F.least(raw, cap), -cap)


def region_adjust(df: DataFrame, y: str, by: str, within: Sequence[str], k: float, cap: float,
                  name: str = "adjusted") -> DataFrame:
    """Score less the shift of its group, for given k and cap."""
    within = list(within)
    stats = group_stats(df, y, by, within)
    delta = shift(F.col("n"), F.col("mu"), F.col("grand"), F.lit(float(k)), F.lit(float(cap)))
    deltas = materialize(stats.select(*within, by, delta.alias("_delta")), "deltas")
    out = join_null_safe(df, deltas, [*within, by], "left")
    return out.withColumn(name, F.col(y) - F.col("_delta")).drop("_delta")


def grid_search(df: DataFrame, y: str, by: str, within: Sequence[str], key: Sequence[str]) -> DataFrame:
    """All (K, CAP) pairs per ``within`` group with their figures, score and place.

    ``df`` is read twice; pass a materialised frame.
    """
    within = list(within)
    stats = group_stats(df, y, by, within)
    cfg = F.array(
        *[F.struct(F.lit(i).alias("cfg"), F.lit(float(k)).alias("K"), F.lit(c).alias("CAP"))
          for i, (k, c) in enumerate(GRID)]
    )
    wide = stats.select("*", F.inline(cfg))
    wide = wide.withColumn("delta", shift(F.col("n"), F.col("mu"), F.col("grand"), F.col("K"), F.col("CAP")))
    # a cap that no group reaches changes nothing: all wider caps of the same K repeat it
    raw = F.abs(F.col("n") / (F.col("n") + F.col("K")) * (F.col("mu") - F.col("grand")))
    same_k = W.partitionBy(*within, "K")
    wide = wide.withColumn("reach", F.max(raw).over(same_k))
    wide = wide.withColumn("free_cap", F.min(F.when(F.col("CAP") >= F.col("reach"), F.col("CAP"))).over(same_k))
    repeats = F.coalesce(F.col("CAP") > F.col("free_cap"), F.lit(False))
    first = F.min(F.when(F.col("CAP") == F.col("free_cap"), F.col("cfg"))).over(same_k)
    wide = wide.withColumn("like", F.when(repeats, first).otherwise(F.col("cfg"))).drop("reach", "free_cap")
    wide = materialize(wide.withColumn("mu_post", F.col("mu") - F.col("delta")), "shifts")

    # group figures after the shift; the grand mean moves with the shifts
    all_rows = W.partitionBy(*within, "cfg")
    grand_post = F.sum(F.col("n_known") * F.col("mu_post")).over(all_rows) / F.sum("n_known").over(all_rows)
    known_upto = F.sum("n_known").over(all_rows.orderBy(F.abs("delta"), F.col(by)))
    h = (F.sum("n_known").over(all_rows) - 1) * F.lit(0.95)
    post = wide.withColumns({"grand_post": grand_post, "upto": known_upto, "h": h})
    size, low = F.abs("delta"), F.floor("h")
    lo = F.min(F.when(F.col("upto") > low, size))
    hi = F.min(F.when(F.col("upto") > F.ceil("h"), size))
    mu, grand = F.col("mu"), F.col("grand")
    mu2, grand2 = F.col("mu_post"), F.col("grand_post")
    ssw = F.sum("ss_within")
    frac = F.max("h") - F.max(low)
    figures = post.groupBy(*within, "cfg", "K", "CAP", "like").agg(
        F.coalesce(F.try_divide(_between(mu, grand), ssw + _between(mu, grand, "n_known")), F.lit(0.0)).alias("eta_pre"),
        F.coalesce(F.try_divide(_between(mu2, grand2), ssw + _between(mu2, grand2, "n_known")), F.lit(0.0)).alias("eta_post"),
        F.sqrt(_between(mu, grand) / F.sum("n")).alias("rms_pre"),
        F.sqrt(_between(mu2, grand2) / F.sum("n")).alias("rms_post"),
        (lo + (hi - lo) * frac).alias("dist_p95"),
        (F.sum(F.col("n_known") * size) / F.sum("n_known")).alias("dist_mean_abs"),
        (F.sum(F.when(size >= F.col("CAP") - 1e-12, F.col("n_known")).otherwise(0)) / F.sum("n_known")).alias("cap_saturation"),
    )

    # rank correlation of the score before and after, all settings in one ranking pass;
    # a setting that repeats another has no shift here and drops out before the exchange
    shifts = (wide.filter(F.col("like") == F.col("cfg")).groupBy(*within, by).agg(
        *[F.max(F.when(F.col("cfg") == i, F.col("delta"))).alias(f"_d{i}") for i in range(len(GRID))]
    ))
    # written, as all tables per group here: rows then meet them where they lie unless the groups are very many
    shifts = materialize(shifts, "shifts_wide")
    rows = join_null_safe(df.filter(F.col(y).isNotNull()).select(*key, *within, by, y), shifts, [*within, by])
    adjusted = [F.col(y) - F.col(f"_d{i}") for i in range(len(GRID))]
    corr = rank_corr(rows, key, F.col(y), adjusted, within)
    corr = corr.withColumnsRenamed({"m": "like", "corr": "spearman"})
    table = join_null_safe(figures, corr, [*within, "like"], "left").drop("like")
    # a constant column has no correlation; its order is unchanged
    table = table.withColumn("spearman", F.coalesce("spearman", F.lit(1.0)))

    seg = W.partitionBy(*(within or [F.lit(0)]))

    def mm(c: Column) -> Column:
        return (c - F.min(c).over(seg)) / (F.max(c).over(seg) - F.min(c).over(seg) + 1e-12)

    total = (
        mm(F.col("eta_post")) * W_ETA
        + mm(F.col("rms_post")) * W_RMS
        + mm(F.col("dist_p95")) * W_DIST
        + mm(1 - F.col("spearman")) * W_RANK
        + F.when(F.col("spearman") < RANK_FLOOR, RANK_PENALTY).otherwise(0.0)
    )
    # rounded to 9 digits, so that sums in another order cannot swap equal settings
    order = seg.orderBy(
        *[F.round(c, 9) for c in ("score", "eta_post", "rms_post", "dist_p95")], "cfg"
    )
    return table.withColumn("score", total).withColumn("place", F.row_number().over(order))


def grid_top_overlap(df: DataFrame, y: str, by: str, within: Sequence[str], key: Sequence[str], k: int = 10) -> DataFrame:
    """Per (K, CAP): share of the k best rows that stay among the k best after the shift.

    Only the k best rows of a ``by`` group, and those that tie with them, are shifted; the limit on
    row_number is applied before the exchange too.
    """
    within = list(within)
    cfg = F.array(*[F.struct(F.lit(i).alias("cfg"), F.lit(float(kk)).alias("K"), F.lit(c).alias("CAP"))
                    for i, (kk, c) in enumerate(GRID)])
    deltas = group_stats(df, y, by, within).select(*within, by, "n", "mu", "grand", F.inline(cfg))
    delta = shift(F.col("n"), F.col("mu"), F.col("grand"), F.col("K"), F.col("CAP"))
    shifts = F.array_sort(F.collect_list(F.struct("cfg", delta.alias("delta"))))
    # one entry per setting and group
    shifts = materialize(deltas.groupBy(*within, by).agg(shifts.alias("shifts")), "shifts")
    known = df.filter(F.col(y).isNotNull()).select(*within, by, *key, y)
    # rows of one group are shifted alike: what is among the best of all is among the best of its group, but for rounding
    place = F.row_number().over(W.partitionBy(*within, by).orderBy(F.col(y).desc()))
    least = known.withColumn("_p", place).filter(F.col("_p") <= k).groupBy(*within, by).agg(F.min(y).alias("least"))
    near = join_null_safe(known, materialize(least, "least"), [*within, by]).filter(F.col(y) >= F.col("least") - 1e-8)
    rows = materialize(join_null_safe(near.drop("least"), shifts, [*within, by]), "best")
    long = rows.select(*within, *key, F.col(y).alias("_y"), F.inline("shifts"))
    long = long.withColumn("_a", F.round(F.col("_y") - F.col("delta"), 9)).withColumn("_y", F.round("_y", 9))

    def best(col: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*within, "cfg").orderBy(F.col(col).desc(), *key))
        return long.withColumn("_p", place).filter(F.col("_p") <= k).select(*within, "cfg", *key)

    both = best("_y").intersect(best("_a"))
    return both.groupBy(*within, "cfg").agg((F.count("*") / F.lit(float(k))).alias("top_overlap"))


def adjust_by_grid(df: DataFrame, y: str, by: str, within: Sequence[str], key: Sequence[str],
                   name: str = "DPI_region_adj", grid: DataFrame | None = None) -> DataFrame:
    """Apply the best setting of each ``within`` group; adds the score, its shift, K and CAP.

    ``grid`` is a search that was made before.
    """
    within = list(within)
    grid = grid_search(df, y, by, within, key) if grid is None else grid
    best = grid.filter("place = 1").select(*within, "K", "CAP")
    stats = group_stats(df, y, by, within)
    deltas = join_null_safe(stats, best, within, "left").select(
        *within, by, "K", "CAP",
        shift(F.col("n"), F.col("mu"), F.col("grand"), F.col("K"), F.col("CAP")).alias("region_delta"),
    )
    out = join_null_safe(df, materialize(deltas, "deltas"), [*within, by], "left")
    return out.withColumn(name, F.col(y) - F.col("region_delta"))


def top_overlap(df: DataFrame, key: Sequence[str], a: str, b: str, k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Share of the k best by ``a`` that are also among the k best by ``b``; ties by key."""
    def best(col: str) -> DataFrame:
        place = F.row_number().over(
            W.partitionBy(*(by or [F.lit(0)])).orderBy(F.col(col).desc_nulls_last(), *key)
        )
        return df.select(*by, *key, place.alias("place")).filter(F.col("place") <= k).drop("place")

    both = best(a).intersect(best(b))
    names = best(a).select(*by).distinct() if by else None
    counts = both.groupBy(*by).agg((F.count("*") / F.lit(float(k))).alias("top_overlap"))
    if names is None:
        return counts
    return join_null_safe(names, counts, list(by), "left").withColumn(
        "top_overlap", F.coalesce("top_overlap", F.lit(0.0))
    )
