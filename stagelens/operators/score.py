"""Composite score of an event from participation (U), scale (S) and affordability (A)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.functions.conditions import is_free, segment
from stagelens.functions.numeric import clip, geo_score, log1p_count, min_max
from stagelens.operators.adjust import adjust_by_grid
from stagelens.operators.ranks import Rank, join_null_safe, percent_ranks, quantiles
from stagelens.session import materialize, write_clustered

# Fixed values of the score: weights, winsor bounds, multiplier and penalty.
WINSOR = (0.05, 0.95)
WEIGHTS_FREE = (0.60, 0.40)
WEIGHTS_PAID = {"as_run": (0.50, 0.30, 0.20), "as_reported": (0.45, 0.35, 0.20)}
SCALE_WEIGHTS = (0.5, 0.3, 0.2)
REVENUE_POWER, PRICE_POWER = 0.6, 0.4
ACCESS_MAX = 11.0
BONUS_BETA, BONUS_RANGE = 0.10, (0.90, 1.10)
GUARD_BELOW, GUARD_FACTOR = 0.20, 0.95
PROTOTYPE_WEIGHTS = (0.4, 0.3, 0.3)


@dataclass(frozen=True)
class ScoreColumns:
    """Names of the input columns."""

    key: Sequence[str] = ("performance_id",)
    occupancy: str = "occupancy"
    sessions: str = "sessions"
    sold: str = "sold"
    avg_sold: str = "avg_sold"
    price: str = "price"
    revenue: str = "rev_per_session"
    access: str = "access_score"
    region: str = "region"
    by: Sequence[str] = field(default=("kind",))


def iqr_filter(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges of the quartiles; unknown values go."""
    q = quantiles(df, {"_q": F.col(col)}, (0.25, 0.75), by)
    reach = (F.col("_q")[1] - F.col("_q")[0]) * 1.5
    inside = (F.col(col) >= F.col("_q")[0] - reach) & (F.col(col) <= F.col("_q")[1] + reach)
    return join_null_safe(df, q, list(by)).filter(inside).drop("_q")


def group_mean(df: DataFrame, value: Column, name: str, by: Sequence[str]) -> DataFrame:
    """Add the mean of a column over each group, aggregated before it is joined back."""
    means = df.groupBy(*by).agg(F.avg(value).alias(name))
    if by:
        # written, so that the planner knows its size
        return join_null_safe(df, materialize(means, "means"), list(by), "left")
    return df.withColumn(name, means.scalar())


def access_multiplier(df: DataFrame, inclusion: str, by: Sequence[str], name: str = "access_multiplier") -> DataFrame:
    """1 + beta * (root of inclusion rank - its mean), kept within the bonus range."""
    tame = F.sqrt(F.col(inclusion))
    out = group_mean(df, tame, "_mean", by)
    mult = F.lit(1.0) + F.lit(BONUS_BETA) * (tame - F.col("_mean"))
    return out.withColumn(name, clip(mult, *BONUS_RANGE)).drop("_mean")


def guardrail(free: Column, revenue_rank: Column) -> Column:
    """Factor below 1 for paid events in the lowest revenue ranks."""
    low = F.coalesce(~free & (revenue_rank < GUARD_BELOW), F.lit(False))
    return F.when(low, GUARD_FACTOR).otherwise(1.0)


def components(df: DataFrame, variant: str = "as_run", cols: ScoreColumns = ScoreColumns()) -> DataFrame:
    """Add U_participation, S_scale, A_afford and the ranks used on the way.

    ``as_run``       outliers of occupancy removed, A mixes revenue and price ranks
    ``as_reported``  nothing removed, A is one minus the price rank
    """
    by = list(cols.by)
    access = clip(F.coalesce(clip(cols.access, 0, ACCESS_MAX).cast("double"), F.lit(0.0)) / ACCESS_MAX, 0.0, 1.0)
    occupancy = F.col(cols.occupancy)
    if variant == "as_run":
        df = iqr_filter(df, cols.occupancy, by)
        occupancy = clip(occupancy, high=1.0)
    ranks = {
        "_occ": Rank(occupancy, winsor=WINSOR),
        "_sessions": Rank(log1p_count(cols.sessions), winsor=WINSOR),
        "_sold": Rank(log1p_count(cols.sold), winsor=WINSOR),
        "_avg": Rank(F.col(cols.avg_sold), winsor=WINSOR),
        "inclusion_pct": Rank(access, winsor=WINSOR),
        "revenue_pct": Rank(F.col(cols.revenue), winsor=WINSOR),
    }
    if variant == "as_run":
        ranks |= {
            "_price_max": Rank(F.col(cols.price), ties="max"),
            "_rev_max": Rank(F.col(cols.revenue), ties="max"),
        }
    else:
        ranks["_price"] = Rank(F.col(cols.price), winsor=WINSOR)
    out = percent_ranks(df, cols.key, ranks, by)
    wp, ws, wa = SCALE_WEIGHTS
    scale = F.col("_sessions") * wp + F.col("_sold") * ws + F.col("_avg") * wa
    if variant == "as_run":
        # an unknown price rank is not below one half, so it stays unknown
        price_part = F.when(F.col("_price_max") < 0.5, 0.5).otherwise(1 - F.col("_price_max"))
        afford = F.pow(clip(F.col("_rev_max"), 1e-9, 1.0), F.lit(REVENUE_POWER)) * F.pow(
            clip(price_part, 1e-9, 1.0), F.lit(PRICE_POWER)
        )
    else:
        afford = clip(1 - F.col("_price"), 0.0, 1.0)
    out = out.withColumns(
        {
            "U_participation": clip(F.col("_occ"), 0.0, 1.0),
            "S_scale": clip(scale, 0.0, 1.0),
            "A_afford": afford,
        }
    )
    return out.drop("_occ", "_sessions", "_sold", "_avg", "_price_max", "_rev_max", "_price")


def score(
    df: DataFrame,
    variant: str = "as_run",
    cols: ScoreColumns = ScoreColumns(),
    guard: bool = False,
) -> DataFrame:
    """Components, free flag, core score, multiplier, DPI_plus and segment."""
    # written once: the mean of the multiplier and all later steps read it again
    out = df.sparkSession.table(write_clustered(components(df, variant, cols), "components", cols.key))
    free = is_free(cols.price, cols.revenue)
    u, s, a = F.col("U_participation"), F.col("S_scale"), F.col("A_afford")
    core = F.when(free, geo_score([u, s], WEIGHTS_FREE)).otherwise(
        geo_score([u, s, a], WEIGHTS_PAID[variant])
    )
    out = access_multiplier(out.withColumns({"is_free": free, "DPI_core": core}), "inclusion_pct", list(cols.by))
    plus = F.col("DPI_core")
    if variant == "as_reported":
        plus = plus * F.col("access_multiplier")
    if guard:
        plus = plus * guardrail(F.col("is_free"), F.col("revenue_pct"))
    return out.withColumns({"DPI_plus": plus, "segment": segment("is_free")})


def scored(
    df: DataFrame,
    variant: str = "as_run",
    cols: ScoreColumns = ScoreColumns(),
    guard: bool = False,
) -> DataFrame:
    """The whole score with the region adjustment chosen per group and segment."""
    base = score(df, variant, cols, guard)
    return adjust_by_grid(
        base, "DPI_plus", cols.region, [*cols.by, "segment"], cols.key
    )


def prototype_free(df: DataFrame, by: Sequence[str], occupancy: str, sold: str, sessions: str,
                   weights: Sequence[float] = PROTOTYPE_WEIGHTS) -> DataFrame:
    """First version for free events: weighted min-max positions; constant columns give 0."""
    cols = [occupancy, sold, sessions]
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs += [F.min(v).alias(f"_lo_{c}"), F.max(v).alias(f"_hi_{c}")]
    if by:
        out = join_null_safe(df, df.groupBy(*by).agg(*aggs), list(by), "left")
    else:
        row = df.agg(*aggs).first()
        out = df.withColumns({k: F.lit(v).cast("double") for k, v in row.asDict().items()})
    total = F.lit(0.0)
    for c, w in zip(cols, weights):
        total = total + min_max(F.col(c).cast("double"), F.col(f"_lo_{c}"), F.col(f"_hi_{c}")) * w
    return out.withColumn("PI", total).drop(*[f"_{e}_{c}" for c in cols for e in ("lo", "hi")])


def prototype_score(df: DataFrame, cols: ScoreColumns = ScoreColumns(), cv: str | None = None) -> DataFrame:
    """Early composite score: stability in U, sessions alone as S, guardrail on revenue.

    ``cv`` names a column with the variation of occupancy over sessions; without it
    stability is neutral.
    """
    ranks = {
        "_occ": Rank(F.col(cols.occupancy), winsor=WINSOR),
        "_sessions": Rank(log1p_count(cols.sessions), winsor=WINSOR),
        "_price": Rank(F.col(cols.price), winsor=WINSOR),
        "_rev": Rank(F.col(cols.revenue), winsor=WINSOR),
    }
    if cv:
        ranks["_cv"] = Rank(F.col(cv), winsor=WINSOR)
    out = percent_ranks(df, cols.key, ranks, list(cols.by))
    stability = clip(1 - F.col("_cv"), 0.0, 1.0) if cv else F.lit(1.0)
    u = F.sqrt(clip(F.col("_occ"), 0.0, 1.0) * stability)
    s = clip(F.col("_sessions"), 0.0, 1.0)
    a = clip(1 - F.col("_price"), 0.0, 1.0)
    free = is_free(cols.price, cols.revenue)
    final = F.when(free, geo_score([u, s], WEIGHTS_FREE)).otherwise(
        geo_score([u, s, a], WEIGHTS_PAID["as_reported"]) * guardrail(free, F.col("_rev"))
    )
    return out.withColumns(
        {"U": u * 100, "S": s * 100, "A": a * 100, "is_free": free, "DPI_final": final}
    ).drop(*ranks)


def weighted_leaderboard(df: DataFrame, by: Sequence[str], weight: str, means: Mapping[str, str],
                         median: str) -> DataFrame:
    """Weighted means, total weight and a median per group (title level summary)."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0)) + 1e-9
    aggs = [(F.sum(F.col(c) * w) / F.sum(w)).alias(n) for n, c in means.items()]
    table = df.groupBy(*by).agg(*aggs, F.sum(weight).alias("total_weight"))
    mid = quantiles(df, {"median_value": F.col(median)}, (0.5,), by)
    mid = mid.withColumn("median_value", F.col("median_value")[0])
    return join_null_safe(table, mid, list(by), "left")


def top_n(df: DataFrame, order: Sequence[Column], n: int, by: Sequence[str] = ()) -> DataFrame:
    """First n rows of an explicit order, per group if asked."""
    if not by:
        return df.orderBy(*order).limit(n)
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)
