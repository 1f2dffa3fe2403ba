"""Queries on metrics, ranks, scores and region adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelens.functions import conditions as C
from stagelens.functions import numeric as N
from stagelens.operators import adjust as A
from stagelens.operators import metrics as M
from stagelens.operators import ranks as R
from stagelens.operators import score as S
from stagelens.plans import fixtures as fx
from stagelens.plans import stages
from stagelens.session import write_clustered

QUERIES_SCORE = {}


def register(fn):
    QUERIES_SCORE[fn.__name__] = fn
    return fn


def r(c, digits: int = 6):
    """Rounded for comparison with another engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits)


@register
def perf_metrics(spark: SparkSession, sf: str) -> DataFrame:
    m = M.event_metrics(fx.ticket(spark, sf), fx.performance(spark, sf))
    return m.select(
        "performance_id", "title", "facility", "region", "seats", "kind", "access_score", "sessions", "sold",
        r("revenue", 2).alias("revenue"),
        "occupancy", "avg_sold", "price", "rev_per_session",
    )


@register
def top_revenue(spark, sf):
    m = M.event_metrics(fx.ticket(spark, sf), fx.performance(spark, sf))
    top = S.top_n(m, [F.col("revenue").desc(), F.col("performance_id")], 5)
    return top.select("performance_id", "title", "region", "sessions", "sold", r("revenue", 2).alias("revenue"))


@register
def occupancy_over_one(spark, sf):
    return stages.metrics(spark, sf).groupBy("kind").agg(
        F.count_if(F.col("occupancy") > 1).alias("over"),
        F.count_if(F.col("occupancy").isNull()).alias("unknown"),
        F.count("*").alias("n"),
    )


@register
def winsor_pctrank(spark, sf):
    m = stages.metrics(spark, sf)
    ranked = R.percent_ranks(
        m, ["performance_id"],
        {"occ_pct": R.Rank(F.col("occupancy"), winsor=S.WINSOR), "price_pct": R.Rank(F.col("price"), winsor=S.WINSOR)},
    )
    return ranked.select("performance_id", r("occ_pct").alias("occ_pct"), r("price_pct").alias("price_pct"))


@register
def cohort_pctrank(spark, sf):
    """Winsor and rank inside cohorts (year)."""
    ranked = R.percent_ranks(
        stages.metrics(spark, sf), ["performance_id"],
        {"rev_pct": R.Rank(F.col("rev_per_session"), winsor=S.WINSOR)}, by=["yr"],
    )
    return ranked.select("performance_id", "yr", r("rev_pct").alias("rev_pct"))


@register
def pctrank_max(spark, sf):
    ranked = R.percent_ranks(
        stages.metrics(spark, sf), ["performance_id"],
        {"price_pct": R.Rank(F.col("price"), ties="max"), "rev_pct": R.Rank(F.col("rev_per_session"), ties="max")},
        by=["kind"],
    )
    return ranked.select("performance_id", r("price_pct").alias("price_pct"), r("rev_pct").alias("rev_pct"))


@register
def iqr_filter(spark, sf):
    kept = S.iqr_filter(stages.metrics(spark, sf), "occupancy", ["kind"])
    return kept.select("performance_id", "kind", r("occupancy", 4).alias("occupancy"))


@register
def venue_bucket(spark, sf):
    m = stages.metrics(spark, sf).select(
        C.venue_size("seats").alias("size"), C.venue_size("seats", inclusive=False).alias("size_strict"), "occupancy"
    )
    return m.groupBy("size", "size_strict").agg(F.count("*").alias("n"), r(F.avg("occupancy"), 4).alias("mean_occ"))


@register
def segment_flag(spark, sf):
    m = stages.metrics(spark, sf)
    flags = {rule: C.is_free("price", "rev_per_session", rule) for rule in ("any_or_missing", "any_known", "both_zero")}
    m = m.select("kind", *[c.alias(n) for n, c in flags.items()], C.segment(flags["any_or_missing"]).alias("segment"))
    return m.groupBy("kind", "segment").agg(
        *[F.count_if(n).alias(n) for n in flags], F.count("*").alias("n")
    )


def _dpi(df):
    return df.select(
        "performance_id", "kind", "segment", "is_free",
        *[r(c).alias(c) for c in ("U_participation", "S_scale", "A_afford", "access_multiplier")],
        *[r(c, 4).alias(c) for c in ("DPI_core", "DPI_plus", "DPI_region_adj")],
    )


@register
def dpi_as_run(spark, sf):
    return _dpi(stages.scored(spark, sf, "as_run"))


@register
def dpi_as_reported(spark, sf):
    return _dpi(stages.scored(spark, sf, "as_reported"))


@register
def dpi_guardrail(spark, sf):
    return _dpi(stages.scored(spark, sf, "as_reported", guard=True))


@register
def dpi_access_multiplier(spark, sf):
    s = stages.scored(spark, sf, "as_run")
    return s.groupBy("kind", "access_score").agg(
        F.count("*").alias("n"), r(F.min("access_multiplier")).alias("lo"), r(F.max("access_multiplier")).alias("hi")
    )


@register
def dpi_prototype_free(spark, sf):
    m = stages.metrics(spark, sf).filter(C.is_free("price", "rev_per_session", "both_zero"))
    out = S.prototype_free(m, ["kind"], "occupancy", "sold", "sessions")
    return out.select("performance_id", "kind", r("PI").alias("PI"))


@register
def dpi_prototype(spark, sf):
    """Prototype score with stability from the spread of session sizes."""
    per_event = M.session_sales(fx.ticket(spark, sf)).groupBy("performance_id").agg(
        r(F.try_divide(F.stddev_pop("sold"), F.avg("sold")), 9).alias("cv")
    )
    m = stages.metrics(spark, sf).join(per_event, "performance_id")
    m = spark.table(write_clustered(m, "prototype", stages.EVENT))  # the ranks read it several times
    out = S.prototype_score(m, cv="cv")
    return out.select(
        "performance_id", "is_free", *[r(c, 4).alias(c) for c in ("U", "S", "A", "DPI_final")]
    )


@register
def region_eta2(spark, sf):
    e = A.effect(stages.scored(spark, sf), "DPI_plus", "region", ["kind", "segment"])
    return e.select("kind", "segment", "n", "groups", r("eta2").alias("eta2"))


@register
def region_rms(spark, sf):
    e = A.effect(stages.scored(spark, sf), "DPI_plus", "region", ["kind", "segment"])
    return e.select("kind", "segment", r("rms").alias("rms"))


@register
def region_adjust(spark, sf):
    out = A.region_adjust(stages.scored(spark, sf), "DPI_plus", "region", ["kind", "segment"], 30, 4.0)
    return out.select("performance_id", r("adjusted", 4).alias("adjusted"))


@register
def region_grid(spark, sf):
    return stages.grid(spark, sf).select(
        "kind", "segment", "cfg", F.col("K").alias("k"), F.col("CAP").alias("cap"), "place",
        *[r(c).alias(c) for c in ("eta_pre", "eta_post", "rms_pre", "rms_post", "dist_p95", "dist_mean_abs",
                                  "cap_saturation", "spearman")],
        r("score", 4).alias("score"),
    )


@register
def region_grid_overlap(spark, sf):
    return A.grid_top_overlap(stages.scored(spark, sf), "DPI_plus", "region", ["kind", "segment"], ["performance_id"])


@register
def region_before_after(spark, sf):
    s = stages.scored(spark, sf)
    return s.groupBy("kind", "segment", "region").agg(
        F.count("*").alias("n"), r(F.avg("DPI_plus"), 4).alias("before"), r(F.avg("DPI_region_adj"), 4).alias("after")
    )


@register
def region_rank_pct(spark, sf):
    out = R.percent_ranks(
        stages.scored(spark, sf), ["performance_id"], {"pct": R.Rank(F.col("DPI_plus"))}, ["kind", "segment", "region"]
    )
    return out.select("performance_id", "region", r("pct").alias("pct"))


@register
def spearman(spark, sf):
    s = stages.scored(spark, sf).filter(F.col("DPI_plus").isNotNull())
    s = s.select("performance_id", "kind", "segment", "DPI_plus", "DPI_region_adj", "occupancy", "sold")
    corr = R.rank_corr(
        s, ["performance_id"], F.col("DPI_plus"),
        [F.col("DPI_region_adj"), F.col("occupancy"), F.col("sold")], ["kind", "segment"],
    )
    names = {0: "adj", 1: "occ", 2: "sold"}
    return corr.groupBy("kind", "segment").agg(
        *[r(F.max(F.when(F.col("m") == m, F.col("corr")))).alias(n) for m, n in names.items()]
    )


@register
def topk_overlap(spark, sf):
    s = stages.scored(spark, sf).select(
        "kind", "segment", "performance_id", r("DPI_plus").alias("a"), r("DPI_region_adj").alias("b")
    )
    return A.top_overlap(s, ["performance_id"], "a", "b", 10, ["kind", "segment"])


@register
def leaderboard(spark, sf):
    """Ten best events of each kind and segment by the adjusted score."""
    s = stages.scored(spark, sf).select(
        "kind", "segment", "performance_id", "title",
        *[r(c).alias(c) for c in ("DPI_region_adj", "U_participation", "S_scale", "A_afford")],
    )
    order = [F.col(c).desc_nulls_last() for c in ("DPI_region_adj", "U_participation", "S_scale", "A_afford")]
    return S.top_n(s, [*order, F.col("performance_id")], 10, ["kind", "segment"])


@register
def title_leaderboard(spark, sf):
    s = stages.scored(spark, sf)
    t = S.weighted_leaderboard(
        s, ["title", "region"], "sessions", {"dpi_wmean": "DPI_region_adj", "u_wmean": "U_participation"}, "price"
    )
    return t.select("title", "region", r("dpi_wmean", 4).alias("dpi_wmean"), r("u_wmean").alias("u_wmean"),
                    F.col("total_weight").alias("sessions"), r("median_value").alias("median_price"))
