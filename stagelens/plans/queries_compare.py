"""Queries on profiles, group comparison, tests, improvement and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelens.functions import conditions as C
from stagelens.functions import numeric as N
from stagelens.functions import text as X
from stagelens.operators import checks as K
from stagelens.operators import cluster as CL
from stagelens.operators import compare as P
from stagelens.operators import forest as FO
from stagelens.operators import improve as I
from stagelens.operators import inference as H
from stagelens.operators import keys as U
from stagelens.operators import metrics as M
from stagelens.operators import profile as PR
from stagelens.operators import summaries as SU
from stagelens.operators import score as S
from stagelens.operators.score import WEIGHTS_FREE, WEIGHTS_PAID
from stagelens.plans import fixtures as fx
from stagelens.plans import stages
from stagelens.plans.queries_score import r
from stagelens.session import scratch_path
from stagelens.sources import files as FI

QUERIES_COMPARE = {}


def register(fn):
    QUERIES_COMPARE[fn.__name__] = fn
    return fn


METRICS = ["DPI_plus", "U_participation", "S_scale", "A_afford"]


def scored_events(spark, sf, variant: str = "as_run"):
    """Scored events with size class, recorded genre and the first run's predicted pair."""
    def build():
        run = stages.predictions(spark, sf).filter("run_id = 1").select("performance_id", "genre1", "genre2", "p1", "p2")
        names = stages.labels(spark, sf).select("performance_id", F.col("mid").alias("genre"), "broad")
        rows = stages.scored(spark, sf, variant).withColumn("size", C.venue_size("seats"))
        return rows.join(run, "performance_id", "left").join(names, "performance_id", "left")

    return stages.clustered(spark, sf, f"events_{variant}", build)


def stored_events(spark, sf):
    """The reported events with the scores of a ranked list that was stored with one digit, from an earlier run with the guardrail."""
    def build():
        path = scratch_path(spark, "stored-scores")
        run = stages.scored(spark, sf, "as_reported", guard=True)
        FI.write_ranked(run.select("segment", "performance_id", *[F.round(c, 1).alias(c) for c in METRICS]), path, "segment",
                        ["DPI_plus"], ["performance_id"])
        back = FI.read_ranked(spark, path).select(F.col("performance_id").cast("long"), *[F.col(c).cast("double") for c in METRICS])
        return scored_events(spark, sf, "as_reported").drop(*METRICS).join(back, "performance_id")

    return stages.stage(spark, sf, "events_stored", build)


def composite(spark, sf):
    return scored_events(spark, sf).filter("kind = 'composite'")


def single(spark, sf):
    return scored_events(spark, sf).filter("kind = 'single'")


def pairs(spark, sf):
    return stages.stage(spark, sf, "pairs", lambda: P.pair_table(composite(spark, sf), single(spark, sf)))


# ------------------------------------------------------------------ profiling

@register
def net_sales_reconcile(spark, sf):
    """Signed sums of the transactions against the event metrics, and row counts."""
    t = fx.ticket(spark, sf)
    sessions = M.session_sales(t)
    events = M.event_sales(t)
    raw = t.agg(F.sum(M.signed("amount")).cast("double").alias("revenue"), F.sum(M.signed("quantity")).cast("double").alias("sold"))
    per_session = sessions.agg(F.sum("revenue").cast("double").alias("revenue"), F.sum("sold").cast("double").alias("sold"))
    model = events.agg(F.sum("revenue").alias("revenue"), F.sum("sold").cast("double").alias("sold"))

    def long(df, name):
        return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias(name)) for c in ("revenue", "sold")])))

    out = long(raw, "raw").join(long(per_session, "sessions"), "item").join(long(model, "model"), "item")
    return out.select("item", *[r(c, 2).alias(c) for c in ("raw", "sessions", "model")],
                      (F.abs(F.col("raw") - F.col("model")) < 1).alias("match"))


@register
def rows_reconcile(spark, sf):
    """Rows and amounts of the flat tickets against the fact table of the model, joined to its dimensions."""
    from stagelens.plans.queries_graph import model_of

    tables = model_of(spark, sf)
    fact = tables["ticket_event"].join(tables["show_session"], "session_id").join(tables["performance"], "performance_id")
    out = K.reconcile(fx.ticket(spark, sf), fact, {"amount": (F.col("amount"), F.col("amount"))})
    return out.select("item", r("raw", 2).alias("raw"), r("model", 2).alias("model"), "match")


@register
def key_uniqueness(spark, sf):
    return PR.key_uniqueness(fx.ticket(spark, sf), {
        "ticket": ["ticket_no"],
        "ticket+type": ["ticket_no", "event_type"],
        "ticket+type+time": ["ticket_no", "event_type", "show_at"],
        "ticket+part+supplier": ["ticket_no", "l_partkey", "l_suppkey"],
        "session": ["performance_id", "show_at"],
    })


@register
def fd_violations(spark, sf):
    """Which columns follow from which key, for several keys."""
    cols = ["facility", "region", "title", "seats", "access_score", "kind", "yr"]
    return PR.fd_table(fx.performance(spark, sf), ["facility", "region", "title", "kind"], cols)


@register
def column_profile(spark, sf):
    out = PR.column_profile(fx.performance(spark, sf))
    return out.select("column", "distinct_values", r("missing_pct", 4).alias("missing_pct"), "example")


@register
def schema_table(spark, sf):
    return PR.schema_table(fx.table(spark, sf, "customer"), "customer")


@register
def missing_by_year(spark, sf):
    perf = fx.performance(spark, sf).withColumn("note", F.when(F.col("access_score") > 2, " ").otherwise(F.col("title")))
    return PR.missing_by(perf, ["kind", "yr"], ["title", "seats", "note"])


@register
def missing_pivot(spark, sf):
    """Missing rate per kind and column in every year of the data, with its change since the year before."""
    perf = fx.performance(spark, sf)
    rates = PR.missing_by(perf, ["kind", "yr"], ["title", "seats", "access_score"])
    out = SU.step_changes(rates, "yr", "missing_pct", ["kind", "column"])
    return out.select("kind", "column", "yr", r("missing_pct", 2).alias("rate"), r("change", 2).alias("change"))


@register
def drop_columns(spark, sf):
    perf = fx.performance(spark, sf).withColumn("writer", F.when(F.col("access_score") == 0, F.col("title")))
    return PR.drop_candidates(PR.missing_by(perf, ["kind", "yr"], ["title", "seats", "writer"]))


@register
def group_size_dist(spark, sf):
    return PR.group_size_dist(fx.ticket(spark, sf), ["ticket_no"])


@register
def sessions_per_event(spark, sf):
    return PR.distinct_dist(fx.ticket(spark, sf), "performance_id", "show_at")


@register
def multi_value_stats(spark, sf):
    return PR.multi_value_stats(stages.cells(spark, sf), ["cast_txt", "crew_txt", "org_txt"], ["performance_id"])


@register
def genre_distribution(spark, sf):
    out = SU.value_counts(scored_events(spark, sf), ["kind", "genre"])
    return out.select("kind", "genre", "n", r("share").alias("share"))


@register
def booked_and_cancelled(spark, sf):
    """Tickets that were both booked and cancelled (condition on two conditional counts)."""
    t = fx.ticket(spark, sf).groupBy("ticket_no").agg(
        F.count_if(F.col("event_type") == "booking").alias("b"), F.count_if(F.col("event_type") == "cancel").alias("c")
    )
    return t.filter("b > 0 AND c > 0").agg(F.count("*").alias("tickets"), F.sum("b").alias("bookings"), F.sum("c").alias("cancels"))


@register
def shared_titles(spark, sf):
    """Titles used by more than one event."""
    return fx.performance(spark, sf).groupBy("title").agg(F.count("*").alias("events")).filter("events > 1")


@register
def dedup_keep_none(spark, sf):
    out = U.keep_unique(fx.performance(spark, sf).select("title", "yr", "kind", "performance_id"), ["title", "yr"])
    return out.select("title", "yr", "kind", "performance_id")


@register
def dedup_keep_first(spark, sf):
    return U.keep_first(
        fx.performance(spark, sf).select("title", "yr", "kind", "performance_id"), ["title", "yr"], ["performance_id"]
    )


@register
def access_flags(spark, sf):
    """Boolean spellings parsed and counted; one unknown flag makes the count unknown."""
    o = fx.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    texts = [
        F.when(k % 2 == 0, "True").otherwise("N"),
        F.when(k % 3 == 0, "Y").otherwise("false"),
        F.when(k % 11 == 0, "?").when(k % 5 == 0, "1").otherwise("0"),
    ]
    score = M.access_score(*[C.parse_bool(t) for t in texts])
    return o.select("o_orderkey", score.alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


@register
def exclusion_filter(spark, sf):
    """Events of other genres are kept, and so are events without a genre."""
    p = fx.performance(spark, sf).join(stages.labels(spark, sf), "performance_id", "left")
    kept = p.filter(C.not_equal_keep_null("mid", "PROMO"))
    kept = kept.filter((F.col("kind") == "single") | C.not_equal_keep_null("broad", "basic"))
    return kept.groupBy("kind", "mid").agg(F.count("*").alias("n"), F.count_if(C.contains("title", "01")).alias("with_01"))


# ------------------------------------------------------------------ comparison

@register
def mean_table(spark, sf):
    out = SU.mean_table(scored_events(spark, sf), "kind", "composite", "single", METRICS)
    return out.select("metric", *[r(c).alias(c) for c in ("mean_first", "mean_second", "difference")])


@register
def rollup_means(spark, sf):
    out = SU.rollup_means(scored_events(spark, sf), ["kind", "segment"], [*METRICS, "DPI_region_adj"])
    return out.select("kind", "segment", F.col("level").cast("bigint").alias("level"), "n",
                      *[r(c).alias(c) for c in [*METRICS, "DPI_region_adj"]])


@register
def welch_stats(spark, sf):
    out = H.welch(scored_events(spark, sf), "kind", "composite", "single", METRICS, ["segment"])
    return out.select("segment", "metric", "n1", "n2", *[r(c, 5).alias(c) for c in ("mean1", "mean2", "t", "dof")])


@register
def welch_p(spark, sf):
    out = H.welch_p(scored_events(spark, sf), "kind", "composite", "single", METRICS, ["segment"])
    return out.select("segment", "metric", r("p", 3).alias("p"))


@register
def anova_f(spark, sf):
    e = composite(spark, sf)
    out = H.anova(e, "region", "occupancy").unionByName(H.anova(e, "size", "revenue")).unionByName(H.anova(e, "region", "DPI_plus"))
    return out.select("by", "metric", "groups", "n", "dof1", "dof2", r("f", 5).alias("f"), r("explained").alias("explained"))


@register
def anova_p(spark, sf):
    e = composite(spark, sf)
    out = H.anova_p(e, "region", "occupancy").unionByName(H.anova_p(e, "size", "revenue"))
    return out.select("by", "metric", r("p", 3).alias("p"))


@register
def kruskal_h(spark, sf):
    e = composite(spark, sf)
    out = H.kruskal(e, "region", "sessions", ["performance_id"]).unionByName(H.kruskal(e, "size", "sold", ["performance_id"]))
    return out.select("by", "metric", "groups", "n", "dof", r("h", 5).alias("h"))


@register
def kruskal_p(spark, sf):
    out = H.kruskal_p(composite(spark, sf), "region", "sessions", ["performance_id"])
    return out.select("by", "metric", r("p", 3).alias("p"))


@register
def chi2_stat(spark, sf):
    e = scored_events(spark, sf)
    out = H.chi2(e, "region", "size").unionByName(H.chi2(e, "kind", "segment"))
    return out.select("row", "col", "rows", "cols", "n", "dof", r("chi2", 5).alias("chi2"))


@register
def chi2_p(spark, sf):
    out = H.chi2_p(scored_events(spark, sf), "region", "size")
    return out.select("row", "col", r("p", 3).alias("p"))


@register
def group_summary(spark, sf):
    means = {"occupancy": "occupancy", "sessions": "sessions", "sold": "sold", "revenue": "revenue",
             "free_rate": F.col("is_free").cast("int"), "U": "U_participation", "S": "S_scale", "A": "A_afford", "DPI": "DPI_plus"}
    out = SU.group_summary(composite(spark, sf), ["region"], means, {"median_revenue": F.col("revenue")})
    return out.select("region", "n", *[r(c, 4).alias(c) for c in [*means, "median_revenue"]])


@register
def summary_extremes(spark, sf):
    """Group with the largest and smallest mean of each metric."""
    t = SU.group_summary(composite(spark, sf), ["region"], {"occ": "occupancy", "rev": "revenue", "ses": "sessions"})
    t = t.select("region", "n", *[r(c).alias(c) for c in ("occ", "rev", "ses")])
    return SU.extremes(t, "region", ["occ", "rev", "ses"], 10)


@register
def concentration(spark, sf):
    out = SU.concentration(scored_events(spark, sf), "region", "revenue")
    return out.select("region", "n", r("mean", 4).alias("mean"), r("median", 3).alias("median"), r("top_share").alias("top_share"))


@register
def crosstab(spark, sf):
    return SU.crosstab(scored_events(spark, sf), "region", "size", list(C.VENUE_LABELS))


@register
def corr_matrix(spark, sf):
    out = SU.corr_matrix(scored_events(spark, sf), [*METRICS, "price", "occupancy"])
    return out.select("a", "b", r("corr").alias("corr"))


@register
def histogram_table(spark, sf):
    e = scored_events(spark, sf).withColumn("score", r("DPI_plus", 6))
    out = SU.histogram(e, "score", 30, ["segment"])
    return out.select("segment", "bin", "n", r("from").alias("from"), r("to").alias("to"))


@register
def boxplot_table(spark, sf):
    out = SU.five_numbers(scored_events(spark, sf), ["kind", "segment"], "DPI_plus")
    return out.select("kind", "segment", *[r(c, 5).alias(c) for c in ("lowest", "q1", "median", "q3", "highest")])


@register
def mean_interval(spark, sf):
    out = SU.mean_interval(scored_events(spark, sf), ["genre", "segment"], "DPI_region_adj", ["performance_id"])
    return out.select("genre", "segment", "n", *[r(c, 5).alias(c) for c in ("mean", "low", "high")])


@register
def describe_columns(spark, sf):
    out = SU.describe_columns(composite(spark, sf), METRICS)
    return out.select("column", *[r(c).alias(c) for c in ("mean", "min", "max")])


def _pair_columns(df):
    nums = ["DPI_AB", "U_AB", "S_AB", "A_AB", "DPI_A", "DPI_B", "U_A", "U_B", "S_A", "S_B", "A_A", "A_B", "baseline"]
    return df.select("segment", "size", "pair", "n", "genre_A", "genre_B", "verdict", *[r(c).alias(c) for c in nums])


@register
def pair_judgment(spark, sf):
    return _pair_columns(pairs(spark, sf))


@register
def success_rate(spark, sf):
    out = P.success_rate(pairs(spark, sf))
    return out.select("segment", "rows", "successes", r("rate", 4).alias("rate"), "events", "rows_min_n")


@register
def success_cube(spark, sf):
    out = SU.success_cube(pairs(spark, sf), ["pair", "size"], "verdict", P.SUCCESS, P.FAIL)
    return out.select("pair", "size", F.col("level").cast("bigint").alias("level"), "successes", "failures", r("rate", 4).alias("rate"))


@register
def verdict_audit(spark, sf):
    """Stored verdicts against the rule; every third pair name carries a flipped verdict."""
    flipped = F.when(F.length("pair") % 3 == 0, F.when(F.col("verdict") == P.SUCCESS, P.FAIL).otherwise(P.SUCCESS)).otherwise(F.col("verdict"))
    rows = pairs(spark, sf).filter(F.col("verdict") != P.UNDECIDABLE).withColumn("stored", flipped)
    out = P.audit(rows, "stored")
    return out.select("segment", "rows", "successes", "failures", r("rule_matches").alias("rule_matches"), "pairs",
                      P.which_rate(out, 50.0, 5.0).alias("equals"))


@register
def wins_either(spark, sf):
    rows = P.against_singles(composite(spark, sf), single(spark, sf), "DPI_region_adj", "facility", by=["segment"])
    return P.wins_summary(rows, ["segment"]).select("segment", "comparable", "wins", r("rate", 4).alias("rate"))


def _gain_rows(spark, sf):
    from stagelens.functions.text import pair_key

    rows = P.against_singles(composite(spark, sf), single(spark, sf), "DPI_region_adj", "facility", by=["segment"])
    return rows.withColumn("pair", pair_key("genre1", "genre2"))


@register
def gain_by_pair(spark, sf):
    out = P.gains(_gain_rows(spark, sf), ["pair"], 5)
    return out.select("pair", "n", r("win_rate", 4).alias("win_rate"), r("mean_gain", 4).alias("mean_gain"))


@register
def gain_by_region(spark, sf):
    out = P.gains(_gain_rows(spark, sf), ["region"])
    return out.select("region", "n", r("win_rate", 4).alias("win_rate"), r("mean_gain", 4).alias("mean_gain"))


@register
def gain_overall(spark, sf):
    out = SU.group_summary(
        _gain_rows(spark, sf).filter("comparable"), ["segment"],
        {"win_rate": F.col("wins").cast("int") * 100, "mean_gain": "gain", "mean_ratio": "gain_ratio"}, {"median_gain": F.col("gain")},
    )
    return out.select("segment", "n", *[r(c, 4).alias(c) for c in ("win_rate", "mean_gain", "mean_ratio", "median_gain")])


@register
def gain_extremes(spark, sf):
    rows = _gain_rows(spark, sf).withColumn("gain", r("gain"))
    out = P.best_and_worst(rows, "gain", ["performance_id"])
    return out.select("side", "performance_id", "title", "region", "facility", "pair", r("best_single").alias("best_single"), "gain")


@register
def top_pair_means(spark, sf):
    """Mean adjusted score by segment for the ten best pairs."""
    rows = _gain_rows(spark, sf)
    best = P.in_top_groups(rows, "pair", "DPI_region_adj")
    out = best.groupBy("pair").agg(
        *[F.avg(F.when(F.col("segment") == s, F.col("DPI_region_adj"))).alias(s) for s in ("Paid", "Free")], F.count("*").alias("n")
    )
    return out.select("pair", "n", r("Paid", 4).alias("paid"), r("Free", 4).alias("free"))


@register
def pair_means(spark, sf):
    """Mean adjusted score of every pair, by segment."""
    out = P.group_means(_gain_rows(spark, sf), "pair", "DPI_region_adj", "segment", ["Paid", "Free"])
    return out.select("pair", "n", *[r(c, 4).alias(c.lower()) for c in ("mean", "Paid", "Free")])


@register
def most_frequent_pairs(spark, sf):
    """The ten pairs with the most events."""
    rows = _gain_rows(spark, sf).groupBy("pair").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "pair").limit(10)


@register
def region_pair_events(spark, sf):
    """Count and mean of all mixed events per region, comparable or not."""
    out = composite(spark, sf).groupBy("region").agg(F.count("*").alias("n"), F.avg("DPI_region_adj").alias("mean"))
    return out.select("region", "n", r("mean", 4).alias("mean"))


@register
def candidate_sources(spark, sf):
    """Which average reproduces a reported number: all candidate means side by side."""
    p = pairs(spark, sf).filter(F.col("verdict") != P.UNDECIDABLE)
    out = SU.rollup_means(p, ["segment"], ["DPI_AB", "baseline", "U_AB", "S_AB", "A_AB"])
    return out.select("segment", "n", *[r(c).alias(c) for c in ("DPI_AB", "baseline", "U_AB", "S_AB", "A_AB")],
                      (F.abs(F.col("DPI_AB") - 45.0) < 5).alias("near_45"))


@register
def variant_sweep(spark, sf):
    """Both computed variants and the stored scores judged the same way: success, means and their difference."""
    out = None
    for variant in ("as_run", "as_reported", "stored"):
        e = stored_events(spark, sf) if variant == "stored" else scored_events(spark, sf, variant)
        comp, alone = e.filter("kind = 'composite'"), e.filter("kind = 'single'")
        t = P.success_rate(P.pair_table(comp, alone))
        means = e.groupBy("segment").agg(*[
            F.avg(F.when(F.col("kind") == k, F.col("DPI_plus"))).alias(f"mean_{k}") for k in ("composite", "single")])
        tests = H.welch(e, "kind", "composite", "single", ["DPI_plus"], ["segment"]).select("segment", "t")
        t = t.join(means, "segment").join(tests, "segment").select(
            F.lit(variant).alias("variant"), "segment", "rows", "successes", r("rate", 4).alias("rate"),
            r("mean_composite", 4).alias("mean_composite"), r("mean_single", 4).alias("mean_single"), r("t", 4).alias("t"))
        out = t if out is None else out.unionByName(t)
    return out


@register
def table_diff(spark, sf):
    """Guarded and plain reported scores compared by event, outer."""
    a = stages.scored(spark, sf, "as_run").select("performance_id", r("A_afford", 3).alias("A_afford"), "segment")
    b = stages.scored(spark, sf, "as_reported").select("performance_id", r("A_afford", 3).alias("A_afford"), "segment")
    d = K.diff_tables(a, b, ["performance_id"], ["segment", "A_afford"])
    return d.groupBy("found", "same").agg(F.count("*").alias("n"), r(F.max(F.abs(F.col("A_afford_a") - F.col("A_afford_b"))), 3).alias("largest"))


def _checks(spark, sf):
    e = scored_events(spark, sf)
    return K.check_table(e, "compare", [
        ("events", F.count("*"), F.count("performance_id"), "invariant", 0.0),
        ("best segment", F.max("segment"), "Paid", "text", 0.0),
        ("first kind", F.min("kind"), "single", "text", 0.0),
        ("mean score", F.round(F.avg("DPI_plus"), 2), 45.0, "report", 10.0),
        ("mean price", F.round(F.avg("price"), 0), 0.0, "report", 1.0),
    ])


@register
def check_table(spark, sf):
    return _checks(spark, sf).select("step", "item", "source", "match")


@register
def check_rollup(spark, sf):
    return K.check_rollup(_checks(spark, sf))


# ------------------------------------------------------------------ improvement

@register
def min_improvement_formula(spark, sf):
    fails = pairs(spark, sf).filter(F.col("verdict") == P.FAIL)
    out = I.minimal_improvement(fails, ["size", "pair"])
    return out.select("segment", "size", "pair", "converted", *[r(c, 4).alias(c) for c in ("dU", "dS", "dA", "gap", "predicted", "margin")])


@register
def improvement_summary(spark, sf):
    out = I.minimal_improvement(pairs(spark, sf).filter(F.col("verdict") == P.FAIL), ["size", "pair"])
    return out.groupBy("segment").agg(
        F.count("*").alias("fails"), r(F.avg(F.col("converted").cast("int")), 4).alias("conversion"),
        *[r(F.avg(c), 4).alias(c) for c in ("dU", "dS", "dA", "gap", "margin")],
    )


@register
def whatif_formula(spark, sf):
    out = I.what_if(pairs(spark, sf).filter(F.col("verdict") == P.FAIL))
    return out.select("segment", "n", "axis", r("uplift", 5).alias("uplift"))


@register
def formula_fit(spark, sf):
    """The score against its own formula with the other variant's weights."""
    u, s, a = F.col("U_participation"), F.col("S_scale"), F.col("A_afford")
    other = F.when(F.col("segment") == "Free", N.geo_score([u, s], WEIGHTS_FREE)).otherwise(N.geo_score([u, s, a], WEIGHTS_PAID["as_reported"]))
    out = H.formula_fit(scored_events(spark, sf), "DPI_plus", other, ["kind", "segment"])
    return out.select("kind", "segment", "n", *[r(c).alias(c) for c in ("corr", "r2", "ratio_min", "ratio_max")])


@register
def combined_figures(spark, sf):
    """Figures of two lists that know different events and columns, the first one's where both have one."""
    m = stages.metrics(spark, sf)
    a = m.filter("performance_id % 3 <> 0").select(
        "performance_id", F.when(F.col("sold") > 20, F.col("sold")).alias("sold"), F.col("occupancy"))
    b = m.filter("performance_id % 2 = 0").select("performance_id", (F.col("sold") + 1).alias("sold"), F.col("sessions"))
    out = U.combine_first(a, b, ["performance_id"], ["sold", "occupancy", "sessions"])
    return out.select("performance_id", "sold", r("occupancy").alias("occupancy"), "sessions")


@register
def picked_columns(spark, sf):
    """Wanted columns of a list whose header has blanks, checked for values; one that it has not is added empty; the words of a name counted and joined."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias(" key "), F.col("c_name").alias("name "))
    picked = C.assert_columns(C.pick_existing(c, ["key", "name", "note"], add_missing=True), ["key", "name"])
    parts = F.split("name", "#")
    return picked.select("key", "note", X.joined(parts).alias("joined"), X.list_length(F.concat_ws(",", parts)).alias("parts"))


PAIR_FEATURES = ["U_AB", "S_AB", "A_AB"]
PAIR_KEY = ["segment", "size", "pair"]


def _by_segment(spark, sf, fit):
    """One row of figures per segment from ``fit(pair rows of the segment)``."""
    out = None
    for name in ("Paid", "Free"):
        rows = pairs(spark, sf).filter(F.col("segment") == name)
        row = fit(rows).withColumn("segment", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@register
def linreg(spark, sf):
    """Linear regression of the pair score per segment: rows, and whether its errors are what least squares leaves.

    The errors on the training rows add up to nothing, alone and times any feature, and the
    fit is better than the mean.
    """
    def fit(rows):
        model, figures = I.regress(rows, PAIR_FEATURES, "DPI_AB", PAIR_KEY)
        known = I.vectors(rows, PAIR_FEATURES, "DPI_AB", PAIR_KEY).filter(U.in_training(0.8, *PAIR_KEY))
        error = F.col("label") - F.col("prediction")
        sums = model.transform(known).agg(*[
            (F.abs(F.sum(error * c)) < 1e-6 * F.sum(F.abs(F.col("label") * c))).alias(n)
            for n, c in (("even", F.lit(1.0)), *((f, F.col(f)) for f in PAIR_FEATURES))])
        orthogonal = F.col("even") & F.col("U_AB") & F.col("S_AB") & F.col("A_AB")
        return figures.crossJoin(sums).select(  # one row each
            "train_rows", "test_rows", orthogonal.alias("least_squares"), (F.col("r2") > 0).alias("better_than_mean"))

    return _by_segment(spark, sf, fit)


@register
def linreg_figures(spark, sf):
    """Linear regression of the pair score per segment: coefficients, R2 and MSE on the test rows."""
    def fit(rows):
        _, figures = I.regress(rows, PAIR_FEATURES, "DPI_AB", PAIR_KEY)
        weights = [r(F.col("weights")[i], 4).alias(n) for i, n in enumerate([*PAIR_FEATURES, "intercept"])]
        return figures.select(*weights, r("r2", 4).alias("r2"), r("mse", 4).alias("mse"))

    return _by_segment(spark, sf, fit)


def pair_forest(spark, sf, segment):
    """The forest of a segment's pair scores, which all queries on it share."""
    rows = pairs(spark, sf).filter(F.col("segment") == segment)
    return stages.fitted(spark, sf, f"forest_{segment}", lambda: I.training_forest(rows, PAIR_FEATURES, "DPI_AB", PAIR_KEY))


def _with_forest(spark, sf, use):
    """Rows of both segments from ``use(forest, pair rows of the segment)``."""
    out = None
    for name in ("Paid", "Free"):
        row = use(pair_forest(spark, sf, name), pairs(spark, sf).filter(F.col("segment") == name))
        row = row if "segment" in row.columns else row.withColumn("segment", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


@register
def rf_regression(spark, sf):
    """Forest of the pair score per segment: rows, importances that add up to one, better than the mean."""
    def use(forest, rows):
        total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
        figures = I.forest_figures(forest, rows, "DPI_AB", PAIR_KEY)
        return figures.select("train_rows", "test_rows", r(total).alias("importances"), (F.col("r2") > 0).alias("better_than_mean"))

    return _with_forest(spark, sf, use)


@register
def rf_whatif(spark, sf):
    """Rise of the forest's score of the failing pairs, axis by axis: a rise never lowers it much, and the pairs that it is the mean of."""
    def use(forest, rows):
        fails = rows.filter(F.col("verdict") == P.FAIL).select(*PAIR_KEY, *PAIR_FEATURES)
        return I.predicted_what_if(forest, fails).select("axis", (F.col("uplift") > -1).alias("not_lower"), F.col("n").alias("fails"))

    return _with_forest(spark, sf, use)


def cross_validation(spark, sf):
    def build():
        return _by_segment(spark, sf, lambda rows: I.cross_validate(rows, PAIR_FEATURES, "DPI_AB", PAIR_KEY))

    return stages.stage(spark, sf, "cross_validation", build)


@register
def rf_cross_validation(spark, sf):
    """Five folds per segment: the rows of each and whether its R2 is a number no larger than one."""
    return cross_validation(spark, sf).select("segment", "fold", "n", (F.col("r2") <= 1).alias("valid"))


@register
def rf_first_split(spark, sf):
    """First split of a tree on all pairs of a segment: its axis, the rows on either side, what it takes off the squared errors."""
    def fit(rows):
        known = rows.dropna(subset=[*PAIR_FEATURES, "DPI_AB"]).select(*PAIR_KEY, *PAIR_FEATURES, "DPI_AB")
        return FO.first_split(known, PAIR_FEATURES, "DPI_AB", PAIR_KEY)

    return _by_segment(spark, sf, fit).select("segment", "feature", "low_rows", "high_rows", *[r(c, 4).alias(c) for c in ("low_mean", "high_mean", "gain")])


PROTOTYPE = ["rev_per_session", "price", "sold", "sessions"]


def prototype_index(spark, sf):
    """Prototype index of all events: free ones by position, paid ones by the importance of their figures."""
    def build():
        m = stages.metrics(spark, sf)
        free = C.is_free("price", "rev_per_session", "both_zero")
        a = S.prototype_free(m.filter(free), ["kind"], "occupancy", "sold", "sessions").select("performance_id", "PI")
        b = I.importance_weighted_index(m.filter(~free), "occupancy", PROTOTYPE, ["performance_id"])
        return a.unionByName(b)

    return stages.stage(spark, sf, "prototype_index", build)


@register
def dpi_prototype_paid(spark, sf):
    """Prototype index of paid events, all of which it covers, between 0 and 1."""
    paid = stages.metrics(spark, sf).filter(~C.is_free("price", "rev_per_session", "both_zero"))
    out = paid.join(prototype_index(spark, sf), "performance_id", "left")
    known = F.col("PI").isNotNull()
    return out.groupBy("kind").agg(F.count("*").alias("paid"), F.count_if(known).alias("scored"),
                                   F.count_if(known & ~F.col("PI").between(0, 1 + 1e-9)).alias("outside"))


CLUSTER = ["PI", "occupancy", "sold", "rev_per_session", "price", "sessions"]


def _vectors(spark, sf):
    rows = stages.metrics(spark, sf).join(prototype_index(spark, sf), "performance_id")
    return CL.standardized(rows, CLUSTER, ["performance_id"])


def elbow(spark, sf):
    return stages.stage(spark, sf, "elbow", lambda: CL.elbow(_vectors(spark, sf), CLUSTER))


def profiles(spark, sf):
    return stages.stage(spark, sf, "profiles", lambda: CL.cluster_profiles(_vectors(spark, sf), CLUSTER, (3, 4, 5, 6)))


@register
def event_zscores(spark, sf):
    """Standardized figures of the events that clusters are made of (the index, which is fitted, left out)."""
    names = [c for c in CLUSTER if c != "PI"]
    z = CL.standardized(stages.metrics(spark, sf).dropna(subset=PROTOTYPE), names, ["performance_id"])
    return z.select("performance_id", *[r(f"z_{c}", 5).alias(f"z_{c}") for c in names])


@register
def kmeans_elbow(spark, sf):
    """For two to seven clusters: events that they hold, and whether inertia falls with their number."""
    n = _vectors(spark, sf).count()
    return SU.step_changes(elbow(spark, sf), "k", "inertia").select(
        "k", F.lit(n).alias("events"), (F.coalesce("change", F.lit(-1.0)) < 0).alias("falls"))


@register
def kmeans_profile(spark, sf):
    """Profiles for three to six clusters: the clusters hold all known events, every one has a label."""
    return profiles(spark, sf).groupBy("k").agg(
        F.count("*").alias("clusters"), F.sum("n").alias("events"), F.count("profile").alias("labelled"))


@register
def ratio_list_cv(spark, sf):
    """Variation of numbers given as text lists."""
    p = fx.table(spark, sf, "lineitem").select(
        "l_orderkey", F.concat(F.lit("["), F.col("l_discount").cast("string"), F.lit(", "), F.col("l_tax").cast("string"), F.lit(", x, 0.5]")).alias("txt")
    )
    cv = N.coefficient_of_variation(N.ratio_list("txt"))
    return p.groupBy("l_orderkey").agg(r(F.avg(cv), 5).alias("mean_cv"), F.count("*").alias("n"))


@register
def row_spread(spark, sf):
    """Smallest, largest and mean of several columns of a row; distinct values in a row."""
    runs = stages.predictions(spark, sf).groupBy("performance_id").agg(
        *[F.max(F.when(F.col("run_id") == i, F.col("p2"))).alias(f"p{i}") for i in (1, 2, 3)],
        *[F.max(F.when(F.col("run_id") == i, F.col("genre1"))).alias(f"g{i}") for i in (1, 2, 3)],
    )
    lo, hi, mean = N.row_extremes([F.col(f"p{i}") for i in (1, 2, 3)])
    return runs.select("performance_id", lo.alias("lo"), hi.alias("hi"), r(mean, 9).alias("mean"),
                       N.distinct_in_row([F.col(f"g{i}") for i in (1, 2, 3)]).alias("genres"))


@register
def region_revenue(spark, sf):
    """Revenue per region with a region renamed on the way, largest first."""
    m = stages.metrics(spark, sf).replace("MIDDLE EAST", "ASIA", subset=["region"])
    return m.groupBy("region").agg(r(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double"), 2).alias("revenue"),
                                   F.sum("sold").alias("sold")).orderBy(F.col("revenue").desc())
