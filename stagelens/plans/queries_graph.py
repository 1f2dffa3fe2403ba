"""Queries on cells, people, the relational model, the graph and repeated runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagelens.functions import conditions as C
from stagelens.functions import text as X
from stagelens.operators import checks as K
from stagelens.operators import ablation as AB
from stagelens.operators import compare as P
from stagelens.operators import consensus as CO
from stagelens.operators import graph as G
from stagelens.operators import logit as LO
from stagelens.operators import inference as H
from stagelens.operators import keys as U
from stagelens.operators import people as PE
from stagelens.operators import ranks as RK
from stagelens.operators import summaries as SU
from stagelens.plans import fixtures as fx
from stagelens.plans import model as MO
from stagelens.plans import stages
from stagelens.plans.queries_compare import composite, scored_events, single
from stagelens.plans.queries_score import r
from stagelens.session import clustered, materialize, scratch_path
from stagelens.sources import files as FI

QUERIES_GRAPH = {}


def register(fn):
    QUERIES_GRAPH[fn.__name__] = fn
    return fn


CELLS = {"cast": "cast_txt", "crew": "crew_txt"}


def events(spark, sf):
    """Every event with transactions, its kind and recorded genres at three levels."""
    def build():
        perf = fx.performance(spark, sf).select("performance_id", "kind", "yr")
        rows = stages.labels(spark, sf).join(perf, "performance_id")
        return clustered(rows, stages.EVENT).withColumn("fine", F.concat_ws("/", "mid", F.col("yr").cast("string")))

    return stages.clustered(spark, sf, "labelled_events", build)


def people(spark, sf):
    """Participation records with the genre levels of their event."""
    def build():
        links = stages.participation(spark, sf).filter("role <> 'org'").select("performance_id", "role", "name")
        return links.join(events(spark, sf), "performance_id")

    return stages.clustered(spark, sf, "people", build)


# ------------------------------------------------------------------ cells

@register
def split_names(spark, sf):
    """Names out of the cells of every ticket, counted."""
    return PE.count_names(stages.cells(spark, sf), CELLS, weight="tickets")


@register
def split_names_twice(spark, sf):
    return PE.count_names(stages.cells(spark, sf), CELLS, lambda c: X.split_names(c, passes=2), "tickets")


@register
def split_document_names(spark, sf):
    """The cell cleaner over whole free texts: list lengths and distinct items per document."""
    d = fx.table(spark, sf, "documents").select("doc_id", X.split_names("text").alias("names"))
    return d.select("doc_id", F.size("names").alias("items"), F.size(F.array_distinct("names")).alias("kinds"),
                    F.md5(F.array_join("names", "|")).alias("digest"))


@register
def ghost_names(spark, sf):
    c = stages.cells(spark, sf)
    return PE.ghost_names(PE.count_names(c, CELLS, X.split_names_legacy, "tickets"), PE.count_names(c, CELLS))


@register
def org_roles(spark, sf):
    bridge = PE.split_orgs(stages.cells(spark, sf), "org_txt", ["performance_id"])
    return bridge.groupBy("role").agg(F.count("*").alias("links"), F.count_distinct("org").alias("orgs"))


@register
def multi_role_orgs(spark, sf):
    return PE.multi_role(PE.split_orgs(stages.cells(spark, sf), "org_txt", ["performance_id"]))


@register
def norm_genre(spark, sf):
    p = fx.table(spark, sf, "part").select(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(") (x) ")).alias("g"), "p_name")
    return p.groupBy(X.norm_genre("g").alias("genre"), X.genre_prefix("g").alias("prefix")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ people

@register
def person_genre_score(spark, sf):
    out = PE.genre_scores(people(spark, sf), "mid")
    return out.select("name", F.col("mid").alias("genre"), "count", r("score").alias("score"))


@register
def person_lookup(spark, sf):
    """One name's participations by genre, most first."""
    p = people(spark, sf).filter("name = 'red widget'")
    return p.groupBy("name", "mid").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "mid")


@register
def homonym_levels(spark, sf):
    out = PE.homonym_levels(people(spark, sf), ["broad", "mid", "fine"])
    return out.select("level", "names", "genres", "names_in_many", "quasi_ids",
                      *[r(c).alias(c) for c in ("share_in_many", "mean_genres", "mean_top_share")])


@register
def dominant_person(spark, sf):
    return PE.dominant_genre(people(spark, sf).filter("kind = 'single'"), "mid")


@register
def ambiguity_stats(spark, sf):
    p = people(spark, sf)
    return PE.ambiguity(p.filter("kind = 'composite'"), PE.dominant_genre(p.filter("kind = 'single' AND yr < 1997"), "mid"))


@register
def resolved_people(spark, sf):
    """Participants of mixed events linked to the dominant person of their name."""
    p = people(spark, sf)
    dominant = PE.dominant_genre(p.filter("kind = 'single'"), "mid")
    open_ = p.filter("kind = 'composite'").select("performance_id", "role", "name")
    out = PE.resolve(open_, dominant, "mid", "composite", ["performance_id"])
    return out.groupBy("name", "mid", "resolved").agg(F.count("*").alias("links"))


@register
def most_genres(spark, sf):
    return PE.most_genres(PE.genre_scores(people(spark, sf), "fine"), "fine", 3)


@register
def name_collisions(spark, sf):
    """Supplier names used as persons and as organisations."""
    # whose organisations they are does not matter: different cells are split once
    orgs = PE.split_orgs(stages.cells(spark, sf), "org_txt", [])
    return PE.name_collisions(people(spark, sf), orgs).agg(F.count("*").alias("names"))


@register
def dense_person_ids(spark, sf):
    return U.dense_ids(people(spark, sf).filter("kind = 'single'"), ["name", "mid"], "person_id")


def model_of(spark, sf):
    """The tables of the relational model, taken from the flat ticket table."""
    info = events(spark, sf).select("performance_id", F.concat("mid", F.lit(" (g)")).alias("genre"), F.col("fine").alias("subgenre"))
    # dimensions meet before the tickets do: one row per event
    def build():
        per_event = fx.performance(spark, sf).join(info, "performance_id")
        return fx.ticket_cells(spark, sf, stages.EVENT).join(per_event, "performance_id")

    return MO.normalise(
        stages.clustered(spark, sf, "flat", build),
        {"facility": MO.Entity(["facility"], ["region"]), "hall": MO.Entity(["facility", "seats"], ["access_score"]),
         "operator": MO.Entity(["l_suppkey"]), "booking_channel": MO.Entity(["channel"]),
         "payment_method": MO.Entity(["payment"]), "discount_type": MO.Entity(["discount"])},
        cells=CELLS, org_cell="org_txt",
        fact=["performance_id", "show_at", "ticket_no", "l_partkey", "l_suppkey", "event_type", "quantity", "amount",
              "channel", "payment", "discount"],
        predictions=stages.predictions(spark, sf).filter("run_id = 1"),
    )


@register
def model_tables(spark, sf):
    """Rows, columns and cells of every table of the model."""
    return MO.table_sizes(model_of(spark, sf))


def stored_model(spark, sf):
    """The tables of the model as they are stored, each written once."""
    made = stages.fitted(spark, sf, "model", lambda: model_of(spark, sf))
    return {name: stages.stage(spark, sf, f"model_{name}", lambda name=name: made[name]) for name in MODEL}


# Tables that rules are checked on.
MODEL = ("facility", "hall", "booking_channel", "genre", "subgenre", "performance", "performance_genre", "show_session",
         "person", "performance_person", "organization", "performance_org", "ticket_event")


@register
def model_integrity(spark, sf):
    """Keys and references of the stored model: the rows of each rule and how many break it."""
    return K.integrity(stored_model(spark, sf), MO.RULES)


@register
def model_integrity_damaged(spark, sf):
    """The same after the genre that sorts first, and the tickets' first session each, have been taken out: rows that lost what they refer to."""
    tables = stored_model(spark, sf)
    first = tables["genre"].agg(F.min("genre")).first()[0]
    tables["genre"] = tables["genre"].filter(F.col("genre") != F.lit(first))
    gone = tables["show_session"].groupBy("performance_id").agg(F.min("show_at").alias("show_at"))
    tables["show_session"] = tables["show_session"].join(gone, ["performance_id", "show_at"], "left_anti")
    out = K.integrity(tables, [rule for rule in MO.RULES if isinstance(rule, K.Reference)])
    return out.filter(F.col("broken") > 0).select("table", "rule", "broken")


@register
def model_facilities(spark, sf):
    """Contents of the facility table with what its key determines."""
    return model_of(spark, sf)["facility"].select("facility", "region")


@register
def model_performances(spark, sf):
    """Every performance with the genre and sub-genre that its ids lead to."""
    t = model_of(spark, sf)
    out = t["performance"].join(t["genre"], "genre_id").join(t["subgenre"].drop("genre_id"), "subgenre_id")
    return out.select("performance_id", "kind", "genre", "subgenre")


@register
def model_org_bridge(spark, sf):
    """The bridge of organisations by name: links per organisation and role."""
    t = model_of(spark, sf)
    out = t["performance_org"].join(t["organization"], "org_id")
    return out.groupBy("org", "role").agg(F.count("*").alias("links"))


@register
def model_sessions(spark, sf):
    """Tickets and amounts per performance through the session ids."""
    t = model_of(spark, sf)
    out = t["ticket_event"].join(t["show_session"], "session_id")
    return out.groupBy("performance_id").agg(
        F.count("*").alias("tickets"), F.count_distinct("show_at").alias("sessions"),
        r(F.sum("amount").cast("double"), 2).alias("amount"))


@register
def performance_genres(spark, sf):
    """First and second predicted label of mixed events with their probabilities, as ranks joined back."""
    run = stages.predictions(spark, sf).filter("run_id = 1")
    long = run.select("performance_id", F.inline(F.array(*[
        F.struct(F.lit(i).alias("rank_no"), F.col(f"genre{i}").alias("genre"), F.col(f"p{i}").alias("p")) for i in (1, 2)]))).filter("genre IS NOT NULL")
    a = long.filter("rank_no = 1").select("performance_id", F.col("genre").alias("first"), F.col("p").alias("p_first"))
    b = long.filter("rank_no = 2").select("performance_id", F.col("genre").alias("second"), F.col("p").alias("p_second"))
    both = a.join(b, "performance_id").join(fx.performance(spark, sf).filter("kind = 'composite'").select("performance_id", "title"), "performance_id")
    return both.orderBy(F.col("p_second").desc(), "performance_id").limit(5)


@register
def prediction_catalog(spark, sf):
    """Three catalogues with different columns stacked and tagged."""
    perf = fx.performance(spark, sf)
    out = FI.union_tagged({
        "raw": perf.select("performance_id", "title", "yr"),
        "single": perf.filter("kind = 'single'").select("title", "region"),
        "composite": perf.filter("kind = 'composite'").select("title", "region", "seats"),
    })
    return out.groupBy("source").agg(
        F.count("*").alias("n"), F.count("performance_id").alias("ids"), F.count("region").alias("regions"), F.count("seats").alias("seats")
    )


@register
def prediction_link_rate(spark, sf):
    """Predictions joined back by id, guarded by the title they carry, with the match rate.

    The list was kept with the title of each customer's first order, which repeats: a carried
    title is right only if that list meant this event's row.
    """
    perf = fx.performance(spark, sf).select("performance_id", "title", "kind", "yr")
    first = perf.groupBy("yr", "kind").agg(F.min("title").alias("carried_title"))
    carried = stages.predictions(spark, sf).filter("run_id = 1 AND p1 > 0.5").join(perf, "performance_id")
    carried = carried.join(first, ["yr", "kind"]).select(
        "performance_id",
        F.when(F.col("performance_id") % 3 == 0, F.col("carried_title")).otherwise(F.col("title")).alias("carried_title"),
        F.lit(True).alias("linked"),
    )
    both = perf.join(carried, "performance_id", "left")
    match = F.count_if(F.col("carried_title") == F.col("title"))
    return both.groupBy("kind").agg(
        F.count("*").alias("catalogue"), F.count("linked").alias("linked"), match.alias("titles_match"),
        r(match / F.count("*")).alias("match_rate"))


# ------------------------------------------------------------------ files

@register
def csv_by_year(spark, sf):
    """Events written as CSV per kind and year and read back as text in one scan."""
    base = scratch_path(spark, "csv-by-year")
    perf = fx.performance(spark, sf).select("performance_id", "title", "seats", "kind", "yr")
    FI.write_csv(perf, base, ["kind", "yr"])
    back = FI.read_years(spark, [f"{base}/*/*"], r"/kind=(\w+)/", r"/yr=(\d{4})/")
    return back.groupBy("kind", "yr").agg(
        F.count("*").alias("n"), F.count("seats").alias("seats"), F.sum(F.col("performance_id").try_cast("bigint")).alias("id_sum")
    )


@register
def ranked_sink(spark, sf):
    """Segment folders of ranked events, read back in the order of the files: the place of every event."""
    base = scratch_path(spark, "ranked")
    s = stages.scored(spark, sf).select("segment", "performance_id", "title", *[r(c).alias(c) for c in ("DPI_region_adj", "U_participation")])
    FI.write_ranked(s, base, "segment", ["DPI_region_adj", "U_participation"], ["performance_id"])
    return FI.read_ranked(spark, base).select("segment", F.col("performance_id").cast("bigint"), "place")


@register
def csv_roundtrip(spark, sf):
    """Texts with quotes, commas, line breaks of all kinds and backslashes written as CSV and read back as they were."""
    breaks = F.concat("text", F.lit("\r\n\\n \\\\n\\"), F.lit("\n \r \\r\\\\"), F.col("doc_id").cast("string"))
    d = fx.table(spark, sf, "documents").select("doc_id", breaks.alias("text"), "source")
    path = scratch_path(spark, "csv-roundtrip")
    FI.write_csv(d, path)
    back = FI.read_csv(spark, path, "doc_id long, text string, source string", escapes=True)
    return back.select("doc_id", "source", F.md5("text").alias("digest"))


@register
def encoding_fallback(spark, sf):
    """A list in another encoding: wanted columns, in the first encoding whose header has them."""
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("번호"), F.concat(F.lit("관객 "), "c_name").alias("이름"), "c_nationkey")
    path = scratch_path(spark, "csv-ms949")
    c.write.option("header", True).option("encoding", "MS949").csv(path)
    back = FI.read_columns(spark, path, ["이름", "번호"], damaged="damaged")
    return back.select(F.col("번호").cast("long").alias("custkey"), F.col("이름").alias("name"), "damaged")


@register
def encoding_by_data(spark, sf):
    """Files with the same plain header, one in each encoding: every file is decoded by what all of its rows are valid in."""
    c = fx.table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("관객 "), "c_name").alias("name"), F.col("c_nationkey").cast("int").alias("n"))
    base = scratch_path(spark, "csv-mixed")
    for encoding, part in (("UTF-8", c.filter("n % 2 = 0")), ("MS949", c.filter("n % 2 = 1"))):
        part.select("c_custkey", "name").write.option("header", True).option("encoding", encoding).csv(f"{base}/{encoding}")
    back = FI.read_columns(spark, [f"{base}/UTF-8", f"{base}/MS949"], ["c_custkey", "name"], damaged="damaged")
    return back.select(F.col("c_custkey").cast("long").alias("custkey"), "name", "damaged")


@register
def json_sink(spark, sf):
    """Metrics per region written as JSON lines and read back."""
    path = scratch_path(spark, "json")
    m = stages.metrics(spark, sf).groupBy("region").agg(F.count("*").alias("n"), F.sum("sold").alias("sold"))
    FI.write_json(m, path)
    return spark.read.schema("region string, n long, sold long").json(path)


@register
def table_sink(spark, sf):
    """Metrics written as a table by kind and read back by partition."""
    back = FI.write_table(stages.metrics(spark, sf), scratch_path(spark, "table"), ["kind"])
    return back.filter("kind = 'composite'").groupBy("region").agg(F.count("*").alias("n"), F.sum("sessions").alias("sessions"))


@register
def unique_title_join(spark, sf):
    """Events joined to the prediction list by a title that only one event of each has."""
    perf = fx.performance(spark, sf).select("performance_id", F.when(F.col("seats") > 20, F.col("title")).alias("title"), "yr")
    run = stages.predictions(spark, sf).filter("run_id = 1").select("performance_id", "genre1")
    listed = perf.filter("yr < 1998").join(run, "performance_id").select("title", "genre1")
    out = U.join_on_unique(perf, listed, ["title"])
    return out.select("performance_id", "title", "genre1")


@register
def known_anywhere(spark, sf):
    """Events that know at least one of two columns, numbers cleaned and codes mapped on the way."""
    m = stages.metrics(spark, sf).select(
        "performance_id", "kind", C.finite(F.try_divide(F.col("revenue"), F.col("sold"))).alias("a"), F.when(F.col("seats") > 500, F.col("occupancy")).alias("b"))
    rows = U.drop_all_null(m, ["a", "b"])
    code = C.map_values("kind", {"composite": "C", "single": "S"})
    return rows.groupBy(code.alias("code")).agg(F.count("*").alias("n"), F.count("a").alias("a"), F.count("b").alias("b"))


# ------------------------------------------------------------------ graph

def weighted_edges(spark, sf):
    # a node names its term
    return stages.clustered(spark, sf, "edges", lambda: G.weighted_edges(stages.namings(spark, sf)).drop("term"))


def graph(spark, sf):
    """Undirected edges with loops; events are nodes too."""
    e = weighted_edges(spark, sf).select("performance_id", X.typed_key("performance", "performance_id").alias("p"), "node", "weight")
    return G.undirected(e, "p", "node", "weight", home="performance_id")


def split(spark, sf):
    """Single events with their genre, split by hash into training and held-out."""
    def build():
        e = events(spark, sf).filter("kind = 'single'").select("performance_id", F.col("mid").alias("genre"))
        return e.withColumn("train", U.in_training(0.8, "performance_id"))

    return stages.clustered(spark, sf, "split", build)


@register
def edge_view(spark, sf):
    p = people(spark, sf)
    orgs = stages.participation(spark, sf).filter("role = 'org'").select("performance_id", F.col("name").alias("org"))
    labels = events(spark, sf).filter("kind = 'single'").select("performance_id", F.col("mid").alias("genre"))
    view = G.edge_view(p, orgs, labels)
    return view.groupBy("relation").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


@register
def edge_tfidf(spark, sf):
    return weighted_edges(spark, sf).select("performance_id", "node", "tf", r("weight").alias("weight"))


@register
def edge_tfidf_lower(spark, sf):
    """The older lookup in lower case: names with capitals weigh nothing."""
    e = G.tfidf(G.participant_edges(stages.participation(spark, sf)), lower_terms=True)
    return e.groupBy("performance_id").agg(F.count_if(F.col("weight") == 0).alias("zero"), r(F.sum("weight")).alias("weight"))


@register
def undirected_edges(spark, sf):
    return graph(spark, sf).select("src", "dst", r("weight").alias("weight"))


@register
def node_types(spark, sf):
    """Dense node ids: count, smallest and largest id per type."""
    ev = events(spark, sf)
    nodes = G.node_table(weighted_edges(spark, sf), ev, genres=ev.select("mid"))
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"), F.max("node_id").alias("last_id"))


@register
def node_features(spark, sf):
    """One-hot node types, counted."""
    nodes = G.node_table(weighted_edges(spark, sf), events(spark, sf))
    kinds = ["performance", "person", "org"]
    return G.type_one_hot(nodes, kinds).groupBy(*[f"is_{k}" for k in kinds]).agg(F.count("*").alias("n"))


@register
def graph_census(spark, sf):
    return G.census(weighted_edges(spark, sf), fx.performance(spark, sf).select("performance_id", "kind"))


@register
def holdout_edge_cut(spark, sf):
    s = split(spark, sf)
    cut = G.cut_edges(weighted_edges(spark, sf), s.filter("NOT train"))
    return cut.groupBy(F.split("node", ":")[0].alias("type")).agg(
        F.count("*").alias("edges"), F.count_distinct("performance_id").alias("events"))


def _votes(spark, sf):
    s = split(spark, sf)
    return G.genre_vote(weighted_edges(spark, sf), s.filter("train"), s.filter("NOT train"))


@register
def genre_vote(spark, sf):
    return _votes(spark, sf)


@register
def vote_accuracy(spark, sf):
    truth = split(spark, sf).filter("NOT train").select("performance_id", "genre")
    out = G.accuracy_by(truth, _votes(spark, sf), [F.col("voted")])
    return out.select("voted", "n", r("top1_acc").alias("top1_acc"), r("top2_acc").alias("top2_acc"))


@register
def class_weights(spark, sf):
    out = G.class_weights(split(spark, sf).filter("train"))
    return out.select("genre", "c", r("pos_weight").alias("pos_weight"), r("inverse_share").alias("inverse_share"))


def _node():
    """An event is a node by its id, a participant by its name."""
    return F.coalesce("node", X.typed_key("performance", "performance_id")).alias("node")


def _hop(spark, sf, number: int):
    """Scores after so many steps; every step is a table that the next one and all readers share."""
    if number == 0:
        return split(spark, sf).filter("train").select("performance_id", F.lit(None).cast("string").alias("node"), "genre", F.lit(1.0).alias("value"))
    links = weighted_edges(spark, sf).select("performance_id", "node", "weight")
    degree = stages.clustered(spark, sf, "degree", lambda: G.degrees_by_event(links))
    before = _hop(spark, sf, number - 1)
    return stages.hop(spark, sf, number, lambda: G.hop_by_event(links, degree, before))


@register
def propagate_1hop(spark, sf):
    out = _hop(spark, sf, 1)
    return out.select(_node(), "genre", r("value", 8).alias("value"))


@register
def propagate_2hop(spark, sf):
    out = _hop(spark, sf, 2)
    return out.select(_node(), "genre", r("value", 8).alias("value"))


def _propagated(spark, sf):
    """Scores of events after two steps."""
    return _hop(spark, sf, 2).filter("performance_id IS NOT NULL").select("performance_id", "genre", "value")


@register
def propagated_top2(spark, sf):
    """Two best labels of each mixed event from two hops, as shares, and the pair."""
    shares = G.normalised(_propagated(spark, sf), "performance_id").withColumn("p", F.round("p", 8))
    comp = events(spark, sf).filter("kind = 'composite'").select("performance_id")
    best = G.top2(shares.join(comp, "performance_id", "left_semi"), "performance_id")
    return best.select(X.typed_key("performance", "performance_id").alias("node"), "genre1", "genre2", r("p1", 5).alias("p1"), r("p2", 5).alias("p2"), X.pair_key("genre1", "genre2").alias("pair"))


@register
def holdout_metrics(spark, sf):
    """Propagation on held-out single events: F1, Hamming, top-1 and top-2."""
    truth = split(spark, sf).filter("NOT train").select("performance_id", "genre")
    held = _propagated(spark, sf).join(truth.select("performance_id"), "performance_id", "left_semi")
    out = G.multilabel_metrics(truth, G.normalised(held, "performance_id").withColumn("p", F.round("p", 8)))
    return out.select("n", "classes", *[r(c).alias(c) for c in ("top1_acc", "top2_acc", "subset_acc", "micro_f1", "macro_f1", "weighted_f1", "hamming_acc")])


def head_probabilities(spark, sf):
    """(held-out events with their genre, the logistic head's probabilities of them)."""
    s = split(spark, sf)
    train, test = s.filter("train").select("performance_id", "genre"), s.filter("NOT train").select("performance_id", "genre")

    def build():
        # a class per genre of the training labels
        genres = sorted(row["genre"] for row in train.select("genre").distinct().collect())
        return G.logistic_head(_propagated(spark, sf), train, test.select("performance_id"), genres, "performance_id")

    return test, stages.clustered(spark, sf, "head_probabilities", build)


@register
def sgc_logreg(spark, sf):
    """Logistic head on the propagated scores, evaluated on held-out events: rows, classes, figures in their range."""
    test, probs = head_probabilities(spark, sf)
    whole = probs.groupBy("performance_id").agg(F.sum("p").alias("p")).agg(F.max(F.abs(F.col("p") - 1)).alias("off"))
    out = G.multilabel_metrics(test, probs).crossJoin(whole)  # one row each
    return out.select("n", "classes", (F.col("top1_acc") <= F.col("top2_acc")).alias("top2_not_below"),
                      F.col("top1_acc").between(0, 1).alias("valid"), (F.col("off") < 1e-6).alias("sums_to_one"))


@register
def logit_kind(spark, sf):
    """Newton steps for a mixed event against its occupancy, either class against the other: slope and intercept."""
    m = stages.metrics(spark, sf).filter("occupancy IS NOT NULL").select(
        (F.col("kind") == "composite").cast("int").alias("label"), F.col("occupancy").cast("double").alias("x"))
    coef = LO.fit(m, ["x"], "label", [1.0, 2.0])
    rows = [(i, round(float(a), 5), round(float(b), 5)) for i, (a, b) in enumerate(coef)]
    return spark.createDataFrame(rows, "label int, slope double, intercept double")


def _mix_probs(spark, sf):
    """Scores of the genres of an event by seats (second measure of the mix)."""
    mix = stages.genre_mix(spark, sf)
    total = mix.groupBy("performance_id").agg(F.sum("qty").alias("t"))
    return mix.join(total, "performance_id").select("performance_id", "genre", F.round(F.col("qty") / F.col("t"), 8).alias("p"))


def _truth(spark, sf):
    return stages.labels(spark, sf).select("performance_id", F.col("mid").alias("genre"))


@register
def multilabel_metrics(spark, sf):
    out = G.multilabel_metrics(_truth(spark, sf), _mix_probs(spark, sf))
    return out.select("n", "classes", *[r(c).alias(c) for c in ("top1_acc", "top2_acc", "subset_acc", "micro_f1", "macro_f1", "weighted_f1", "hamming_acc")])


@register
def per_class_accuracy(spark, sf):
    best = stages.predictions(spark, sf).filter("run_id = 2").select("performance_id", "genre1", "genre2")
    out = G.accuracy_by(_truth(spark, sf), best, ["genre"])
    return out.select("genre", "n", r("top1_acc").alias("top1_acc"), r("top2_acc").alias("top2_acc"))


# ------------------------------------------------------------------ runs

@register
def top2_pairs(spark, sf):
    return CO.top2_pairs(stages.predictions(spark, sf))


@register
def run_agreement(spark, sf):
    out = CO.run_agreement(stages.predictions(spark, sf))
    return out.select("run_a", "run_b", "n", r("first_agreement").alias("first_agreement"), r("pair_agreement").alias("pair_agreement"))


@register
def saved_agreement(spark, sf):
    p = stages.predictions(spark, sf)
    out = CO.saved_agreement(p.filter("run_id = 1"), p.filter("run_id = 3"))
    return out.select("n", r("same_first").alias("same_first"), r("same_pair").alias("same_pair"))


def _mixed_run(spark, sf):
    comp = fx.performance(spark, sf).filter("kind = 'composite'").select("performance_id")
    return stages.predictions(spark, sf).filter("run_id = 1").join(comp, "performance_id", "left_semi")


@register
def second_probability(spark, sf):
    return H.threshold_counts(_mixed_run(spark, sf), "p2", [0.5, 0.3, 0.1])


@register
def second_probability_summary(spark, sf):
    """Median of the second probability, weak first guesses, and mixed events that name nobody."""
    run = _mixed_run(spark, sf)
    mid = RK.quantiles(run, {"q": F.col("p2")}, [0.5]).select(r(F.col("q")[0], 9).alias("median_p2"))
    named = people(spark, sf).select("performance_id").distinct().withColumn("named", F.lit(True))
    counts = run.join(named, "performance_id", "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("p1") < 0.5).alias("weak_first"), F.count_if(F.col("named").isNull()).alias("nobody"))
    return counts.crossJoin(mid)  # one row each


@register
def accuracy_by_participants(spark, sf):
    """Accuracy of the vote for held-out events with a crew of their own and without.

    A crew member who takes part in training events counts; the others leave an event without.
    """
    s = split(spark, sf)
    truth = s.filter("NOT train").select("performance_id", "genre")
    crew = stages.participation(spark, sf).filter("role = 'crew'").select("performance_id", "name")
    # written, so that the planner knows the size of a row per name
    seen = materialize(crew.join(s.filter("train").select("performance_id"), "performance_id", "left_semi").select("name").distinct(), "seen")
    having = crew.join(seen, "name", "left_semi").select("performance_id").distinct().withColumn("has", F.lit(True))
    marked = truth.join(having, "performance_id", "left").withColumn("participants", F.coalesce("has", F.lit(False))).drop("has")
    out = G.accuracy_by(marked, _votes(spark, sf), ["participants"])
    return out.select("participants", "n", r("top1_acc").alias("top1_acc"), r("top2_acc").alias("top2_acc"))


@register
def consensus_class(spark, sf):
    c = CO.consensus(stages.predictions(spark, sf))
    return c.select("performance_id", "main_stable", "pair_stable", r("min_p2").alias("min_p2"), r("mean_p2", 9).alias("mean_p2"),
                    CO.classify(0.3).alias("class"))


@register
def threshold_sweep(spark, sf):
    out = CO.threshold_sweep(CO.consensus(stages.predictions(spark, sf)))
    return out.select("tau", "pair_fixed", "main_fixed", "undecided", r("pair_share").alias("pair_share"))


@register
def confident_success(spark, sf):
    """The comparison repeated with fixed pairs only, per threshold."""
    c = CO.consensus(stages.predictions(spark, sf))
    sure = CO.confident_at(composite(spark, sf), c)
    # the baseline is the same at every threshold
    taus = F.explode(F.array(*[F.lit(t) for t in CO.THRESHOLDS])).alias("tau")
    base = single(spark, sf).select("segment", "size", "genre", "DPI_plus", "U_participation", "S_scale", "A_afford", taus)
    out = P.success_rate(P.pair_table(sure, base, by=("tau", "segment", "size")), ["tau", "segment"])
    return out.select("tau", "segment", "rows", "successes", r("rate", 4).alias("rate"), "events", "rows_min_n")


@register
def confident_means(spark, sf):
    """Mean scores of mixed events by confidence class."""
    c = CO.consensus(stages.predictions(spark, sf)).select("performance_id", CO.classify(0.3).alias("class"))
    e = composite(spark, sf).join(c, "performance_id", "left")
    out = SU.group_summary(e, ["segment", "class"], {"mean": "DPI_plus"})
    return out.select("segment", "class", "n", r("mean", 5).alias("mean"))


# Seeds of the splits. Fixed values.
SEEDS = (42, 7)
STEPS = ("0 roles apart", "1 + one person", "2 + orgs", "3 + edge weights", "4 + genre weights", "5 + second round")


def splits(spark, sf):
    """The single events with their genre once per seed, split by hash; the first split is that of all other queries."""
    first = split(spark, sf).withColumn("seed", F.lit(SEEDS[0]))
    more = [split(spark, sf).withColumns({"seed": F.lit(s), "train": U.in_training(0.8, "performance_id", F.lit(s))}) for s in SEEDS[1:]]
    for other in more:
        first = first.unionByName(other)
    return first


def ablation_edges(spark, sf):
    """(config, event, node, w) of the first five configurations; the sixth has the edges of the fifth.

    They are made from a row per event and name wherever they are read: only that table is written.
    """
    names = stages.clustered(spark, sf, "weighed_names", lambda: G.weighed_names(stages.namings(spark, sf)))
    person, sets = F.col("cast") + F.col("crew"), []
    for kind, times, configs in (("cast", F.col("cast"), (0,)), ("crew", F.col("crew"), (0,)), ("person", person, (1, 2, 3, 4)), ("org", F.col("org"), (2, 3, 4))):
        node, tf, weight = F.concat(F.lit(f"{kind}:"), "name"), times.cast("double"), times * F.col("raw") / F.col("norm")
        sets += [F.when(times > 0, F.struct(F.lit(i).alias("config"), node.alias("node"), (tf if i < 3 else weight).alias("w"))) for i in configs]
    return names.select("performance_id", F.inline(F.array(*sets))).filter("config IS NOT NULL").select("config", "performance_id", "node", "w")


def ablation_sizes(spark, sf):
    """Nodes and edges of each configuration, from the times that a name is named at all; without weights an unknown event or name is an edge too."""
    n, known = F.count_if, F.col("performance_id").isNotNull()
    person = F.col("cast") + F.col("crew") > 0
    per = stages.namings(spark, sf).groupBy("name").agg(
        n(F.col("cast") > 0).alias("cast"), n(F.col("crew") > 0).alias("crew"), n(person).alias("person"),
        n(person & known).alias("weighed"), n((F.col("org") > 0) & known).alias("org"))
    named, sizes = F.col("name").isNotNull(), []
    # without a name both roles of an event are one node
    per = per.withColumns({"cast": F.when(named, F.col("cast")).otherwise(F.col("person")), "crew": F.when(named, F.col("crew")).otherwise(0)})
    for configs, kinds, used in (((0,), ("cast", "crew"), F.lit(True)), ((1,), ("person",), F.lit(True)), ((2, 3, 4, 5), ("weighed", "org"), named)):
        nodes = sum((n((F.col(k) > 0) & named) for k in kinds[1:]), n((F.col(kinds[0]) > 0) & named))
        edges = sum((F.sum(F.when(used, F.col(k))) for k in kinds[1:]), F.sum(F.when(used, F.col(kinds[0]))))
        sizes += [F.struct(F.lit(i).alias("config"), nodes.alias("nodes"), edges.alias("edges")) for i in configs]
    return per.agg(F.array(*sizes).alias("s")).select(F.inline("s")).filter("edges > 0")


def ablation_figures(spark, sf):
    def build():
        said = AB.votes_by_case(ablation_edges(spark, sf), splits(spark, sf), weighed=(4,), second=4)
        return AB.over_seeds(AB.case_accuracy(said))

    return stages.stage(spark, sf, "ablation_figures", build)


@register
def ablation(spark, sf):
    """Accuracy as nodes, weights of edges and of genres and a second round are added, edges kept or cut: mean and range over seeds, step changes."""
    figures = SU.step_changes(ablation_figures(spark, sf), "config", "top1_acc", ["protocol"]).join(ablation_sizes(spark, sf), "config")
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), F.col("config") + 1).alias("step")
    names = [f"{n}{end}" for n in ("top1_acc", "top2_acc", "macro_f1") for end in ("", "_lo", "_hi")]
    return figures.select(step, "protocol", "nodes", "edges", "runs", *[r(c).alias(c) for c in (*names, "change")])


@register
def ablation_pivot(spark, sf):
    """Accuracy of each step with edges kept and cut, their difference, and the change to the step before."""
    wide = AB.pivoted(ablation_figures(spark, sf))
    step = F.element_at(F.array(*[F.lit(x) for x in STEPS]), F.col("config") + 1).alias("step")
    return wide.select(step, *[r(c).alias(c) for c in ("kept", "cut", "difference", "kept_change", "cut_change")])


@register
def audit_segments(spark, sf):
    """Segment read from the spelling of a flag that other rules stored, against the scored one."""
    e = scored_events(spark, sf)
    stored = C.is_free("price", "rev_per_session", "both_zero")
    spelled = C.segment(F.when(stored, F.when(F.col("performance_id") % 2 == 0, "True").otherwise("1")).otherwise("False"))
    return e.groupBy("segment", spelled.alias("spelled")).agg(F.count("*").alias("n"))
