"""Participation graph: nodes, weighted edges, votes and label propagation.

Events and participants are the nodes of a bipartite graph. The edges of an event lie together
(``session.write_clustered``), so what is summed per event, and what events tell participants, meets without
an exchange. Popular names are hubs: participants are counted first, and their tables, a row per name and
genre, come to the edges; where those are too large to broadcast, adaptive execution splits the hubs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.functions.text import typed_key
from stagelens.operators import logit
from stagelens.operators.keys import dense_ids
from stagelens.operators.skew import skew_join
from stagelens.session import clustered, materialize

PERSON_ROLES = ("cast", "crew")
ROLES = (*PERSON_ROLES, "org")


def edge_view(people: DataFrame, orgs: DataFrame, labels: DataFrame, event: str = "performance_id") -> DataFrame:
    """Typed edges: has_<role> to persons, by_org to organisations, labeled_as to genres."""
    source = typed_key("performance", event).alias("source")
    return (
        people.select(source, typed_key("person", "name").alias("target"), F.concat(F.lit("has_"), F.col("role")).alias("relation")).distinct()
        .unionByName(orgs.select(event, "org").distinct().select(source, typed_key("org", "org").alias("target"), F.lit("by_org").alias("relation")))
        .unionByName(labels.select(source, typed_key("genre", "genre").alias("target"), F.lit("labeled_as").alias("relation")))
    )


def participations(namings: DataFrame, event: str = "performance_id") -> DataFrame:
    """(event, role, name, times) of ``namings``, a row per event and name with the times of each role."""
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col("name"), F.col(role).alias("times")) for role in ROLES])
    return namings.select(event, F.inline(roles)).filter("times > 0")


def participant_edges(occurrences: DataFrame, event: str = "performance_id", merge_roles: bool = True,
                      with_orgs: bool = True, org_wins: bool = False) -> DataFrame:
    """(event, node, term, tf): how often a participant is named by an event.

    ``merge_roles`` makes cast and crew of one name one node, ``org_wins`` turns a name
    that is also an organisation of the event into that organisation.
    """
    rows = occurrences if with_orgs else occurrences.filter(F.col("role") != "org")
    is_org = F.col("role") == "org"
    if org_wins and with_orgs:
        is_org = F.max(F.col("role") == "org").over(W.partitionBy(event, "name"))
    kind = F.when(is_org, "org").when(F.lit(merge_roles), "person").otherwise(F.col("role"))
    rows = rows.withColumn("node", F.concat(kind, F.lit(":"), F.col("name")))
    return rows.groupBy(event, "node", F.col("name").alias("term")).agg(F.sum("times").alias("tf"))


def tfidf(edges: DataFrame, event: str = "performance_id", lower_terms: bool = False) -> DataFrame:
    """Add the smoothed, length-normalised TF-IDF weight of each edge.

    idf = ln((1 + n) / (1 + df)) + 1, every event's weights have unit length. An edge
    counts once per naming, so its weight is tf times the weight of the term.
    ``lower_terms`` repeats an older weighting that looked names up in lower case:
    names with capitals then weigh nothing.
    """
    term = F.lower("term") if lower_terms else F.col("term")
    edges = edges.withColumn("_t", term)
    terms = edges.select(event, "_t").distinct()
    n = terms.agg(F.count_distinct(event)).scalar()
    df = materialize(terms.groupBy("_t").agg(F.count("*").alias("df")), "terms_df")
    idf = df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).drop("df")
    # a term may belong to several nodes of an event; the first of them counts for all
    own = W.partitionBy(event, "_t")
    marked = edges.filter(F.col(event).isNotNull()).withColumns(
        {"_all": F.sum("tf").over(own), "_first": F.row_number().over(own.orderBy("node")) == 1})
    raw = F.col("_all") * F.col("idf")
    # a row per term: broadcast unless the terms are very many
    weighed = marked.join(idf, "_t").withColumn("_raw", raw)
    norm = F.sqrt(F.sum(F.when(F.col("_first"), F.col("_raw") * F.col("_raw"))).over(W.partitionBy(event)))
    weight = F.when(F.col("term") == F.col("_t"), F.col("tf") * F.col("_raw") / norm).otherwise(0.0)
    return weighed.select(event, "node", "term", "tf", weight.alias("weight"))


def weighed_names(namings: DataFrame, event: str = "performance_id") -> DataFrame:
    """Add to ``namings``, a row per event and name with the times of each role, what weights are made of: ``raw`` and ``norm``.

    A name has one row per event there, so names are counted, and their weights made, without grouping them again.
    """
    n = namings.agg(F.count_distinct(event)).scalar()
    df = materialize(namings.groupBy("name").agg(F.count("*").alias("df")), "terms_df")
    idf = df.withColumn("idf", F.log((n + 1) / (F.col("df") + 1)) + 1).drop("df")
    times = sum((F.col(role) for role in ROLES[1:]), F.col(ROLES[0]))
    # a row per name: broadcast unless the names are very many
    weighed = namings.filter(F.col(event).isNotNull()).join(idf, "name").withColumn("raw", times * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(event)))
    return weighed.select(event, "name", *ROLES, "raw", norm.alias("norm"))


def weighted_edges(namings: DataFrame, event: str = "performance_id") -> DataFrame:
    """``tfidf`` of ``participant_edges``, of ``namings``: a row per event and name with the times of each role."""
    persons = sum((F.col(role) for role in PERSON_ROLES[1:]), F.col(PERSON_ROLES[0]))
    kinds = F.array(F.struct(F.lit("person").alias("kind"), persons.alias("tf")), F.struct(F.lit("org").alias("kind"), F.col("org").alias("tf")))
    edges = weighed_names(namings, event).select(event, F.col("name").alias("term"), "raw", "norm", F.inline(kinds)).filter("tf > 0")
    return edges.select(event, F.concat("kind", F.lit(":"), "term").alias("node"), "term", "tf",
                        (F.col("tf") * F.col("raw") / F.col("norm")).alias("weight"))


def undirected(edges: DataFrame, src: str, dst: str, weight: str, loops: bool = True, home: str | None = None) -> DataFrame:
    """Both directions with duplicate edges summed, and a loop of weight 1 at every node.

    ``home`` names a column that ``src`` is made from where no ``dst`` is also a ``src``, as with events and
    participants: duplicates then meet where the rows of that column lie.
    """
    if home is not None:
        there = edges.groupBy(home, F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum(weight).alias("weight"))
        # duplicates are summed once for both directions
        ways = [F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("weight")) for a, b in (("src", "dst"), ("dst", "src"))]
        out = there.select(F.inline(F.array(*ways)))
        if not loops:
            return out
        nodes = edges.select(home, F.col(src).alias("src")).distinct().select("src").union(edges.select(dst).distinct())
        return out.unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight")))
    there = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(weight).alias("weight"))
    both = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    out = both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    if not loops:
        return out
    nodes = both.select("src").distinct()
    return out.unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight")))


def node_table(edges: DataFrame, events: DataFrame, event: str = "performance_id", genres: DataFrame | None = None) -> DataFrame:
    """All nodes with their type and a dense id 1..n (order of the key's hash)."""
    keys = edges.select(F.col("node").alias("key")).union(events.select(typed_key("performance", event)))
    if genres is not None:
        keys = keys.union(genres.select(typed_key("genre", genres.columns[0])))
    ids = dense_ids(keys, ["key"], "node_id")
    return ids.withColumn("type", F.split("key", ":")[0])


def type_one_hot(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """One 0/1 column per node type."""
    return nodes.withColumns({f"is_{k}": (F.col("type") == k).cast("int") for k in kinds})


def census(edges: DataFrame, events: DataFrame, event: str = "performance_id", kind: str = "kind") -> DataFrame:
    """Nodes per type, edges, edges without weight, events without participants."""
    nodes = edges.select("node").distinct().groupBy(F.concat(F.lit("nodes_"), F.split("node", ":")[0]).alias("item")).agg(F.count("*").alias("n"))
    perf = events.agg(F.count("*").alias("n")).select(F.lit("nodes_performance").alias("item"), "n")
    size = edges.agg(F.count("*").alias("a"), F.count_if(F.col("weight") == 0).alias("b"))
    size = size.select(F.inline(F.array(F.struct(F.lit("edges").alias("item"), F.col("a").alias("n")),
                                        F.struct(F.lit("zero_weight").alias("item"), F.col("b").alias("n")))))
    alone = events.join(edges.select(event).distinct(), event, "left_anti").groupBy(kind).agg(F.count("*").alias("n"))
    # kinds without isolated events are reported as 0
    kinds = events.select(kind).distinct().join(alone, kind, "left")
    alone = kinds.select(F.concat(F.lit("isolated_"), F.col(kind)).alias("item"), F.coalesce("n", F.lit(0)).alias("n"))
    return nodes.unionByName(perf).unionByName(size).unionByName(alone)


def cut_edges(edges: DataFrame, held_out: DataFrame, event: str = "performance_id") -> DataFrame:
    """Edges that touch no held-out event."""
    return edges.join(held_out.select(event), event, "left_anti")


def genre_vote(edges: DataFrame, train: DataFrame, targets: DataFrame, event: str = "performance_id", genre: str = "genre",
               asking: DataFrame | None = None, weight: str = "tf", genre_weights: DataFrame | None = None) -> DataFrame:
    """Baseline: add up the training genres of an event's participants, keep the best two.

    ``asking`` gives the edges of the targets where they differ from those that vote, ``weight``
    the column that an edge counts with, ``genre_weights`` (genre, pos_weight) what a vote for a
    genre counts. Sums are rounded to 6 digits, so that their order cannot swap equal ones.

    Events without any vote get the most frequent training genre. Ties go to the label
    that sorts first.
    """
    counted = edges.join(train.select(event, genre), event)
    hist = counted.groupBy("node", genre).agg(F.sum(weight).alias("votes"))
    if genre_weights is not None:
        hist = hist.join(genre_weights.select(genre, "pos_weight"), genre)
        hist = hist.select("node", genre, (F.col("votes") * F.col("pos_weight")).alias("votes"))
    asked = (edges if asking is None else asking).join(targets.select(event), event, "left_semi").select(event, "node", weight)
    # written, so that the planner knows its size
    votes = (
        asked.join(materialize(hist, "histograms"), "node")
        .groupBy(event, genre).agg(F.round(F.sum(F.col("votes") * F.col(weight)), 6).alias("votes"))
    )
    ballot = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("m"), F.col(genre).alias("g"))))
    # one entry per genre: bounded by the number of genres
    top = votes.groupBy(event).agg(ballot.alias("b")).select(
        event, F.get("b", F.lit(0))["g"].alias("genre1"), F.get("b", F.lit(1))["g"].alias("genre2")
    )
    major = train.groupBy(genre).agg(F.count("*").alias("n")).agg(
        F.min(F.struct((-F.col("n")).alias("m"), F.col(genre).alias("g"))).alias("b")
    ).select("b.g").scalar()
    out = targets.select(event).join(top, event, "left")
    return out.withColumns({"voted": F.col("genre1").isNotNull(), "genre1": F.coalesce("genre1", major)})


def propagate(edges: DataFrame, labels: DataFrame, hops: int, node: str = "node", genre: str = "genre") -> DataFrame:
    """K-hop label propagation D^-1/2 (A+I) D^-1/2 of one-hot labels (src, dst, weight edges).

    The scaling by the degree is done on node rows before and after each sum along the
    edges, so edges are never joined with degrees. Every hop is written to the shared
    folder, which cuts the lineage.
    """
    degree = materialize(degrees(edges), "degree")
    values = labels.select(node, genre, F.lit(1.0).alias("value"))
    for number in range(hops):
        values = materialize(hop(edges, degree, values, node, genre), f"hop{number}")
    return values


def degrees(edges: DataFrame) -> DataFrame:
    """Weight and number of the edges that reach each node."""
    return edges.groupBy("dst").agg(F.sum("weight").alias("d"), F.count("*").alias("rows_of_key"))


def hop(edges: DataFrame, degree: DataFrame, values: DataFrame, node: str = "node", genre: str = "genre") -> DataFrame:
    """One step of the propagation from (node, genre, value)."""
    # edges run both ways: as many leave a node as reach it
    sizes = degree.select(F.col("dst").alias("src"), "rows_of_key")
    root = degree.select(F.col("dst").alias(node), F.sqrt("d").alias("root"))
    sent = values.join(root, node).select(F.col(node).alias("src"), genre, (F.col("value") / F.col("root")).alias("x"))
    # edges of a hub share one source: salted
    moved = skew_join(edges, sent, ["src"], ["dst"], sizes=sizes)
    summed = moved.groupBy(F.col("dst").alias(node), genre).agg(F.sum(F.col("weight") * F.col("x")).alias("x"))
    return summed.join(root, node).select(node, genre, (F.col("x") / F.col("root")).alias("value"))


def degrees_by_event(links: DataFrame, event: str = "performance_id") -> DataFrame:
    """Degree of every event and every participant, the loop included: (event, node, d), the event null for participants.

    ``links`` are (event, node, weight), each edge once.
    """
    d = (F.sum("weight") + 1.0).alias("d")
    return links.groupBy(event).agg(d).select(event, F.lit(None).cast("string").alias("node"), "d").unionByName(
        links.groupBy("node").agg(d).select(F.lit(None).cast(links.schema[event].dataType).alias(event), "node", "d"))


def hop_by_event(links: DataFrame, degree: DataFrame, values: DataFrame, event: str = "performance_id", genre: str = "genre") -> DataFrame:
    """``hop`` over edges between events and participants, each given once as (event, node, weight).

    ``degree`` is that of ``degrees_by_event``; ``values`` and the result are (event, node, genre, value) with the
    event null for participants. Sums of an event are made where its edges lie, those of a participant are combined
    before they are exchanged; the scores of participants, a row per name and genre, come to the edges.
    """
    is_event = F.col(event).isNotNull()
    events = degree.filter(is_event).select(event, F.sqrt("d").alias("root"))
    names = degree.filter(~is_event).select("node", F.sqrt("d").alias("root"))
    x = (F.col("value") / F.col("root")).alias("x")
    from_events = values.filter(is_event).join(events, event).select(event, genre, x)
    # written, so that the planner knows its size
    from_names = materialize(values.filter(~is_event).join(names, "node").select("node", genre, x), "sent")
    moved = (F.col("weight") * F.col("x")).alias("x")
    to_names = links.join(from_events, event).select("node", genre, moved).unionByName(from_names)
    value = (F.col("x") / F.col("root")).alias("value")
    # summed and scaled where the edges lie, then laid by event once, as the table that is written from it
    told = links.join(from_names, "node").select(event, genre, moved).groupBy(event, genre).agg(F.sum("x").alias("x"))
    parts = told.join(events, event).select(event, genre, value).unionByName(from_events.join(events, event).select(event, genre, value))
    at_events = clustered(parts, [event]).groupBy(event, genre).agg(F.sum("value").alias("value")).select(
        event, F.lit(None).cast("string").alias("node"), genre, "value")
    at_names = to_names.groupBy("node", genre).agg(F.sum("x").alias("x")).join(names, "node")
    return at_events.unionByName(
        at_names.select(F.lit(None).cast(links.schema[event].dataType).alias(event), "node", genre, value))


def class_weights(labels: DataFrame, genre: str = "genre") -> DataFrame:
    """Weight of the positive class: (total - c) / (c + 1e-6), and the inverse share."""
    counts = labels.groupBy(genre).agg(F.count("*").alias("c"))
    total = F.sum("c").over(W.partitionBy(F.lit(0)))
    return counts.select(genre, "c", ((total - F.col("c")) / (F.col("c") + 1e-6)).alias("pos_weight"), (total / F.col("c")).alias("inverse_share"))


def normalised(values: DataFrame, by: str, genre: str = "genre", value: str = "value") -> DataFrame:
    """Scores of a node as shares of their sum."""
    total = F.sum(value).over(W.partitionBy(by))
    return values.select(by, genre, F.try_divide(F.col(value), total).alias("p"))


def multilabel_metrics(truth: DataFrame, probs: DataFrame, event: str = "performance_id", genre: str = "genre", cut: float = 0.5) -> DataFrame:
    """Micro and macro F1, Hamming accuracy, subset, top-1 and top-2 accuracy.

    ``truth`` has one label per event, ``probs`` any number of scored labels; labels
    without a score count as 0. All figures come from one row per event and one row
    per class; no dense event-by-class matrix is built.
    """
    rank = F.row_number().over(W.partitionBy(event).orderBy(F.col("p").desc(), genre))
    scored = probs.withColumn("rank", rank).join(
        truth.select(event, F.col(genre).alias("true")), event
    )
    hit = F.col(genre) == F.col("true")
    above = F.col("p") > cut
    per_event = scored.groupBy(event).agg(
        F.max(hit & (F.col("rank") == 1)).alias("top1"), F.max(hit & (F.col("rank") <= 2)).alias("top2"),
        F.count_if(above & hit).alias("tp"), F.count_if(above & ~hit).alias("fp"),
    )
    events = truth.select(event).join(per_event, event, "left")
    exact = (F.coalesce("tp", F.lit(0)) == 1) & (F.coalesce("fp", F.lit(0)) == 0)
    tops = events.agg(
        F.count("*").alias("n"),
        F.avg(F.coalesce(F.col("top1"), F.lit(False)).cast("int")).alias("top1_acc"),
        F.avg(F.coalesce(F.col("top2"), F.lit(False)).cast("int")).alias("top2_acc"),
        F.avg(exact.cast("int")).alias("subset_acc"),
    )
    cls = per_class(truth, probs, event, genre, cut)
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    sums = cls.agg(
        F.count("*").alias("classes"),
        F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fp + fn), F.lit(0.0)).alias("micro_f1"),
        F.avg(f1).alias("macro_f1"),
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        (fp + fn).alias("errors"),
    )
    one = tops.withColumn("_k", F.lit(1)).join(sums.withColumn("_k", F.lit(1)), "_k").drop("_k")
    hamming = 1 - F.col("errors") / (F.col("n") * F.col("classes"))
    return one.withColumn("hamming_acc", hamming).drop("errors")


def per_class(truth: DataFrame, probs: DataFrame, event: str = "performance_id", genre: str = "genre", cut: float = 0.5) -> DataFrame:
    """Support, true and false positives and false negatives per class."""
    said = probs.filter(F.col("p") > cut).join(truth.select(event, F.col(genre).alias("true")), event)
    hit = F.col(genre) == F.col("true")
    claimed = said.groupBy(genre).agg(F.count_if(hit).alias("tp"), F.count_if(~hit).alias("fp"))
    support = truth.groupBy(genre).agg(F.count("*").alias("support"))
    out = support.join(claimed, genre, "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("support", "tp", "fp")}
    return out.withColumns(zero).withColumn("fn", F.col("support") - F.col("tp"))


def accuracy_by(truth: DataFrame, top: DataFrame, by: Sequence[str | Column], event: str = "performance_id", genre: str = "genre") -> DataFrame:
    """Top-1 and top-2 accuracy per class or any other split of the events."""
    rows = truth.join(top, event, "left")
    first = F.coalesce(F.col("genre1") == F.col(genre), F.lit(False))
    second = F.coalesce(F.col("genre2") == F.col(genre), F.lit(False))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(first.cast("int")).alias("top1_acc"), F.avg((first | second).cast("int")).alias("top2_acc")
    )


def top2(values: DataFrame, by: str, genre: str = "genre", value: str = "p") -> DataFrame:
    """Two best labels of a node with their scores; ties go to the label that sorts first."""
    rank = F.row_number().over(W.partitionBy(by).orderBy(F.col(value).desc(), genre))
    best = values.withColumn("_r", rank).filter("_r <= 2")
    return best.groupBy(by).agg(
        *[F.max(F.when(F.col("_r") == i, F.col(c))).alias(n)
          for n, i, c in (("genre1", 1, genre), ("p1", 1, value), ("genre2", 2, genre), ("p2", 2, value))]
    )


def head_rows(values: DataFrame, nodes: DataFrame, genres: Sequence[str], node: str = "node", genre: str = "genre") -> DataFrame:
    """``nodes`` with a column per genre (x0, x1, ...): the node's share of its propagated scores, 0 where it has none."""
    whole = F.sum("value")
    wide = values.groupBy(node).agg(*[
        F.coalesce(F.try_divide(F.sum(F.when(F.col(genre) == g, F.col("value"))), whole), F.lit(0.0)).alias(f"x{i}") for i, g in enumerate(genres)])
    return nodes.join(wide, node, "left").fillna(0.0, [f"x{i}" for i in range(len(genres))])


def logistic_head(values: DataFrame, train: DataFrame, targets: DataFrame, genres: Sequence[str], node: str = "node", genre: str = "genre") -> DataFrame:
    """Class probabilities (node, genre, p) from propagated scores, each class against the rest.

    A class counts by the inverse share of its positives, as in ``class_weights``.
    """
    names = [f"x{i}" for i in range(len(genres))]
    number = F.array_position(F.array(*[F.lit(g) for g in genres]), F.col(genre)) - 1
    rows = materialize(head_rows(values, train, genres, node, genre).select(number.cast("int").alias("label"), *names), "head")
    found = {r[genre]: r["pos_weight"] for r in class_weights(train, genre).collect()}  # a row per class
    coef = logit.fit(rows, names, "label", [found[g] for g in genres])
    shares = F.array(*[F.struct(F.lit(g).alias("genre"), p.alias("p")) for g, p in zip(genres, logit.probabilities(coef, names))])
    return head_rows(values, targets, genres, node, genre).select(node, F.inline(shares).alias(genre, "p"))
