"""Tables that lie by event: what is summed per event needs no further exchange, and the results are the plain ones."""

import pytest
from pyspark.sql import functions as F

from stagelens.operators import ablation as AB
from stagelens.operators import graph as G
from stagelens.plans import model as MO
from stagelens.session import clustered, step, write_clustered


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def laid_out(spark, df, name):
    return spark.table(write_clustered(clustered(df, ["performance_id"]), name, ["performance_id"]))


def named(spark):
    rows = [(e, role, f"n{(e * k) % 7}", 1 + e % 2) for e in range(40) for k, role in enumerate(("cast", "crew", "org"), 1)]
    return spark.createDataFrame(rows, "performance_id long, role string, name string, times long")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning(performance_id" in line]


def test_edges_of_an_event_are_not_exchanged_again(spark):
    occ = laid_out(spark, named(spark), "named")
    edges = G.tfidf(G.participant_edges(occ))
    assert exchanges(edges) == []
    plain = G.tfidf(G.participant_edges(named(spark)))
    assert {(r[0], r[1], round(r.weight, 9)) for r in edges.collect()} == {(r[0], r[1], round(r.weight, 9)) for r in plain.collect()}
    key = F.concat(F.lit("performance:"), F.col("performance_id").cast("string")).alias("p")
    links = laid_out(spark, edges, "links").select("performance_id", key, "node", "weight")
    assert exchanges(G.undirected(links, "p", "node", "weight", home="performance_id")) == []
    a, b = (sorted(tuple(r) for r in G.undirected(links, "p", "node", "weight", home=home).collect()) for home in ("performance_id", None))
    assert [x[:2] for x in a] == [x[:2] for x in b] and [x[2] for x in a] == pytest.approx([x[2] for x in b])


def test_step_by_event_is_the_plain_step(spark, no_broadcast):
    edges = laid_out(spark, G.tfidf(G.participant_edges(named(spark))), "edges").select("performance_id", "node", "weight")
    key = F.concat(F.lit("performance:"), F.col("performance_id").cast("string"))
    graph = G.undirected(edges.withColumn("p", key), "p", "node", "weight")
    labels = spark.createDataFrame([(e, "xy"[e % 2]) for e in range(0, 40, 3)], "performance_id long, genre string")
    degree = G.degrees_by_event(edges)
    values = labels.select("performance_id", F.lit(None).cast("string").alias("node"), "genre", F.lit(1.0).alias("value"))
    for hops in (1, 2):
        values = G.hop_by_event(edges, degree, values)
        got = {(r.node or f"performance:{r.performance_id}", r.genre): r.value for r in values.collect()}
        plain = G.propagate(graph, labels.select(key.alias("node"), "genre"), hops)
        assert got == pytest.approx({(r.node, r.genre): r.value for r in plain.collect()})


def test_votes_of_all_cases_are_counted_where_edges_lie(spark):
    edges = laid_out(spark, G.participant_edges(named(spark)).select(F.lit(0).alias("config"), "performance_id", "node", F.col("tf").cast("double").alias("w")), "cases")
    labels = spark.createDataFrame([(s, e, "xy"[e % 2], (e + s) % 4 > 0) for s in (1, 2) for e in range(30)],
                                   "seed int, performance_id long, genre string, train boolean")
    cases, seeds = AB._cases(labels, "performance_id")
    asks = {r.performance_id: [(a.seed, a.held) for a in r.asks] for r in AB._asking(cases, seeds, "performance_id").collect()}
    assert asks[3] == [(1, 1)] and asks[2] == [(2, 1)] and asks[1] == []
    anywhere = laid_out(spark, AB._asking(cases, seeds, "performance_id"), "asks")
    asked = edges.join(anywhere, "performance_id").select("config", "performance_id", "node", "w", F.inline("asks"))
    hist = spark.createDataFrame([(0, 1, "person:n1", "x", 1.0)], "config int, seed int, node string, genre string, votes double")
    assert exchanges(AB._asked(asked, F.broadcast(hist), ["seed"], "performance_id")) == []


def test_tickets_meet_their_sessions_without_salt(spark):
    flat = spark.createDataFrame([(e, f"d{i % 3}", i, "g (a)", "s", "single") for e in range(5) for i in range(6)],
                                 "performance_id long, show_at string, ticket_no long, genre string, subgenre string, kind string")
    made = MO.normalise(laid_out(spark, flat, "flat"), {}, fact=["performance_id", "show_at", "ticket_no"])
    assert "_salt" not in made["ticket_event"]._jdf.queryExecution().analyzed().toString()
    assert made["ticket_event"].join(made["show_session"], "session_id").groupBy("session_id").count().count() == 15


def test_a_step_takes_its_tables_along(spark):
    with step(spark):
        name = write_clustered(named(spark), "short", ["performance_id"])
        assert spark.catalog.tableExists(name) and spark.table(name).count() == 120
    assert not spark.catalog.tableExists(name)
