"""Names of an event are grouped once: edges and propagated scores come from where its rows lie."""

import pytest
from pyspark.sql import functions as F

from stagelens.operators import graph as G
from stagelens.session import clustered, write_clustered


def laid_out(spark, df, name):
    return spark.table(write_clustered(clustered(df, ["performance_id"]), name, ["performance_id"]))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


# a name in several roles, one without a name, one without an event, a name of capitals beside its lower-case form
SAID = [(1, "a", 2, 1, 0), (1, "b", 0, 0, 3), (1, "c", 1, 0, 2), (2, "a", 0, 1, 0), (2, None, 1, 0, 0), (3, None, 0, 0, 1), (None, "a", 1, 0, 1), (4, "A", 0, 2, 5)]


def test_weighted_edges_are_the_weights_of_participant_edges(spark):
    said = spark.createDataFrame(SAID, "performance_id long, name string, cast long, crew long, org long")
    long = G.participations(said)
    assert sorted((r.role, r.times) for r in long.filter("performance_id = 1 AND name = 'a'").collect()) == [("cast", 2), ("crew", 1)]
    assert long.count() == sum(t > 0 for row in SAID for t in row[2:])
    plain = {(r.performance_id, r.node, r.term, r.tf): r.weight for r in G.tfidf(G.participant_edges(long)).collect()}
    got = {(r.performance_id, r.node, r.term, r.tf): r.weight for r in G.weighted_edges(said).collect()}
    assert got == pytest.approx(plain) and len(got) == 7


def test_weighted_edges_group_no_edges(spark):
    said = laid_out(spark, spark.createDataFrame(SAID, "performance_id long, name string, cast long, crew long, org long"), "said")
    lines = plan(G.weighted_edges(said))
    top = lines[:next(i for i, line in enumerate(lines) if "Subquery" in line)]
    assert not [line for line in top if "Aggregate" in line or "Exchange hashpartitioning" in line]


def test_both_directions_come_from_one_sum(spark):
    edges = spark.createDataFrame([(1, "p:1", "x", 1.0), (1, "p:1", "x", 2.0), (2, "p:2", "x", 4.0)], "performance_id long, p string, node string, weight double")
    both = G.undirected(laid_out(spark, edges, "links"), "p", "node", "weight", loops=False, home="performance_id")
    assert len([line for line in plan(both) if "FileScan" in line]) == 1
    assert sorted(map(tuple, both.collect())) == [("p:1", "x", 3.0), ("p:2", "x", 4.0), ("x", "p:1", 3.0), ("x", "p:2", 4.0)]


def test_crew_meets_known_names_where_it_lies(spark, tmp_path, monkeypatch):
    from stagelens.plans import queries_graph as Q
    from stagelens.plans import stages

    rows = [(e, f"n{e % 7}", 0, 1, 0) for e in range(60)] + [(99, "new", 0, 1, 0)]
    said = laid_out(spark, spark.createDataFrame(rows, "performance_id long, name string, cast long, crew long, org long"), "said")
    cases = laid_out(spark, spark.createDataFrame([(e, "xy"[e % 2], e < 40) for e in [*range(60), 99]], "performance_id long, genre string, train boolean"), "cases")
    monkeypatch.setattr(stages, "namings", lambda *_: said)
    monkeypatch.setattr(Q, "weighted_edges", lambda *_: G.weighted_edges(said))
    monkeypatch.setattr(Q, "split", lambda *_: cases)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")  # a row per name is below it, rows of events are not
        out = Q.accuracy_by_participants(spark, str(tmp_path))
        assert not [line for line in plan(out) if "Exchange hashpartitioning(name#" in line]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert {r.participants: r.n for r in out.collect()} == {True: 20, False: 1}


def test_a_step_moves_rows_of_events_once(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    events = spark.range(4000).select(F.col("id").alias("performance_id"))
    edges = events.select("performance_id", F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col("performance_id") % 5) for k in "abc"])).alias("node"),
                          (F.rand(1) + 0.1).alias("weight"))
    links = laid_out(spark, edges, "links")
    degree = laid_out(spark, G.degrees_by_event(links), "degree")
    # genres may be null, events may have no score
    genre = F.when(F.col("performance_id") % 3 > 0, F.concat(F.lit("g"), F.col("performance_id") % 4))
    first = laid_out(spark, events.filter("performance_id % 2 = 0").select("performance_id", F.lit(None).cast("string").alias("node"), genre.alias("genre"), F.lit(1.0).alias("value")), "first")
    told = links.join(first.select("performance_id", "genre"), "performance_id").count()
    assert told == 6000
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "6000")  # names come to the edges, events do not
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        after = G.hop_by_event(links, degree, first)
        assert len([line for line in plan(after) if "Exchange hashpartitioning(performance_id" in line]) == 1
        second = laid_out(spark, after, "second")
        after = G.hop_by_event(links, degree, second)
        assert len([line for line in plan(after) if "Exchange hashpartitioning(performance_id" in line]) == 1
        got = {(r.node or f"performance:{r.performance_id}", r.genre): r.value for r in after.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    key = F.concat(F.lit("performance:"), F.col("performance_id").cast("string"))
    graph = G.undirected(links.withColumn("p", key), "p", "node", "weight")
    plain = G.propagate(graph, first.select(key.alias("node"), "genre"), 2)
    assert got == pytest.approx({(r.node, r.genre): r.value for r in plain.collect()})
