"""The configurations of the ablation come from one row per event and name, and what is found meets its cases where both lie."""

import pytest
from pyspark.sql import functions as F

from stagelens.operators import ablation as AB
from stagelens.operators import graph as G
from stagelens.plans import queries_graph as QG
from stagelens.plans import stages
from stagelens.session import clustered, write_clustered


@pytest.fixture
def built(spark, monkeypatch):
    """Namings, some of them without an event or a name, and the stages that are written from them."""
    rows = [(e if e % 9 else None, f"n{(e * k) % 7}" if k != 4 else None, e % 2, k % 3, (e + k) % 2) for e in range(40) for k in (1, 2, 3, 4)]
    plain = spark.createDataFrame(rows, "performance_id long, name string, cast long, crew long, org long")
    namings = plain.groupBy("performance_id", "name").agg(*[F.sum(c).alias(c) for c in G.ROLES])
    written = []

    def stage(spark, sf, name, build):
        written.append(name)
        return spark.table(write_clustered(clustered(build(), ["performance_id"]), name, ["performance_id"]))

    monkeypatch.setattr(stages, "clustered", stage)
    monkeypatch.setattr(stages, "namings", lambda *_: namings)
    return namings, written


def plain_sets(namings):
    occ, weighed = G.participations(namings), G.weighted_edges(namings)
    sets = [(G.participant_edges(occ, merge_roles=False, with_orgs=False), "tf"), (G.participant_edges(occ, with_orgs=False), "tf"),
            (weighed, "tf"), (weighed, "weight"), (weighed, "weight")]
    return [df.select("performance_id", "node", F.col(w).cast("double").alias("w")).collect() for df, w in sets]


def test_edges_of_all_configurations_are_written_as_one_row_per_name(spark, built):
    namings, written = built
    got = QG.ablation_edges(spark, "").collect()
    assert written == ["weighed_names"]
    for config, rows in enumerate(plain_sets(namings)):
        want = {(r[0], r[1], round(r.w, 9)) for r in rows if r[0] is not None and r[1] is not None}
        assert {(r[1], r[2], round(r.w, 9)) for r in got if r.config == config} == want
    assert len(got) == len({(r[0], r[1], r[2]) for r in got})


def test_sizes_count_what_the_edges_hold(spark, built):
    namings, _ = built
    got = {r.config: (r.nodes, r.edges) for r in QG.ablation_sizes(spark, "").collect()}
    want = [(len({r.node for r in rows} - {None}), len(rows)) for rows in plain_sets(namings)]
    assert [got[i] for i in range(6)] == [*want, want[4]]


def test_what_is_found_is_not_exchanged_for_its_cases(spark, built, monkeypatch):
    held = [(s, e, "xy"[e % 2], (e + s) % 3 > 0) for s in (1, 2) for e in range(1, 40)]
    labels = spark.createDataFrame(held, "seed int, performance_id long, genre string, train boolean")
    said = AB.votes_by_case(QG.ablation_edges(spark, ""), labels, weighed=(4,))
    plan = said._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "performance_id" in line]
    assert said.count() == 5 * 2 * sum(not train for *_, train in held)
