"""Names of persons and organisations meet without the events they belong to."""

from stagelens.plans import queries_graph as QG


def test_organisations_meet_persons_without_their_events(spark, monkeypatch):
    cells = spark.createDataFrame([(e, f"B#{e % 3}(host), S{e % 4}") for e in range(20)] + [(20, ""), (None, "S9(host)"), (21, None)],
                                  "performance_id long, org_txt string")
    people = spark.createDataFrame([(e, f"S{e}") for e in (1, 2, 9, 30, None)] * 2, "performance_id long, name string")
    monkeypatch.setattr(QG.stages, "cells", lambda spark, sf: cells)
    monkeypatch.setattr(QG, "people", lambda spark, sf: people)
    out = QG.name_collisions(spark, "")
    assert "hashpartitioning(performance_id" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["names"] for r in out.collect()] == [3]
