"""Extra columns may have any name, also those that an operator uses inside."""

from pyspark.sql import functions as F

from stagelens.llm import merkle, quality_votes, repeats, sharding, simhash
from stagelens.llm.collocations import collocations
from tests.llm.cases import awkward, empty

INSIDE = ("_key", "_label", "_cuts", "_id", "_digest", "_row", "_text", "_nth", "key", "row", "hub", "shard", "at", "n", "grp", "prefix", "word", "leaf")


def named(docs):
    return docs.withColumns({c: F.lit(f"own {c}") for c in INSIDE})


def without(docs, out):
    """Rows with their extra columns as they were, then without them."""
    assert out.columns == docs.columns
    assert out.filter(" OR ".join(f"`{c}` IS DISTINCT FROM 'own {c}'" for c in INSIDE)).count() == 0
    return sorted(map(repr, out.drop(*INSIDE).collect()))


def test_rows_keep_their_columns(spark):
    docs = awkward(spark).drop(*INSIDE)
    more = named(docs)
    for operator in (simhash.keep_one, repeats.remove_repeats):
        assert without(more, operator(more)) == sorted(map(repr, operator(docs).collect()))


def test_results_do_not_depend_on_other_columns(spark):
    docs = awkward(spark).drop(*INSIDE)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 14)], "doc_id long, quality int")
    other = labels.withColumns({"_key": F.lit(1), "_label": F.lit(0), "_l": F.lit(0)})
    for run in (
        lambda d: quality_votes.quality_votes(d, labels if "row" not in d.columns else other),
        merkle.manifest, lambda d: sharding.sharded(d).drop("shard", "slot"), collocations,
    ):
        assert sorted(map(repr, run(named(docs)).collect())) == sorted(map(repr, run(docs).collect()))


def test_empty_tables(spark):
    more = named(empty(spark).drop(*INSIDE))
    assert simhash.keep_one(more).count() == repeats.remove_repeats(more).count() == 0
