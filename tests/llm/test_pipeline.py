"""The pipeline against the stages done by hand on the smallest data."""

import re

import numpy as np

import corpus_pipeline
from stagelens.llm import packing, pii
from stagelens.llm.queries import tokenizer
from tests.llm.test_pii import plain_spans
from tests.llm.test_quality_rules import plain as plain_rules
from tests.llm.test_mixing import plain_targets
from tests.llm.test_simhash import plain_groups, plain_print

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.collect()
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality rules"](spark, docs, SF)
    expected = [r for r in rows if plain_rules(r.text)[-1]]
    assert kept.columns == columns and sorted(map(repr, kept.collect())) == sorted(map(repr, expected))

    kept = spark.createDataFrame(expected, docs.schema)
    one = stages["simhash near-dedup"](spark, kept, SF)
    groups = plain_groups([(r.doc_id, plain_print(r.text)) for r in expected])
    alone = {c for _, _, c in groups}
    expected = [r for r in expected if r.doc_id in alone]
    assert one.columns == columns and sorted(map(repr, one.collect())) == sorted(map(repr, expected))

    masked = stages["personal data"](spark, spark.createDataFrame(expected, docs.schema), SF).collect()
    by = {r.doc_id: r for r in masked}
    assert len(masked) == len(expected)
    for r in expected:
        if plain_spans(r.text):
            assert by[r.doc_id].text != r.text and not plain_spans(by[r.doc_id].text)
        else:
            assert by[r.doc_id] == r

    before = spark.createDataFrame(masked, docs.schema)
    mixed = stages["mixing to target weights"](spark, before, SF).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken, longest = {}, {}, {}
    for r in masked:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        longest[r.source] = max(longest.get(r.source, 0), size(r.text))
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for source, target in plain_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= longest[source] / 2 + 2
    assert set(map(repr, mixed)) <= set(map(repr, masked))

    packed = stages["best-fit packing"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    counts = np.bincount([r.length for r in packed], minlength=2049)
    assert len({r.sequence_id for r in packed}) <= packing.lower_bound(counts, 2048) + 1
    words = packing.Words(tokenizer())
    import pyarrow as pa

    _, ends = words.ids(*packing.utf8(pa.array([r.text for r in mixed])))
    assert sum(r.length for r in packed) == int(ends[-1]) + len(mixed)


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "simhash near-dedup", "personal data", "mixing to target weights", "best-fit packing"]
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0 and pii.KINDS
