import re

import numpy as np
import pytest

from stagelens.llm import mixing as m
from tests.llm.cases import awkward, empty, rows_of


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes):
    """Targets by giving out the words in rounds until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while free and left > 1e-9:
        whole, given, left = sum(weight[s] for s in free), left, 0.0
        for s in sorted(free, key=str):
            target[s] += given * weight[s] / whole
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                free = free - {s}
    return target


def check(docs):
    rows = docs.collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    targets = plain_targets(sizes)
    mixed = m.mix(docs)
    got = mixed.collect()
    assert sorted([(r.doc_id, r.size, r.source_size) for r in got], key=repr) == sorted(
        [(r.doc_id, size(r.text), sizes[r.source]) for r in rows], key=repr)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for source, words in taken.items():
        assert abs(words - targets[source]) <= 3  # rows with one key share the last words
    assert rows_of(mixed, "doc_id", "taken") == rows_of(m.mix(docs), "doc_id", "taken")


def test_awkward_rows(spark):
    check(awkward(spark))


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_splitting_tree_adds_up():
    quotas = np.array([7, 0, 1000, 33])
    for shards in (1, 2, 7, 40):
        dealt = np.zeros((shards, 4), int)
        for shard, source, n in m.split_quotas(quotas, shards):
            dealt[shard, source] += n
        assert (dealt.sum(0) == quotas).all()
        totals = dealt.sum(1)
        assert totals.max() - totals.min() <= np.ceil(np.log2(max(2, shards))) + 1
    assert list(m.split_quotas(np.array([0, 0]), 4)) == []


def test_split_is_hypergeometric():
    first = []
    for seed in range(400):
        got = {(s, i): n for s, i, n in m.split_quotas(np.array([10, 30]), 2, seed)}
        first.append(got.get((0, 0), 0))
    assert np.mean(first) == pytest.approx(5, abs=0.4)
    assert np.var(first) == pytest.approx(20 * 0.25 * 0.75 * 20 / 39, rel=0.35)


def test_blocks_of_a_pass_go_to_one_shard_each(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    mixed = m.mix(docs, shard_words=20_000).selectExpr("source", "inline(drawn)")
    shards = {r.shard for r in mixed.collect()}
    assert len(shards) > 5 and shards == set(range(len(shards)))


def test_rows_of_the_mix(spark):
    docs = awkward(spark)
    out = m.mixed_rows(docs)
    assert out.columns == docs.columns
    have = [repr(r) for r in docs.collect()]
    drawn = [repr(r) for r in out.collect()]
    assert set(drawn) <= set(have)
    assert all(drawn.count(r) <= 2 * have.count(r) for r in set(drawn))
    # documents stay whole, so a source may miss its target by half of its longest one
    words = sum(size(r.text) for r in out.collect())
    assert abs(words - 1.5 * sum(size(r.text) for r in docs.collect())) <= 3000 + 5 * 120


def test_empty_table(spark):
    assert m.mix(empty(spark)).count() == 0
    assert m.mixed_rows(empty(spark)).count() == 0
