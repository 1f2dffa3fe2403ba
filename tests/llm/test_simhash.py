import random
import re

import numpy as np
import xxhash

from stagelens.llm import simhash as s
from stagelens.llm.components import components
from tests.llm.cases import awkward, empty, rows_of


def plain_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """Smallest id reachable, for (id, print) rows, by all pairs."""
    ids = sorted({p for _, p in prints})
    parent = {p: p for p in ids}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    least = {}
    for key, p in prints:
        root = find(p)
        if key is not None:
            least[root] = min(least.get(root, key), key)
    return sorted(((key, f"{p:016x}", least.get(find(p))) for key, p in prints), key=repr)


def check(spark, docs):
    got = s.near_duplicates(docs).select("doc_id", s.hex_fingerprint().alias("f"), "component_id")
    assert rows_of(got, "doc_id", "f", "component_id") == plain_groups([(r.doc_id, plain_print(r.text)) for r in docs.collect()])


def test_awkward_rows(spark):
    check(spark, awkward(spark))


def test_given_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_every_pair_within_four_bits_is_linked(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        for n in (1, 2, 3, 4, 5, 6):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints |= {0, 1, 2**64 - 1, 2**64 - 2, 15, 31}
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    got = {frozenset((r.a % 2**64, r.b % 2**64)) for r in s.links(df).collect()}
    have = sorted(prints)
    assert got == {frozenset((a, b)) for i, a in enumerate(have) for b in have[:i] if (a ^ b).bit_count() <= 4}


def test_anchors_cover():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for code in s.coverings():
        home = code.home(fps)
        assert (np.bitwise_count(home ^ code.block(fps)) <= 1).all()
        near = {(int(r), int(a)) for rows, anchors in code.near(fps) for r, a in zip(rows, anchors)}
        for bit in range(code.width):
            moved = code.home(fps ^ np.uint64(1 << (bit + int(code.shift))))
            assert all((i, int(a)) in near for i, a in enumerate(moved))


def test_components_against_union(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    links += [(500, k) for k in range(501, 560)]
    parent = {n: n for link in links for n in link}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    expected = sorted((n, min(m for m in parent if find(m) == find(n))) for n in {x for a, b in links if a != b for x in (a, b)})
    got = components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((r.node, r.root) for r in got.collect()) == expected


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    kept = s.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r in docs.collect():
        groups.setdefault(plain_print(r.text), set()).add(r.doc_id)
    ids = [r.doc_id for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named))
    assert set(named) == {c for _, _, c in plain_groups([(r.doc_id, plain_print(r.text)) for r in docs.collect()]) if c is not None}
    assert ids.count(None) == 1  # the text that only a row without key has; the null text shares its group with others


def test_empty_table(spark):
    assert s.near_duplicates(empty(spark)).count() == 0
    assert s.keep_one(empty(spark)).count() == 0
