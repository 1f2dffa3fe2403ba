import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stagelens.llm import merkle
from tests.llm.cases import awkward, empty


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def fold(tree, at, digest):
    proof = []
    for nodes in tree[:-1]:
        run = nodes[at // 8 * 8 : at // 8 * 8 + 8]
        proof += run[: at % 8] + run[at % 8 + 1 :]
        digest = sha(*run[: at % 8], digest, *run[at % 8 + 1 :])
        at //= 8
    return proof, digest


def expected(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"], leaf(r, r["text"]), r))
    trees, out = {}, []
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for lang in order:
        groups[lang].sort(key=lambda x: x[:3] if x[0] else (False, 0, x[2]))
        trees[lang] = levels([x[2] for x in groups[lang]])
    top = levels([trees[lang][-1][0] for lang in order])
    for k, lang in enumerate(order):
        for at, (_, key, digest, r) in enumerate(groups[lang]):
            other = leaf(r, lower(r["text"])) if tampered(key) else digest
            proof, sub = fold(trees[lang], at, other)
            more, root = fold(top, k, sub)
            out.append((key, digest, trees[lang][-1][0], top[-1][0], sha(*proof, *more), root, root == top[-1][0]))
    return out


def third(key):
    return key is not None and zlib.crc32(str(key).encode()) % 3 == 0


def check(docs, levels=merkle.LEVELS):
    got = [tuple(r) for r in merkle.manifest(docs, tampered=F.expr("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 0"), levels=levels).collect()]
    assert sorted(got, key=repr) == sorted(expected([r.asDict() for r in docs.collect()], third), key=repr)
    return got


def test_awkward_rows(spark):
    got = check(awkward(spark))
    assert len({g[3] for g in got}) == 1 and any(not g[6] for g in got)


@pytest.mark.parametrize("levels", [1, 2])
def test_many_rounds_of_blocks(spark, levels):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["A", "a"]) + str(i), rng.choice(["en", "en", "de", None]), "s", 1, 1, "", "", 0.0) for i in range(700)]
    rows += [(i, "Alone", f"l{i}", "s", 1, 1, "", "", 0.0) for i in range(700, 730)]
    docs = spark.createDataFrame(rows, awkward(spark).schema)
    check(docs, levels)


def test_one_document(spark):
    docs = awkward(spark).filter("doc_id = 8")
    ((_, digest, sub, root, proof, folded, good),) = check(docs)
    assert digest == sub == root == folded and proof == sha() and good


def test_empty_table(spark):
    assert merkle.manifest(empty(spark)).collect() == []


def test_open_tree_is_the_plain_tree():
    for n in (1, 7, 8, 9, 64, 65, 512, 513):
        leaves = [sha(str(i)) for i in range(n)]
        tree = levels(leaves)
        grown = merkle.OpenTree(len(tree) - 1)
        for i, digest in enumerate(leaves):
            grown.append(digest, i)
        root = grown.finish()
        assert root.digest == tree[-1][0]
        seen = dict(merkle.witnesses(root, len(tree) - 1, []))
        assert sorted(seen) == list(range(n))
        assert all(merkle.folded(leaves[i], w) == root.digest for i, w in seen.items())


def test_partial_witnesses_grow_with_later_siblings():
    tree = merkle.OpenTree(2, fanout=2)
    tree.append("a", 0)
    first = tree.runs[0][0]
    assert (first.left, first.right) == ([], [])
    tree.append("b", 1)
    assert first.right == ["b"] and tree.runs[0] == []
    (above,) = tree.runs[1]
    tree.append("c", 2)
    tree.append("d", 3)
    assert above.right == [merkle.digest_of(["c", "d"])]


def test_witnesses_as_text():
    witness = [([sha("a"), sha("b")], [sha("c")]), ([], [])]
    assert merkle._steps(merkle._packed(witness)) == witness
