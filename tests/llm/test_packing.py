import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stagelens.llm import packing as p
from stagelens.llm.queries import tokenizer
from tests.llm.cases import awkward, empty


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer())


@pytest.fixture(scope="module")
def words():
    return p.Words(tokenizer())


def ids_of(words, text):
    import pyarrow as pa

    return words.ids(*p.utf8(pa.array([text])))[0].tolist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("aAbBéÉß'’.,!<|>1²́ \n \x1cxsSt×K-", max_size=12), st.text(max_size=10))))
def test_ids_are_the_tokenizers(public, words, parts):
    text = " ".join(parts)
    assert ids_of(words, text) == public.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts(public, words):
    for text in ("a<|endoftext|>b", "<|startoftext|>", "x <|ENDOFTEXT|> y", "<| endoftext|>"):
        assert ids_of(words, text) == public.encode(text, add_special_tokens=False).ids


def fewest(lengths, capacity):
    """Fewest sequences by trying all sets for the longest piece."""
    if not lengths:
        return 0
    lengths = sorted(lengths, reverse=True)
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    seen = set()
    for n in range(len(rest) + 1):
        for chosen in combinations(range(len(rest)), n):
            values = tuple(rest[i] for i in chosen)
            if first + sum(values) > capacity or values in seen:
                continue
            seen.add(values)
            best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=8))
def test_as_few_sequences_as_possible(lengths):
    counts = np.bincount(lengths, minlength=21) if lengths else np.zeros(21, int)
    made = p.bin_completion(counts, 20)
    used = np.zeros(21, int)
    for pattern in made:
        assert sum(a * m for a, m in pattern.items) <= 20
        for a, m in pattern.items:
            used[a] += m * pattern.copies
    assert (used == counts).all()
    n = sum(x.copies for x in made)
    assert p.lower_bound(counts, 20) <= n == fewest(lengths, 20)


def test_branch_and_bound_beats_best_fit():
    counts = np.bincount([6, 6, 4, 4, 3, 3, 2, 2, 7, 3] * 3, minlength=11)
    best = sum(x.copies for x in p.best_fit_decreasing(counts, 10))
    assert sum(x.copies for x in p.bin_completion(counts, 10)) == p.lower_bound(counts, 10) <= best


@pytest.mark.parametrize("pieces, least", [({5: 200_000, 7: 100_000}, 831), ({6: 100_000, 11: 50_000}, 562), ({2048: 3, 1: 10}, 4)])
def test_short_pieces_by_the_hundred(pieces, least):
    counts = np.zeros(2049, int)
    for length, n in pieces.items():
        counts[length] = n
    made = p.bin_completion(counts)
    used = np.zeros(2049, int)
    for pattern in made:
        assert sum(a * m for a, m in pattern.items) <= 2048
        for a, m in pattern.items:
            used[a] += m * pattern.copies
    assert (used == counts).all() and sum(x.copies for x in made) == least == p.lower_bound(counts, 2048)


def test_all_undominated_fillings():
    counts = np.bincount([2, 2, 3, 5, 5, 7], minlength=11)
    got = {items for _, items in p.fillings(counts, 10, 10, [0])}
    # 7 2 wastes one and takes 3 in place of 2; in 5 3 2 no single piece gives way to a longer one
    assert got == {((7, 1), (3, 1)), ((5, 2),), ((5, 1), (3, 1), (2, 1))}
    assert all(rest == 10 - sum(a * m for a, m in items) for rest, items in p.fillings(counts, 10, 10, [0]))


def check(docs, public):
    expected = []
    rows = docs.collect()
    for r in rows:
        ids = [*public.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            expected.append((r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    got = p.pack(docs, tokenizer()).collect()
    assert sorted([tuple(x)[:5] for x in got], key=repr) == sorted(expected, key=repr)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    counts = np.bincount([x.length for x in got], minlength=2049)
    assert p.lower_bound(counts, 2048) <= len(by) <= p.lower_bound(counts, 2048) + 1


def test_awkward_rows(spark, public):
    check(awkward(spark), public)


def test_given_documents(spark, public):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), public)


def test_ids_of_pieces(spark, public):
    docs = awkward(spark).filter("doc_id = 10")
    parts = sorted(p.pack(docs, tokenizer(), keep_ids=True).collect(), key=lambda r: r.piece)
    assert sum((list(r.ids) for r in parts), []) == [*public.encode(docs.first().text, add_special_tokens=False).ids, 0]


def test_many_rank_groups(spark, monkeypatch, public):
    monkeypatch.setattr(p, "RANK_ROWS", 5)
    check(awkward(spark).union(awkward(spark)).union(awkward(spark)), public)


def test_empty_table(spark):
    assert p.pack(empty(spark), tokenizer()).count() == 0
