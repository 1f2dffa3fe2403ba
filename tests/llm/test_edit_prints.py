import hashlib
import random

import numpy as np
import pytest

from stagelens.llm import edit_prints as e
from tests.llm.cases import awkward, empty

WAITS = e.coin_waits()


def plain_walk(text, waits=WAITS):
    """The pointer, a step at a time: the character that it sees at each step."""
    coins = {}
    seen, i, step = [], 0, 0
    while i < len(text):
        c = ord(text[i]) % e.CLASSES
        seen.append(text[i])
        # the wait at a step is one exactly where the coin says go
        coins[c, step] = waits[c, step % e.PERIOD] == 1
        if coins[c, step]:
            i += 1
        step += 1
    return seen


def test_walks_side_by_side_are_the_plain_walk():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé日") for _ in range(n)) for n in (0, 1, 2, 5, 40, 400, 5000, 7)]
    steps = e.Steps()
    for text, reached in zip(texts, e.walk([e.code_points(t) for t in texts], WAITS)):
        seen = plain_walk(text)
        assert reached[-1] == len(seen)
        again = [text[np.searchsorted(reached, s, "right") - 1] for s in range(len(seen))]
        assert again == seen
        made = e.print_of(e.code_points(text), reached, steps)
        assert made == e.prints([text], WAITS, e.Steps())[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        most = rng.randint(0, 8)
        assert e.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def test_likeness_follows_edits():
    rng = random.Random(2)
    steps, few, many, other = e.Steps(), [], [], []
    for _ in range(30):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
        at = rng.randrange(1400)
        slight = text[:at] + "xyz" + text[at + 2 :]
        half = text[:750] + "".join(rng.choice("etaoin shrdlu") for _ in range(750))
        new = "".join(rng.choice("etaoin shrdlu") for _ in range(1500))
        a, b, c, d = e.prints([text, slight, half, new], WAITS, steps)
        few.append(e.likeness(a, b, steps))
        many.append(e.likeness(a, c, steps))
        other.append(e.likeness(a, d, steps))
        assert e.likeness(a, a, steps) == 1 and e.likeness(b, a, steps) == e.likeness(a, b, steps)
    assert np.mean(few) > 0.9 and 0.4 < np.mean(many) < 0.75 and np.mean(other) < 0.25


def plain_next(rows):
    """(id, n_chars, edited text, next text) by sorting all rows."""
    rows = sorted(((r.doc_id, r.text) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for (key, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        q = len(text) // 4
        out.append((key, len(text), text[: len(text) - q] + after[:q], text, after))
    return out


@pytest.mark.parametrize("per_range", [2, 500])
def test_against_next(spark, monkeypatch, per_range):
    monkeypatch.setattr(e, "DOCS_PER_RANGE", per_range)
    docs = awkward(spark)
    steps, expected = e.Steps(), []
    for key, n, edited, text, after in plain_next(docs.collect()):
        a, b, c = e.prints([text, edited, after], WAITS, steps)
        expected.append((key, n, hashlib.sha256(edited.encode()).hexdigest(), a, b, e.likeness(a, b, steps), e.likeness(a, c, steps)))
    assert sorted(map(tuple, e.with_next(docs).collect()), key=repr) == sorted(expected, key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in e.with_next(docs).collect()}
    for key, n, edited, _, _ in plain_next(docs.collect()):
        assert got[key].n_chars == n and got[key].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert np.median([r.near_edited for r in got.values()]) > 0.6 > 0.2 > np.median([r.near_next for r in got.values()])


def test_one_document_and_none(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    row = e.with_next(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1.0
    assert e.with_next(empty(spark)).count() == 0


def test_similar_pairs(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(600)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t[:300] + "##" + t[303:]) for i, t in enumerate(base)] + [(200, base[0]), (201, None), (202, "")]
    got = e.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), most_edits=0.02).collect()
    found = {(r.a, r.b) for r in got}
    assert found <= {(i, 100 + i) for i in range(12)} and len(found) >= 11
    assert all(r.edits == distance(base[r.a], dict(rows)[r.b]) for r in got)


def edited(rng, text, n, front):
    """``text`` with ``n`` edits: characters in front, or changes, insertions and deletions all over."""
    if front:
        return "".join(rng.choice("etaoin shrdlu") for _ in range(n)) + text
    made = list(text)
    for _ in range(n):
        at, what = rng.randrange(len(made)), rng.randrange(3)
        made[at : at + (what != 1)] = [] if what == 2 else [rng.choice("etaoin shrdlu")]
    return "".join(made)


@pytest.mark.parametrize("front, share", [(False, 0.02), (False, 0.05), (True, 0.03)])
def test_bands_of_long_texts_and_any_edits(front, share):
    rng, steps = random.Random(4), e.Steps()
    for n in (40, 600, 2000, 6000):
        found = 0
        for _ in range(40):
            text = "".join(rng.choice("etaoin shrdlu") for _ in range(n))
            a, b = (set(e.band_keys(p, steps)) | set(e.gram_keys(e.code_points(t)))
                    for t in (text, edited(rng, text, int(share * n), front)) for p in e.prints([t], WAITS, steps))
            found += bool(a & b)
        assert found >= 36


def test_similar_pairs_within_five_percent(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("etaoin shrdlu") for _ in range(600)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, edited(rng, t, 18, i % 2)) for i, t in enumerate(base)]
    got = e.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {(r.a, r.b) for r in got}
    assert found <= {(i, 100 + i) for i in range(40)} and len(found) >= 36
    assert all(0 < r.edits <= 18 for r in got)
