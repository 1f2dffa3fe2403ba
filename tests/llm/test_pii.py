import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stagelens.llm import pii
from tests.llm.cases import awkward, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])]
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_patterns_on_random_texts():
    rng = random.Random(5)
    bits = ["1", "2", "25", "5", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "é", "4111111111111111", "%", "_", "\n", "255"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    for text, (base, added) in zip(texts, pii.find_spans(pa.array(texts), pii.field())):
        assert base == plain_spans(text)
        assert all(b <= x or a >= y for _, a, b in added for _, x, y in base)


def check(spark, docs):
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.personal_data(docs).collect()), key=repr)
    expected = []
    for r in docs.collect():
        spans = plain_spans(r.text)
        counts = [sum(s[0] == k for s in spans) for k in PATTERNS]
        expected.append((r.doc_id, *counts, hashlib.sha256(joined(spans).encode()).hexdigest()))
    assert got == sorted(expected, key=repr)
    for r in pii.personal_data(docs).collect():
        have = [s for s in r.spans.split(",") if s]
        assert len(have) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added


def test_awkward_rows(spark):
    extra = [(30, "é mail a.b@c.de, +49 30 1234567 at 10.0.0.255 or 4111 1111 1111 1111", "de", "a"),
             (31, "+1 (269) 555-3296 4524132264652876", "en", "a"), (32, "7" * 30000, "en", "a"), (33, "a" * 50000 + "@", "en", "a")]
    check(spark, awkward(spark, extra))


def test_given_documents(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


@pytest.mark.parametrize("text,kind,found", [
    ("Call me at (415) 555-0134 now", "phone", "(415) 555-0134"),
    ("write bob (at) example (dot) com please", "email", "bob (at) example (dot) com"),
    ("my card 4111.1111.1111.1111 is", "card", "4111.1111.1111.1111"),
    ("phone 415-555-0134.", "phone", "415-555-0134"),
    ("a +1 (269) 555-3296 4524132264652876 b", "phone", "+1 (269) 555-3296"),
    ("a +1 (269) 555-3296 4524132264652876 b", "card", "4524132264652876"),
])
def test_other_forms_are_added(text, kind, found):
    added = pii.find_spans(pa.array([text]), pii.field())[0][1]
    assert (kind, found) in [(k, text[a:b]) for k, a, b in added]


@pytest.mark.parametrize("text", [
    "Licensed under CC BY-NC 4.0, version 3. of 1999-10-12 at 10:30", "password=b7db7aa4a5fcc78305 is", "on page 123 of 456",
    "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" x", "they met at the dot on (a) [b] {c}", "order 12345678 no. 555",
])
def test_plain_texts_are_left_alone(text):
    assert pii.find_spans(pa.array([text]), pii.field()) == [([], [])]


def test_clean_documents_have_no_added_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert pii.personal_data(docs).filter("n_added > 0 and n_email + n_ip + n_card + n_phone = 0").count() == 0


def test_field_learns_its_table():
    rows, model = pii.labelled_table(), pii.field()
    wrong = 0
    for words, labels in rows:
        scores = np.array([[model.scores(pii.features(words, i)) for i in range(len(words))]])
        wrong += pii.viterbi(scores, np.array([len(words)]), model.moves)[0].tolist() != labels
    assert wrong <= 0.01 * len(rows)


def test_field_on_unseen_fillings():
    model = pii.field()
    rows = pii.labelled_table(2, seed=99)
    wrong = 0
    for words, labels in rows:
        scores = np.array([[model.scores(pii.features(words, i)) for i in range(len(words))]])
        wrong += pii.viterbi(scores, np.array([len(words)]), model.moves)[0].tolist() != labels
    assert wrong <= 0.03 * len(rows)


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    k = 3
    moves = rng.normal(size=(k, k))
    scores = rng.normal(size=(5, 4, k))
    sizes = np.array([4, 3, 1, 2, 4])
    got = pii.viterbi(scores, sizes, moves)
    for i, n in enumerate(sizes):
        def value(path):
            whole = [0, *path, 0]
            return sum(scores[i, t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(whole, whole[1:]))
        assert tuple(got[i, :n]) == max(itertools.product(range(k), repeat=int(n)), key=value)


def test_masking(spark):
    docs = awkward(spark, [(30, "é a.b@c.de, +49 30 1234567!", "de", "a")])
    out = {r.doc_id: r for r in pii.mask_personal_data(docs).collect()}
    assert out[30].text == "é [EMAIL], [PHONE]!" and out[30].n_chars == len(out[30].text)
    before = {r.doc_id: r for r in docs.collect()}
    assert all(out[i] == before[i] for i in before if i != 30)
    assert pii.masked("abcdef", [("ip", 1, 4), ("card", 2, 5)]) == "a[IP]f"


def test_empty_table(spark):
    assert pii.personal_data(empty(spark)).count() == 0
    assert pii.mask_personal_data(empty(spark)).count() == 0


@pytest.mark.parametrize("text, base, added", [
    ("ip 1.2.3." + "0" * 5000, [("ip", 3, 5009)], []),
    ("host 1.2.3." + "9" * 5000 + " end", [], []),
    ("host " + "7" * 5000 + ".2.3.4 " + "0" * 4400 + "1.2.3.4", [("ip", 5012, 9419)], []),
])
def test_long_runs_of_digits(text, base, added):
    ((got, more),) = pii.find_spans(pa.array([text]), pii.field())
    assert got == base and [s for s in more if s[0] == "ip"] == added


def test_ten_megabytes_of_digits():
    ((base, _),) = pii.find_spans(pa.array(["1234567890" * 1_000_000]), pii.field())
    assert base == []


def test_kept_shapes_stay_bounded():
    model = pii.field()
    for part in range(10):
        texts = [" ".join(f"{part}x{i}-{k}" for k in range(1000)) for i in range(100)]
        pii.find_spans(pa.array(texts), model)
    assert pii._kept_shape.cache_info().currsize <= pii.SHAPES
    before = pii._kept_shape.cache_info().currsize
    pii._shape("9-" * 100)
    assert pii._kept_shape.cache_info().currsize == before
