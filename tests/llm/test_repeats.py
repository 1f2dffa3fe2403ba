import random

import numpy as np
import pyarrow as pa

from stagelens.llm import repeats as r
from tests.llm.cases import awkward, empty


def made_words(rng, n):
    return " ".join("".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(1, 9))) for _ in range(n))


def bounds(text):
    data, offsets = r.utf8(pa.array([text]))
    _, starts, stops = r.chunk_bounds(data, offsets, r.gear_table())
    return data, starts.tolist(), stops.tolist()


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    text = made_words(rng, 400) + " é日本 " + made_words(rng, 100)
    data, starts, stops = bounds(text)
    assert starts[0] == 0 and stops[-1] == len(data) and starts[1:] == stops[:-1]
    raw = data.tobytes()
    whole = {raw[a:b] for a, b in zip(starts, stops)}
    for part in whole:
        part.decode()  # never inside a character
    moved, a, b = bounds("some new words first " + text)
    again = {moved.tobytes()[x:y] for x, y in zip(a, b)}
    assert len(whole - again) <= 2
    assert 20 < len(raw) / len(starts) < 60


def test_texts_in_a_batch_do_not_touch():
    rng = random.Random(2)
    texts = [made_words(rng, n) for n in (50, 1, 200)] + ["", "x"]
    data, offsets = r.utf8(pa.array(texts))
    which, starts, stops = r.chunk_bounds(data, offsets, r.gear_table())
    for i, text in enumerate(texts):
        mine = [(a - offsets[i], b - offsets[i]) for k, a, b in zip(which, starts, stops) if k == i]
        alone = bounds(text)
        assert mine == list(zip(alone[1], alone[2]))


def test_rolling_hash_is_the_gear_hash():
    data = np.frombuffer(random.Random(3).randbytes(200), np.uint8)
    gear = r.gear_table()
    got = r.rolling_hash(data, np.arange(200), gear)
    for i in range(200):
        value = 0
        for b in data[max(0, i - r.REACH + 1) : i + 1]:
            value = (value * 2 + int(gear[b])) % 2**32
        assert got[i] == value


def test_planted_passages(spark):
    rng = random.Random(4)
    passages = [made_words(rng, 55) for _ in range(60)]
    rows = []
    for i, passage in enumerate(passages):
        rows.append((2 * i, f"{made_words(rng, 70)} {passage} {made_words(rng, 30)}"))
        rows.append((2 * i + 1, f"{made_words(rng, 20)} {passage}"))
    clean = [(1000 + i, made_words(rng, 120)) for i in range(40)]
    short = made_words(rng, 12)
    boiler = [(2000 + i, f"{short} {made_words(rng, 90)} {short}") for i in range(20)]
    docs = spark.createDataFrame(rows + clean + boiler, "doc_id long, text string")
    spans = r.repeated_spans(docs).collect()
    texts = dict(rows)
    assert {s.doc_id for s in spans} <= set(range(120))
    assert len({s.doc_id for s in spans}) >= 118
    for s in spans:
        part = texts[s.doc_id][s.start : s.stop]
        assert part in texts[s.first_id] and s.first_id == s.doc_id // 2 * 2 and s.is_first == (s.doc_id == s.first_id)
    out = {x.doc_id: x.text for x in r.remove_repeats(docs).collect()}
    cut = {s.doc_id: s for s in spans if not s.is_first}
    for key, text in rows + clean + boiler:
        s = cut.get(key)
        assert out[key] == (text if s is None else text[: s.start] + text[s.stop :])


def test_every_passage_is_found(spark):
    rng = random.Random(6)

    def line(n):
        return " ".join(made_words(rng, 1)[:5].ljust(4, "x") for _ in range(n))

    kinds = [made_words(rng, 51) for _ in range(700)] + [" ".join(rng.choice("etaoinsh") for _ in range(51)) for _ in range(50)]
    kinds += [" ".join([line(n)] * (51 // n + 1)) for n in range(1, 26) for _ in range(8)]  # repeated lines
    rows = []
    for i, passage in enumerate(kinds):
        rows.append((2 * i, f"{made_words(rng, 70)} {passage} {made_words(rng, 30)}"))
        rows.append((2 * i + 1, f"{made_words(rng, 20)} {passage}" + f" {made_words(rng, 25)}" * (i % 2)))
    spans = r.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {s.doc_id for s in spans} == {k for k, _ in rows}
    assert {s.doc_id for s in spans if s.is_first} == set(range(0, len(rows), 2))
    texts = dict(rows)
    outside = [s for s in spans if texts[s.doc_id][s.start : s.stop].strip() not in kinds[s.doc_id // 2]]
    assert not outside


def test_chunks_have_a_greatest_length():
    rng = random.Random(7)
    for text in (made_words(rng, 3000), "one line said over and over\n" * 500, "a b " * 900, "x " * 700):
        data, starts, stops = bounds(text)
        assert max(len(data[a:b].tobytes().split()) for a, b in zip(starts[1:-1], stops[1:-1])) <= r.WINDOW
    _, starts, _ = bounds("".join(rng.choice("etaoinshrdlu") for _ in range(9000)))  # a text without spaces
    assert 20 < 9000 / len(starts) < 60


def test_boilerplate_beside_a_repeated_passage(spark):
    rng = random.Random(5)
    header, article, phrase = made_words(rng, 80), made_words(rng, 90), made_words(rng, 15)
    whole = f"{article} {phrase} {made_words(rng, 60)}"  # the phrase is known from document 2
    rows = [(1, f"{header} {made_words(rng, 70)}"), (2, f"{made_words(rng, 40)} {phrase} {made_words(rng, 40)}"),
            (5, f"{header} {whole} {made_words(rng, 30)}"), (7, f"{header} {made_words(rng, 50)}"),
            (9, f"{header} {whole} {made_words(rng, 20)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = r.repeated_spans(docs).collect()
    texts = dict(rows)
    for s in spans:
        assert texts[s.doc_id][s.start : s.stop] in texts[s.first_id] and s.is_first == (s.doc_id == s.first_id)
    keepers = {(s.doc_id, s.first_id) for s in spans}
    assert {(1, 1), (5, 1), (5, 5), (7, 1), (9, 1), (9, 5)} <= keepers
    out = {x.doc_id: x.text for x in r.remove_repeats(docs).collect()}
    assert out[1] == texts[1] and out[2] == texts[2] and whole in out[5]
    middles = [header[150:250], article[150:300]]
    assert [[m in out[k] for k in (1, 5, 7, 9)] for m in middles] == [[True, False, False, False], [False, True, False, False]]


def test_awkward_rows(spark):
    docs = awkward(spark)
    spans = r.repeated_spans(docs).collect()
    assert {s.doc_id for s in spans} == {1, 2, 13}  # equal texts, and one with more behind
    assert {(s.doc_id, s.is_first) for s in spans} == {(1, True), (2, False), (13, False)}
    out = r.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_empty_table(spark):
    assert r.repeated_spans(empty(spark)).count() == 0
    assert r.remove_repeats(empty(spark)).count() == 0


def shingles(text, n):
    words = text.split()
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_spans_against_a_plain_scan(spark):
    """Every span has a true copy elsewhere and names the first of them; what is shared at length has a span; the rest has none."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts = {x.doc_id: x.text for x in rows if x.text}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    spans = r.repeated_spans(docs).collect()
    assert spans
    where = {}
    for n in (r.MIN_WORDS - 2 * r.WINDOW, r.MIN_WORDS, r.MIN_WORDS + 2 * r.WINDOW):
        for key, text in texts.items():
            for s in shingles(text, n):
                where.setdefault(s, set()).add(key)
    for s in spans:
        part = texts[s.doc_id][s.start : s.stop]
        if s.is_first:
            assert s.first_id == s.doc_id
            few = shingles(part, r.MIN_WORDS - 2 * r.WINDOW)
            assert any(len(where[x]) > 1 for x in few)
        else:
            holders = [key for key, text in texts.items() if part.strip() in text]
            assert s.first_id in holders and s.first_id < s.doc_id
            # a few words alone may stand in earlier documents that go on otherwise
            assert s.n_words < r.MIN_WORDS or s.first_id == min(holders)
    found = {}
    for s in spans:
        found.setdefault(s.doc_id, []).append((s.start, s.stop))
    for key, text in texts.items():
        if not any(len(where[x]) > 1 for x in shingles(text, r.MIN_WORDS - 2 * r.WINDOW)):
            assert key not in found
        if any(len(where[x]) > 1 for x in shingles(text, r.MIN_WORDS + 2 * r.WINDOW)):
            assert key in found
