import random
import re
from collections import Counter

import pytest

from stagelens.llm import collocations as C
from tests.llm.cases import DOCS, awkward, empty


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=10, top=2000):
    counts, sizes = {}, Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(r["text"] or "")):
            w = re.findall("[^\x20\x09]+", piece)
            sizes[lang] += len(w)
            for k in (1, 2, 3):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = [p for p, a in f.items() if len(p) > 1 and a >= least]
        most = Counter()
        for p in cand:
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    most[q] = max(most[q], f[p])
        rows = []
        for p in cand:
            if len(p) == 2 and 100 * most[p] >= 50 * f[p] and most[p]:
                continue
            score, _, left, right = min((10**6 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -s))
    return sorted(out)


def check(docs, **options):
    got = sorted(tuple(r) for r in C.collocations(docs, **options).collect())
    assert got == plain([r.asDict() for r in docs.collect()], **options)
    return got


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, lang, "a", 1, 1, "f", None, 0.1) for i, (t, lang) in enumerate(texts)], DOCS)


def test_awkward_rows(spark):
    assert check(awkward(spark))


def test_random_words(spark):
    rng = random.Random(3)
    words = ["a", "B", "b", "É", "é", "cc", "x\x1cy", "the", "of", "日本"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ".", "\n", ", "]) for _ in range(rng.randint(0, 60)))
             for _ in range(150)]
    docs = docs_of(spark, [(t, rng.choice(["en", "de", None, "und"])) for t in texts])
    got = check(docs, least=4)
    assert {g[0] for g in got} == {"en", "de", "und"}
    check(docs, least=4, top=5)


def test_longer_phrases_take_the_place_of_shorter_ones(spark):
    texts = [("new york city", "en")] * 12 + [("new york", "en")] * 12 + [("york city", "en")] * 13
    got = {g[2] for g in check(docs_of(spark, texts))}
    assert got == {"new york city", "york city"}  # 12 of 24 are half, 12 of 25 are not


def test_frequent_prefixes_are_cut_into_parts(spark, monkeypatch):
    """A word that every second one is, in slices of a few bytes, merged a few entries at a time."""
    rng = random.Random(4)
    monkeypatch.setattr(C, "SLICE", 400)
    monkeypatch.setattr(C, "MERGED", 20)
    texts = [(" ".join(w for _ in range(30) for w in ("the", rng.choice("abcdefgh") * rng.randint(1, 3))), "en") for _ in range(60)]
    docs = docs_of(spark, texts)
    counted = [C._hot(docs.selectExpr("'en' AS lang", "cast('the' AS binary) AS word", "1800L AS f"), __import__("pyspark").sql.functions.col("word"), 3600, 8)]
    assert counted[0] == {("en", b"the"): 9}
    check(docs)


def test_a_filter_that_lets_everything_through(spark, monkeypatch):
    """Bits that other phrases share cost work, not rows."""
    import numpy as np

    monkeypatch.setattr(C, "_bit_map", lambda phrases: np.full(1 << (C.BITS - 3), 255, np.uint8))
    check(awkward(spark), least=3)


def test_merging_in_steps():
    import numpy as np
    import pyarrow as pa

    def stripe(prefix, entries):
        return [pa.RecordBatch.from_arrays([
            pa.array(["en"]), pa.array([prefix], pa.binary()), pa.array([0], pa.int32()),
            pa.array([b"\n".join(entries)], pa.binary()), pa.array([np.array(list(entries.values()), "<i8").tobytes()], pa.binary()),
        ], names=["lang", "prefix", "part", "words", "counts"])]

    rows = stripe(b"a", {b"x": 1, b"y": 2}) + stripe(b"a", {b"y": 3}) + stripe(b"b", {b"x": 7})
    for held in (rows, C._joined(rows)):
        got = C._merge(held, 1, True).to_pylist()
        assert sorted((g["prefix"], g["word"] or b"", g["f"]) for g in got) == [
            (b"a", b"", 6), (b"a", b"x", 1), (b"a", b"y", 5), (b"b", b"", 7), (b"b", b"x", 7)]


def test_scores_beyond_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([(big - 1, big, big + 3)], "a long, l long, r long")
    (row,) = df.select(C._floor_score("a", "l", "r").cast("long").alias("s")).collect()
    assert row.s == 10**6 * (big - 1) ** 2 // (big * (big + 3))


def test_empty_table(spark):
    assert C.collocations(empty(spark)).collect() == []


@pytest.mark.parametrize("text", ["", " \t ", "...", "a", "\n\n"])
def test_texts_without_pairs(spark, text):
    assert C.collocations(docs_of(spark, [(text, "en")])).collect() == []
