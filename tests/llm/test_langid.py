import math
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stagelens.llm import langid as g
from tests.llm.cases import awkward, empty, rows_of


def plain_bits(counts, lang, data, order=g.ORDER):
    """Code length byte by byte: longest known context first, an escape for every one that fails."""
    total = 0.0
    for i in range(len(data)):
        for k in range(min(order, i), -1, -1):
            followers = counts[lang].get(data[i - k : i])
            if not followers:
                continue
            n = sum(followers.values())
            if data[i] in followers:
                total -= math.log2(followers[data[i]] / (n + len(followers)))
                break
            total -= math.log2(len(followers) / (n + len(followers)))
        else:
            total += 8
    return total


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return g.fit(docs.filter(g.fold("doc_id", 5) != 0))


def test_counts_and_code_lengths(spark, learned):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter(g.fold("doc_id", 5) != 0)
    counts = defaultdict(lambda: defaultdict(lambda: defaultdict(int)))
    for r in docs.filter("lang is not null").collect():  # fewer than the bound, so all of them
        data = r.text.encode()
        for i in range(len(data)):
            for k in range(min(g.ORDER, i) + 1):
                counts[r.lang][data[i - k : i]][data[i]] += 1
    assert sum(n for c in counts.values() for f in c.values() for n in f.values()) == learned.n.sum()
    model = g.Trees(learned)
    texts = ["", "a", "xyzzy 中文 {}[]", "The of and", *[r.text[:400] for r in docs.limit(12).collect()]]
    bits = model.bits(*g.utf8(pa.array(texts)))
    for text, row in zip(texts, bits):
        for lang, value in zip(model.langs, row):
            assert value == pytest.approx(plain_bits(counts, lang, text.encode()), rel=1e-5, abs=1e-6)


def made_languages(spark, n):
    """Three scripts; a language's words have three letters of its own; the last languages have one short text each."""
    scripts = ["abcdefghijklmnop", "бвгджзклмнпрстфх", "αβγδεζηθικλμνξοπ"]
    rows = []
    for i in range(n):
        letters = scripts[i % 3]
        own = [letters[(i * 5 + k * (1 + i % 11) + j) % 16] + letters[(i // 3 + 7 * k) % 16] + letters[(i // 48 + k * k) % 16]
               for k in range(6) for j in range(2)]
        for d in range(6 if i < n // 2 else 2):
            rows.append((i * 10 + d, " ".join(own[(d * 5 + k * 3) % 12] for k in range(30 if i < n // 2 else 8)), f"l{i:04d}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_every_language_can_be_predicted(spark):
    """1,200 languages, the small ones with two short texts: none is left out of the model."""
    docs = made_languages(spark, 1200)
    counts = g.fit(docs)
    assert counts.lang.nunique() == 1200
    asked = docs.filter("doc_id % 10 = 0 AND doc_id % 7 = 0")
    made = g.predict(asked, counts).join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert len(made) > 150 and sum(r.lang == r.lang_pred for r in made) >= 0.9 * len(made)
    late = [r for r in made if r.lang >= "l0600"]
    assert sum(r.lang == r.lang_pred for r in late) >= 0.9 * len(late)


def test_a_language_keeps_its_contexts_beside_a_big_one(spark):
    docs = spark.createDataFrame([(i, "lorem ipsum dolor " * 50 + str(i * 7919), "big") for i in range(50)] + [(99, "zq zq", "tiny")],
                                 "doc_id long, text string, lang string")
    counts = g.fit(docs)
    tiny = dict(zip(*[counts[counts.lang == "tiny"][c] for c in ("gram", "n")]))
    runs = [b"zq zq"[i : i + size] for size in range(1, 5) for i in range(6 - size)]
    assert {int.from_bytes(b"\x01" + run) for run in runs} == set(tiny)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = g.language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert made.filter("lang = lang_pred").count() >= 0.97 * made.count()
    assert made.filter("score < 0 or score > 1").count() == 0


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r.doc_id, r.lang_pred, r.score) for r in g.language(docs).collect()}
    langs = {r.lang for r in docs.collect()} - {None}
    for key, lang, score in got:
        assert lang in langs | {"und"} and 0 <= score <= 1
    und = {key for key, lang, _ in got if lang == "und"}
    assert {3, 4, 5, 12, 15} <= und and not und & {1, 2, 6, 8, 10, 11, 16}
    assert len(rows_of(g.language(docs), "doc_id")) == docs.count()


def test_nothing_to_learn_from(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in g.language(docs).collect()} == {"und"}
    assert g.language(empty(spark)).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    per = g.training_sample(docs, "doc_id", "lang", 50).groupBy("lang").count().collect()
    assert all(20 <= r["count"] <= 90 for r in per)
