import re
from collections import Counter

import pytest
import zstandard

from stagelens.llm import quality_rules as q
from tests.llm.cases import awkward, empty, rows_of


def plain(text):
    """The counts, word by word."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    data, pack = text.encode(), zstandard.ZstdCompressor(level=q.LEVEL)

    def fits(part):
        low, high = q.band(len(part))
        return low <= (len(pack.compress(part)) / len(part) if part else 0) <= high

    chunks = [data[i : i + q.CHUNK_BYTES] for i in range(0, len(data), q.CHUNK_BYTES)] if len(data) > q.CHUNK_BYTES else []
    good = fits(data) and sum(not fits(c) for c in chunks) <= q.MAX_BAD_CHUNKS * len(chunks)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
            len(inside), failed, good and not failed)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def test_awkward_rows_against_plain_counts(spark):
    docs = awkward(spark, [(20, "a b c d e f g h " * 9, "en", "a"), (21, "l one\n l one\nl one\n\n\n#", "en", "a")])
    got = rows_of(q.quality_rules(docs), "doc_id", *NAMES)
    assert got == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = rows_of(q.quality_rules(docs), "doc_id", *NAMES)
    assert got == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)


@pytest.mark.parametrize("kind,kept", [("prose", True), ("repeated", False), ("noise", False)])
def test_bands(spark, kind, kept):
    import random
    rng = random.Random(2)
    letters = "etaoinshrdlu"
    word = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = {
        "prose": " ".join(rng.choice(word) for _ in range(3000)),
        "repeated": "\n".join(f"{rng.choice(word)} {k % 3} spam and more spam for all" for k in range(400)),
        "noise": " ".join("".join(chr(rng.randint(33, 126)) for _ in range(8)) for _ in range(2000)),
    }[kind]
    row = q.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.kept is kept


def test_stage_keeps_rows_as_they_are(spark):
    docs = awkward(spark)
    kept = q.keep_quality(docs)
    assert kept.columns == docs.columns
    expected = [r for r in docs.collect() if plain(r.text)[-1]]
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, expected))


def test_empty_table(spark):
    assert q.quality_rules(empty(spark)).count() == 0
    assert q.keep_quality(empty(spark)).count() == 0
