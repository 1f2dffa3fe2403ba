"""Small tables with every awkward row, for the tests of all operators."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string, key string, score double"


def awkward(spark, extra=()):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text, clashing extra columns."""
    rng = random.Random(1)
    words = ["the", "of", "and", "Haus", "été", "niño", "tree", "stone", "river", "light", "cloud", "maker", "over"]

    def prose(n):
        return " ".join(rng.choice(words) + str(rng.randrange(50)) * (rng.random() < 0.3) for _ in range(n)) + "."

    one = prose(80)
    rows = [
        (1, one, "en", "a"), (2, one, "en", "a"), (2, one, "en", "a"), (3, None, "en", "b"), (4, "", None, "b"),
        (5, " \n\t ", "de", None), (6, prose(60), None, None), (None, prose(50), "fr", "c"), (None, None, None, None),
        (8, "x", "en", "c"), (9, "x", "en", "c"), (10, prose(6000), "en", "a"), (11, "日本語 テキスト 🙂 " * 30, "ja", "d"),
        (12, "1234567890" * 40, "en", "d"), (13, one + " more", "en", "b"), (14, "same same " * 60, "en", "b"),
        (15, "- * #\n- * #\n- * #", "en", "a"), (16, "á     \x1c end", "en", "a"),
        *extra,
    ]
    full = [(i, t, l, s, None if t is None else len(t), 7, "f", None, 0.5) for i, t, l, s in rows]
    return spark.createDataFrame(full, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *names):
    """Rows as tuples in an order of their own."""
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
