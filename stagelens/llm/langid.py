"""Language of a text by prediction by partial matching.

Every language has a tree of byte contexts up to ``order`` bytes with the counts of the bytes that
follow them. A byte costs minus the logarithm of its probability in the longest context the language
knows; in a context where it was not seen, an escape is paid and the next shorter context asked (method
C: the escape counts as often as there are different followers). Below the empty context all bytes are
alike. The statistics are frozen after training, so the code length of a text in each language is
exact: a sum of looked-up costs. The shortest code wins.

A language's tree is two sorted arrays: the runs of bytes it has seen, with the cost of their last byte in
the context of the others, and the contexts, with the cost of their escape. So a language takes the
room of what it has seen, and neither contexts nor languages are left out. Texts are scored a slice at a
time: every different run of bytes in the slice is looked up once per language, from the longest context
to the shortest, and a text's code length is the sum over its runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import per_text, text_slices, utf8, within
from stagelens.session import materialize

ORDER = 3
# Training documents of a language, about: a sample by a hash of the key. Whole texts are counted.
TRAIN_DOCS = 2000
UNKNOWN = "und"


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null keys are fold -1."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds, F.lit(-1))


def training_sample(docs: DataFrame, key: str, lang: str, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """About ``per_lang`` documents of each language, by a hash of the key.

    The table of shares has a row per language. It is written, so the planner knows its size: while it is
    small it is broadcast, and texts are not exchanged.
    """
    known = docs.filter(F.col(lang).isNotNull())
    share = materialize(known.groupBy(F.col(lang).alias("_lang")).agg(F.count("*").alias("_n")), "shares")
    chance = F.pmod(F.xxhash64(F.lit("train"), key), F.lit(1 << 20)) / float(1 << 20)
    joined = known.join(share, F.col(lang) == F.col("_lang"))
    return joined.filter(chance * F.col("_n") < per_lang).drop("_n", "_lang")


def context_counts(sample: DataFrame, lang: str, text: str, order: int = ORDER) -> DataFrame:
    """(lang, gram, n): how often every run of 1 to order + 1 bytes ends at a byte of the language's texts.

    ``gram`` holds the bytes under a leading 1, so its length shows.
    """
    schema = T.StructType.fromDDL("lang string, gram long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                for value in pc.unique(part.column(0)):
                    mine = part.filter(pc.equal(part.column(0), value))
                    data, offsets = utf8(mine.column(1))
                    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
                    for size in range(1, order + 2):
                        gram = _grams(data, size)[place[size - 1 :] >= size - 1]
                        grams, n = np.unique(gram | (1 << 8 * size), return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([value.as_py()] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                            names=schema.names,
                        )

    counted = sample.select(F.col(lang).alias("lang"), text).mapInArrow(run, schema)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _grams(data: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` bytes as numbers, first byte highest."""
    n = max(0, len(data) - size + 1)
    out = np.zeros(n, np.int64)
    for k in range(size):
        out = out << 8 | data[k : k + n]
    return out


def _lengths(gram: np.ndarray) -> np.ndarray:
    """Bytes of runs under a leading 1."""
    out = np.zeros(len(gram), np.int64)
    for size in range(1, 8):
        out[gram >= 1 << 8 * size] = size
    return out


def _shortened(gram: np.ndarray) -> np.ndarray:
    """Runs without their first byte."""
    mark = np.int64(1) << 8 * (_lengths(gram) - 1)
    return mark | gram & (mark - 1)


class Tree:
    """Costs in bits of one language: of each run's last byte after the others, and of each context's escape."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        self.gram, n = gram[order], n[order].astype(np.float64)
        context = self.gram >> 8
        self.context, first, kinds = np.unique(context, return_index=True, return_counts=True)
        total = np.add.reduceat(n, first) if len(n) else n
        self.escape = (-np.log2(kinds / (total + kinds))).astype(np.float32)
        self.seen = (-np.log2(n / np.repeat(total + kinds, kinds))).astype(np.float32)

    def costs(self, runs: np.ndarray) -> np.ndarray:
        """Cost of the last byte of each run, escapes from longer contexts included."""
        out = np.zeros(len(runs))
        left, now = np.arange(len(runs)), runs
        while len(left):
            at = np.minimum(np.searchsorted(self.gram, now), len(self.gram) - 1)
            hit = self.gram[at] == now
            out[left[hit]] += self.seen[at[hit]]
            left, now = left[~hit], now[~hit]
            context = now >> 8
            at = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
            known = self.context[at] == context
            out[left[known]] += self.escape[at[known]]
            last = context == 1  # the empty context: all bytes are alike
            out[left[last]] += 8
            left, now = left[~last], _shortened(now[~last])
        return out


class Trees:
    """The trees of all languages."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER):
        self.order, self.trees = order, {}
        ordered = counts.sort_values("lang", kind="stable")
        langs, gram, n = (ordered[c].to_numpy() for c in ("lang", "gram", "n"))
        self.langs, first = np.unique(langs.astype(str), return_index=True)
        self.langs = self.langs.tolist()
        self.trees = [Tree(gram[a:b].astype(np.int64), n[a:b]) for a, b in zip(first, [*first[1:], len(gram)])]

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of every text in every language."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        if not len(data):
            return out
        runs = np.zeros(len(data), np.int64)
        runs[self.order :] = _grams(data, self.order + 1) | 1 << 8 * (self.order + 1)
        begins, sizes = offsets[:-1], np.diff(offsets)
        for place in range(min(self.order, int(sizes.max()))):  # the first bytes of a text have shorter contexts
            at = begins[sizes > place] + place
            run = np.ones(len(at), np.int64)
            for k in range(place + 1):
                run = run << 8 | data[at - place + k]
            runs[at] = run
        distinct, which = np.unique(runs, return_inverse=True)
        for k, tree in enumerate(self.trees):
            out[:, k] = _sums(tree.costs(distinct)[which], offsets)
        return out


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, dtype=np.float64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = within(_ASCII_LETTER[data], offsets) > 0
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts[i].as_py() or "")
    return out


_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_TABLES: dict[str, Trees | None] = {}  # the trees of the model a worker process last used


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = TRAIN_DOCS,
        order: int = ORDER) -> pd.DataFrame:
    """The frozen statistics (lang, gram, n) from a bounded sample of labelled rows.

    Their number follows from the sample, ``per_lang`` documents of each language, not from the corpus.
    """
    sample = training_sample(docs.select(key, text, lang), key, lang, per_lang)
    return context_counts(sample, lang, text, order).toPandas()


def predict(docs: DataFrame, counts: pd.DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per document: key, lang_pred, score, bits (its code length in the language predicted).

    ``score`` is the share of the predicted language if every language is given the probability
    that its code length stands for. Equal lengths go to the language that sorts first. A null
    text and one without letters is ``und`` with score 0, as is any text if nothing was learned.
    """
    statistics = docs.sparkSession.sparkContext.broadcast(counts)
    name = uuid.uuid4().hex

    def work(texts: pa.Array) -> dict[str, object]:
        if name not in _TABLES:
            _TABLES.clear()
            _TABLES[name] = Trees(statistics.value, order) if len(statistics.value) else None
        model = _TABLES[name]
        data, offsets = utf8(texts)
        if model is None:
            n = len(texts)
            return {"lang_pred": pa.array([UNKNOWN] * n), "score": np.zeros(n), "bits": np.zeros(n)}
        bits = model.bits(data, offsets)
        best = bits.argmin(1)
        least = bits[np.arange(len(best)), best]
        score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
        known = has_letter(texts, data, offsets)
        langs = np.array([*model.langs, UNKNOWN], object)[np.where(known, best, -1)]
        return {"lang_pred": pa.array(langs, pa.string()), "score": np.where(known, score, 0.0), "bits": least}

    return per_text(docs.select(key, text), work, "lang_pred string, score double, bits double")


def language(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5) -> DataFrame:
    """Predictions for all documents by a model of those whose fold is not 0; ``held_out`` marks the others."""
    counts = fit(docs.filter(fold(key, folds) != 0), key, text, lang)
    made = predict(docs, counts, key, text)
    return made.withColumn("held_out", fold(key, folds) == 0)
