"""Quality of documents by votes of their nearest labelled neighbours in a latent space.

A document is a bag of hashed terms: its words, the shapes of its words (which signs and cases they
are made of), pairs of neighbouring shapes, and marks for repetition and length. Latent-semantic
vectors come from a truncated singular value decomposition of the weighted terms of a bounded sample of
labelled documents. The labelled vectors are broadcast, their number being that bound; every
document is held against all of them in blocks of exact cosine products, and its nearest ones vote with
their labels, weighted by similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import per_text, text_slices
from stagelens.llm.langid import fold

# Labelled documents of each label to learn from, about: a sample by a hash of the key.
PER_LABEL = 1500
DIMENSIONS = 64
NEIGHBOURS = 25
SHARPNESS = 8.0  # a vote weighs the similarity to this power
PRIOR_WEIGHT = 0.01
BLOCK = 256

# Kinds of terms: (name, hashed to so many columns, weight of the kind in a document).
KINDS = (("word", 3072, 0.5), ("shape", 512, 1.0), ("pair", 1024, 1.0), ("mark", 64, 1.0))
COLUMNS = sum(n for _, n, _ in KINDS)
STARTS = dict(zip((k for k, _, _ in KINDS), np.cumsum([0, *(n for _, n, _ in KINDS)])))

_SHAPE = bytes(
    ord("a") if chr(b).islower() or b >= 128 else ord("A") if chr(b).isupper() else ord("9") if chr(b).isdigit() else b
    for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)


def shape_of(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(_SHAPE))


def terms(texts: pa.Array) -> np.ndarray:
    """Counts of the hashed terms: a row per text, COLUMNS columns."""
    n = len(texts)
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = pc.list_flatten(lists)
    real = pc.not_equal(flat, "")
    docs = pc.list_parent_indices(lists).filter(real).to_numpy().astype(np.int64)
    coded = flat.filter(real).dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    words = [w.encode() for w in coded.dictionary.to_pylist()]
    word = np.array([zlib.crc32(w.lower()) for w in words], np.int64)
    shape = np.array([zlib.crc32(shape_of(w)) for w in words], np.int64)
    out = np.zeros((n, COLUMNS))

    def add(kind: str, rows: np.ndarray, values: np.ndarray) -> None:
        width = next(k[1] for k in KINDS if k[0] == kind)
        at = rows * width + values % width
        first = STARTS[kind]
        out[:, first : first + width] += np.bincount(at, minlength=n * width).reshape(n, width)

    if len(which):
        add("word", docs, word[which])
        add("shape", docs, shape[which])
        together = docs[1:] == docs[:-1]
        pair = shape[which[:-1]] * 31 + shape[which[1:]] * 17
        add("pair", docs[1:][together], pair[together])
        same = together & (which[1:] == which[:-1])
        add("mark", docs[1:][same], np.zeros(int(same.sum()), np.int64))
    size = np.bincount(docs, minlength=n)
    distinct = np.bincount(np.unique(docs * max(1, len(words)) + which) // max(1, len(words)), minlength=n)
    share = np.where(size > 0, distinct / np.maximum(size, 1), 0)
    every = np.arange(n)[size > 0]
    # marks: 1..11 share of different words, 16.. size
    add("mark", every, (1 + np.floor(10 * share)).astype(np.int64)[size > 0])
    add("mark", every, (16 + np.floor(np.log2(size + 1))).astype(np.int64)[size > 0])
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic counts times rarity, each kind scaled to its weight."""
    out = np.log1p(counts) * idf
    for kind, width, weight in KINDS:
        part = out[:, STARTS[kind] : STARTS[kind] + width]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


@dataclass
class Votes:
    """The model: rarity of the terms, the latent space, the labelled vectors and their labels."""

    idf: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def scores(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        prior = self.labels.mean() if len(self.labels) else 0.5
        if not len(self.labels):
            return np.full(len(counts), prior)
        own = unit(weighted(counts, self.idf) @ self.space)
        near = own @ self.vectors.T
        k = min(neighbours, near.shape[1])
        # ties at the last place go to the vector that comes first
        order = np.argsort(-near, axis=1, kind="stable")[:, :k] if near.shape[1] <= 4 * k else _largest(near, k)
        weight = np.maximum(np.take_along_axis(near, order, 1), 0) ** SHARPNESS
        return ((weight * self.labels[order]).sum(1) + PRIOR_WEIGHT * prior) / (weight.sum(1) + PRIOR_WEIGHT)


def _largest(near: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row; equal ones at the border by column."""
    border = -np.partition(-near, k - 1, axis=1)[:, k - 1 : k]
    sure = near > border
    need = k - sure.sum(1, keepdims=True)
    even = near == border
    take = sure | (even & (np.cumsum(even, axis=1) <= need))
    return np.nonzero(take)[1].reshape(len(near), k)


def learn(counts: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS, seed: int = 10) -> Votes:
    """Truncated singular value decomposition of the sample by random projection and power steps."""
    n = len(labels)
    idf = np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1
    rows = weighted(counts, idf)
    rng = np.random.default_rng(seed)
    width = min(dimensions + 16, n, COLUMNS)
    basis = rows @ rng.standard_normal((COLUMNS, width))
    for _ in range(4):
        basis = rows @ (rows.T @ np.linalg.qr(basis)[0])
    q = np.linalg.qr(basis)[0]
    space = np.linalg.svd(q.T @ rows, full_matrices=False)[2][:dimensions].T
    return Votes(idf, np.ascontiguousarray(space), unit(rows @ space), labels.astype(float))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        per_label: int = PER_LABEL) -> Votes:
    """Learn from about ``per_label`` documents of each label, whole texts; the driver gets their sparse terms only."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).alias("_label")).filter("_label IS NOT NULL")
    known = known.groupBy("_key").agg(F.min("_label").alias("_label"))
    share = known.groupBy(F.col("_label").alias("_l")).agg((F.lit(per_label) / F.count("*")).alias("_share"))
    chance = F.pmod(F.xxhash64(F.lit("learn"), "_key"), F.lit(1 << 20)) / float(1 << 20)
    sample = known.join(share, F.col("_label") == F.col("_l")).filter(chance < F.col("_share")).select("_key", "_label")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(sample), "_key")
    rows = rows.select(F.col("_key").cast("string"), F.col("_label").cast("double"), "_text")
    schema = T.StructType.fromDDL("key string, label double, place array<int>, n array<float>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, 2):
                counts = terms(part.column(2))
                places = [np.flatnonzero(c).astype(np.int32) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(places, pa.list_(pa.int32())),
                     pa.array([c[p].astype(np.float32) for c, p in zip(counts, places)], pa.list_(pa.float32()))],
                    names=schema.names,
                )

    made = rows.mapInArrow(run, schema).toArrow().sort_by([("key", "ascending")])
    if not made.num_rows:
        return Votes(np.ones(COLUMNS), np.zeros((COLUMNS, 1)), np.zeros((0, 1)), np.zeros(0))
    counts = np.zeros((made.num_rows, COLUMNS))
    sizes = pc.list_value_length(made["place"]).to_numpy()
    place = pc.list_flatten(made["place"]).to_numpy()
    counts[np.repeat(np.arange(len(sizes)), sizes), place] = pc.list_flatten(made["n"]).to_numpy()
    return learn(counts, made["label"].to_numpy())


def score(docs: DataFrame, model: Votes, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score): between 0 and 1, higher where label 1 is likelier.

    Texts without words (null, empty) have no neighbours and get the labels' mean in the sample.
    Repeated rows each get their row, equal texts the same score, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> dict[str, np.ndarray]:
        parts = [shared.value.scores(terms(texts.slice(i, BLOCK))) for i in range(0, len(texts), BLOCK)]
        return {"score": np.concatenate(parts)}

    return per_text(docs.select(key, text), work, "score double")


def quality_votes(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 4,
                  held: int = 2, threshold: float = 0.7) -> DataFrame:
    """Scores of all documents by labels of those whose fold is not ``held``; ``held_out`` marks the others."""
    seen = labels.filter(fold(key, folds) != held)
    scored = score(docs, fit(docs, seen, key, text), key, text)
    return scored.select(
        key, (fold(key, folds) == held).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
