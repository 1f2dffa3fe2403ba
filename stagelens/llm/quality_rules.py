"""Rules for the quality of texts, with compression bands.

Rules count words, symbols, repeated lines and repeated passages. The bands take the
zstandard ratio (compressed over plain bytes) of the whole document and of its fixed
chunks: text that repeats itself compresses far below prose of its length, text without
any structure far above. What a ratio can be depends on the length, so each length has
limits of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from stagelens.llm.common import IS_SPACE, give_back, is_char, per_text, settle, text_slices, utf8, within

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # per cent of the words
LEVEL = 3
CHUNK_BYTES = 4096
# From so many bytes on, the ratio must be within (low, high). Fixed values.
BANDS = (
    (0, 0.00, float("inf")),  # too short to tell
    (160, 0.30, 1.10),
    (512, 0.26, 0.90),
    (2048, 0.22, 0.80),
    (8192, 0.18, 0.75),
    (32768, 0.15, 0.72),
)
# A document goes if more than this share of its chunks lies outside their band.
MAX_BAD_CHUNKS = 0.25

FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "ratio double, n_chunks long, n_bad_chunks long, kept boolean"
)

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """The limits for a text of so many bytes."""
    return next((low, high) for least, low, high in reversed(bands) if size >= least)


def repeated_words(ids: np.ndarray, docs: np.ndarray, n_docs: int, width: int = WINDOW) -> np.ndarray:
    """Per document the words inside windows of ``width`` (a power of two) that the document has twice or more.

    Equal windows get equal numbers by numbering pairs, pairs of pairs and so on, so nothing rests on a hash.
    """
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    step, number = 1, ids.astype(np.int64)
    while step < width:
        number, names = pd.factorize(number[:-step] * (number.max() + 1) + number[step:])
        number = number.astype(np.int64)
        step *= 2
    starts = np.flatnonzero(docs[:n] == docs[width - 1 :])
    windows, _ = pd.factorize(number[starts] * np.int64(n_docs) + docs[starts])
    again = starts[np.bincount(windows)[windows] > 1] if len(starts) else starts
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + width, -1)
    return np.bincount(docs[np.cumsum(edge[:-1]) > 0], minlength=n_docs)


def duplicate_lines(texts: pa.Array) -> np.ndarray:
    """Per text the lines with a word that equal an earlier line of it."""
    lines = pc.split_pattern(texts, "\n")
    docs = pc.list_parent_indices(lines).to_numpy()
    flat = pc.list_flatten(lines)
    worded = pc.not_equal(pc.ascii_trim_whitespace(flat), "").to_numpy(zero_copy_only=False)
    ids = flat.filter(pa.array(worded)).dictionary_encode().indices.to_numpy().astype(np.int64)
    docs = docs[worded].astype(np.int64)
    n = len(texts)
    first = np.unique(ids * n + docs) % n if len(ids) else ids
    return np.bincount(docs, minlength=n) - np.bincount(first, minlength=n)


def compression(data: bytes, chunk: int = CHUNK_BYTES, bands=BANDS, packer=None) -> tuple[float, int, int]:
    """Ratio of the whole text, number of its fixed chunks and of those outside their band."""
    packer = packer or zstandard.ZstdCompressor(level=LEVEL)
    if not data:
        return 0.0, 0, 0
    ratio = len(packer.compress(data)) / len(data)
    n = bad = 0
    if len(data) > chunk:
        for at in range(0, len(data), chunk):
            part = data[at : at + chunk]
            low, high = band(len(part), bands)
            n += 1
            bad += not low <= len(packer.compress(part)) / len(part) <= high
    return ratio, n, bad


def _rules(texts: pa.Array) -> dict[str, np.ndarray]:
    texts = pc.fill_null(texts, "")
    data, offsets = utf8(texts)
    n = len(texts)
    space = IS_SPACE[data]
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    starts = offsets[:-1]
    before[starts[starts < len(data)]] = True
    n_words = within(~space & before, offsets)
    words = pc.list_flatten(pc.ascii_split_whitespace(texts))
    ids = words.filter(pc.not_equal(words, "")).dictionary_encode().indices.to_numpy().astype(np.int64)
    repeated = repeated_words(ids, np.repeat(np.arange(n), n_words), n)
    failed = (n_words < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n_words)
    packer = zstandard.ZstdCompressor(level=LEVEL)
    raw = data.tobytes()
    ratios, chunks, bad = (
        np.array(x) for x in zip(*(compression(raw[a:b], packer=packer) for a, b in zip(offsets, offsets[1:])))
    )
    limits = np.array([band(size) for size in np.diff(offsets)])
    good = (ratios >= limits[:, 0]) & (ratios <= limits[:, 1]) & (bad <= MAX_BAD_CHUNKS * chunks)
    return {
        "n_words": n_words,
        "word_chars": within(is_char(data) & ~space, offsets),
        "n_symbols": within(_IS_SYMBOL[data], offsets),
        "n_dup_lines": duplicate_lines(texts),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "ratio": ratios.astype(float),
        "n_chunks": chunks.astype(np.int64),
        "n_bad_chunks": bad.astype(np.int64),
        "kept": ~failed & good,
    }


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its key, the counts of the rules, the ratios and the verdict ``kept``.

    A null text counts as empty: no words, so it fails. Repeated rows each get their row; an
    empty table gives an empty table; other columns are not looked at. No exchange: every
    document is judged where it is read.
    """
    return per_text(docs.select(key, text), _rules, FIELDS)


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in text_slices(batch, at):
                yield part.filter(pa.array(_rules(part.column(at))["kept"]))
        give_back()

    return docs.mapInArrow(run, docs.schema)
