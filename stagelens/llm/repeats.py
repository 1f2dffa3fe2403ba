"""Passages that repeat across documents, by content-defined chunks.

Every word has a hash of itself and the word behind it. A chunk begins at each word whose hash is the
smallest among some ``WINDOW`` neighbouring words (the last one of equals), so no chunk is longer than
``WINDOW`` words and where it begins depends on nearby words alone: the same passage is cut at the same
places wherever it stands, also one of repeated lines, but for ``WINDOW`` words at either end. Long
words, as in scripts without spaces, are cut inside by a gear hash over their last 16 bytes. Chunks are
deduplicated by a 128-bit digest, which looks some words ahead, so a chunk of a word or two is not taken
for shared because of a common phrase. Neighbouring chunks that other documents have too make up a repeated span.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import IS_SPACE, is_char, text_slices, utf8

SEED = 9
REACH = 16  # bytes that the rolling hash looks back, a power of two
SPACING = 20  # bytes between places inside a long word that could end a chunk, on average
LEAST = 12  # bytes since the last such place, else the chunk goes on
WINDOW = 11  # words in a chunk at most; passages of 25 + 2 * WINDOW words are never missed
AHEAD_WORDS, AHEAD_BYTES = 8, 48  # from its beginning on, a chunk's digest covers the fewer of these; no more words than WINDOW
MIN_WORDS = 25  # words in a span that counts as a repeated passage

CHUNK = "start long, stop long, first_word long, last_word long, d1 long, d2 long"


def gear_table(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray, place: np.ndarray, gear: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Gear hash at every byte over the last ``reach`` bytes of its text; ``place`` counts within the text."""
    value, span = gear[data], 1
    while span < reach:
        earlier = np.zeros_like(value)
        earlier[span:] = value[:-span] << np.uint32(span)
        earlier[place < span] = 0
        value = value + earlier
        span *= 2
    return value


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which the words of all texts begin."""
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = ~space[heads]
    return np.flatnonzero(begins)


def smallest(value: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Whether a value is the smallest, the last one of equals, of ``window`` neighbours in its text."""
    span = np.ones(len(value), np.int64)
    for step in (1, -1):
        alive = np.ones(len(value), bool)
        for k in range(1, min(window, len(value))):
            here, there = (slice(k, None), slice(None, -k))[::step]
            lower = value[there] >= value[here] if step == 1 else value[there] > value[here]
            reached = np.zeros(len(value), bool)
            reached[here] = lower & (text[there] == text[here])
            alive &= reached
            span += alive
    return span >= window


def chunk_bounds(data: np.ndarray, offsets: np.ndarray, gear: np.ndarray, spacing: int = SPACING,
                 least: int = LEAST, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, stop) of all chunks as byte positions; chunks cover every text without gaps."""
    sizes = np.diff(offsets)
    words = word_starts(data, offsets)
    text = np.searchsorted(offsets, words, "right") - 1
    # hashes within a word: of it, at its last byte, and at the places inside where it could be cut
    heads = np.union1d(offsets[:-1][sizes > 0], words)
    place = np.arange(len(data)) - np.repeat(heads, np.diff(np.append(heads, len(data))))
    place[IS_SPACE[data]] = 0
    value = rolling_hash(data, place, gear)
    space_behind = np.append(IS_SPACE[data], True)
    space_behind[offsets[1:]] = True
    last = np.flatnonzero(~IS_SPACE[data] & space_behind[1:])
    own = value[last].astype(np.uint64)
    behind = np.zeros(len(own), np.uint64)
    behind[:-1] = np.where(text[1:] == text[:-1], own[1:] + np.uint64(1), 0)
    with np.errstate(over="ignore"):
        both = (own * np.uint64(0x9E3779B97F4A7C15) ^ behind) * np.uint64(0xD6E8FEB86659FD93)
    both = (both ^ both >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    starts = words[smallest(both, text, window)]
    ends = np.flatnonzero((value < np.uint32((1 << 32) // spacing)) & (place >= REACH)) + 1
    far = np.ones(len(ends), bool)
    far[1:] = (np.diff(ends) >= least) | (place[ends[1:] - 1] < np.diff(ends) + REACH)
    ends = ends[far]
    ends = ends[is_char(np.append(data, 0)[ends]) & ~space_behind[ends]]  # never inside a character
    starts = np.union1d(np.union1d(starts, ends), offsets[:-1][sizes > 0])
    stops = np.append(starts[1:], len(data)) if len(starts) else starts
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All chunks: key, start and stop as code points, the words that begin in it, its digest as two numbers."""
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(CHUNK).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, digest = gear_table(), xxhash.xxh3_128_digest
        for batch in batches:
            for part in text_slices(batch):
                data, offsets = utf8(part.column(1))
                which, starts, stops = chunk_bounds(data, offsets, gear)
                heads = word_starts(data, offsets)
                chars = np.append(0, np.cumsum(is_char(data)))
                words = np.zeros(len(data) + 1, np.int64)  # that begin before a byte
                words[heads + 1] = 1
                words = np.cumsum(words)
                raw, text_end = data.tobytes(), offsets[which + 1]
                ahead = np.append(heads, np.full(AHEAD_WORDS + 1, len(data)))[words[starts] + AHEAD_WORDS]
                covered = np.maximum(stops, np.minimum(np.minimum(ahead, starts + AHEAD_BYTES), text_end))
                # a few words at the end of a text, with those before them
                text_start, last_words = offsets[which], np.append(heads, len(data))[np.maximum(words[text_end] - AHEAD_WORDS, 0)]
                few = (covered == text_end) & (starts > text_end - AHEAD_BYTES) & (starts > last_words)
                since = np.where(few, np.maximum(text_start, np.maximum(text_end - AHEAD_BYTES, last_words)), starts)
                which_part = (starts - since) << 32 | stops - starts
                spans = zip(since.tolist(), covered.tolist(), which_part.tolist())
                digests = b"".join([digest(raw[a:b], part) for a, b, part in spans])
                d = np.frombuffer(digests, np.int64).reshape(-1, 2)
                # equal neighbours, as in a line said over and over, are one row
                fresh = np.ones(len(d), bool)
                fresh[1:] = (d[1:] != d[:-1]).any(1) | (which[1:] != which[:-1])
                first = np.flatnonzero(fresh)
                starts, stops = starts[first], stops[np.append(first[1:], len(d))[: len(first)] - 1]
                which, d = which[first], d[first]
                head = offsets[which]
                columns = [chars[starts] - chars[head], chars[stops] - chars[head], words[starts] - words[head],
                           words[stops] - words[head], d[:, 0], d[:, 1]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(which)), *map(pa.array, columns)], names=schema.names
                )

    return docs.select(key, text).mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(key, start, stop, n_words, first_id, is_first): spans of passages of ``min_words`` words or more that other documents have too.

    start and stop are code points, stop exclusive. Neighbouring chunks that other documents have too make up
    a passage; ``min_words`` counts for the whole passage. It falls into spans wherever the document that
    has the chunks first changes: ``first_id`` is the smallest key that has all chunks of the span, and
    ``is_first`` marks spans whose first place is here, which a deduplication keeps. Fewer than ``min_words``
    words from elsewhere beside such a span stay part of it, so the first copy of a passage has no
    holes where a phrase is known from another document. A chunk is never in a span to be cut
    where it comes first. A passage covers the whole chunks inside a shared one, so it may stop
    some words short of its ends. Rows with equal keys are one document, rows without key are left
    out, null and empty texts and an empty table have no spans. Equal chunks are counted by an aggregate
    that combines before the exchange, and found again by a join, so a chunk that a third of the
    documents share needs no task of its own.
    """
    named = docs.filter(F.col(key).isNotNull())
    found = chunks(named, key, text).withColumnRenamed(key, "id")
    shared = found.groupBy("d1", "d2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    shared = shared.filter("first_id < last_id").drop("last_id")
    hits = found.join(shared, ["d1", "d2"]).drop("d1", "d2")
    along = Window.partitionBy("id").orderBy("start", "stop", "first_id")
    until = along.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    own = F.col("first_id") == F.col("id")

    def words(part: str) -> Column:
        whole = Window.partitionBy("id", part)
        return F.max("last_word").over(whole) - F.min("first_word").over(whole)

    def turned(*names: str) -> Column:
        """Whether a passage begins or one of the columns changes."""
        return reduce(or_, [F.lag(n).over(along) != F.col(n) for n in names], F.col("opens"))

    runs = hits.withColumns({"own": own, "opens": F.coalesce(before < F.col("start"), F.lit(True))})
    runs = runs.withColumns({"run": F.count_if("opens").over(until), "turns": turned("own")})
    runs = runs.withColumn("side", F.count_if("turns").over(until))
    runs = runs.withColumn("words", words("run")).filter(F.col("words") >= min_words)
    has_own = F.max("own").over(Window.partitionBy("id", "run"))
    runs = runs.withColumn("kept", F.col("own") | (has_own & (words("side") < min_words)))
    runs = runs.withColumn("first_id", F.when(F.col("kept"), F.col("id")).otherwise(F.col("first_id")))
    runs = runs.withColumn("turns", turned("first_id"))
    spans = runs.withColumn("span", F.count_if("turns").over(until)).groupBy("id", "span").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"),
        (F.max("last_word") - F.min("first_word")).alias("n_words"), F.min("first_id").alias("first_id"),
    )
    is_first = F.col("first_id") == F.col("id")
    return spans.select(F.col("id").alias(key), "start", "stop", "n_words", "first_id", is_first.alias("is_first"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated spans that are not the first of their kind; other columns stay."""
    spans = repeated_spans(docs, key, text, min_words).filter("not is_first")
    cuts = spans.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts"))
    whole = docs.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    joined = whole.join(cuts, "_key", "left")
    kept = F.aggregate(
        "_cuts",
        F.struct(F.lit("").alias("made"), F.lit(0).cast("long").alias("at")),
        lambda a, c: F.struct(
            F.concat(a["made"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), (c["start"] - a["at"]).cast("int"))).alias("made"),
            F.greatest(a["at"], c["stop"]).alias("at"),
        ),
        lambda a: F.concat(a["made"], F.substring(F.col("_text"), (a["at"] + 1).cast("int"), F.length(F.col("_text")))),
    )
    made = F.when(F.col("_cuts").isNull(), F.col("_text")).otherwise(kept)
    return joined.select(F.col("_row").withField(f"`{text}`", made).alias("_row")).select("_row.*")
