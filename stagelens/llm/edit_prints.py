"""Fingerprints of documents by a randomised edit embedding.

A pointer walks over the characters of a text. At every step a random coin, which depends on the
step and the character and is the same for all texts, decides whether it moves on. What it sees at each step is
the embedding: two texts an edit apart meet again after a few steps, so their embeddings differ in few
places, and edit distance becomes Hamming distance. The fingerprint samples the embedding at random
steps and keeps one bit of what the pointer sees there.

The steps to sample at come from one random order: level k holds the steps whose random number has k
trailing zeros or more, about one of 2**k. A text uses the level at which about ``samples`` steps cover its
walk, so fingerprints of long texts are no longer than those of short ones, and two fingerprints of
neighbouring levels are compared at the steps of the higher one, which the lower one has too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import per_text, text_slices
from stagelens.session import materialize

SEED = 8
SAMPLES = 256
PERIOD = 1 << 12  # steps after which the coins come back
CLASSES = 256  # characters fall into so many classes, by code point
LANES = 1024  # texts that are walked side by side at most
CELLS = 4 << 20  # characters that are walked side by side, with the gaps behind shorter texts
SLICE = 8 << 20
DOCS_PER_RANGE = 500
BANDS = 8
BAND_BITS = 16
GRAM, GRAM_BANDS, GRAM_ROWS = 8, 32, 3  # characters of a gram; bands of grams, and grams in a band
SHORT, SHORT_GRAM = 320, 4  # texts up to so many characters have bands of shorter grams too


def coin_waits(seed: int = SEED) -> np.ndarray:
    """For class and step (modulo the period): steps until the pointer moves on, itself included."""
    coins = np.random.default_rng(seed).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    coins[~coins.any(1), 0] = 1
    waits = np.empty((CLASSES, PERIOD), np.uint8)
    left = np.zeros(CLASSES, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):  # twice around, so the end knows the beginning
        left = np.where(coins[:, step % PERIOD] == 1, 1, left + 1)
        waits[:, step % PERIOD] = left
    return waits


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed random 64-bit number for each number."""
    x = np.asarray(x, np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def level_of(steps: int, samples: int = SAMPLES) -> int:
    """The level at which a walk of so many steps has about ``samples`` of them or fewer."""
    return max(0, (max(1, steps) - 1).bit_length() - samples.bit_length() + 1)


class Steps:
    """The sampled steps of every level, found as far as they are needed."""

    def __init__(self):
        self.levels: dict[int, np.ndarray] = {}
        self.reach: dict[int, int] = {}

    def at(self, level: int, end: int) -> np.ndarray:
        """Sampled steps of the level before ``end``, in order."""
        if level not in self.reach or self.reach[level] < end:
            reach = max(2 * end, 1 << 16)
            blocks = []
            for first in range(0, reach, 1 << 20):
                steps = np.arange(first, min(reach, first + (1 << 20)))
                blocks.append(steps[mixed(steps) & np.uint64((1 << level) - 1) == 0])
            self.levels[level], self.reach[level] = np.concatenate(blocks), reach
        found = self.levels[level]
        return found[: np.searchsorted(found, end)]


def walk(texts: list[np.ndarray], waits: np.ndarray, first_step: np.ndarray | None = None) -> list[np.ndarray]:
    """For every text (its code points) the step at which the pointer reaches each character, and the end.

    ``LANES`` texts of like length are walked side by side, a character at a time.
    """
    flat = waits.ravel().astype(np.int32)
    out: list[np.ndarray] = [np.zeros(1, np.int32)] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        lanes = order[at : at + max(1, min(LANES, CELLS // max(1, longest)))]
        at += len(lanes)
        lengths = np.array([len(texts[i]) for i in lanes])
        rows = np.zeros((longest, len(lanes)), np.int32)
        for k, i in enumerate(lanes):
            rows[: lengths[k], k] = (texts[i] % CLASSES).astype(np.int32) * PERIOD
        reached = np.zeros((longest + 1, len(lanes)), np.int32)
        if first_step is not None:
            reached[0] = first_step[lanes]
        # lanes are sorted by length, so those still walking are the first ones
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        for t, n in enumerate(active.tolist()):
            here = reached[t, :n]
            np.add(here, flat[rows[t, :n] + (here & (PERIOD - 1))], out=reached[t + 1, :n])
        for k, i in enumerate(lanes):
            out[i] = reached[: lengths[k] + 1, k].copy()
    return out


def sampled_bits(points: np.ndarray, reached: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """One bit for each step of what the pointer sees there."""
    where = np.searchsorted(reached, steps, "right") - 1
    seen = points[where].astype(np.uint64)
    return (mixed(seen * np.uint64(0x100000001B3) ^ steps.astype(np.uint64)) >> np.uint64(40)).astype(np.uint8) & 1


def print_of(points: np.ndarray, reached: np.ndarray, steps: Steps, samples: int = SAMPLES) -> str:
    """level:end:bits in hexadecimal; the same text always gives the same print."""
    end = int(reached[-1])
    level = level_of(end, samples)
    chosen = steps.at(level, end)
    bits = sampled_bits(points, reached, chosen) if len(chosen) else np.zeros(0, np.uint8)
    return f"{level:02x}:{end:x}:{np.packbits(bits).tobytes().hex()}"


def likeness(a: str, b: str, steps: Steps) -> float:
    """1 for equal prints, about 0 for unrelated ones: agreement of the bits beyond chance.

    Compared at the sampled steps of the higher level before the longer walk's end; a step that only
    one walk reaches counts as unlike. Two walks without a common sample are alike if they are equal.
    """
    if a == b:
        return 1.0
    (la, ea, ba), (lb, eb, bb) = (_parts(x) for x in (a, b))
    level = max(la, lb)
    ends, bits = [], []
    for own, end, data in ((la, ea, ba), (lb, eb, bb)):
        at = steps.at(own, end)
        ends.append(end)
        bits.append(data[: len(at)][mixed(at) & np.uint64((1 << level) - 1) == 0])
    common, longer = sorted((len(bits[0]), len(bits[1])))
    if not longer:
        return 0.0
    unlike = int((bits[0][:common] != bits[1][:common]).sum())
    return max(0.0, (common - 2 * unlike) / longer)


def _parts(printed: str) -> tuple[int, int, np.ndarray]:
    level, end, data = printed.split(":")
    return int(level, 16), int(end, 16), np.unpackbits(np.frombuffer(bytes.fromhex(data), np.uint8))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def prints(texts: list[str], waits: np.ndarray, steps: Steps) -> list[str]:
    points = [code_points(t) for t in texts]
    return [print_of(p, r, steps) for p, r in zip(points, walk(points, waits))]


# --- every document against the next one --------------------------------------------------------


def in_ranges(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(range, guest, key, text): documents dealt by ranges of the key, each with the first document behind it.

    The ranges end at keys of the data, as many as the square root of the rows at most. The last
    range is followed by the first document of all. Rows without key come first.
    """
    rows = docs.count()
    n = max(1, math.ceil(rows / max(DOCS_PER_RANGE, math.isqrt(rows))))
    probs = [i / n for i in range(1, n)] or [0.5]
    seen = docs.agg(F.percentile_approx(key, probs, 20 * n).alias("cuts"), F.min(key).alias("least"),
                    F.count_if(F.col(key).isNull()).alias("unnamed")).first()
    cuts = np.unique(np.array([c for c in seen["cuts"] or [] if n > 1 and c != seen["least"]], np.int64))
    nulls = seen["unnamed"] > 0
    if nulls and seen["least"] is not None:
        cuts = np.unique(np.append(cuts, seen["least"]))  # the rows without key are a range of their own
    least = seen["least"]
    schema = T.StructType([*T.StructType.fromDDL("range int, guest boolean").fields, docs.schema[key], docs.schema[text]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, unnamed = batch.column(0), np.array(pc.is_null(batch.column(0)))
            values = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False)
            place = np.where(unnamed, 0, np.searchsorted(cuts, values, "right"))
            first = ~unnamed & np.isin(values, cuts)
            opening = unnamed if nulls else values == least
            parts = [(np.arange(len(place)), place, False), (np.flatnonzero(first), place[first] - 1, True),
                     (np.flatnonzero(opening), np.full(opening.sum(), len(cuts)), True)]
            for rows, where, guest in parts:
                if len(rows):
                    some = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(where.astype(np.int32)), pa.array(np.full(len(rows), guest)), *some.columns],
                        names=schema.names,
                    )

    dealt = docs.select(key, text).mapInArrow(run, schema).repartition("range")
    return dealt.sortWithinPartitions("range", "guest", F.col(key).asc_nulls_first(), text)


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every row, of its text with the last quarter replaced, and their likeness.

    The last quarter of the characters gives way to as many of the next document's, by ascending key
    (equal keys by text, rows without key first; after the last the first). Columns: key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is empty, and
    empty texts have equal prints; an empty table gives an empty one; repeated rows each get their row.
    """
    fields = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    schema = T.StructType([docs.schema[key], *T.StructType.fromDDL(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits, steps, held = coin_waits(), Steps(), None
        for batch in batches:
            for part in text_slices(batch, 3, SLICE):
                rows = part if held is None else pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = rows.slice(rows.num_rows - 1)
                if rows.num_rows > 1:
                    yield _against_next(rows, schema.names, waits, steps)

    return in_ranges(docs, key, text).mapInArrow(run, schema)


def _against_next(rows: pa.RecordBatch, names: list[str], waits: np.ndarray, steps: Steps) -> pa.RecordBatch:
    """Results for all rows but the last one and the guests."""
    own = [i for i, guest in enumerate(rows.column(1).to_pylist()[:-1]) if not guest]
    texts = pc.fill_null(rows.column(3), "").to_pylist()
    points = [code_points(t) for t in texts]
    reached = walk(points, waits)
    made = [print_of(p, r, steps) for p, r in zip(points, reached)]
    cut = [len(points[i]) - len(points[i]) // 4 for i in own]
    tails = [points[i + 1][: len(points[i]) // 4] for i in own]
    ends = walk(tails, waits, np.array([reached[i][c] for i, c in zip(own, cut)], np.int32))
    hashes, edited = [], []
    for i, c, tail, end in zip(own, cut, tails, ends):
        hashes.append(hashlib.sha256((texts[i][:c] + texts[i + 1][: len(texts[i]) // 4]).encode()).hexdigest())
        if np.array_equal(tail, points[i][c:]):
            edited.append(made[i])
        else:
            edited.append(print_of(np.concatenate([points[i][:c], tail]), np.concatenate([reached[i][:c], end]), steps))
    return pa.RecordBatch.from_arrays(
        [
            rows.column(2).take(pa.array(own, pa.int64())),
            pa.array([len(points[i]) for i in own], pa.int64()),
            pa.array(hashes, pa.string()),
            pa.array([made[i] for i in own], pa.string()),
            pa.array(edited, pa.string()),
            pa.array([likeness(made[i], e, steps) for i, e in zip(own, edited)], pa.float64()),
            pa.array([likeness(made[i], made[i + 1], steps) for i in own], pa.float64()),
        ],
        names=names,
    )


# --- banding and verification -------------------------------------------------------------------


def band_keys(printed: str, steps: Steps, samples: int = SAMPLES, bands: int = BANDS, bits: int = BAND_BITS) -> list[str]:
    """Keys of the bands: each holds ``bits`` sampled steps at the text's level, and again at the level above.

    Only steps that every walk of the level and of the one below reaches are in bands, so texts of like
    length share steps. A text too short for any sample is its own band.
    """
    level, end, data = _parts(printed)
    at = steps.at(level, end)
    keys = []
    for upper in (level, level + 1):
        if upper == 0:
            continue
        use = (at < (samples // 4) << upper) & (mixed(at) & np.uint64((1 << upper) - 1) == 0)
        for band in range(bands):
            order = np.argsort(mixed(at[use] + np.int64(band + 1) * (1 << 40)), kind="stable")[:bits]
            keys.append(f"{upper}:{band}:{np.packbits(data[: len(at)][use][np.sort(order)]).tobytes().hex()}")
    return keys


def gram_keys(points: np.ndarray) -> list[str]:
    """Keys of bands that do not depend on the place in the text: each holds the grams with the least random numbers.

    Edits spread over the text, or text put in front, keep the walks of a long text apart, but not its grams.
    """
    keys = []
    for size in (GRAM, SHORT_GRAM) if len(points) <= SHORT else (GRAM,):
        wide = min(size, len(points))
        grams = np.zeros(len(points) - wide + 1, np.uint64)
        for j in range(wide):
            grams = grams * np.uint64(0x100000001B3) + points[j : len(points) - wide + 1 + j]
        grams = np.unique(mixed(grams))
        odd = mixed(np.arange(GRAM_BANDS * GRAM_ROWS)) | np.uint64(1)
        least = np.array([(grams * o).min() for o in odd]).reshape(GRAM_BANDS, GRAM_ROWS)
        keys += [f"g{size}:{band}:{row.tobytes().hex()}" for band, row in enumerate(least)]
    return keys


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance of two texts, or ``most`` + 1 if it is more: rows of a band around the diagonal."""
    x, y = code_points(a), code_points(b)
    if abs(len(x) - len(y)) > most:
        return most + 1
    width, far = 2 * most + 1, most + 1
    shift = np.arange(width)
    row = np.where(shift >= most, shift - most, far)  # row 0: insertions only
    padded = np.concatenate([np.full(most, 0xFFFFFFFF, np.uint32), y, np.full(2 * most + 1, 0xFFFFFFFF, np.uint32)])
    for i in range(1, len(x) + 1):
        columns = i - most + shift
        change = row + (padded[i - 1 : i - 1 + width] != x[i - 1])
        drop = np.append(row[1:], far) + 1
        new = np.minimum(np.minimum(change, drop), far)
        new[columns < 0] = far
        if 0 <= most - i < width:
            new[most - i] = i
        new = np.minimum(np.minimum.accumulate(new - shift) + shift, far)  # insertions along the row
        new[(columns < 0) | (columns > len(y))] = far
        row = new
        if row.min() >= far:
            return far
    return int(min(row[len(y) - len(x) + most], far))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, bands) of every row."""
    state: list = []

    def work(texts: pa.Array) -> dict[str, object]:
        if not state:
            state.extend([coin_waits(), Steps()])
        values = pc.fill_null(texts, "").to_pylist()
        made = prints(values, *state)
        bands = [band_keys(p, state[1]) + gram_keys(code_points(t)) for p, t in zip(made, values)]
        return {"fingerprint": made, "bands": pa.array(bands, pa.list_(pa.string()))}

    return per_text(docs.select(key, text), work, "fingerprint string, bands array<string>", SLICE)


def similar_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", most_edits: float = 0.05) -> DataFrame:
    """(a, b, edits): pairs of different texts that share a band and lie within ``most_edits`` of the longer one.

    Texts are compared once each: a and b are the smallest keys that hold them, so copies are not
    paired. Bands of sampled steps and of grams decide what is compared, the exact edit distance what is
    returned. Of pairs within 5 % the bands find 0.9 or more, see README; with more edits they find fewer.
    """
    plain = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    once = materialize(plain.groupBy("t").agg(F.min("k").alias("k")), "texts")
    banded = fingerprints(once, "k", "t").select("k", F.explode("bands").alias("band"))
    pairs = banded.join(banded.withColumnRenamed("k", "l"), "band").filter("k < l").select("k", "l").distinct()
    joined = pairs.join(once, "k").join(once.withColumnsRenamed({"k": "l", "t": "u"}), "l")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            most = [int(most_edits * max(len(x), len(y))) for x, y in zip(a, b)]
            edits = [edit_distance(x, y, m) for x, y, m in zip(a, b, most)]
            near = pa.array([e <= m for e, m in zip(edits, most)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(near), batch.column(1).filter(near), pa.array(edits, pa.int64()).filter(near)],
                names=["a", "b", "edits"],
            )

    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("a", kind), T.StructField("b", kind), T.StructField("edits", T.LongType())])
    return joined.select("k", "l", "t", "u").mapInArrow(run, schema)
