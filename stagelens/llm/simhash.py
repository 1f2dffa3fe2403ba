"""Near-duplicates by SimHash and a covering code.

A fingerprint has 64 bits; two documents are linked if their fingerprints differ in at most
``threshold`` bits. The bits are cut into ``threshold // 2 + 1`` blocks, so two linked
fingerprints differ in at most one bit of some block. The anchors of a block are the words of a
covering code: a perfect Hamming code on as many bits as fit, all words on the rest, which
covers the block with radius 1. A fingerprint has its home at the anchor within the radius and
is copied to every anchor within the radius plus the one bit that may differ. If x and y differ
in one bit of a block at most, y is a copy at the home of x; so the join of homes with copies by
anchor finds every link, and the exact distance is compared there and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import per_text
from stagelens.llm.components import components
from stagelens.session import materialize

SHINGLE = 4
SEED = 42
THRESHOLD = 4
BITS = 64


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """SimHash of the word shingles, A-Z lower-cased; zero for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist())], ">u8"
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(texts: pa.Array) -> dict[str, np.ndarray]:
    values = pc.fill_null(texts, "").cast(pa.large_binary()).to_pylist()
    return {"fp": np.array([fingerprint(v) for v in values], np.uint64).view(np.int64)}


def simhash(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): the fingerprint of every row as a signed 64-bit number; a null text is empty."""
    return per_text(docs.select(key, text), _fingerprints, "fp long")


def block_widths(threshold: int = THRESHOLD) -> list[int]:
    """Widths of the blocks, the first ones shorter."""
    n = threshold // 2 + 1
    return [BITS * (i + 1) // n - BITS * i // n for i in range(n)]


class Covering:
    """Anchors of one block: a Hamming code on its first 2**order - 1 bits times all words of the rest."""

    def __init__(self, shift: int, width: int):
        self.shift, self.width = np.uint64(shift), width
        self.order = (width + 1).bit_length() - 1
        self.coded = 2**self.order - 1
        place = range(1, self.coded + 1)  # bit place-1 of the block has this syndrome
        self.checks = [np.uint64(sum(1 << (p - 1) for p in place if p >> k & 1)) for k in range(self.order)]
        # flips that lead from a word with this syndrome to the code words two bits away
        self.pairs = [
            [np.uint64(1 << (p - 1) | 1 << ((p ^ s) - 1)) for p in place if p < p ^ s <= self.coded]
            for s in range(self.coded + 1)
        ]
        self.rest = [np.uint64(1 << b) for b in range(self.coded, width)]

    def block(self, fps: np.ndarray) -> np.ndarray:
        return (fps >> self.shift) & np.uint64((1 << self.width) - 1)

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        return sum(
            ((np.bitwise_count(block & check).astype(np.int64) & 1) << k for k, check in enumerate(self.checks)),
            np.zeros(len(block), np.int64),
        )

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The one anchor within the covering radius."""
        block = self.block(fps)
        s = self.syndrome(block)
        flip = np.where(s > 0, np.left_shift(np.uint64(1), np.maximum(s - 1, 0).astype(np.uint64)), np.uint64(0))
        return block ^ flip

    def near(self, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, anchors): all anchors within the radius plus one bit of each fingerprint's block."""
        every = np.arange(len(fps))
        home, block = self.home(fps), self.block(fps)
        yield every, home
        for bit in self.rest:
            yield every, home ^ bit
        s = self.syndrome(block)
        for value in range(1, self.coded + 1):
            rows = np.flatnonzero(s == value)
            for flip in self.pairs[value]:
                yield rows, block[rows] ^ flip
        rows = np.flatnonzero(s == 0)
        for i, one in enumerate(self.rest):
            for two in self.rest[:i]:
                yield rows, block[rows] ^ (one | two)


def coverings(threshold: int = THRESHOLD) -> list[Covering]:
    out, shift = [], 0
    for width in block_widths(threshold):
        out.append(Covering(shift, width))
        shift += width
    return out


def _to_anchors(fps: DataFrame, threshold: int, copies: bool) -> DataFrame:
    schema = T.StructType.fromDDL("block int, anchor int, fp long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coverings(threshold)
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            words = fp.view(np.uint64)
            for number, code in enumerate(codes):
                for rows, anchors in code.near(words) if copies else [(np.arange(len(fp)), code.home(words))]:
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(rows), number, np.int32)), pa.array(anchors.astype(np.int32)),
                             pa.array(fp[rows])], names=schema.names,
                        )

    return fps.mapInArrow(run, schema)


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """All pairs (a, b), a < b, of different fingerprints (column fp) within ``threshold`` bits.

    A sort-merge join by anchor that keeps linked pairs only; large anchors are split by
    adaptive execution. Up to a block of 32 bits, so from a threshold of 2 on.
    """
    homes = _to_anchors(fps, threshold, False).withColumnRenamed("fp", "a")
    copies = _to_anchors(fps, threshold, True).withColumnRenamed("fp", "b")
    test = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return homes.join(copies.hint("merge"), ["block", "anchor"]).filter(test).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD
) -> DataFrame:
    """One row per document: key, fp, component_id (the smallest key reachable over links).

    Equal fingerprints are one node, so copies are never paired. Documents without words have
    the fingerprint zero and are linked like any other. A row without key takes part but never
    names a component unless all rows of it have none (then component_id is null). Repeated
    rows each get their row; an empty table gives an empty one.
    """
    marked = materialize(simhash(docs, key, text), "fingerprints")
    nodes = materialize(marked.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    roots = components(links(nodes.select("fp"), threshold)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    joined = rooted.join(named, "root").select("fp", "component")
    reached = nodes.join(joined, "fp", "left").select(
        "fp", F.coalesce("component", "least").alias("component_id")
    )
    # written out, so that the last join stands alone and a fingerprint of very many copies is split
    reached = materialize(reached, "reached")
    return marked.join(reached, "fp").select(key, "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The document with the smallest key of every group, with all its columns; repeated rows go too.

    The key is a number. Rows without one come after all others, in the order of a hash of
    their text. Rows that share a key but not the text are documents of their own.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    number = F.coalesce(F.col(key).cast("long"), F.pmod(digest, F.lit(1 << 61)) + (1 << 62))
    named = docs.select(number.alias("_id"), digest.alias("_digest"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    groups = near_duplicates(named, "_id", "_text")
    kept = groups.filter("_id = component_id").select("_id").distinct()
    one = named.select("_id", "_digest", "_row").join(kept, "_id", "left_semi")
    return one.dropDuplicates(["_id", "_digest"]).select("_row.*")
