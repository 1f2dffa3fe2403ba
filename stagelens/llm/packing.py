"""Best-fit packing of token sequences by bin completion.

Pieces of at most ``capacity`` tokens are packed into as few sequences as possible. All that
matters for that is how many pieces there are of each length, a table with at most ``capacity``
rows however large the corpus is. Bin completion runs on this table: it takes the largest length
that is left, enumerates the undominated fillings of the room beside it, and repeats the chosen
filling as long as the counts allow, so one step settles any number of equal sequences. Branch
and bound goes back to other fillings while the waste so far leaves a chance to beat the best
packing known; that incumbent starts as best-fit decreasing and a packing that meets the lower
bound ends the search. The plan (patterns of lengths with their number) is then dealt out to the
pieces by their rank within their length, which is an ordinary distributed job.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.llm.common import IS_SPACE, give_back, settle, text_slices, utf8
from stagelens.session import materialize

CAPACITY = 2048
END_ID = 0
# Effort of the search for a better packing than the incumbent; the result is complete at any effort.
SEARCH_NODES = 20_000
AHEAD = 16  # fillings looked up before the best of them is tried; the others follow
EFFORT = 50  # choices of the enumeration for each node
RANK_ROWS = 200_000  # rows that are ranked together in one group, about
SLICE = 2 << 20
CACHED_PARTS = 400_000  # in a worker, for one task
LINE_PARTS = 500
LINES = 16  # encoded at once


# --- the plan: from counts per length to patterns ------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """A filling: (length, how many of it) with the longest first, used for ``copies`` sequences."""

    items: tuple[tuple[int, int], ...]
    copies: int


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs: by tokens, and by pieces that cannot share one (Martello and Toth)."""
    lengths = np.arange(len(counts))
    best = -(-int((lengths * counts).sum()) // capacity)
    above = np.cumsum(counts[::-1])[::-1]  # pieces of at least each length
    for k in np.flatnonzero(counts[: capacity // 2 + 1]):
        big = int(counts[lengths > capacity - k].sum())
        middle = slice(capacity // 2 + 1, capacity - k + 1)
        n_middle = int(counts[middle].sum())
        room = n_middle * capacity - int((lengths[middle] * counts[middle]).sum())
        small = int((lengths * counts)[k : capacity // 2 + 1].sum())
        best = max(best, big + n_middle + max(0, -(-(small - room) // capacity)))
    return max(best, int(above[capacity // 2 + 1]) if len(counts) > capacity // 2 + 1 else 0)


Items = tuple[tuple[int, int], ...]


def fillings(counts: np.ndarray, room: int, waste: int, steps: list[int]) -> Iterator[tuple[int, Items]]:
    """All undominated fillings of ``room`` from the pieces left that waste at most ``waste``, as (waste, items), one by one.

    How many pieces of a length go in is chosen at once, the most of the longest first. A filling is
    dominated if a longer piece fits in place of one of its pieces or if one more piece fits beside them:
    the other one leaves easier pieces for the sequences to come. ``steps[0]`` counts the choices made.
    """
    left = np.flatnonzero(counts[: room + 1]).tolist()[::-1]
    many = [int(counts[length]) for length in left]
    shorter = [-length for length in left]  # ascending, to search in
    total = np.cumsum([length * n for length, n in zip(left[::-1], many[::-1])])[::-1].tolist() if left else []
    chosen: list[tuple[int, int]] = []

    def dominated(rest: int) -> bool:
        used = dict(chosen)
        for length in (0, *used):
            first = bisect.bisect_left(shorter, -(length + rest))
            if any(many[i] > used.get(left[i], 0) for i in range(first, bisect.bisect_left(shorter, -length))):
                return True
        return False

    def extend(first: int, room: int) -> Iterator[tuple[int, Items]]:
        steps[0] += 1
        i = max(first, bisect.bisect_left(shorter, -room))
        while i < len(left):
            if room - total[i] > waste:  # all that is left does not fill it
                return
            length = left[i]
            for n in range(min(many[i], room // length), 0, -1):
                chosen.append((length, n))
                yield from extend(i + 1, room - n * length)
                chosen.pop()
            i += 1
            steps[0] += 1
        if room <= waste and not dominated(room):
            yield room, tuple(chosen)

    return extend(0, room)


def _apply(counts: np.ndarray, items: tuple[tuple[int, int], ...], sign: int) -> None:
    for length, many in items:
        counts[length] += sign * many


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """The first incumbent: longest pieces first, each sequence filled with the longest that fits."""
    counts, out = counts.copy(), []
    for length in range(capacity, 0, -1):
        while counts[length]:
            items, room, top = [], capacity, length
            while top:
                many = min(int(counts[top]), room // top)
                if many:
                    items.append((top, many))
                    room -= many * top
                top = min(top - 1, room)
                while top and not counts[top]:
                    top -= 1
            copies = min(int(counts[a]) // m for a, m in items)
            out.append(Pattern(tuple(items), copies))
            _apply(counts, tuple((a, m * copies) for a, m in items), -1)
    return out


def bin_completion(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = SEARCH_NODES, effort: int = EFFORT) -> list[Pattern]:
    """Patterns that use every piece of ``counts`` (pieces per length, index 0 unused) exactly once.

    At every node the longest piece left is put with the fillings beside it, ``AHEAD`` of which are looked up
    and tried by their waste before the next ones are. A filling is used as often as the pieces and the
    waste allow, then half as often, and so on down to once; as it may be chosen again below, every number
    is reached. So all there is can be tried; only the budget of ``nodes``, and of ``effort`` choices
    for each of them, ends the search before the lower bound or the last possibility does.
    """
    counts = np.asarray(counts, np.int64).copy()
    total = int((np.arange(len(counts)) * counts).sum())
    best = best_fit_decreasing(counts, capacity)
    n_best, bound = sum(p.copies for p in best), lower_bound(counts, capacity)
    steps, visited, waste = [0], 0, 0
    # of every node above: pattern, waste before it, what is left to try
    stack: list[tuple[Pattern, int, Iterator[tuple[Items, int]]]] = []

    def slack() -> int:
        """What a packing with one sequence less may still waste."""
        return (n_best - 1) * capacity - total - waste

    def options() -> Iterator[tuple[Items, int]]:
        """(filling, copies) of the node."""
        longest = int(np.flatnonzero(counts)[-1])
        left = counts.copy()
        left[longest] -= 1
        source = fillings(left, capacity - longest, min(slack(), capacity), steps)
        while True:
            ahead: list[tuple[int, Items]] = []
            until = steps[0] + effort
            for lost, items in source:
                use = dict(items)
                use[longest] = use.get(longest, 0) + 1
                ahead.append((lost, tuple(sorted(use.items(), reverse=True))))
                if not lost or len(ahead) == AHEAD or steps[0] > until:
                    break
            if not ahead:
                return
            for lost, items in sorted(ahead, key=lambda x: x[0]):
                copies = min(int(left[a] + (a == longest)) // m for a, m in items)
                if lost:
                    copies = min(copies, slack() // lost)
                while copies > 0:
                    yield items, copies
                    copies //= 2

    here = options() if counts.any() else iter(())
    while n_best > bound and visited < nodes and steps[0] < nodes * effort:
        visited += 1
        choice = next(here, None) if slack() >= 0 else None
        if choice is None:
            if not stack:
                break
            pattern, waste, here = stack.pop()
            _apply(counts, tuple((a, m * pattern.copies) for a, m in pattern.items), 1)
            continue
        items, copies = choice
        stack.append((Pattern(items, copies), waste, here))
        _apply(counts, tuple((a, m * copies) for a, m in items), -1)
        waste += (capacity - sum(a * m for a, m in items)) * copies
        if counts.any():
            here = options()
            continue
        n = sum(p.copies for p, _, _ in stack)
        if n < n_best:
            best, n_best = [p for p, _, _ in stack], n
        here = iter(())
    return best


# --- the pieces ---------------------------------------------------------------------------------

PIECES = "piece int, start long, length long, ids_crc32 long"


# Kinds of bytes: white space, letters, digits, other signs, and what is left to the tokenizer to split.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[ord("'")] = _OTHER  # it may begin a contraction
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(128) if chr(c).isdigit()]] = _DIGIT
_KIND[IS_SPACE] = _SPACE
_LATIN = np.zeros(256, bool)  # second bytes of the letters that begin with 0xC3
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
# A part without bytes of the last kind.
_PLAIN = re.compile(rb"(?:[!-&(-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
_BLANKS = frozenset(np.flatnonzero(IS_SPACE).tolist())


class Words:
    """Token ids of many texts at once, from the ids of their distinct parts.

    The tokenizer drops white space, lower-cases, and joins nothing across runs of letters, single
    digits and runs of other signs. So a text's ids are those of such parts in a row, and a
    worker keeps the ids of the parts it has seen. A word with anything else in it (apostrophes,
    special tokens, characters beyond the Latin letters) is one part as a whole. The last id of
    a part closes a word, which tells the parts of a line that is encoded at once apart.
    """

    def __init__(self, tokenizer: str, most: int = CACHED_PARTS):
        from tokenizers import Tokenizer

        self.most = most
        self.tokenizer = Tokenizer.from_file(tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes] = {}

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4") for e in made]

    def _learn(self, parts: list[bytes]) -> None:
        plain = [p for p in parts if _PLAIN(p) and b"<|" not in p]
        mixed = list(set(parts).difference(plain))
        lines = [plain[i : i + LINE_PARTS] for i in range(0, len(plain), LINE_PARTS)]
        encoded = (
            ids for i in range(0, len(lines), LINES) for ids in self._encode([b" ".join(line) for line in lines[i : i + LINES]])
        )
        for line, ids in zip(lines, encoded):
            ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(ends) != len(line):
                mixed += line
                continue
            data, starts = ids.tobytes(), [0, *ends[:-1]]
            self.parts.update((p, data[4 * a : 4 * b]) for p, a, b in zip(line, starts, ends))
        self.parts.update((p, ids.tobytes()) for p, ids in zip(mixed, self._encode(mixed)))

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in a row (their bytes and offsets), and where each text's ids begin."""
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        kinds = _kinds(data)
        edge = np.ones(len(data), bool)
        edge[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        begins = offsets[:-1][offsets[:-1] < len(data)]
        edge[begins] = True
        lowered = _LOWER[data]
        strange = np.flatnonzero(kinds == _OTHER)
        if len(strange):
            space = kinds == _SPACE
            opens = ~space
            opens[1:] &= space[:-1]
            opens[begins] = ~space[begins]
            number = np.cumsum(opens, dtype=np.int32)
            whole = np.zeros(int(number[-1]) + 1, bool)
            whole[number[strange]] = True
            whole = whole[number] & ~space
            edge[whole & ~opens] = False
            lowered[whole] = data[whole]
        starts = np.append(np.flatnonzero(edge), len(data))
        parts = pa.Array.from_buffers(
            pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(lowered)]
        ).dictionary_encode()
        distinct, which = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        if len(self.parts) + len(distinct) > self.most:
            self.parts.clear()
        known = self.parts
        known.update((p, b"") for p in distinct if p[0] in _BLANKS)
        self._learn([p for p in distinct if p not in known])
        found = [known[p] for p in distinct]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        first = np.cumsum(size) - size
        sizes = size[which]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(first[which] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts[:-1], offsets)]


def _kinds(data: np.ndarray) -> np.ndarray:
    kinds = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        kinds[lead] = kinds[lead + 1] = np.where(_LATIN[data[lead + 1]], _LETTER, _OTHER)
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kinds[special] = _OTHER
    return kinds


@cache
def _words(tokenizer: str) -> Words:
    """A worker reads a vocabulary once; the parts it has seen go at the end of each task."""
    return Words(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is the ids of its whole text and the end id; only one longer than ``capacity`` is
    cut. A null or empty text is the end id alone.
    """
    fields = T.StructType.fromDDL(PIECES + ", ids array<int>" * keep_ids).fields
    schema = T.StructType([docs.schema[key], *fields])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each keep memory
        words = _words(tokenizer)
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                rows, number, start, length, crc, ids = [], [], [], [], [], []
                flat, begins = words.ids(*utf8(part.column(1)))
                for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
                    data = flat[a:b].tobytes() + end
                    n = len(data) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        cut = data[4 * at : 4 * (at + capacity)]
                        rows.append(i)
                        number.append(k)
                        start.append(at)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if keep_ids:
                            ids.append(np.frombuffer(cut, "<i4"))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()),
                           pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        words.parts.clear()
        give_back()

    return docs.select(key, text).mapInArrow(run, schema)


def plan_table(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, offset), sorted by length and rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern in patterns:
        offset = 0
        for length, many in pattern.items:
            rows.append((length, used.get(length, 0), many, sequence, offset))
            used[length] = used.get(length, 0) + many * pattern.copies
            offset += length * many
        sequence += pattern.copies
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def deal_out(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """Replace ``_rank`` (from 0, within the length) by sequence_id and offset."""
    kept = [f for f in ranked.schema.fields if f.name != "_rank"]
    schema = T.StructType([*kept, *T.StructType.fromDDL("sequence_id long, offset long").fields])
    lengths, firsts = plan[:, 0], plan[:, 1]
    begins = np.searchsorted(lengths, np.arange(lengths.max() + 2 if len(lengths) else 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            order = np.lexsort((rank, length))
            row = np.empty(len(length), np.int64)
            for value in np.unique(length):
                lo, hi = begins[value], begins[value + 1]
                mine = order[np.searchsorted(length[order], value) : np.searchsorted(length[order], value, "right")]
                row[mine] = lo + np.searchsorted(firsts[lo:hi], rank[mine], "right") - 1
            _, first, many, sequence, offset = plan[row].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [batch.column(f.name) for f in kept]
                + [pa.array(sequence + nth // many), pa.array(offset + nth % many * length)],
                names=schema.names,
            )

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         keep_ids: bool = False) -> DataFrame:
    """One row per piece of every row of ``docs``: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one token long. Rows with equal keys are documents of their own and
    packed each. An empty table gives an empty one. The plan is made on the driver from at most
    ``capacity`` counts; the ranks that it is dealt out by are counted in groups of bounded size,
    so a length that a third of the pieces share is no single task.
    """
    made = materialize(pieces(docs, tokenizer, key, text, capacity, keep_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in made.groupBy("length").count().collect():  # a row per length, ``capacity`` at most
        counts[row["length"]] = row["count"]
    plan = plan_table(bin_completion(counts, capacity))
    groups = max(1, int(counts.sum()) // RANK_ROWS + 1)
    cells = made.withColumn("_group", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    before = cells.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    running = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("length", "_group", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_group").orderBy(key, "piece", "ids_crc32")
    ranked = cells.withColumn("_nth", F.row_number().over(inside) - 1).join(before, ["length", "_group"])
    ranked = ranked.select(*made.columns, (F.col("_before") + F.col("_nth")).cast("long").alias("_rank"))
    return deal_out(ranked, plan)
