"""Collocations by stripes: each prefix keys a counter of the words that follow it.

A stripe of a prefix of no word counts the words of a language, one of a word its pairs, one of a pair
its triples. Tasks count the stripes of a few megabytes of text at once, in numpy over word numbers, and
send each as one row: the prefix, its next words, their counts. Stripes of a prefix meet in one place
and are merged elementwise. A merged stripe has all that is asked of it: its entries are the prefix's
extensions with their frequencies, their sum the number of times the prefix was extended, and the
largest of them decides whether a longer phrase takes the prefix's place.

What cannot be part of a candidate is not counted at the next length: a phrase that occurs often enough
has parts that do. Which these are is sent to the tasks as a bit map of fixed size over hashes. A bit
may be set for another phrase too; then some rare phrase is counted in vain and dropped after the
merge, so the map's size decides about the work, never about the result.

The stripe of a frequent prefix has as many entries as the corpus has words. It is cut into parts by
the hash of the next word, in all tasks alike; how many parts follows from the prefix's count, which is
known from the length before. Only prefixes above a share of all words are cut, a bounded number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.llm.common import give_back, settle, text_slices, utf8
from stagelens.operators.skew import partitions
from stagelens.session import materialize

# Fixed values of the report: least occurrences, percent of them inside one longer phrase that drop a
# candidate, scale of the score, rows per language.
LEAST, INSIDE, SCALE, TOP = 10, 50, 1_000_000, 2000
NO_LANG = "und"
LONGEST = 3
BITS = 24  # the bit map has two to this power of them
SLICE = 8 << 20  # bytes of text that a task counts at once
MERGED = 1 << 20  # entries that are merged at once, about

_WORD, _BLANK, _BREAK = range(3)
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

STRIPE = "lang string, prefix binary, part int, words binary, counts binary"
PHRASE = "lang string, prefix binary, word binary, f long"


# --- words of a slice ---------------------------------------------------------------------------


def hashes(lang: str, phrases: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases), np.uint64, len(phrases))


def paired(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words in a row from theirs."""
    with np.errstate(over="ignore"):
        mixed = (first ^ (first >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + second
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed ^ (mixed >> np.uint64(32))


def has_bit(bits: np.ndarray, of: np.ndarray) -> np.ndarray:
    at = of & np.uint64((1 << BITS) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts in a row, lower-cased; the text of each; the number of its piece."""
    kind = _KIND[data]
    inner = kind == _WORD
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    starts = inner.copy()
    starts[1:] &= ~inner[:-1] | begins[1:-1]
    breaks = np.cumsum((kind == _BREAK) | begins[:-1])
    at = np.flatnonzero(starts)
    kept = np.cumsum(inner)
    ends = np.append(kept[at] - 1, kept[-1] if len(kept) else 0)
    packed = _LOWER[data[inner]]
    words = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(packed)])
    text = np.searchsorted(offsets, at, "right") - 1
    return words, text, breaks[at]


class Slice:
    """Numbers of the words of some texts, and of their languages."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        words, text, self.piece = words_of(*utf8(texts))
        coded = words.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.word = coded.indices.to_numpy().astype(np.int64)
        self.langs = sorted(set(langs))
        number = {name: i for i, name in enumerate(self.langs)}
        self.lang = np.array([number[name] for name in langs], np.int64)[text] if len(text) else np.zeros(0, np.int64)
        self.size = max(1, len(self.words))

    def typed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different (language, word), the number of each word in them, their counts."""
        return np.unique(self.lang * self.size + self.word, return_inverse=True, return_counts=True)

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty(len(codes), np.uint64)
        for i, name in enumerate(self.langs):
            a, b = np.searchsorted(codes, [i * self.size, (i + 1) * self.size])
            out[a:b] = hashes(name, [self.words[c] for c in (codes[a:b] - i * self.size).tolist()])
        return out


def _stripes(langs: list[str], prefixes: list[bytes], word: np.ndarray, count: np.ndarray, row: np.ndarray,
             part: np.ndarray, words: list[bytes]) -> pa.RecordBatch:
    """Rows of stripes from entries (prefix ``row``, part, word number, count)."""
    order = np.lexsort((part, row))
    row, part, word, count = row[order], part[order], word[order], count[order].astype("<i8")
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (part[1:] != part[:-1])
    cuts = np.append(np.flatnonzero(new), len(row)).tolist()
    names = [words[w] for w in word.tolist()]
    heads = row[cuts[:-1]].tolist()
    return pa.RecordBatch.from_arrays([
        pa.array([langs[r] for r in heads], pa.string()), pa.array([prefixes[r] for r in heads], pa.binary()),
        pa.array(part[cuts[:-1]], pa.int32()),
        pa.array([b"\n".join(names[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
        pa.array([count[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
    ], names=["lang", "prefix", "part", "words", "counts"])


def _part(words: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Part of each entry, by the hash of its word."""
    return np.where(parts > 1, (words >> np.uint64(20)) % parts.astype(np.uint64), 0).astype(np.int32)


def _count(piece: Slice, length: int, bits: np.ndarray | None, cut: dict[tuple[str, bytes], int],
           parts: int) -> pa.RecordBatch | None:
    """Stripes of the prefixes of ``length - 1`` words."""
    codes, which, counts = piece.typed()
    if not len(codes):
        return None
    hashed = piece.hashed(codes)
    lang, word = codes // piece.size, codes % piece.size
    if length == 1:
        part = _part(hashed, np.full(len(codes), parts))
        return _stripes(piece.langs, [b""] * len(piece.langs), word, counts, lang, part, piece.words)
    same = piece.piece[1:] == piece.piece[:-1]
    if length == 2:
        often = has_bit(bits, hashed)
        left = np.flatnonzero(same & often[which[:-1]] & often[which[1:]])
        # both words are of one text, so of one language
        pairs, counts = np.unique(which[left] * len(codes) + which[left + 1], return_counts=True)
        first, second = pairs // len(codes), pairs % len(codes)
        names = [piece.words[w] for w in word.tolist()]
        heads = [piece.langs[i] for i in lang.tolist()]
        rows = first
    else:
        left = np.flatnonzero(same)
        pairs, at = np.unique(which[left] * len(codes) + which[left + 1], return_inverse=True)
        often = has_bit(bits, paired(hashed[pairs // len(codes)], hashed[pairs % len(codes)]))
        pair = np.full(len(which), -1, np.int64)
        pair[left] = np.where(often[at], at, -1)
        left = np.flatnonzero((pair[:-1] >= 0) & (pair[1:] >= 0))
        triples, counts = np.unique(pair[left] * len(codes) + which[left + 2], return_counts=True)
        rows, second = triples // len(codes), triples % len(codes)
        used, rows = np.unique(rows, return_inverse=True)
        a, b = pairs[used] // len(codes), pairs[used] % len(codes)
        names = [piece.words[x] + b" " + piece.words[y] for x, y in zip(word[a].tolist(), word[b].tolist())]
        heads = [piece.langs[i] for i in lang[a].tolist()]
    if not len(counts):
        return None
    cuts = np.array([cut.get(key, 1) for key in zip(heads, names)] if cut else np.ones(len(names)), np.int64)
    part = _part(hashed[second], cuts[rows])
    return _stripes(heads, names, word[second], counts, rows, part, piece.words)


# --- merging ------------------------------------------------------------------------------------


def _merge(rows: list[pa.RecordBatch], least: int, totals: bool) -> pa.RecordBatch:
    """Add the stripes of equal prefixes, which follow each other; entries of ``least`` at least."""
    table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    lang, prefix, _, words, counts = table.columns
    n = table.num_rows
    keys = pc.binary_join_element_wise(lang.cast(pa.binary()), prefix, b"\n").dictionary_encode()
    key = keys.indices.to_numpy().astype(np.int64)
    data, offsets = counts.buffers()[2], np.frombuffer(counts.buffers()[1], np.int32)[counts.offset : counts.offset + n + 1]
    count = np.frombuffer(data, "<i8", (offsets[-1] - offsets[0]) // 8, offsets[0])
    names = pc.split_pattern(words, b"\n").flatten().dictionary_encode()
    code = np.repeat(key, np.diff(offsets) // 8) * (len(names.dictionary) + 1) + names.indices.to_numpy()
    codes, at = np.unique(code, return_inverse=True)
    total = np.zeros(len(codes), np.int64)
    np.add.at(total, at, count)
    first = np.zeros(len(keys.dictionary), np.int64)
    first[key[::-1]] = np.arange(n)[::-1]
    head, name = codes // (len(names.dictionary) + 1), codes % (len(names.dictionary) + 1)
    often = total >= least
    take = first[head[often]]
    out = [lang.take(pa.array(take)), prefix.take(pa.array(take)), names.dictionary.take(pa.array(name[often])), pa.array(total[often])]
    if totals:  # of each prefix: all its entries, rare ones too
        whole = np.zeros(len(first), np.int64)
        np.add.at(whole, head, total)
        heads = pa.array(first)
        out = [pa.concat_arrays([x, y]) for x, y in zip(out, [
            lang.take(heads), prefix.take(heads), pa.nulls(len(first), names.dictionary.type), pa.array(whole)])]
    return pa.RecordBatch.from_arrays(out, names=["lang", "prefix", "word", "f"])


def merged(stripes: DataFrame, least: int, totals: bool = False) -> DataFrame:
    """(lang, prefix, word, f) with ``least`` occurrences at least.

    With ``totals`` there is also a row without a word for each part, with the sum of all its entries.
    """
    dealt = stripes.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            batch = batch.cast(pa.schema([("lang", pa.string()), ("prefix", pa.binary()), ("part", pa.int32()),
                                          ("words", pa.binary()), ("counts", pa.binary())]))
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            sizes = pc.binary_length(batch.column(4)).to_pylist()
            start = 0
            for i, key in enumerate(keys):
                if key != last and size >= MERGED:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield _merge(held, least, totals)
                    held, size, start = [], 0, i
                size += sizes[i] // 8
                last = key
            if start < len(keys):
                held.append(batch.slice(start))
            if size >= MERGED:  # a long stripe: what came of it so far becomes one row
                held = _joined(held)
                size = sum(len(c) // 8 for b in held for c in b.column(4).to_pylist()[:-1])
        if held:
            yield _merge(held, least, totals)
        give_back()

    return dealt.mapInArrow(run, PHRASE)


def _joined(rows: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The same stripes with rows of equal prefix and part added up."""
    table = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
    out: list[tuple] = []
    for lang, prefix, part, words, counts in zip(*(c.to_pylist() for c in table.columns)):
        entries = zip(words.split(b"\n"), np.frombuffer(counts, "<i8").tolist())
        if out and out[-1][:3] == (lang, prefix, part):
            into = out[-1][3]
            for word, n in entries:
                into[word] = into.get(word, 0) + n
        else:
            out.append((lang, prefix, part, dict(entries)))
    columns = [[o[i] for o in out] for i in range(3)]
    words = [b"\n".join(o[3]) for o in out]
    counts = [np.fromiter(o[3].values(), "<i8", len(o[3])).tobytes() for o in out]
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*columns, words, counts], table.schema.types)],
                                       schema=table.schema)]


# --- lengths ------------------------------------------------------------------------------------


def _stripes_of(docs: DataFrame, length: int, bits: np.ndarray | None, cut: dict, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()

        def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
            table = pa.Table.from_batches(held).combine_chunks()
            texts = table.column("text").cast(pa.large_string()).combine_chunks()
            return _count(Slice(texts, table.column("lang").to_pylist()), length, bits, cut, parts)

        held, size = [], 0
        for batch in batches:
            for part in text_slices(batch, 1, SLICE):
                held.append(part)
                size += int(pc.sum(pc.fill_null(pc.binary_length(part.column(1)), 0)).as_py() or 0)
                if size >= SLICE:
                    made = counted(held)
                    held, size = [], 0
                    if made:
                        yield made
        if held and (made := counted(held)):
            yield made
        give_back()

    return docs.mapInArrow(run, STRIPE)


def _bit_map(phrases: DataFrame) -> np.ndarray:
    """The bits of the phrases' hashes; the driver gets a row for every 64 of them at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, prefix, word = (batch.column(i).to_pylist() for i in range(3))
            at = np.empty(len(lang), np.uint64)
            for name in set(lang):
                mine = [i for i, x in enumerate(lang) if x == name]
                of = hashes(name, [word[i] for i in mine])
                if prefix[mine[0]]:
                    of = paired(hashes(name, [prefix[i] for i in mine]), of)
                at[mine] = of
            at &= np.uint64((1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array((at >> np.uint64(6)).astype(np.int32)),
                 pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["slot", "bits"])

    slots = phrases.select("lang", "prefix", "word").mapInArrow(run, "slot int, bits long")
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), "<i8")
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def _hot(phrases: DataFrame, phrase: Column, words: int, parts: int) -> dict[tuple[str, bytes], int]:
    """Prefixes above half a partition's share of all words, with the number of their parts; at most two a partition."""
    share = max(1, words // (2 * parts))
    rows = phrases.filter(F.col("f") > share).select("lang", phrase.alias("phrase"), "f").collect()
    return {(r["lang"], bytes(r["phrase"])): r["f"] // share + 1 for r in rows}


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, ...]:
    """(words, pairs, triples, sizes): phrases with ``least`` occurrences as (lang, prefix, word, f), and (lang, n)."""
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).alias("text"))
    parts = partitions(docs)
    first = materialize(merged(_stripes_of(docs, 1, None, {}, parts), least, totals=True), "words")
    sizes = first.filter("word IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    words = first.filter("word IS NOT NULL")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    pairs = _stripes_of(docs, 2, _bit_map(words), _hot(words, F.col("word"), total, parts), parts)
    pairs = materialize(merged(pairs, least), "pairs")
    phrase = F.concat("prefix", F.lit(b" "), "word")
    triples = _stripes_of(docs, 3, _bit_map(pairs), _hot(pairs, phrase, total, parts), parts)
    return words, pairs, materialize(merged(triples, least), "triples"), sizes


def _floor_score(a: str, left: str, right: str) -> Column:
    """floor(SCALE * a * a / (left * right)), exact: products fit into 38 digits up to 10^16 occurrences."""
    wide = [F.col(c).cast("decimal(19,0)") for c in (a, left, right)]
    above = (wide[0] * wide[0]).cast("decimal(31,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", above, (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of two or three words per language: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null language is ``und``; repeated rows count each; an empty table
    gives an empty one. Words and pieces are read from whole texts. Columns of other names are not looked at.
    """
    words, pairs, triples, sizes = phrase_counts(docs, text, lang, least)
    space = F.lit(b" ")
    single = words.select("lang", F.col("word").alias("w"), F.col("f").alias("fw"))
    pairs = pairs.select("lang", "prefix", "word", F.concat("prefix", space, "word").alias("phrase"), F.col("f").alias("a"))
    double = pairs.select("lang", F.col("phrase").alias("w"), F.col("a").alias("fw"))
    triples = triples.select("lang", "prefix", "word", F.concat("prefix", space, "word").alias("phrase"), F.col("f").alias("a"))

    def cut(phrases: DataFrame, left: DataFrame, left_of: Column, right: DataFrame, right_of: Column, k: int) -> DataFrame:
        cells = phrases.select("lang", "phrase", "a", left_of.alias("_l"), right_of.alias("_r"))
        cells = cells.join(left.select("lang", F.col("w").alias("_l"), F.col("fw").alias("l")), ["lang", "_l"])
        cells = cells.join(right.select("lang", F.col("w").alias("_r"), F.col("fw").alias("r")), ["lang", "_r"])
        score = _floor_score("a", "l", "r").cast("long")
        return cells.select("lang", "phrase", "a", F.struct(score.alias("score"), F.lit(k).alias("k"), "l", "r").alias("cut"))

    # a stripe's largest entry is the most frequent phrase that begins with its prefix
    after = triples.groupBy("lang", F.col("prefix").alias("phrase")).agg(F.max("a").alias("m"))
    begins = F.expr("substring(prefix, octet_length(substring_index(decode(prefix, 'UTF-8'), ' ', 1)) + 2)")
    tail = F.concat(begins, space, "word")
    before = triples.groupBy("lang", tail.alias("phrase")).agg(F.max("a").alias("m"))
    longer = after.unionByName(before).groupBy("lang", "phrase").agg(F.max("m").alias("m"))
    open_pairs = pairs.join(longer, ["lang", "phrase"], "left").filter(
        F.col("m").isNull() | (100 * F.col("m") < INSIDE * F.col("a"))
    )
    start = F.expr("substring(prefix, 1, octet_length(substring_index(decode(prefix, 'UTF-8'), ' ', 1)))")
    cuts = cut(open_pairs, single, F.col("prefix"), single, F.col("word"), 1)
    cuts = cuts.unionByName(cut(triples, single, start, double, tail, 1))
    cuts = cuts.unionByName(cut(triples, double, F.col("prefix"), single, F.col("word"), 2))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    best = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", F.col("cut.l").alias("l"),
        F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"),
    )
