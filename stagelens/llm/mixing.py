"""Mixing sources to target weights.

Each source gets a target of words; what it cannot give within ``epochs`` passes over it goes to
the others by weight. A pass over a source is a random order of its documents in blocks, about
as many blocks as documents in a block. The mix takes the first blocks of that order, and of the
block where the target is reached the first documents of a random order. So every source meets
its target, no block is drawn twice in a pass, and a rerun draws the same.

The drawn blocks go to output shards by a splitting tree: each node splits the blocks of all
sources between the two halves of its shards by a multivariate hypergeometric draw, down to
single shards, so every shard has an exact number of blocks of every source and the numbers add
up to the quotas. The blocks of a source are dealt to the shards in their random order, and each
shard is shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.llm.common import WORD
from stagelens.session import materialize

WEIGHTS = (5.0, 2.0, 1.0)
EPOCHS = 2
SHARE = 1.5
SEED = 20
SHARD_WORDS = 2_000_000  # words in an output shard, about


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to a table of one row per source (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. A target is the smaller of
    ``epochs`` times the size and level times weight, with the level at which all targets add up
    to ``share`` of the words: what capped sources leave is shared out by weight until none is above.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn(
        "weight", F.element_at(cycle, (F.row_number().over(in_order) - 1) % len(weights) + 1)
    ).withColumn("cap", F.col("source_size") * float(epochs))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = by_cap.rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every) * float(share)
    capped = ranked.select(
        "*",
        total.alias("total"),
        (F.col("cap") / F.col("weight")).alias("full_at"),
        # the level if the sources before this one were at their cap; the first one that fits is the highest
        ((total - (F.sum("cap").over(upto) - F.col("cap")))
         / (F.sum("weight").over(every) - F.sum("weight").over(upto) + F.col("weight"))).alias("level"),
    )
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(every)
    target = F.least(F.col("cap"), F.coalesce(level, F.max("full_at").over(every)) * F.col("weight"))
    return capped.select("source", "source_size", target.alias("target"))


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> Iterator[tuple[int, int, int]]:
    """(shard, source number, blocks): how the blocks of every source are split among the shards.

    A binary tree over the shards; each node draws the blocks of its left half from its own, with
    a generator of its own.
    """

    def part(first: int, n: int, which: np.ndarray, have: np.ndarray) -> Iterator[tuple[int, int, int]]:
        if n == 1:
            yield from ((first, int(i), int(k)) for i, k in zip(which, have))
            return
        left = n // 2
        rng = np.random.default_rng([seed, first, n])
        take = rng.multivariate_hypergeometric(have, int(have.sum()) * left // n, method="marginals")
        for at, size, some in ((first, left, take), (first + left, n - left, have - take)):
            if some.any():
                yield from part(at, size, which[some > 0], some[some > 0])

    quotas = np.asarray(quotas, np.int64)
    if quotas.any():
        yield from part(0, shards, np.flatnonzero(quotas), quotas[quotas > 0])


def _random(*parts: Column | str) -> Column:
    """A random number in [0, 2**62) that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 62))


def _same(columns: dict[str, str]) -> Column:
    """Equality of columns where null equals null."""
    test = F.lit(True)
    for a, b in columns.items():
        test = test & F.col(a).eqNullSafe(F.col(b))
    return test


def _sharded(drawn: DataFrame, shard_words: int) -> DataFrame:
    """Add ``shard`` to the drawn blocks by the splitting tree over their counts.

    The tree needs one number per source and pass and gives ranges of places, fewer than blocks.
    """
    quotas = drawn.groupBy("source", "pass").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()
    quotas.sort(key=lambda r: (r["source"] is None, r["source"] or "", r["pass"]))
    blocks, total = sum(r["n"] for r in quotas), sum(r["words"] for r in quotas)
    shards = max(1, min(-(-total // shard_words), blocks // 4))
    reached, rows = [0] * len(quotas), []
    for shard, i, n in split_quotas(np.array([r["n"] for r in quotas], np.int64), shards):
        rows.append((quotas[i]["source"], quotas[i]["pass"], shard, reached[i], reached[i] + n))
        reached[i] += n
    ranges = drawn.sparkSession.createDataFrame(rows, "_s string, _p int, shard int, _lo long, _hi long")
    # a row per drawn block, so the join is one to one
    places = ranges.select("_s", "_p", "shard", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))).alias("_nth"))
    return drawn.join(places, _same({"source": "_s", "pass": "_p", "nth": "_nth"})).drop("_s", "_p", "_nth")


def plan_mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS,
             shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """From (key, source, size): the sources (source, source_size, target, blocks) and the drawn blocks.

    A drawn block has its source, block number and ``draws``, one per pass that draws it: pass,
    shard and, where the target falls inside the block, the cut: documents below ``cut`` are
    drawn, the ``cut_rows`` on it have ``rest`` of their ``cut_words`` words left to draw.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sources = source_targets(sizes, weights, share, epochs)
    sources = sources.join(
        sizes.select(F.col("source").alias("_s"), F.ceil(F.sqrt("n")).cast("long").alias("blocks")),
        _same({"source": "_s"}),
    ).drop("_s")
    sources = materialize(sources, "sources")
    rows = with_block(sized, sources)
    goal = F.least(F.col("target") - F.col("pass") * F.col("source_size"), F.col("source_size").cast("double"))
    blocks = rows.groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.max("target").alias("target"), F.max("source_size").alias("source_size")
    ).filter("words > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("pass"))
    order = Window.partitionBy("source", "pass").orderBy(_random(F.lit("block"), "source", "pass", "block"), "block")
    drawn = blocks.select(
        "source", "pass", "block", "words", F.round(F.greatest(goal, F.lit(0.0))).cast("long").alias("goal"),
        (F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")).alias("before"),
        F.row_number().over(order).cast("long").alias("nth"),
    ).filter("before < goal")
    drawn = materialize(drawn, "drawn-blocks")

    # the block of each source and pass in which the target falls
    last = drawn.filter("before + words > goal").select(
        F.col("source").alias("_s"), "pass", F.col("block").alias("_b"), (F.col("goal") - F.col("before")).alias("room")
    )
    units = rows.join(last, _same({"source": "_s", "block": "_b"})).withColumn("u", _random("key", "pass"))
    units = units.groupBy("_s", "pass", "_b", "room", "u").agg(F.sum("size").alias("n"), F.count("*").alias("m"))
    along = Window.partitionBy("_s", "pass").orderBy("u").rowsBetween(Window.unboundedPreceding, 0)
    cuts = units.withColumn("sofar", F.sum("n").over(along) - F.col("n"))
    cuts = cuts.filter("sofar <= room and sofar + n > room").select(
        "_s", F.col("pass").alias("_p"), "_b", F.col("u").alias("cut"), (F.col("room") - F.col("sofar")).alias("rest"),
        F.col("n").alias("cut_words"), F.col("m").alias("cut_rows"),
    )
    drawn = _sharded(drawn, shard_words).join(cuts, _same({"source": "_s", "pass": "_p", "block": "_b"}), "left")
    draw = F.struct("pass", "shard", "cut", "rest", "cut_words", "cut_rows")
    return sources, materialize(drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(draw)).alias("draws")),
                                "draws")


def with_block(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Add source_size, target and block to rows that have key and source."""
    joined = rows.join(sources.withColumnRenamed("source", "_s"), _same({"source": "_s"}), "left").drop("_s")
    return joined.withColumn("block", F.pmod(_random(F.lit("row"), "key"), F.col("blocks")))


def draw_rows(rows: DataFrame, sources: DataFrame, draws: DataFrame, trim: bool = True) -> DataFrame:
    """Add source_size, target and ``drawn``, the draws of each row as (pass, shard, taken), to (key, source, size ...)."""
    placed = with_block(rows, sources)
    joined = placed.join(
        draws.withColumnsRenamed({"source": "_s", "block": "_b"}), _same({"source": "_s", "block": "_b"}), "left"
    ).drop("_s", "_b")

    def taken(d: Column) -> Column:
        u, size = _random("key", d["pass"]), F.col("size")
        if trim:
            on_cut = F.least(size, F.floor(d["rest"] / d["cut_rows"]).cast("long"))
        else:
            on_cut = F.when(2 * d["rest"] >= d["cut_words"], size).otherwise(0)
        whole = d["cut"].isNull() | (u < d["cut"])
        return F.when(whole, size).when(u == d["cut"], on_cut).otherwise(0).cast("long")

    drawn = F.transform("draws", lambda d: F.struct(d["pass"], d["shard"], taken(d).alias("taken")))
    drawn = F.filter(F.coalesce(drawn, F.array()), lambda d: d["taken"] > 0)
    return joined.withColumn("drawn", drawn).drop("draws", "blocks", "block")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        share: float = SHARE, epochs: int = EPOCHS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken, and ``drawn`` (pass, shard, taken).

    A null text has size 0, a null source is a source of its own, rows with equal keys are drawn
    together, an empty table gives an empty one. A pass takes a document whole, but for those at the
    very end of a source's draw, which are taken up to the target.
    """
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words(text).alias("size"))
    sized = materialize(sized, "sizes")
    sources, draws = plan_mix(sized, weights, share, epochs, shard_words)
    rows = draw_rows(sized, sources, draws)
    total = F.aggregate("drawn", F.lit(0).cast("long"), lambda a, d: a + d["taken"])
    return rows.withColumn("taken", total).withColumnsRenamed({"key": key, "source": source})


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix draws, as often as it draws them, shard by shard in random order.

    Documents stay whole: one at the end of a draw is taken if at least half of it is due.
    """
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("_row"), F.col(key).alias("key"), F.col(source).alias("source"),
                       words(text).alias("size"))
    sources, draws = plan_mix(materialize(rows.drop("_row"), "sizes"), **options)
    out = draw_rows(rows, sources, draws, trim=False).select("_row", "key", F.explode("drawn").alias("d"))
    shard, place = F.col("d.shard"), _random(F.lit("place"), "d.shard", "key", "d.pass")
    return out.repartition(shard).sortWithinPartitions(shard, place).select("_row.*")
