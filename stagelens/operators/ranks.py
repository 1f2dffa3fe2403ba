"""Exact percentile ranks and quantiles without sorting a column, or a hot group of it, in one task.

1. the values of a column are cut at approximate quantiles; every value gets its place between the cuts.
   A value that is a cut itself is hot: whatever a third of the rows share is one;
2. rows are counted per place, the hot ones apart (combined before the exchange): a table with a row per cut
   and group gives the rank where each place starts, and the ranks of all hot values;
3. the other rows are exchanged once, by their place, and ranked there by a window. A place holds about
   1/cuts of the column's rows, whatever group they belong to; their ranks go back by the key.

The ranks are exact: the approximation only decides where the cuts are. Frames are read several times: pass
written ones. Where a frame lies by its key only the ranks of rows that are not hot move.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.functions.numeric import clip
from stagelens.session import clustered, materialize


@dataclass(frozen=True)
class Rank:
    """A percentile rank to add: ``avg`` or ``max`` rank of ties over the known values."""

    value: Column
    ties: str = "avg"
    winsor: tuple[float, float] | None = None


def same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    """Null-safe equality of columns of the same name."""
    test = F.lit(True)
    for c in cols:
        test = test & a[c].eqNullSafe(b[c])
    return test


def join_null_safe(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same name where NULL equals NULL."""
    renamed = b.withColumnsRenamed({c: f"_r_{c}" for c in cols})
    test = F.lit(True)
    for c in cols:
        test = test & a[c].eqNullSafe(renamed[f"_r_{c}"])
    return a.join(renamed, test, how).drop(*[f"_r_{c}" for c in cols])


def _known(value: Column) -> Column:
    value = value.cast("double") + F.lit(0.0)  # one zero
    return F.when(~F.isnan(value), value)


def _long(df: DataFrame, keep: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """One row per (row, column number) with a known value."""
    cells = F.posexplode(F.array(*[_known(v) for v in values])).alias("m", "v")
    return df.select(*keep, cells).filter(F.col("v").isNotNull())


def _cut_count(df: DataFrame) -> int:
    """Eight cuts per shuffle partition; at least 63."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(63, 8 * parts - 1)


def _placed(df: DataFrame, keep: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """One row per (row, column number) with a known value and its place.

    ``pos`` is how many of the column's cut points the value reaches, ``hot`` whether it is the last of them.
    """
    cuts = _cut_count(df)
    probs = [i / (cuts + 1) for i in range(1, cuts + 1)]
    found = _long(df, [], values).groupBy("m").agg(F.percentile_approx("v", probs, 4 * (cuts + 1)).alias("points"))
    finite = F.filter("points", lambda x: F.abs(x) < math.inf)
    found = materialize(found.select("m", F.array_sort(F.array_distinct(finite)).alias("_points")), "cuts")
    points = [[0.0] for _ in values]
    for row in found.collect():  # one row per ranked column, `cuts` numbers each
        points[row["m"]] = row["_points"] or [0.0]
    ins, outs = [f"_v{m}" for m in range(len(values))], [f"_p{m}" for m in range(len(values))]
    wide = df.select(*keep, *[_known(v).alias(c) for v, c in zip(values, ins)])
    wide = Bucketizer(splitsArray=[[-math.inf, *some, math.inf] for some in points], inputCols=ins, outputCols=outs, handleInvalid="keep").transform(wide)
    cells = F.posexplode(F.array(*[F.struct(F.col(i).alias("v"), F.col(o).cast("int").alias("pos")) for i, o in zip(ins, outs)]))
    long = wide.select(*keep, cells.alias("m", "_cell")).select(*keep, "m", "_cell.v", "_cell.pos").filter(F.col("v").isNotNull())
    hot = F.coalesce(F.get("_points", F.col("pos") - 1) == F.col("v"), F.lit(False))
    return long.join(F.broadcast(found), "m").withColumn("hot", hot).drop("_points")


def _offsets(placed: DataFrame, by: Sequence[str], sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows of every place, hot and others apart: their number ``c``, how many lie ``before`` them, the count ``n`` of the group.

    ``v`` is the value of the hot ones; ``sums`` are further sums over rows.
    """
    extra = [F.sum(c).alias(n) for n, c in (sums or {}).items()]
    counts = placed.groupBy(*by, "m", "pos", "hot").agg(F.count("*").alias("c"), F.max("v").alias("v"), *extra)
    counts = materialize(counts, "counts")
    group = W.partitionBy(*by, "m")
    # a place begins with its hot value
    before = F.sum("c").over(group.orderBy("pos", F.col("hot").desc())) - F.col("c")
    return counts.withColumns({"before": before, "n": F.sum("c").over(group)})


def _hot(offsets: DataFrame) -> DataFrame:
    """The hot values with lowest and highest rank."""
    return offsets.filter("hot").withColumns({"lo": F.col("before") + 1, "hi": F.col("before") + F.col("c")})


def _cold(placed: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The other rows with lowest and highest rank of their value and the count of their group."""
    place = W.partitionBy(*by, "m", "pos").orderBy("v")
    inside = placed.filter(~F.col("hot")).withColumns({"_low": F.rank().over(place), "_high": F.count("*").over(place)})
    starts = offsets.filter(~F.col("hot")).select(*by, "m", "pos", "before", "n")
    ranked = join_null_safe(inside, starts, [*by, "m", "pos"])
    return ranked.withColumns({"lo": F.col("before") + F.col("_low"), "hi": F.col("before") + F.col("_high")}).drop("_low", "_high", "before")


def _at(p: float) -> Column:
    """Where a quantile lies among ``n`` values, counted from 0."""
    return (F.col("n") - 1) * F.lit(float(p))


def _ordered(placed: DataFrame, offsets: DataFrame, by: Sequence[str], probs: Mapping[int, Sequence[float]]) -> DataFrame:
    """(by, m, n, t, v, lo, hi): the values on both sides of each quantile, ``t`` their number in the order from 0.

    Only the places that hold one are ranked.
    """
    wanted = F.array().cast("array<bigint>")
    for m, some in probs.items():
        ends = F.array_distinct(F.array(*[end(_at(p)) for p in some for end in (F.floor, F.ceil)]))
        wanted = F.when(F.col("m") == m, ends).otherwise(wanted)
    here = F.filter(wanted, lambda t: (t >= F.col("before")) & (t < F.col("before") + F.col("c")))
    held = materialize(offsets.withColumn("t", F.explode(here)).select(*by, "m", "pos", "hot", "c", "v", "before", "n", "t"), "held")
    names = [*by, "m", "n", "t", "v", "lo", "hi"]
    others = held.filter(~F.col("hot")).select(*by, "m", "pos", "before", "n", "t")
    rows = join_null_safe(placed.filter(~F.col("hot")).select(*by, "m", "pos", "v"), others.select(*by, "m", "pos").distinct(), [*by, "m", "pos"])
    values = rows.groupBy(*by, "m", "pos", "v").agg(F.count("*").alias("k"))
    values = values.withColumn("upto", F.sum("k").over(W.partitionBy(*by, "m", "pos").orderBy("v")))
    found = join_null_safe(values, others, [*by, "m", "pos"])
    found = found.withColumns({"lo": F.col("before") + F.col("upto") - F.col("k") + 1, "hi": F.col("before") + F.col("upto")})
    found = found.filter((F.col("t") >= F.col("lo") - 1) & (F.col("t") < F.col("hi")))
    return _hot(held).select(*names).unionByName(found.select(*names))


def _quantile(p: float) -> Column:
    """Aggregate over ``_ordered``: the linear-interpolated quantile."""
    h = _at(p)
    low = F.max(F.when(F.col("t") == F.floor(h), F.col("v")))
    high = F.max(F.when(F.col("t") == F.ceil(h), F.col("v")))
    return low + (high - low) * (F.max(h) - F.max(F.floor(h)))


def quantiles(
    df: DataFrame, values: Mapping[str, Column], probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact linear-interpolated quantiles: ``by`` columns and one array per value.

    Unknown values are left out; a group without any known value has NULLs.
    """
    by, names = list(by), list(values)
    placed = _placed(df, by, [values[n] for n in names])
    ordered = _ordered(placed, _offsets(placed, by), by, {m: probs for m in range(len(names))})
    q = ordered.groupBy(*by, "m").agg(F.array(*[_quantile(p) for p in probs]).alias("q"))
    none = F.array(*[F.lit(None).cast("double") for _ in probs])
    wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("m") == i, F.col("q"))).alias(n) for i, n in enumerate(names)])
    if by:
        wide = join_null_safe(df.select(*by).distinct(), wide, by, "left")
    # written, so that the planner knows its size
    return materialize(wide.withColumns({n: F.coalesce(n, none) for n in names}), "quantiles")


def winsorize(
    df: DataFrame, values: Mapping[str, Column], bounds: Mapping[str, tuple[float, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Add each value clipped to its quantile bounds (unknown stays unknown)."""
    by = list(by)
    out = df
    for pair in dict.fromkeys(bounds.values()):
        names = [n for n in values if bounds[n] == pair]
        q = quantiles(df, {n: values[n] for n in names}, pair, by)
        q = q.withColumnsRenamed({n: f"_q_{n}" for n in names})
        out = join_null_safe(out, q, by, "left")
        out = out.withColumns(
            {n: clip(_known(values[n]), F.col(f"_q_{n}")[0], F.col(f"_q_{n}")[1]) for n in names}
        ).drop(*[f"_q_{n}" for n in names])
    return out


@dataclass(frozen=True)
class _Column:
    """A value to rank once, the bounds it is clipped to, and the numbers of the ranks that come from it."""

    value: Column
    winsor: tuple[float, float] | None
    ranks: list[int]


def _columns(ranks: Sequence[Rank]) -> list[_Column]:
    """The different values among the ranks; bounds differ only between columns."""
    out: list[_Column] = []
    for i, rank in enumerate(ranks):
        for j, col in enumerate(out):
            if repr(col.value) == repr(rank.value) and (None in (col.winsor, rank.winsor) or col.winsor == rank.winsor):
                out[j] = _Column(col.value, col.winsor or rank.winsor, [*col.ranks, i])
                break
        else:
            out.append(_Column(rank.value, rank.winsor, [i]))
    return out


def _bounds(ordered: DataFrame, by: Sequence[str], columns: Sequence[_Column]) -> DataFrame:
    """(by, m, low, high, upto_low, below_high): the quantiles a column is clipped to and the counts up to and below them."""
    ends = {"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")}
    for m, col in enumerate(columns):
        if col.winsor:
            for k, name in enumerate(("low", "high")):
                ends[name] = F.when(F.max(F.col("m")) == m, _quantile(col.winsor[k])).otherwise(ends[name])
    bounds = ordered.groupBy(*by, "m").agg(*[c.alias(n) for n, c in ends.items()])
    both = join_null_safe(ordered, bounds, [*by, "m"])
    one = F.max(F.col("low") == F.col("high"))
    # the values next to a bound are all among the rows; rounding may put a bound past the last of them
    below = F.coalesce(F.min(F.when(F.col("v") >= F.col("high"), F.col("lo") - 1)), F.max("hi"))
    beyond = both.groupBy(*by, "m").agg(
        F.max("low").alias("low"), F.max("high").alias("high"),
        F.when(one, F.max("n")).otherwise(F.max(F.when(F.col("v") <= F.col("low"), F.col("hi")))).alias("upto_low"),
        F.when(one, F.lit(0)).otherwise(below).alias("below_high"),
    )
    return materialize(beyond, "bounds")


def _with_places(ranked: DataFrame, ranks: Sequence[Rank], columns: Sequence[_Column], bounds: DataFrame | None,
                 by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add the place of every rank that a column has, over the count of the group: the n-th rank of a column in the n-th of the slots.

    Clipping to quantiles keeps the order and ties what lies at or beyond a bound, so the ranks
    of clipped values follow from the plain ones and the counts beyond the bounds.
    """
    if bounds is not None:
        ranked = join_null_safe(ranked, bounds, [*by, "m"], "left")
    v, lo, hi, n = (F.col(c) for c in ("v", "lo", "hi", "n"))
    slots = [f"_s{k}" for k in range(max(len(col.ranks) for col in columns))]
    places = {slot: F.lit(None).cast("double") for slot in slots}
    for m, col in enumerate(columns):
        for slot, i in zip(slots, col.ranks):
            top = ranks[i].ties == "max"
            place = (hi if top else (lo + hi) / 2).cast("double")
            if ranks[i].winsor:
                low = F.col("upto_low") if top else (F.col("upto_low") + 1) / 2
                high = n if top else (F.col("below_high") + 1 + n) / 2
                place = F.when(v <= F.col("low"), low.cast("double")).when(v >= F.col("high"), high.cast("double")).otherwise(place)
            places[slot] = F.when(F.col("m") == m, place / n).otherwise(places[slot])
    return ranked.withColumns(places), slots


def percent_ranks(df: DataFrame, key: Sequence[str], ranks: Mapping[str, Rank], by: Sequence[str] = ()) -> DataFrame:
    """Add percentile ranks within ``by``: rank among the known values over their number.

    ``key`` must identify a row. Values with ``winsor`` are clipped first. Ranks of one value share one ranking.
    """
    key, by, names, wanted = list(key), list(by), list(ranks), list(ranks.values())
    columns = _columns(wanted)
    placed = _placed(df, [*key, *by], [col.value for col in columns])
    offsets = _offsets(placed, by)
    probs = {m: col.winsor for m, col in enumerate(columns) if col.winsor}
    bounds = _bounds(_ordered(placed, offsets, by, probs), by, columns) if probs else None
    hot, slots = _with_places(_hot(offsets), wanted, columns, bounds, by)
    hot = materialize(hot.select(*by, "m", "pos", *slots), "hot")
    hot = join_null_safe(placed.filter("hot").select(*key, *by, "m", "pos"), hot, [*by, "m", "pos"])
    cold, _ = _with_places(_cold(placed, offsets, by), wanted, columns, bounds, by)
    out = df
    for part, rows in (("hot", hot.select(*key, "m", *slots)), ("cold", clustered(cold.select(*key, "m", *slots), key))):
        cols = [
            F.max(F.when(F.col("m") == m, F.col(slot))).alias(f"_{part}_{names[i]}")
            for m, col in enumerate(columns) for slot, i in zip(slots, col.ranks)
        ]
        out = out.join(rows.groupBy(*key).agg(*cols), key, "left")
    both = [(f"_hot_{n}", f"_cold_{n}") for n in names]
    out = out.withColumns({n: F.greatest(*pair) for n, pair in zip(names, both)})
    return out.drop(*[c for pair in both for c in pair])


def rank_corr(df: DataFrame, key: Sequence[str], x: Column, others: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Spearman correlation of ``x`` with every other column: by, number ``m``, ``corr``.

    Rows must know all the columns; ranks of ties are averaged. Only sums leave the places of another
    column, so no row is ranked twice. NULL where a column is constant.
    """
    key, by = list(key), list(by)
    rx = F.col("_x") - 0.5
    ranked = materialize(percent_ranks(df, key, {"_x": Rank(x)}, by), "ranked_x")
    placed = _placed(ranked, [*by, "_x"], others)
    offsets = _offsets(placed, by, {"sx": rx, "sxx": rx * rx})
    ry = (F.col("lo") + F.col("hi")) / 2 / F.col("n") - 0.5
    cold = _cold(placed, offsets, by).groupBy(*by, "m").agg(
        F.count("*").alias("c"), F.sum(rx).alias("sx"), F.sum(rx * rx).alias("sxx"), F.sum(ry).alias("sy"),
        F.sum(ry * ry).alias("syy"), F.sum(rx * ry).alias("sxy"),
    )
    hot = _hot(offsets).groupBy(*by, "m").agg(
        F.sum("c").alias("c"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"), F.sum(F.col("c") * ry).alias("sy"),
        F.sum(F.col("c") * ry * ry).alias("syy"), F.sum(F.col("sx") * ry).alias("sxy"),
    )
    sums = hot.unionByName(cold).groupBy(*by, "m").agg(*[F.sum(c).alias(c) for c in ("c", "sx", "sxx", "sy", "syy", "sxy")])
    c, sx, sy = F.col("c"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / c, F.col("syy") - sy * sy / c
    corr = (F.col("sxy") - sx * sy / c) / F.sqrt(vx * vy)
    # ranks that differ at all vary by far more than this
    return sums.select(*by, "m", F.when((vx > 1e-9) & (vy > 1e-9), corr).alias("corr"))
