"""Descriptive tables: shares, group means, cross tables, distributions, concentration."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from stagelens.operators.ranks import join_null_safe, quantiles
from stagelens.session import materialize


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per value and their share of all."""
    counts = df.groupBy(*cols).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count("*")).scalar())


def mean_table(df: DataFrame, split: str, first: str, second: str, metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric on both sides of a split and the difference, one pass."""
    def mean(metric: str, side: str) -> Column:
        return F.avg(F.when(F.col(split) == side, F.col(metric)))

    wide = df.agg(*[e for m in metrics for e in (mean(m, first).alias(f"{m}_1"), mean(m, second).alias(f"{m}_2"))])
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"{m}_1").alias("mean_first"), F.col(f"{m}_2").alias("mean_second"))
        for m in metrics
    ])
    return wide.select(F.inline(rows)).withColumn("difference", F.col("mean_first") - F.col("mean_second"))


def group_summary(
    df: DataFrame, by: Sequence[str], means: Mapping[str, Column | str], medians: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Count, means (rates for booleans) and exact medians per group."""
    aggs = [F.avg(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in means.items()]
    table = df.groupBy(*by).agg(F.count("*").alias("n"), *aggs)
    if not medians:
        return table
    q = quantiles(df, medians, (0.5,), by)
    q = q.select(*by, *[F.col(n)[0].alias(n) for n in medians])
    return join_null_safe(table, q, list(by), "left")


def rollup_means(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means per group and for every prefix of the grouping, in one pass."""
    return df.rollup(*by).agg(
        F.grouping_id().alias("level"), F.count("*").alias("n"), *[F.avg(m).alias(m) for m in metrics]
    )


def success_cube(df: DataFrame, by: Sequence[str], verdict: str, success: str, fail: str) -> DataFrame:
    """Success rate for every combination of the grouping columns, in one pass."""
    ok, bad = F.count_if(F.col(verdict) == success), F.count_if(F.col(verdict) == fail)
    return df.filter(F.col(verdict).isin(success, fail)).cube(*by).agg(
        F.grouping_id().alias("level"), ok.alias("successes"), bad.alias("failures"),
        (ok * 100.0 / F.count("*")).alias("rate"),
    )


def concentration(df: DataFrame, by: str, value: str, top: int = 5) -> DataFrame:
    """Share of a sum held by its largest rows per group, with mean and median.

    The row_number limit is applied before the exchange as well, so a hot group ships
    only its best rows.
    """
    order = W.partitionBy(by).orderBy(F.col(value).desc_nulls_last())
    best = (
        df.filter(F.col(value).isNotNull()).select(by, value)
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
        .groupBy(by).agg(F.sum(value).alias("top_sum"))
    )
    base = group_summary(df, [by], {"mean": value}, {"median": F.col(value)})
    sums = df.groupBy(by).agg(F.sum(value).alias("total"))
    out = join_null_safe(join_null_safe(base, sums, [by]), best, [by], "left")
    return out.withColumn("top_share", F.try_divide("top_sum", "total")).drop("top_sum", "total")


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of two labels; ``values`` fixes the columns."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(v) for v in values])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of all pairs, each over the rows that know both; one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def corr(a: str, b: str) -> Column:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        return F.corr(F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double")))

    wide = df.agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    rows = F.array(*[
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{a}|{b}`").alias("corr"))
        for a, b in pairs for x, y in dict.fromkeys(((a, b), (b, a)))
    ])
    return wide.select(F.inline(rows))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the range of the column; the last bin is closed."""
    ends = materialize(df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")), "ends")
    lo, hi = ends.select("lo").scalar(), ends.select("hi").scalar()
    width = (hi - lo) / bins
    v = F.col(value).cast("double")
    place = F.least(F.floor((v - lo) / width), F.lit(bins - 1))
    counted = df.filter(v.isNotNull()).select(*by, F.when(hi > lo, place).otherwise(0).cast("int").alias("bin"))
    counts = counted.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumns({"from": lo + width * F.col("bin"), "to": lo + width * (F.col("bin") + 1)})


def five_numbers(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum per group."""
    q = quantiles(df, {"q": F.col(value)}, (0.0, 0.25, 0.5, 0.75, 1.0), by)
    names = ("lowest", "q1", "median", "q3", "highest")
    return q.select(*by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


# Replicates, and where the uniform 16-bit number of a row passes to the next count of a
# Poisson distribution with mean 1.
REPLICATES, POISSON = 400, (24109, 48219, 60273, 64291, 65296, 65497, 65530, 65535)
PER_HASH = 8  # 16-bit numbers in a digest


def drawn_numbers(key: Sequence[str], blocks: int) -> Column:
    """The 16-bit numbers of a row in all replicates, bytes of the digests of its key and each block."""
    own = [F.col(k).cast("string") for k in key]
    return F.concat(*[F.unhex(F.md5(F.concat_ws("\x1f", *own, F.lit(str(i))))) for i in range(blocks)])


def _drawn_sums(by: Sequence[str], blocks: int):
    """Per batch, group and block: how many rows each replicate draws and the sum of their values."""
    counts = np.searchsorted(POISSON, np.arange(1 << 16), side="right").astype(np.uint8)
    names = [f"{c}{i}" for c in "ns" for i in range(PER_HASH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            codes = [batch.column(b).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for b in by]
            _, first, group = np.unique(np.column_stack([*codes, np.zeros(n, np.int64)]), axis=0, return_index=True, return_inverse=True)
            group = group.reshape(-1)
            order = np.argsort(group, kind="stable")
            starts = np.searchsorted(group[order], np.arange(len(first)))
            numbers = np.frombuffer(b"".join(batch.column("_d").to_pylist()), ">u2").reshape(n, -1)[order]
            drawn = counts[numbers].astype(float)
            value = batch.column("_v").to_numpy(zero_copy_only=False)[order]
            parts = [np.add.reduceat(x, starts, axis=0).reshape(-1, PER_HASH) for x in (drawn, drawn * value[:, None])]
            at = pa.array(np.repeat(first, blocks))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(b).take(at) for b in by], pa.array(np.tile(np.arange(blocks), len(first)), pa.int32()),
                 *[pa.array(parts[0][:, i].astype(np.int64)) for i in range(PER_HASH)], *[pa.array(parts[1][:, i]) for i in range(PER_HASH)]],
                names=[*by, "_block", *names])

    return run


def mean_interval(df: DataFrame, by: Sequence[str], value: str, key: Sequence[str], level: float = 0.95,
                  replicates: int = REPLICATES) -> DataFrame:
    """Mean with a bootstrap interval: the middle ``level`` of the means of drawn rows.

    Every row is drawn a Poisson number of times in each replicate, by the hash of its key, so all replicates
    are one aggregate that combines before the exchange, and equal tables give equal intervals. Unknown
    values are left out; a replicate that draws no row of a group has no mean of it. A task sums up the
    replicates of a batch at once, and what leaves it is a row per batch, group and block.
    """
    known = df.filter(F.col(value).isNotNull()).select(*by, *[k for k in key if k not in by], F.col(value).cast("double").alias("_v"))
    blocks = replicates // PER_HASH
    fields = [known.schema[b] for b in by] + [StructField("_block", IntegerType())]
    fields += [StructField(f"{c}{i}", t) for c, t in (("n", LongType()), ("s", DoubleType())) for i in range(PER_HASH)]
    drawn = known.select(*by, "_v", drawn_numbers(key, blocks).alias("_d")).mapInArrow(_drawn_sums(by, blocks), StructType(fields))
    sums = drawn.groupBy(*by, "_block").agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for c in "ns" for i in range(PER_HASH)])
    means = sums.select(*by, F.explode(F.array(*[F.try_divide(F.col(f"s{i}"), F.col(f"n{i}")) for i in range(PER_HASH)])).alias("_m"))
    ends = means.groupBy(*by).agg(*[F.percentile("_m", F.lit(p)).alias(n) for n, p in (("low", (1 - level) / 2), ("high", (1 + level) / 2))])
    plain = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    return join_null_safe(plain, ends, list(by)) if by else plain.join(ends)


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, minimum and maximum per column, one pass."""
    wide = df.agg(*[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}_{n}").cast("double").alias(n) for n in ("mean", "min", "max")])
        for c in cols
    ])
    return wide.select(F.inline(rows))


def extremes(table: DataFrame, label: str, cols: Sequence[str], min_n: int = 0, n: str = "n") -> DataFrame:
    """Label with the largest and (among groups of ``min_n`` rows) the smallest value of each column."""
    def at(pick, c: str, test: Column | None = None) -> Column:
        known = F.col(c).isNotNull() if test is None else F.col(c).isNotNull() & test
        ties = F.struct(F.col(c) if pick is F.min else -F.col(c), F.col(label))
        return F.min(F.when(known, ties)).getField(label)

    wide = table.agg(*[
        e for c in cols
        for e in (at(F.max, c).alias(f"{c}_hi"), at(F.min, c, F.col(n) >= min_n).alias(f"{c}_lo"))
    ])
    rows = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(f"{c}_hi").alias("highest"), F.col(f"{c}_lo").alias("lowest")) for c in cols
    ])
    return wide.select(F.inline(rows))


def step_changes(df: DataFrame, order: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Value less that of the step before."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w))
