"""Profiling of flat tables: column statistics, keys, dependencies, missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelens.functions.text import is_missing


def _cells(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(column, value as text), one row per cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(*keep, F.inline(pairs))


def column_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, share of missing cells (NULL or empty) and an example per column.

    Cells are counted per (column, value) first: no row is repeated per distinct count.
    """
    counts = _cells(df, cols or df.columns).groupBy("column", "value").agg(F.count("*").alias("n"))
    value = F.col("value")
    return counts.groupBy("column").agg(
        F.count(value).alias("distinct_values"),
        (F.sum(F.when(value.isNull() | (value == ""), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("missing_pct"),
        F.min(F.nullif(value, F.lit(""))).alias("example"),
    )


def schema_table(df: DataFrame, name: str) -> DataFrame:
    """Columns of a table with their types and number of known values."""
    known = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f.name).alias("known"))
        for i, f in enumerate(df.schema.fields)
    ])
    return known.select(F.lit(name).alias("table"), F.col("_rows").alias("rows"), F.inline(rows))


def fd_violations(df: DataFrame, key: str, cols: Sequence[str], near: float = 0.05) -> DataFrame:
    """Per column, how many key values carry more than one value of it.

    More than one value means the smallest and the largest differ, so no distinct
    counting is needed and every key is one row of partial aggregates.
    """
    def text(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    per_key = df.groupBy(key).agg(*[(F.min(text(c)) != F.max(text(c))).alias(c) for c in cols])
    totals = per_key.agg(F.count("*").alias("keys"), *[F.count_if(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("violations")) for c in cols])
    bad, keys = F.col("violations"), F.col("keys")
    kind = F.when(bad == 0, "full").when(bad <= keys * near, "near").otherwise("none")
    return totals.select(F.lit(key).alias("key"), "keys", F.inline(pairs)).withColumn("dependency", kind)


def fd_table(df: DataFrame, keys: Sequence[str], cols: Sequence[str], near: float = 0.05) -> DataFrame:
    """The test for several keys at once: one row per key and column."""
    return reduce(DataFrame.unionByName, [fd_violations(df, k, [c for c in cols if c != k], near) for k in keys])


def key_uniqueness(df: DataFrame, candidates: Mapping[str, Sequence[str]]) -> DataFrame:
    """Rows, distinct tuples and uniqueness of every candidate key (NULLs count as values)."""
    def one(label: str, cols: Sequence[str]) -> DataFrame:
        tuples = df.groupBy(*cols).agg(F.count("*").alias("n"))
        return tuples.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys")).withColumn("candidate", F.lit(label))

    return (
        reduce(DataFrame.unionByName, [one(k, c) for k, c in candidates.items()])
        .withColumn("is_unique", F.col("rows") == F.col("distinct_keys"))
        .select("candidate", "rows", "distinct_keys", "is_unique")
    )


def group_size_dist(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """How many keys have how many rows."""
    sizes = df.groupBy(*key).agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("keys"))


def distinct_dist(df: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys have how many distinct values."""
    pairs = df.select(key, value).distinct().groupBy(key).agg(F.count(value).alias("distinct_values"))
    return pairs.groupBy("distinct_values").agg(F.count("*").alias("keys"))


def missing_by(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Missing cells (NULL or blank) and their rate per group and column."""
    counts = df.groupBy(*by).agg(F.count("*").alias("rows"), *[F.count_if(is_missing(c)).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in cols])
    return counts.select(*by, "rows", F.inline(pairs)).withColumn(
        "missing_pct", F.bround(F.col("missing") * 100.0 / F.col("rows"), 2)
    )


def drop_candidates(missing: DataFrame, at_least: float = 85.0) -> DataFrame:
    """Columns whose missing rate reaches the threshold in every group."""
    return missing.groupBy("column").agg(F.min("missing_pct").alias("lowest_pct")).filter(F.col("lowest_pct") >= at_least)


def multi_value_stats(df: DataFrame, cols: Sequence[str], key: Sequence[str], sep: str = ",") -> DataFrame:
    """Cells with a value, cells holding a list, longest list; over the distinct cells of each ``key``."""
    cells = _cells(df, cols, key).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()
    return cells.groupBy("column").agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("value").contains(sep)).alias("lists"),
        F.max(F.size(F.split("value", sep))).alias("longest"),
    )
