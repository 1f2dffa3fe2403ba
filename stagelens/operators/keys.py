"""Duplicates, surrogate keys and hash splits."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.operators.ranks import join_null_safe


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in an explicit order; a hot key is reduced before the exchange."""
    rest = [c for c in df.columns if c not in by and c not in order]
    row = F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return df.groupBy(*by).agg(row).select(*by, "_row.*").select(*df.columns)


def keep_unique(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Only rows whose key occurs once; a hot key is reduced before the exchange."""
    rest = [c for c in df.columns if c not in by]
    grouped = df.groupBy(*by).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_row"))
    return grouped.filter(F.col("_n") == 1).select(*by, "_row.*").select(*df.columns)


def drop_all_null(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows that know at least one column of the subset."""
    return df.dropna(how="all", subset=list(subset))


def combine_first(a: DataFrame, b: DataFrame, on: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``a`` with its missing values filled from ``b``, and the rows and columns that only ``b`` has.

    ``on`` is a key of both; a value that neither has stays null.
    """
    there = b.select(*[F.col(c).alias(f"_b_{c}") for c in [*on, *values] if c in b.columns])
    test = F.lit(True)
    for c in on:
        test = test & a[c].eqNullSafe(there[f"_b_{c}"])

    def first(c: str) -> Column:
        own, other = c in a.columns, f"_b_{c}" in there.columns
        return F.coalesce(*[F.col(x) for x, has in ((c, own), (f"_b_{c}", other)) if has]).alias(c)

    return a.join(there, test, "full").select(*[first(c) for c in [*on, *values]])


def join_on_unique(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on a key that occurs once on either side; elsewhere nothing is attached. NULL meets NULL."""
    once = keep_unique(left, by).select(*by, F.lit(True).alias("_once"))
    partner = join_null_safe(keep_unique(right, by), once, by)
    return join_null_safe(left, partner.drop("_once"), by, "left")


def key_hash(*cols: Column | str) -> Column:
    """Stable hex digest of a key, the same in any engine."""
    return F.md5(F.concat_ws("\x1f", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]))


def dense_ids(df: DataFrame, keys: Sequence[str], name: str = "id") -> DataFrame:
    """Distinct keys numbered 1..n in the order of their hash.

    Keys are distinct and the hash is even, so buckets of its first digits are too:
    numbering runs per bucket, only the bucket counts, some hundred per shuffle partition at
    most, meet in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = math.ceil(math.log(16 * parts, 16))
    distinct = df.select(*keys).distinct().withColumn("_h", key_hash(*keys))
    distinct = distinct.withColumn("_b", F.substring("_h", 1, digits))
    counts = distinct.groupBy("_b").agg(F.count("*").alias("_c"))
    before = F.coalesce(
        F.sum("_c").over(W.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    # at most 256 rows per shuffle partition
    offsets = F.broadcast(counts.select("_b", before.alias("_before")))
    place = F.row_number().over(W.partitionBy("_b").orderBy("_h", *keys)) + F.col("_before")
    return distinct.join(offsets, "_b").withColumn(name, place).select(*keys, name)


def hash_part(parts: int, *cols: Column | str) -> Column:
    """Number 0..parts-1 from the hash of a key: portable, repeatable splits and folds."""
    return F.conv(F.substring(key_hash(*cols), 1, 8), 16, 10).cast("bigint") % parts


def in_training(share: float, *cols: Column | str) -> Column:
    return hash_part(100, *cols) < round(share * 100)


def bounded_sample(df: DataFrame, most: int, key: Sequence[str]) -> DataFrame:
    """All rows if there are at most so many, else about so many of them, by a hash of the key."""
    n = df.count()
    if n <= most:
        return df
    grain = 1 << 31
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), *key), F.lit(grain)) < int(grain * most / n))
