"""Joins whose key may be hot: a third of all rows may share one value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salt_count(df: DataFrame) -> int:
    """Parts that a hot key is split into: its rows then fill no more than a few partitions' share each."""
    return max(4, partitions(df) // 4)


def key_sizes(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count("*").alias("rows_of_key"))


def hot_keys(sizes: DataFrame, on: Sequence[str], share: float) -> DataFrame:
    """Keys above ``share`` of the rows; fewer than ``1 / share`` rows by construction."""
    total = sizes.agg(F.sum("rows_of_key")).scalar()
    return sizes.filter(F.col("rows_of_key") > total * share).select(*on, F.lit(True).alias("_hot"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str | Column],
    how: str = "inner",
    share: float | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi-join (inner or left) that splits every hot key of the left side.

    For joins where hubs are expected; a fact meets its dimensions by a plain join. Left
    rows of a hot key get a salt from the ``spread`` columns, right rows of a hot key are
    repeated once per salt; all other keys join as they are. Left rows with a NULL in the
    key meet nothing, so all of them are salted. The result is the plain join, whatever the
    key distribution. A key is hot above half a partition's share of the rows, so there are
    at most two hot keys per partition. ``sizes`` (key, rows_of_key) saves counting the left
    rows where that is known.
    """
    if how not in ("inner", "left"):
        raise ValueError("skew_join does inner and left joins")
    on = list(on)
    share = share or 1 / (2 * partitions(left))
    salts = salt_count(left)
    hot = F.broadcast(hot_keys(sizes if sizes is not None else key_sizes(left, on), on, share))
    unmatched = F.lit(False)
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    salt = F.when(F.col("_hot") | unmatched, F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0))
    salted = left.join(hot, on, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
