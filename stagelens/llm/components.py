"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelens.session import materialize


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of them: those above the node (large) or up to it (small).

    The smallest neighbour is an aggregate that combines before the exchange and returns by a
    join, so a node with very many neighbours needs no task of its own.
    """
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.filter("b < a")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    stars = joined.select(F.col("b").alias("x"), "m")
    if large:
        stars = joined.filter("b > a").select(F.col("b").alias("x"), "m")
    else:
        stars = stars.union(least.select(F.col("a").alias("x"), "m"))
    return stars.filter("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Alternates large and small stars until nothing changes, which takes about the logarithm of
    the longest path in rounds. Each round is written out, so a lost executor costs one round.
    A table without links gives a table without rows.
    """
    links = materialize(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "links",
    )
    mark = F.struct(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))))
    seen = None
    while True:
        now = links.agg(mark.alias("m")).first()["m"]
        if now == seen or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        seen = now
        links = materialize(_stars(_stars(links, True), False), "links")
