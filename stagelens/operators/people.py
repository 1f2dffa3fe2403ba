"""Participants: names out of cells, homonyms, person and organisation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stagelens.functions import text as X
from stagelens.operators.skew import skew_join


def explode_names(df: DataFrame, cells: Mapping[str, str], keep: Sequence[str], cleaner=X.split_names) -> DataFrame:
    """(keep, role, name): one row per name in the cells; ``cells`` maps a role to its column."""
    roles = F.array(*[F.struct(F.lit(role).alias("role"), cleaner(F.col(c)).alias("names")) for role, c in cells.items()])
    return df.select(*keep, F.inline(roles)).select(*keep, "role", F.explode("names").alias("name"))


def count_names(df: DataFrame, cells: Mapping[str, str], cleaner=X.split_names, weight: str | None = None) -> DataFrame:
    """(role, name, n) over all cells; equal cells are counted first and cleaned once.

    ``weight`` names a column with the rows that each row stands for.
    """
    roles = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("cell")) for role, c in cells.items()])
    rows = df.select(F.inline(roles), (F.col(weight) if weight else F.lit(1)).alias("w"))
    distinct = rows.groupBy("role", "cell").agg(F.sum("w").alias("c"))
    return distinct.select("role", "c", F.explode(cleaner("cell")).alias("name")).groupBy("role", "name").agg(F.sum("c").alias("n"))


def genre_scores(people: DataFrame, genre: str, name: str = "name") -> DataFrame:
    """Participations per name and genre with their share of the name's total."""
    counts = people.filter(F.col(genre).isNotNull()).groupBy(name, genre).agg(F.count("*").alias("count"))
    return counts.withColumn("score", F.col("count") / F.sum("count").over(W.partitionBy(name)))


def homonym_levels(people: DataFrame, levels: Sequence[str], name: str = "name") -> DataFrame:
    """How far names spread over genres at several levels, all levels in one pass."""
    cells = F.array(*[F.struct(F.lit(lv).alias("level"), F.col(lv).alias("genre")) for lv in levels])
    per_genre = people.select(name, F.inline(cells)).groupBy("level", name, "genre").agg(F.count("*").alias("c"))
    known = F.when(F.col("genre").isNotNull(), F.col("c"))
    per_name = per_genre.groupBy("level", name).agg(
        F.count("genre").alias("genres"), (F.max(known) / F.sum(known)).alias("top_share")
    )
    spread = per_name.groupBy("level").agg(
        F.count("*").alias("names"),
        F.count_if(F.col("genres") > 1).alias("names_in_many"),
        F.avg((F.col("genres") > 1).cast("int")).alias("share_in_many"),
        F.avg("genres").alias("mean_genres"),
        F.avg("top_share").alias("mean_top_share"),
        F.sum("genres").alias("quasi_ids"),
    )
    kinds = per_genre.filter("genre IS NOT NULL").select("level", "genre").distinct().groupBy("level").agg(F.count("*").alias("genres"))
    return spread.join(kinds, "level", "left")


def ghost_names(wrong: DataFrame, good: DataFrame, name: str = "name", n: str = "n") -> DataFrame:
    """Counted names left with a list tail by one cleaner that the other never gives."""
    names = wrong.filter(X.has_list_tail(name)).groupBy(name).agg(F.sum(n).alias("records"))
    return names.join(good.select(name).distinct(), name, "left_anti")


def dominant_genre(people: DataFrame, genre: str, name: str = "name") -> DataFrame:
    """Genre a name takes part in most (ties by label) and the number of its genres."""
    counts = people.filter(F.col(genre).isNotNull()).groupBy(name, genre).agg(F.count("*").alias("n"))
    by_name = counts.groupBy(name).agg(
        F.min(F.struct((-F.col("n")).alias("minus"), F.col(genre).alias("g"))).alias("best"), F.count("*").alias("n_genres")
    )
    return by_name.select(name, F.col("best.g").alias(genre), (-F.col("best.minus")).alias("n"), "n_genres")


def ambiguity(unlabelled: DataFrame, dominant: DataFrame, name: str = "name") -> DataFrame:
    """How many names of unlabelled events have no, one or several known genres."""
    names = unlabelled.select(name).distinct().join(dominant.select(name, "n_genres"), name, "left")
    n = F.col("n_genres")
    return names.agg(
        F.count("*").alias("names"), F.count_if(n.isNull()).alias("unseen"),
        F.count_if(n == 1).alias("one_genre"), F.count_if(n > 1).alias("ambiguous"),
    )


def resolve(unlabelled: DataFrame, dominant: DataFrame, genre: str, new_genre: str, spread: Sequence[str],
            name: str = "name") -> DataFrame:
    """Link participants of unlabelled events to the dominant person of their name.

    Names never seen get a person of their own under ``new_genre``. A famous name may
    hold many of the rows, hence the salted join.
    """
    linked = skew_join(unlabelled, dominant.select(name, genre), [name], spread, "left")
    return linked.withColumns(
        {"resolved": F.col(genre).isNotNull(), genre: F.coalesce(F.col(genre), F.lit(new_genre))}
    )


def split_orgs(df: DataFrame, col: str, keep: Sequence[str]) -> DataFrame:
    """(keep, org, role) bridge; the role belongs to the relation, not to the organisation."""
    items = df.filter(F.col(col) != "").select(*keep, col).distinct().select(*keep, F.explode(F.split(col, ",")).alias("_x"))
    return items.select(*keep, X.org_name("_x").alias("org"), X.org_role("_x").alias("role")).filter("org <> ''").distinct()


def multi_role(bridge: DataFrame, org: str = "org", role: str = "role") -> DataFrame:
    """Organisations with more than one role."""
    roles = bridge.select(org, role).distinct()
    return roles.groupBy(org).agg(
        F.count("*").alias("roles"), F.array_join(F.array_sort(F.collect_set(role)), ", ").alias("role_list")
    ).filter(F.col("roles") > 1)


def most_genres(scores: DataFrame, genre: str, n: int, name: str = "name") -> DataFrame:
    """Names that spread over most genres."""
    spread = scores.groupBy(name).agg(
        F.count("*").alias("genres"), F.array_join(F.array_sort(F.collect_set(genre)), ", ").alias("genre_list")
    )
    return spread.orderBy(F.col("genres").desc(), name).limit(n)


def name_collisions(people: DataFrame, orgs: DataFrame, name: str = "name", org: str = "org") -> DataFrame:
    """Names used by persons and organisations alike."""
    return people.select(name).distinct().join(orgs.select(F.col(org).alias(name)).distinct(), name)

