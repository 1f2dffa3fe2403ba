"""Shards of even size that keep linked documents together, by balanced label propagation.

Rows are linked through hubs: all rows with the same hub (a digest of the text, say) are linked to each
other, so a group of any size is as many short rows as it has members, not all its pairs. A row's
label is its shard. In every round each linked row looks up how many of its neighbours each shard
has, by a join with the counts per hub, and asks for the shard with most of them that can still take
rows; a tie goes to the shard that the hub's hash puts first, the same for all its members. Moves
are granted under quotas: between two shards as many rows go one way as the other, and beyond that
a shard takes what it has room for, the moves with the largest gain first. So no shard ever passes
its capacity. Rows without links come last and fill the room that is left, in equal parts.

All of it is joins, aggregates and windows. Exact ranks, which the quotas need, never sort a
group in one task: rows are numbered inside small buckets, and the buckets' counts are added up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.operators.skew import key_sizes, skew_join
from stagelens.session import materialize

SHARDS = 8
ROUNDS = 12  # at most; it ends when no row moves
BUCKET_ROWS = 100_000  # rows that are numbered together, about


def numbered(rows: DataFrame, group: Sequence[str], total: int, first: Column | None = None) -> DataFrame:
    """Add ``nth`` (long, from 0, gapless) to rows with a unique ``row``; by ``first``, then in random order.

    ``total`` is about how many rows there are; it only sets the number of buckets.
    """
    group = list(group)
    buckets = max(1, total // BUCKET_ROWS)
    order = F.lit(0) if first is None else first
    cells = rows.withColumns({"_first": order, "_bucket": F.pmod(F.xxhash64(F.lit("bucket"), "row"), F.lit(buckets))})
    sizes = cells.groupBy(*group, "_first", "_bucket").agg(F.count("*").alias("_rows"))
    along = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_before", F.sum("_rows").over(along.orderBy("_first", "_bucket")) - F.col("_rows"))
    inside = Window.partitionBy(*group, "_first", "_bucket").orderBy("row")
    joined = cells.withColumn("_nth", F.row_number().over(inside) - 1).join(
        sizes.drop("_rows"), [*group, "_first", "_bucket"]
    )
    return joined.withColumn("nth", (F.col("_before") + F.col("_nth")).cast("long")).drop(
        "_first", "_bucket", "_before", "_nth"
    )


def quotas(rows: int, shards: int) -> list[int]:
    """Rows per shard: as many in each, and one more in the first of them."""
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _counts(shards: int) -> list[Column]:
    return [F.count(F.when(F.col("shard") == k, True)).alias(f"c{k}") for k in range(shards)]


def _loads(placed: DataFrame, shards: int) -> list[int]:
    return list(placed.agg(*_counts(shards)).first())


def _wanted(links: DataFrame, placed: DataFrame, hub_sizes: DataFrame, open_to: list[bool]) -> DataFrame:
    """(row, shard, want, gain) of the rows that would rather be in another shard."""
    shards = len(open_to)
    at = links.join(placed, "row")
    per_hub = at.groupBy("hub").agg(*_counts(shards))
    seen = skew_join(at, per_hub, ["hub"], ["row"], sizes=hub_sizes)
    near = seen.groupBy("row", "shard").agg(
        *[F.sum(f"c{k}").alias(f"c{k}") for k in range(shards)], F.min("hub").alias("hub"), F.count("*").alias("hubs")
    )
    # a row is its own neighbour once, however many hubs count it: that settles who stays in a tie
    again = F.col("hubs") - 1
    choices = F.array(*[
        F.struct((F.col(f"c{k}") - F.when(F.col("shard") == k, again).otherwise(0)).alias("n"), F.pmod(F.xxhash64("hub", F.lit(k)), F.lit(1 << 20)).alias("tie"), F.lit(k).alias("k"))
        for k in range(shards)
    ])
    can = F.array(*[F.lit(k) for k in range(shards) if open_to[k]] or [F.lit(-1)])
    best = F.array_max(F.filter(choices, lambda c: F.array_contains(can, c["k"]) | (c["k"] == F.col("shard"))))
    here = F.element_at(choices, F.col("shard") + 1)
    near = near.select("row", "shard", best.alias("best"), here["n"].alias("here"))
    return near.filter("best.k <> shard").select(
        "row", "shard", F.col("best.k").alias("want"), (F.col("best.n") - F.col("here")).alias("gain")
    )


def granted(wants: dict[tuple[int, int], int], loads: list[int], most: list[int]) -> dict[tuple[int, int], int]:
    """How many of the rows that ask for it may move from shard to shard, so that no load passes its most."""
    out = {(a, b): min(n, wants.get((b, a), 0)) for (a, b), n in wants.items()}
    room = [q - n for q, n in zip(most, loads)]
    for (a, b), n in sorted(wants.items(), key=lambda x: (-x[1], x[0])):
        more = min(n - out[a, b], room[b])
        out[a, b] += more
        room[a] += more
        room[b] -= more
    return {move: n for move, n in out.items() if n}


def propagate(links: DataFrame, rows: DataFrame, most: list[int], total: int, rounds: int = ROUNDS) -> DataFrame:
    """(row, shard) of the linked rows: (row, hub) are the links, no shard has more than its ``most`` rows.

    The driver sees counts per pair of shards only.
    """
    shards = len(most)
    hub_sizes = materialize(key_sizes(links, ["hub"]), "hubs")
    placed = numbered(rows.select("row"), [], total).select("row", F.pmod("nth", F.lit(shards)).cast("int").alias("shard"))
    placed = materialize(placed, "labels")
    quiet = 0
    for turn in range(rounds):
        loads = _loads(placed, shards)
        room = [n < q for n, q in zip(loads, most)]
        # every second round asks only for shards with room, the others also offer exchanges
        wanted = materialize(_wanted(links, placed, hub_sizes, room if turn % 2 else [True] * shards), "wanted")
        wants = {(r["shard"], r["want"]): r["n"] for r in wanted.groupBy("shard", "want").agg(F.count("*").alias("n")).collect()}
        moves = granted(wants, loads, most)
        if not moves:
            quiet += 1
            if quiet == 2 or all(room):
                break
            continue
        quiet = 0
        limit = F.create_map(*[F.lit(x) for (a, b), n in moves.items() for x in (a * shards + b, n)])
        rank = numbered(wanted, ["shard", "want"], total, -F.floor(F.log2(F.col("gain") + 1)))
        moving = rank.filter(F.col("nth") < F.coalesce(limit[F.col("shard") * shards + F.col("want")], F.lit(0)))
        placed = materialize(
            placed.join(moving.select("row", "want"), "row", "left").select("row", F.coalesce("want", "shard").alias("shard")),
            "labels",
        )
    return placed


def shard_rows(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows`` (with a unique ``row``) with ``shard`` and ``slot``; ``links`` are (row, hub).

    Shards have equally many rows, or one more. Rows of one hub are kept together as far as that allows;
    a hub of one row links nothing.
    """
    total = rows.count()
    most = quotas(total, shards)
    sizes = materialize(key_sizes(links, ["hub"]).filter("rows_of_key > 1"), "linking-hubs")
    linking = materialize(skew_join(links, sizes.select("hub"), ["hub"], ["row"]), "links")
    linked = linking.select("row").distinct()
    labels = propagate(linking, linked, most, total, rounds)
    room = [q - n for q, n in zip(most, _loads(labels, shards))]
    free = numbered(rows.select("row").join(labels, "row", "left_anti"), [], total)
    ends = [sum(room[: k + 1]) for k in range(shards)]
    place = F.lit(shards - 1)
    for k in reversed(range(shards - 1)):
        place = F.when(F.col("nth") < ends[k], k).otherwise(place)
    placed = materialize(labels.unionByName(free.select("row", place.cast("int").alias("shard"))), "placed")
    slots = numbered(placed, ["shard"], total).withColumnRenamed("nth", "slot")
    return rows.join(slots, "row")


def cut(placed: DataFrame, hub: str = "hub") -> DataFrame:
    """One row: links (members of a hub beyond its first) and how many of them lead to another shard than most."""
    per = placed.groupBy(hub, "shard").agg(F.count("*").alias("n"))
    hubs = per.groupBy(hub).agg(F.sum("n").alias("n"), F.max("n").alias("kept"))
    return hubs.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("n") - F.col("kept")).alias("cut"))


def sharded(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS,
            rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard, and ``hub``, its group.

    The law is ``rows``: numbers of rows differ by one at most. Rows with equal texts are linked, and
    so are rows with a null text. Size is the text's bytes in UTF-8 plus one. Repeated rows and null
    keys are rows like others; an empty table gives an empty one.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.sha2(body, 256)).alias("hub"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "rows")
    placed = shard_rows(rows, rows.select("row", "hub"), shards, rounds)
    return placed.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hub",
    )
