"""Merkle manifest of a dataset, with a witness for every row, by aligned appends.

Rows are leaves. The leaves of a group, in order, are the lowest level of its tree; every ``FANOUT``
consecutive nodes make one of the next level until one is left, the group's subroot. The subroots in
order are the leaves of the last tree.

A tree is built by appending. A node that is appended gets a partial witness, its siblings to the
left, and extends those of the nodes that its run has so far; a run that is full becomes a node of
the level above, which takes its nodes' witnesses along as an open subtree. Nothing moves in such a
tree when leaves follow, so blocks of ``FANOUT ** LEVELS`` leaves at aligned places are appended
by tasks of their own. Their roots are further appends, to the blocks of the next round, until each
group has one node; a round shortens a group to a 512th. Witnesses then come down the same way: the
stream of a block begins with the witness of its root, which all its nodes share. The first way
up keeps roots only, and the way down appends again, so a table of whole witnesses, thirty digests a
row, is never written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagelens.operators.ranks import join_null_safe
from stagelens.operators.skew import partitions
from stagelens.session import materialize

FANOUT = 8
LEVELS = 3  # of a block
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# --- a tree that grows --------------------------------------------------------------------------


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Node:
    """A node with what is known of its witness: its siblings to the left, and those that came after it."""

    __slots__ = ("digest", "below", "left", "right")

    def __init__(self, digest: str, below: object, left: list[str]):
        self.digest, self.below, self.left, self.right = digest, below, left, []


Step = tuple[list[str], list[str]]  # siblings to the left and to the right on one level


class OpenTree:
    """A tree of so many levels above the leaves, to which leaves are appended."""

    def __init__(self, height: int, fanout: int = FANOUT):
        self.height, self.fanout = height, fanout
        self.runs: list[list[Node]] = [[] for _ in range(height + 1)]

    def append(self, digest: str, below: object = None, level: int = 0) -> None:
        run = self.runs[level]
        for earlier in run:
            earlier.right.append(digest)
        run.append(Node(digest, below, [n.digest for n in run]))
        if len(run) == self.fanout and level < self.height:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.append(digest_of([n.digest for n in run]), run, level + 1)

    def finish(self) -> Node:
        """Close the runs that are not full; the root."""
        for level in range(self.height):
            if self.runs[level]:
                self._close(level)
        (root,) = self.runs[self.height]
        return root


def witnesses(node: Node, height: int, above: list[Step]) -> Iterator[tuple[object, list[Step]]]:
    """(what was appended, its witness from the leaf up) for all leaves below a node of that height."""
    if not height:
        yield node.below, above
        return
    for child in node.below:
        yield from witnesses(child, height - 1, [(child.left, child.right), *above])


def folded(digest: str, witness: Sequence[Step]) -> str:
    """The root that follows from a leaf and its witness."""
    for left, right in witness:
        digest = digest_of([*left, digest, *right])
    return digest


def height_of(n: int, most: int, fanout: int = FANOUT) -> int:
    """Levels above ``n`` nodes until one is left, ``most`` at most."""
    height = 0
    while height < most and fanout**height < n:
        height += 1
    return height


def _packed(witness: list[Step]) -> str:
    return "/".join("".join(left) + ":" + "".join(right) for left, right in witness)


def _steps(packed: str) -> list[Step]:
    def cut(row: str) -> list[str]:
        return [row[i : i + 64] for i in range(0, len(row), 64)]

    return [tuple(map(cut, step.split(":"))) for step in packed.split("/")] if packed else []


# --- rounds -------------------------------------------------------------------------------------


def placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Add ``at``, the place of a row among those of its group in this order (from 0), and ``n``, their number.

    Rows are sorted by ranges of (group, order), so a group that holds all of them is as many ranges;
    equal rows are parted by where they were read. The counts per range give each range its first place.
    """
    by = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(rows), *by).sortWithinPartitions(*by)
    dealt = materialize(
        dealt.withColumns({"_part": F.spark_partition_id(), "_nth": F.monotonically_increasing_id()}).drop("_tie"), "placed"
    )
    runs = dealt.groupBy(group, "_part").agg(F.count("*").alias("_rows"), F.min("_nth").alias("_first"))
    all_runs = Window.partitionBy(group)
    runs = runs.select(
        group, "_part", "_first", F.sum("_rows").over(all_runs).alias("n"),
        (F.sum("_rows").over(all_runs.orderBy("_part")) - F.col("_rows")).alias("_before"),
    )
    joined = join_null_safe(dealt, runs, [group, "_part"])
    return joined.withColumn("at", F.col("_before") + F.col("_nth") - F.col("_first")).drop(
        "_part", "_nth", "_first", "_before"
    )


def _in_blocks(nodes: DataFrame, levels: int, work: Callable[[list, dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Give ``work`` each block: its nodes as (digest, values) in order, and the block's own values.

    ``nodes`` are (grp, at, n, digest, above, others); a row with ``above`` in front of a block has the
    witness of its root.
    """
    size = FANOUT**levels
    names = [c for c in nodes.columns if c not in ("grp", "at", "n", "digest", "above")]
    dealt = nodes.withColumn("block", F.floor(F.col("at") / F.lit(size)).cast("long")).withColumn(
        "_order", F.when(F.col("above").isNotNull(), -1).otherwise(F.col("at"))
    )
    dealt = dealt.repartition("grp", "block").sortWithinPartitions("grp", "block", "_order")
    dealt = dealt.select("grp", "block", "n", "digest", "above", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def made() -> Iterator[pa.RecordBatch]:
            rows = list(work(held, block)) if block else []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for grp, number, n, digest, above, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if not block or (block["grp"], block["block"]) != (grp, number):
                    yield from made()
                    block, held = {"grp": grp, "block": number, "n": n, "above": ""}, []
                if above is not None:
                    block["above"] = above
                else:
                    block["n"] = n
                    held.append((digest, values))
        yield from made()

    from pyspark.sql.pandas.types import to_arrow_schema

    frame = nodes.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(frame.schema)
    return dealt.mapInArrow(run, frame.schema)


def _grown(held: list, block: dict, levels: int) -> tuple[Node, int]:
    height = height_of(block["n"], levels)
    tree = OpenTree(height)
    for digest, values in held:
        tree.append(digest, values)
    return tree.finish(), height


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The roots of all blocks, as nodes of the next round."""

    def work(held: list, block: dict) -> Iterator[tuple]:
        root, _ = _grown(held, block, levels)
        more = -(-block["n"] // FANOUT**levels)
        yield block["grp"], block["block"], more, root.digest

    bare = nodes.select("grp", "at", "n", "digest", F.lit(None).cast("string").alias("above"))
    return _in_blocks(bare, levels, work, "grp string, at long, n long, digest string")


def _with_above(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` and, in front of each block, the witness of its root (grp, at, witness)."""
    none = F.lit(None)
    first = above.select("grp", (F.col("at") * FANOUT**levels).alias("at"), none.cast("long").alias("n"),
                         none.cast("string").alias("digest"), F.col("witness").alias("above"))
    return nodes.withColumn("above", none.cast("string")).unionByName(first, allowMissingColumns=True)


def _witnessed(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(grp, at, witness) of every node."""

    def work(held: list, block: dict) -> Iterator[tuple]:
        root, height = _grown(held, block, levels)
        steps = _steps(block["above"])
        for values, witness in witnesses(root, height, steps):
            yield block["grp"], values[0], _packed(witness)

    return _in_blocks(_with_above(nodes.withColumn("place", F.col("at")), above, levels), levels, work,
                      "grp string, at long, witness string")


def _climb(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round, from the leaves (grp, at, n, digest) to one node a group."""
    rounds = [leaves]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        rounds.append(materialize(_roots(rounds[-1], levels), "roots"))
    return rounds


def _descend(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Witnesses (grp, at, witness) of the nodes of the first round after the leaves, from those of the subroots."""
    above = top
    for nodes in reversed(rounds[1:-1]):
        above = materialize(_witnessed(nodes.select("grp", "at", "n", "digest"), above, levels), "witnesses")
    return above


# --- rows ---------------------------------------------------------------------------------------


def encoded(column: Column) -> Column:
    """`-` if null, else the number of bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def tree(leaves: DataFrame, group: str, order: Sequence[str], levels: int = LEVELS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed leaves, subroots, witnesses of the roots of the leaves' blocks).

    ``leaves`` have ``leaf``, the group and the columns of the order; subroots are (grp, subroot, root).
    """
    rows = materialize(placed(leaves, group, [*order, "leaf"]), "leaves")
    nodes = rows.select(F.col(group).cast("string").alias("grp"), "at", "n", F.col("leaf").alias("digest"))
    rounds = _climb(nodes, levels)
    tops = rounds[-1].select(F.col("grp").alias("name"), "digest", F.lit("").alias("all"))
    tops = materialize(placed(tops, "all", ["name"]), "subroots")
    top_nodes = tops.select(F.col("all").alias("grp"), "at", "n", "digest")
    top_rounds = _climb(top_nodes, levels)
    last = top_rounds[-1].first()  # the root is one row
    root = F.lit(last["digest"] if last else None).cast("string").alias("root")
    start = top_nodes.sparkSession.createDataFrame([("", 0, "")], "grp string, at long, witness string")
    above = _witnessed(top_nodes, _descend(top_rounds, start, levels), levels) if len(top_rounds) > 1 else start
    named = tops.select("name", F.col("at").alias("_at"), F.col("digest").alias("subroot"))
    top = above.select(F.col("at").alias("_at"), "witness").join(named, "_at")
    top = materialize(top.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("at"), "witness", "subroot"), "top")
    subroots = top.select("grp", "subroot", root)
    return rows, subroots, _descend(rounds, top.select("grp", "at", "witness"), levels)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", text: str = "text",
             fields: Sequence[str] = FIELDS, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per document: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``proof_sha256`` is the digest of the siblings, level by level from the leaf to the root;
    ``folded_root`` follows from the witness and the leaf, of the document with its text in lower case
    where ``tampered`` holds. Nulls have an encoding of their own, a null group is a group and comes
    first, rows with equal keys follow each other by digest, equal rows are leaves of their own, an
    empty table gives an empty one. Columns that are not named as fields are not looked at.
    """
    columns = [F.col(c) for c in fields]
    changed = [lowered(F.col(c)) if c == text else F.col(c) for c in fields]
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.col(key).alias("key"), F.col(group).alias("lang"), leaf_of(columns).alias("leaf"),
        F.when(tampered, leaf_of(changed)).alias("other"),
    )
    leaves = materialize(leaves, "digests")  # sorting by ranges would read the texts twice
    rows, subroots, above = tree(leaves, "lang", ["key"], levels)
    key_type = docs.schema[key].dataType.simpleString()
    nodes = rows.select(F.col("lang").cast("string").alias("grp"), "at", "n", F.col("leaf").alias("digest"), "key",
                        F.when(F.col("other") != F.col("leaf"), F.col("other")).alias("other"))

    def work(held: list, block: dict) -> Iterator[tuple]:
        root, height = _grown([(digest, (digest, *values)) for digest, values in held], block, levels)
        for (leaf, name, other), witness in witnesses(root, height, _steps(block["above"])):
            proof = digest_of([d for left, right in witness for d in (*left, *right)])
            yield block["grp"], name, leaf, proof, folded(leaf if other is None else other, witness)

    proved = _in_blocks(_with_above(nodes, above, levels), levels, work,
                        f"grp string, key {key_type}, leaf string, proof_sha256 string, folded_root string")
    out = join_null_safe(proved, subroots, ["grp"])
    return out.select(F.col("key").alias(key), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
