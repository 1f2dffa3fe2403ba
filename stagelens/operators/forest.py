"""Regression forests on all rows: one task grows a tree.

The known rows are written once, in order of their key, into the shared folder; tasks read them from there a block at
a time. Each tree draws its own rows from them, with replacement, from a generator
that its number seeds, so equal rows give equal trees wherever they are grown. What comes back
is a short row per tree: the importances, the sums for the rows a tree has not seen, and the tree itself only
if it is asked for. A tree grows level by level: all nodes of a level look for their best split in one sweep
over the rows in order of a feature. Nodes with more rows than a task should hold are split by sweeps over
files in order of each feature, the nodes below them in memory. Either way a split is the best of all cuts between all
values; a task keeps six bytes for every row of the table, and ``PART`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagelens.operators.keys import bounded_sample
from stagelens.session import temporary_path

PART = 1 << 20  # rows that a task holds at once
BLOCK = 1 << 18  # rows that are read or drawn at once
TIE = 1e-9  # gains closer than this share of them are equal


@dataclass
class Tree:
    """Nodes: feature (-1: a leaf), threshold (up to it a row goes left), children, mean."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            inner = np.flatnonzero(self.feature[at] >= 0)
            if not len(inner):
                return self.value[at]
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.threshold[node]
            at[inner] = np.where(low, self.left[node], self.right[node])


def best_splits(x: np.ndarray, order: np.ndarray, node: np.ndarray, w: np.ndarray, wy: np.ndarray,
                nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, threshold) of each node's best split by one feature; gain is what the squared errors lose.

    ``order`` sorts the rows by their node, then by the feature. Of equal gains the smallest threshold counts.
    """
    n, v, ow, oy = node[order], x[order], w[order], wy[order]
    total_w, total = np.bincount(n, ow, nodes), np.bincount(n, oy, nodes)
    rows = np.bincount(n, minlength=nodes)
    start = np.cumsum(rows) - rows
    cw, cy = np.cumsum(ow), np.cumsum(oy)
    before_w, before = np.append(0, cw)[start], np.append(0, cy)[start]
    best, threshold = np.full(nodes, -np.inf), np.zeros(nodes)
    i = np.flatnonzero((n[:-1] == n[1:]) & (v[:-1] < v[1:]))
    if len(i):
        at = n[i]
        lw, ly = cw[i] - before_w[at], cy[i] - before[at]
        rw, ry = total_w[at] - lw, total[at] - ly
        gain = ly**2 / lw + ry**2 / rw - (total**2 / np.maximum(total_w, 1e-300))[at]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        best[at[first]] = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain >= best[at] - TIE * np.abs(best[at]))
        hit = hit[np.append(True, at[hit][1:] != at[hit][:-1])]
        low, high = v[i[hit]], v[i[hit] + 1]
        threshold[at[hit]] = _between(low, high)
    return best, threshold


def _between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = (low + high) / 2
    return np.where(middle < high, middle, low)


def _handed_down(order: np.ndarray, child: np.ndarray, pairs: int) -> np.ndarray:
    """Rows that have a child (2 i or 2 i + 1 of the i-th split node), in the old order within each child."""
    order = order[child[order] >= 0]
    at = child[order]
    side = (at & 1).astype(bool)
    low, high = order[~side], order[side]
    n_low, n_high = np.bincount(at[~side] >> 1, minlength=pairs), np.bincount(at[side] >> 1, minlength=pairs)
    out = np.empty_like(order)
    out[np.arange(len(low)) + np.repeat(np.cumsum(n_high) - n_high, n_low)] = low
    out[np.arange(len(high)) + np.repeat(np.cumsum(n_low), n_high)] = high
    return out


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int) -> tuple[Tree, np.ndarray]:
    """A tree on the rows with a weight, and what each feature's splits take off the squared errors."""
    seen = np.flatnonzero(w)
    x, y, w = x[seen], y[seen], w[seen].astype(float)
    columns = [np.ascontiguousarray(x[:, f]) for f in range(x.shape[1])]
    orders = [np.argsort(c, kind="stable").astype(np.int32) for c in columns]
    node = np.zeros(len(x), np.int32)
    taken = np.zeros(x.shape[1])
    feature, threshold, left, right, value = [], [], [], [], []
    first, nodes = 0, 1
    for step in range(depth + 1):
        weight = np.bincount(node[node >= 0], w[node >= 0], nodes)
        mean = np.bincount(node[node >= 0], (w * y)[node >= 0], nodes) / np.maximum(weight, 1e-300)
        value.append(mean)
        at = np.full(nodes, -1)
        cut, lo, hi = np.zeros(nodes), np.full(nodes, -1), np.full(nodes, -1)
        if step < depth:
            live = node >= 0
            level = y - mean[np.maximum(node, 0)]  # sums of small numbers keep their digits
            spread = np.bincount(node[live], (w * level**2)[live], nodes)
            best = np.full(nodes, -np.inf)
            wy = w * level
            for f, order in enumerate(orders):
                gain, limit = best_splits(columns[f], order, node, w, wy, nodes)
                better = gain > best + TIE * np.abs(np.where(np.isfinite(best), best, 0))
                best[better], cut[better], at[better] = gain[better], limit[better], f
            split = np.isfinite(best) & (spread > 1e-12 * np.maximum(weight, 1))
            at[~split] = -1
            np.add.at(taken, at[split], np.maximum(best[split], 0))
            number = np.cumsum(split) - 1
            lo[split], hi[split] = first + nodes + 2 * number[split], first + nodes + 2 * number[split] + 1
            goes = np.flatnonzero(live & split[np.maximum(node, 0)])
            mine = node[goes]
            right_side = x[goes, at[mine]] > cut[mine]
            new = np.full(len(node), -1, np.int32)
            new[goes] = 2 * number[mine] + right_side
            node = new
            orders = [_handed_down(order, node, int(split.sum())) for order in orders]
        feature.append(at)
        threshold.append(cut)
        left.append(lo)
        right.append(hi)
        grown = 2 * int((at >= 0).sum())
        if not grown:
            break
        first, nodes = first + nodes, grown
    return Tree(*[np.concatenate(a) for a in (feature, threshold, left, right, value)]), taken


def swept(chunks: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], slot: Callable[[np.ndarray], np.ndarray], w: np.ndarray,
          mean: np.ndarray, weight: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``best_splits`` of rows that come in chunks (row, value, y), in order of the value.

    ``slot`` gives the node of rows, -1 for none; ``mean`` is taken off y, ``weight`` and ``total`` are then the sums of the nodes.
    """
    nodes = len(mean)
    lw, ly, last = np.zeros(nodes), np.zeros(nodes), np.full(nodes, np.nan)
    best, threshold = np.full(nodes, -np.inf), np.zeros(nodes)
    for row, v, y in chunks:
        at = slot(row)
        mine = np.flatnonzero(at >= 0)
        if not len(mine):
            continue
        mine = mine[np.argsort(at[mine], kind="stable")]
        at, v, ow = at[mine], v[mine], w[row[mine]].astype(float)
        oy = ow * (y[mine] - mean[at])
        start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        length = np.diff(np.append(start, len(at)))
        here = at[start]
        cw, cy = np.cumsum(ow), np.cumsum(oy)
        cw += np.repeat(lw[here] - cw[start] + ow[start], length)
        cy += np.repeat(ly[here] - cy[start] + oy[start], length)
        before = np.append(np.nan, v[:-1])  # the value of the row before it in the node
        before[start] = last[here]
        i = np.flatnonzero(before < v)
        end = start + length - 1
        lw[here], ly[here], last[here] = cw[end], cy[end], v[end]
        if not len(i):
            continue
        n, sw, sy = at[i], cw[i] - ow[i], cy[i] - oy[i]
        gain = sy**2 / sw + (total[n] - sy) ** 2 / (weight[n] - sw) - total[n] ** 2 / weight[n]
        first = np.flatnonzero(np.append(True, n[1:] != n[:-1]))
        top = np.full(nodes, -np.inf)
        top[n[first]] = np.maximum.reduceat(gain, first)
        hit = np.flatnonzero(gain >= top[n] - TIE * np.abs(top[n]))
        hit = hit[np.append(True, n[hit][1:] != n[hit][:-1])]
        hit = hit[top[n[hit]] > best[n[hit]] + TIE * np.abs(np.where(np.isfinite(best[n[hit]]), best[n[hit]], 0))]
        best[n[hit]] = top[n[hit]]
        threshold[n[hit]] = _between(before[i[hit]], v[i[hit]])
    return best, threshold


def grow_in_parts(blocks: Callable[[], Iterator], ordered: Callable[[int], Iterator], w: np.ndarray, features: int,
                  depth: int, most: int = PART) -> tuple[Tree, np.ndarray]:
    """The tree of ``grow`` from rows that are read: nodes of up to ``most`` rows grow in memory, those above by sweeps.

    ``blocks`` gives (first row, x, y) of all rows one after the other, ``ordered`` chunks (row, value, y) in order of a feature.
    """
    node = np.where(w > 0, 0, -1).astype(np.int32)
    taken = np.zeros(features)
    feature, threshold, left, right, value = (np.full(1, v) for v in (-1, 0.0, -1, -1, 0.0))
    above, lo, hi, step, rows = 0, 0, 1, 0, np.zeros(0, np.int64)
    parts = []
    while lo < hi:
        k = hi - lo
        rows, weight, total = np.zeros(k, np.int64), np.zeros(k), np.zeros(k)
        for first, x, y in blocks():
            at = node[first : first + len(y)]
            moving = np.flatnonzero(at >= above) if step else np.zeros(0, np.int64)
            moving = moving[feature[at[moving]] >= 0]
            was = at[moving]
            at[moving] = np.where(x[moving, feature[was]] <= threshold[was], left[was], right[was])
            mine = np.flatnonzero(at >= lo)
            i, mw = at[mine] - lo, w[first + mine].astype(float)
            rows += np.bincount(i, minlength=k)
            weight += np.bincount(i, mw, k)
            total += np.bincount(i, mw * y[mine], k)
        mean = total / np.maximum(weight, 1e-300)
        value[lo:hi] = mean
        wide = np.flatnonzero(rows > most) if step < depth else np.zeros(0, np.int64)
        parts += [(lo + i, int(rows[i]), depth - step) for i in np.flatnonzero(rows <= most)] if step < depth else []
        above, lo, step = lo, hi, step + 1
        if not len(wide):
            break
        slots = np.full(len(feature) + 1, -1)  # its last place is that of rows without a node
        slots[above + wide] = np.arange(len(wide))
        spread, off = np.zeros(len(wide)), np.zeros(len(wide))
        for first, _, y in blocks():
            at = slots[node[first : first + len(y)]]
            mine = np.flatnonzero(at >= 0)
            level, mw = y[mine] - mean[wide][at[mine]], w[first + mine].astype(float)
            spread += np.bincount(at[mine], mw * level**2, len(wide))
            off += np.bincount(at[mine], mw * level, len(wide))
        best, at, cut = np.full(len(wide), -np.inf), np.full(len(wide), -1), np.zeros(len(wide))
        for f in range(features):
            gain, limit = swept(ordered(f), lambda row: slots[node[row]], w, mean[wide], weight[wide], off)
            better = gain > best + TIE * np.abs(np.where(np.isfinite(best), best, 0))
            best[better], cut[better], at[better] = gain[better], limit[better], f
        split = np.isfinite(best) & (spread > 1e-12 * np.maximum(weight[wide], 1))
        np.add.at(taken, at[split], np.maximum(best[split], 0))
        inner, grown = above + wide[split], 2 * int(split.sum())
        feature[inner], threshold[inner] = at[split], cut[split]
        left[inner], right[inner] = lo + 2 * np.arange(len(inner)), lo + 2 * np.arange(len(inner)) + 1
        feature, left, right = (np.append(a, np.full(grown, -1)) for a in (feature, left, right))
        threshold, value = (np.append(a, np.zeros(grown)) for a in (threshold, value))
        hi = lo + grown
    made, size = [[feature], [threshold], [left], [right], [value]], len(feature)
    while parts:
        some, held = [], 0
        while parts and (not some or held + parts[-1][1] <= most):
            some.append(parts.pop())
            held += some[-1][1]
        slots = np.full(len(feature) + 1, -1)
        slots[[n for n, _, _ in some]] = np.arange(len(some))
        kept = []
        for first, x, y in blocks():
            at = slots[node[first : first + len(y)]]
            mine = np.flatnonzero(at >= 0)
            kept.append((at[mine], x[mine], y[mine], w[first + mine]))
        at, x, y, mw = (np.concatenate(c) for c in zip(*kept))
        for i, (n, _, levels) in enumerate(some):
            mine = at == i
            tree, gains = grow(x[mine], y[mine], mw[mine], levels)
            taken += gains
            down = [np.where(c >= 0, size + c - 1, -1) for c in (tree.left, tree.right)]
            for whole, own in zip(made, (tree.feature, tree.threshold, *down, tree.value)):
                whole[0][n] = own[0]
                whole.append(own[1:])
            size += len(tree.feature) - 1
    return Tree(*[np.concatenate(a) for a in made]), taken


def drawn(rows: int, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree: as many draws as rows, with replacement."""
    rng = np.random.default_rng([seed, tree])
    times = np.zeros(rows, np.uint16)
    for first in range(0, rows, BLOCK):
        np.add.at(times, rng.integers(0, rows, min(BLOCK, rows - first)), 1)
    return times


@dataclass
class Forest:
    """Importances (they add up to one), R2 by the trees that have not seen a row, and the trees if they were kept."""

    features: list[str]
    rows: int
    importances: np.ndarray
    unseen_r2: float
    trees: list[Tree]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sum((t.predict(x) for t in self.trees), np.zeros(len(x))) / max(len(self.trees), 1)


def _numbers(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _read(path: str, columns: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """Columns of the files of a folder, in order of their names, some rows at a time."""
    store, folder = fs.FileSystem.from_uri(path)
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(folder)) if i.base_name.startswith("part-"))
    for name in names:
        with store.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(BLOCK, columns=list(columns), use_threads=False):
                yield [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]


def _written(df: DataFrame, name: str, order: Sequence[str]) -> str:
    path = temporary_path(df.sparkSession, name)
    df.orderBy(*order).write.parquet(path)
    return path


def _by_feature(spark, path: str, names: Sequence[str], y: str) -> list[str]:
    """The rows of ``path`` as (row, value, y), numbered as they lie there, in order of each feature."""
    rows = spark.read.parquet(path).select(*names, y, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    before, n = {}, 0
    for row in sorted(rows.groupBy("_file").agg(F.count("*").alias("n")).collect()):  # a row per file
        before[row["_file"]] = n
        n += row["n"]
    first = F.create_map(*[F.lit(v) for pair in before.items() for v in pair])
    numbered = rows.withColumn("_row", F.col("_at") + first[F.col("_file")])
    return [_written(numbered.select("_row", F.col(f).alias("v"), F.col(y).alias("y")), "by-feature", ["v", "_row"]) for f in names]


def fit_forest(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str], trees: int, depth: int = 30,
               most: int | None = None, seed: int = 42, keep: bool = True, draw: bool = True, part: int = PART) -> Forest:
    """A forest on all known rows of ``df``, or, if the caller asks for it, on about ``most`` of them.

    With ``keep`` the driver holds the trees, each with two nodes a row at most, and what each says of the
    rows that it has not seen. Without ``draw`` every tree has every row once.
    """
    names, spark = list(features), df.sparkSession
    known = df.dropna(subset=[*names, y]).selectExpr(*key, *[f"cast({c} AS double) AS {c}" for c in [*names, y]])
    cells = [f"f{i}" for i in range(len(names))]
    rows = known if most is None else bounded_sample(known, most, key)
    # rows of equal keys lie in order of their values, so that equal tables give equal forests
    path = _written(rows.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)],
                                *[F.col(c).alias(f) for c, f in zip(names, cells)], F.col(y).alias("y")),
                    "forest-rows", [*[f"k{i}" for i in range(len(key))], *cells, "y"])
    n = spark.read.parquet(path).count()
    if not n:
        return Forest(names, 0, np.full(len(names), 0.0), float("nan"), [])
    ordered = _by_feature(spark, path, cells, "y") if n > part else []

    def blocks() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        first = 0
        for *x, target in _read(path, [*cells, "y"]):
            yield first, np.column_stack(x), target
            first += len(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                w = drawn(n, number, seed) if draw else np.ones(n, np.uint16)
                tree, taken = grow_in_parts(blocks, lambda f: _read(ordered[f], ["_row", "v", "y"]), w, len(names), depth, part)
                said = np.concatenate([tree.predict(x) for _, x, _ in blocks()]) if keep else np.zeros(0)
                unseen = np.where(w == 0, said, 0.0) if keep else said
                share = taken / taken.sum() if taken.sum() > 0 else np.zeros(len(names))
                parts = [tree.feature, tree.threshold, tree.left, tree.right, tree.value] if keep else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([share.tolist()], pa.list_(pa.float64())),
                     pa.array([_numbers(unseen)], pa.binary()), pa.array([_numbers((w == 0)[: len(unseen)])], pa.binary()),
                     *[pa.array([_numbers(np.asarray(p, t))], pa.binary()) for p, t in zip(parts, ("i4", "f8", "i4", "i4", "f8"))]],
                    names=["tree", "share", "unseen", "out", "a", "b", "c", "d", "e"])

    numbers = spark.range(0, trees, 1, min(trees, max(spark.sparkContext.defaultParallelism, trees // 4)))
    schema = "tree long, share array<double>, unseen binary, out binary, a binary, b binary, c binary, d binary, e binary"
    share, total, times, kept = np.zeros(len(names)), np.zeros(n if keep else 0), np.zeros(n if keep else 0), []
    for row in sorted(numbers.mapInArrow(run, schema).collect(), key=lambda r: r["tree"]):  # a row per tree
        share += row["share"]
        if keep:
            total += np.frombuffer(row["unseen"])
            times += np.frombuffer(row["out"], bool)
            kept.append(Tree(*[np.frombuffer(row[c], t) for c, t in zip("abcde", ("i4", "f8", "i4", "i4", "f8"))]))
    r2 = float("nan")
    if keep:
        target, was = np.concatenate([block for (block,) in _read(path, ["y"])]), times > 0
        error = ((target[was] - total[was] / times[was]) ** 2).sum()
        spread = ((target[was] - target[was].mean()) ** 2).sum() if was.any() else 0.0
        r2 = float(1 - error / spread) if spread > 0 else r2
    return Forest(names, n, share / (share.sum() or 1.0), r2, kept)


def first_split(df: DataFrame, features: Sequence[str], y: str, key: Sequence[str]) -> DataFrame:
    """One row: the feature that a tree on all rows is cut by first, rows and means on either side, and its gain."""
    (tree,) = fit_forest(df, features, y, key, 1, 1, draw=False).trees or [None]
    if tree is None or tree.feature[0] < 0:
        schema = "feature string, low_rows long, high_rows long, low_mean double, high_mean double, gain double"
        return df.sparkSession.createDataFrame([], schema)
    feature = features[tree.feature[0]]
    low = F.col(feature) <= float(tree.threshold[0])
    n = F.count_if
    sides = df.agg(n(low).alias("low_rows"), n(~low).alias("high_rows"), F.avg(F.when(low, F.col(y))).alias("low_mean"),
                   F.avg(F.when(~low, F.col(y))).alias("high_mean"), F.sum(y).alias("_all"))
    gain = F.col("low_rows") * F.col("low_mean") ** 2 + F.col("high_rows") * F.col("high_mean") ** 2 - F.col("_all") ** 2 / (
        F.col("low_rows") + F.col("high_rows"))
    return sides.select(F.lit(feature).alias("feature"), "low_rows", "high_rows", "low_mean", "high_mean", gain.alias("gain"))


def with_prediction(df: DataFrame, forest: Forest, name: str = "prediction") -> DataFrame:
    """``df`` with the mean of the trees; null where a feature is unknown. The trees are as large as their rows."""
    dealt = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = dealt.value
        for batch in batches:
            x = np.column_stack([batch.column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in model.features])
            known = ~np.isnan(x).any(1)
            out = np.full(len(x), np.nan)
            if known.any():
                out[known] = model.predict(x[known])
            made = pa.array(out, mask=~known)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
