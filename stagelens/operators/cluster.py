"""Clusters of events by their metrics and rule-based profiles of the clusters.

All fits, for every number of clusters and every start, run side by side: a pass over the rows sums up,
for each cluster of each fit, the rows that are nearest to its centre, and the driver moves the centres.
What a pass returns is a row per task and cluster, whatever the number of rows; fits that have
settled are left out of the passes that follow. First centres are drawn from all rows, one for every start in a pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagelens.functions.conditions import first_rule
from stagelens.session import materialize

# Starts, passes, and the rules of the profiles on the prototype index, the first that holds.
STARTS, PASSES = 10, 30
PROFILE_RULES = (
    ("sold < 50", "failing"),
    ("PI > 0.4 AND sold > 10000", "large hit"),
    ("occupancy > 0.8 AND sold < 2000", "steady small"),
    ("sessions > 20 AND rev_per_session < 1000000", "long running"),
    ("PI < 0.2 AND occupancy < 0.5", "weak small"),
)
BLOCK = 1024  # rows that are compared with all centres at once


def standardized(df: DataFrame, features: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """Known rows: the key, the features and their z-scores ``z_*`` (population deviation, constants give 0)."""
    known = df.dropna(subset=list(features))
    row = known.agg(*[e for f in features for e in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))]).first()
    z = {}
    for f in features:
        spread = row[f"s_{f}"] or 0.0
        z[f"z_{f}"] = (F.col(f).cast("double") - row[f"m_{f}"]) / spread if spread > 0 else F.lit(0.0)
    return known.select(*key, *features, *[c.alias(name) for name, c in z.items()])


def _z(features: Sequence[str]) -> list[str]:
    return [f"z_{f}" for f in features]


# --- fits side by side --------------------------------------------------------------------------


@dataclass
class Fit:
    """A number of clusters with its centres, and what the last pass said of them."""

    k: int
    start: int
    centres: np.ndarray
    inertia: float = np.inf
    settled: bool = False


def first_centres(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres far from each other, each drawn by its squared distance to those before it."""
    rng = np.random.default_rng(seed)
    chosen = [points[rng.integers(len(points))]]
    while len(chosen) < k:
        far = ((points[:, None] - np.array(chosen)[None]) ** 2).sum(2).min(1)
        share = far / far.sum() if far.sum() > 0 else None
        chosen.append(points[rng.choice(len(points), p=share)])
    return np.array(chosen)


def _even(rows: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) for each row, by its values and the salt alone."""
    with np.errstate(over="ignore"):
        h = np.full(len(rows), np.uint64(salt) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
        for column in (rows + 0.0).T:  # minus nought is nought
            h = (h ^ np.ascontiguousarray(column).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h = h * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def spread_centres(vectors: DataFrame, k: int, starts: int, seed: int) -> np.ndarray:
    """``first_centres`` of all different rows, for every start: (starts, k, dimensions), no starts without rows.

    A row's chance is its squared distance to the centres before it: of independent waiting times with such rates
    the row with the shortest is drawn. What a pass returns is a row per task and start.
    """
    width, chosen = len(vectors.columns), np.zeros((starts, 0, len(vectors.columns)))
    for number in range(k):
        now = chosen

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = now, number: int = number) -> Iterator[pa.RecordBatch]:
            best: list[tuple] = [()] * starts
            for rows in _blocks(batches):
                for s in range(starts):
                    far = distances(rows, now[s]).min(1) if number else np.ones(len(rows))
                    wait = -np.log(_even(rows, (seed + s) * k + number))
                    # rows that are centres already come last
                    late = np.where(far > 0, wait / np.where(far > 0, far, 1), wait)
                    i = np.lexsort((late, far <= 0))[0]
                    found = (bool(far[i] <= 0), float(late[i]), *rows[i].tolist())
                    best[s] = min(best[s] or found, found)
            some = [(s, *b) for s, b in enumerate(best) if b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*some) if some else [[]] * (width + 3), (pa.int32(), pa.bool_(), *[pa.float64()] * (width + 1)))],
                names=["start", "again", "late", *[f"v{i}" for i in range(width)]])

        row = ["again", "late", *[f"v{i}" for i in range(width)]]
        schema = "start int, again boolean, " + ", ".join(f"{c} double" for c in row[1:])
        drawn = vectors.mapInArrow(run, schema).groupBy("start").agg(F.min(F.struct(*row)).alias("r")).collect()  # a row per start
        if not drawn:
            return np.zeros((0, k, width))
        new = np.array([list(r["r"])[2:] for r in sorted(drawn)])
        chosen = np.concatenate([chosen, new[:, None]], 1)
    return chosen


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_rows else None
        for i in range(0, batch.num_rows, BLOCK):
            yield rows[i : i + BLOCK]


def distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((rows[:, None, :] - centres[None]) ** 2).sum(2)


def one_pass(vectors: DataFrame, fits: Sequence[Fit]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per fit: rows, sums, squared norms and squared distances of each cluster's rows.

    A list of (sums (k, dimensions), counts (k), (norms, distances) (2, k)).
    """
    centres, width = [f.centres for f in fits], len(vectors.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [np.zeros((len(c), width + 3)) for c in centres]
        every, ends = np.vstack(centres), np.cumsum([len(c) for c in centres])
        for rows in _blocks(batches):
            norms = (rows**2).sum(1)
            # squared distances to the centres of all fits by one product
            far = np.maximum(norms[:, None] + (every**2).sum(1) - 2 * rows @ every.T, 0)
            # a line of rows per centre: minima, members and their sums go through whole lines
            lines, values = np.ascontiguousarray(far.T), np.column_stack([np.ones(len(rows)), norms, rows])
            member = np.empty_like(lines)
            for out, c, end in zip(made, centres, ends):
                first = end - len(c)
                best, near = lines[first].copy(), np.zeros(len(rows), np.int32)
                for i in range(1, len(c)):
                    near[lines[first + i] < best] = i
                    np.minimum(best, lines[first + i], out=best)
                mine = member[first:end]
                np.equal(near, np.arange(len(c))[:, None], out=mine)
                out[:, 2] += mine @ best
            sums = member @ values
            for out, end in zip(made, ends):
                mine = sums[end - len(out) : end]
                out[:, :2] += mine[:, :2]
                out[:, 3:] += mine[:, 2:]
        names = ["fit", "cluster", *[f"v{i}" for i in range(width + 3)]]
        flat = np.vstack(made)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(made)), [len(m) for m in made]), pa.int32()),
             pa.array(np.concatenate([np.arange(len(m)) for m in made]), pa.int32()),
             *[pa.array(flat[:, i]) for i in range(width + 3)]], names=names)

    schema = "fit int, cluster int, " + ", ".join(f"v{i} double" for i in range(width + 3))
    sums = vectors.mapInArrow(run, schema).groupBy("fit", "cluster").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(width + 3)])
    found = [np.zeros((len(c), width + 3)) for c in centres]
    for row in sums.collect():  # a row per cluster of each fit
        found[row["fit"]][row["cluster"]] = row[2:]
    return [(m[:, 3:], m[:, 0], m[:, 1:3].T) for m in found]


def kmeans(vectors: DataFrame, ks: Sequence[int], starts: int = STARTS, passes: int = PASSES, seed: int = 42,
           first: dict[tuple[int, int], np.ndarray] | None = None) -> dict[int, Fit]:
    """The fit with the least inertia for each number of clusters; ``first`` gives centres by (k, start).

    A cluster without rows keeps its centre. A fit has settled when no centre moves.
    """
    if first is None:
        # only values decide about the draws, so equal tables give equal centres
        drawn = spread_centres(vectors, max(ks), starts, seed)
        if not len(drawn):
            return {}
        first = {(k, s): drawn[s, :k] for k in ks for s in range(starts)}
    fits = [Fit(k, s, np.array(c, float)) for (k, s), c in first.items()]
    for _ in range(passes):
        moving = [f for f in fits if not f.settled]
        if not moving:
            break
        for fit, (sums, counts, (_, far)) in zip(moving, one_pass(vectors, moving)):
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], fit.centres)
            fit.inertia, fit.settled = float(far.sum()), bool(np.allclose(new, fit.centres, rtol=0, atol=1e-12))
            fit.centres = new
    rest = [f for f in fits if not f.settled]
    for fit, (_, _, (_, far)) in zip(rest, one_pass(vectors, rest) if rest else []):
        fit.inertia = float(far.sum())
    return {k: min((f for f in fits if f.k == k), key=lambda f: (f.inertia, f.start)) for k in ks}


def silhouettes(vectors: DataFrame, fits: Sequence[Fit]) -> list[float]:
    """Mean silhouette by squared distances of each fit; two passes, as a cluster's sums give its mean distance to a row."""
    stats = one_pass(vectors, fits)
    centres = [f.centres for f in fits]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(centres)), 0
        for rows in _blocks(batches):
            n += len(rows)
            for i, (c, (sums, counts, (norms, _))) in enumerate(zip(centres, stats)):
                near, at = distances(rows, c).argmin(1), np.arange(len(rows))
                size = np.maximum(counts, 1)
                mean = (rows**2).sum(1)[:, None] + (norms / size)[None] - 2 * rows @ (sums / size[:, None]).T
                own = mean[at, near] * size[near] / np.maximum(size[near] - 1, 1)
                mean[:, counts == 0] = np.inf
                mean[at, near] = np.inf
                other = mean.min(1)
                alone = (counts[near] <= 1) | ~np.isfinite(other)
                most = np.where(alone, 1.0, np.maximum(own, other))
                total[i] += np.where(alone | (most <= 0), 0.0, (np.where(alone, 0, other) - own) / np.where(most > 0, most, 1)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array([n] * len(total), pa.int64())],
                                         names=["fit", "total", "n"])

    rows = vectors.mapInArrow(run, "fit int, total double, n long").groupBy("fit").agg(F.sum("total").alias("t"), F.sum("n").alias("n"))
    found = {r["fit"]: r["t"] / r["n"] for r in rows.collect()}
    return [found[i] for i in range(len(fits))]


def elbow(rows: DataFrame, features: Sequence[str], ks: Sequence[int] = (2, 3, 4, 5, 6, 7)) -> DataFrame:
    """Inertia and silhouette (squared distances) per number of clusters, of standardized rows."""
    vectors = materialize(rows.select(*_z(features)), "vectors", rebalance=True)
    best = kmeans(vectors, ks)
    fits = list(best.values())
    out = [(f.k, f.inertia, s) for f, s in zip(fits, silhouettes(vectors, fits))] if fits else []
    return rows.sparkSession.createDataFrame(out, "k int, inertia double, silhouette double")


def cluster_profiles(rows: DataFrame, features: Sequence[str], ks: Sequence[int],
                     rules: Sequence[tuple[str, str]] = PROFILE_RULES, default: str = "other") -> DataFrame:
    """k, cluster, n, mean of each feature, and the label of the first rule that holds, of standardized rows."""
    rows = materialize(rows.select(*features, *_z(features)), "vectors", rebalance=True)
    fits = kmeans(rows.select(*_z(features)), ks)
    centres, width = {k: f.centres for k, f in fits.items()}, len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            near = [distances(block[:, width:], c).argmin(1) for c in centres.values()]
            n = len(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(list(centres), n), pa.int32()), pa.array(np.concatenate(near), pa.int32()),
                 *[pa.array(np.tile(block[:, i], len(near))) for i in range(width)]], names=["k", "cluster", *features])

    # sums of what a task sees leave it, not its rows
    schema = "k int, cluster int, " + ", ".join(f"{f} double" for f in features)
    cells = rows.select(*[F.col(f).cast("double") for f in features], *_z(features))
    placed = cells.mapInArrow(run, schema) if fits else rows.sparkSession.createDataFrame([], schema)
    table = placed.groupBy("k", "cluster").agg(F.count("*").alias("n"), *[F.avg(f).alias(f) for f in features])
    return table.withColumn("profile", first_rule([(F.expr(test), name) for test, name in rules], default))
