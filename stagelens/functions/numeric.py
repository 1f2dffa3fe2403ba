"""Numeric column expressions that keep NULL where a value is unknown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip(c: Column | str, low=None, high=None) -> Column:
    """Clip; unlike greatest/least an unknown value stays unknown."""
    c = _col(c)
    out = c
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    return F.when(c.isNotNull(), out)


def log1p_count(c: Column | str) -> Column:
    """log(1+x) of a count: missing and negative counts are 0."""
    return F.log1p(F.greatest(F.coalesce(_col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def geo_score(parts: Sequence[Column], weights: Sequence[float]) -> Column:
    """100 times the weighted geometric mean of parts in 0..1; NULL if any part is."""
    product = F.lit(1.0)
    for part, weight in zip(parts, weights):
        product = product * F.pow(clip(part, 1e-9, 1.0), F.lit(float(weight)))
    return F.lit(100.0) * F.pow(product, F.lit(1.0 / sum(weights)))


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Position between low and high; 0 where they coincide."""
    return F.when(c.isNull(), None).when(high == low, 0.0).otherwise((c - low) / (high - low))


def ratio_list(c: Column | str) -> Column:
    """Text such as ``[0.8, 0.6]`` or ``0.8,0.6`` to an array of numbers."""
    inner = F.regexp_replace(_col(c), r"[\[\]()\s]", "")
    items = F.filter(F.split(inner, ","), lambda x: x != "")
    return F.transform(items, lambda x: x.try_cast("double"))


def coefficient_of_variation(values: Column) -> Column:
    """Population deviation over mean of an array, unknown members left out; one walk."""
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))

    def add(acc: Column, x: Column) -> Column:
        v = F.coalesce(x, F.lit(0.0))
        n = acc["n"] + F.when(x.isNull(), 0.0).otherwise(1.0)
        return F.struct(n.alias("n"), (acc["s"] + v).alias("s"), (acc["q"] + v * v).alias("q"))

    def finish(acc: Column) -> Column:
        n, s, q = acc["n"], acc["s"], acc["q"]
        spread = F.sqrt(F.greatest(F.try_divide(q, n) - F.try_divide(s, n) * F.try_divide(s, n), F.lit(0.0)))
        return F.when(n > 0, F.try_divide(spread, F.try_divide(s, n)))

    return F.aggregate(values, zero, add, finish)


def row_extremes(cols: Sequence[Column]) -> tuple[Column, Column, Column]:
    """Smallest, largest and mean of several columns of a row, unknowns left out."""
    known = F.filter(F.array(*cols), lambda x: x.isNotNull())
    mean = F.try_divide(
        F.aggregate(known, F.lit(0.0), lambda s, x: s + x), F.size(known).cast("double")
    )
    return F.array_min(known), F.array_max(known), mean


def distinct_in_row(cols: Sequence[Column]) -> Column:
    return F.size(F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull())))
