"""Predicates and conditional columns, with the NULL rule of each spelled out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings of true and false in the raw files.
TRUE_WORDS = ("True", "true", "Y", "1")
FALSE_WORDS = ("False", "false", "N", "0")

VENUE_LABELS = ("small", "medium", "large")
VENUE_CUTS = (300, 1000)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_equal_keep_null(c: Column | str, value) -> Column:
    """True unless equal; an unknown value is kept."""
    c = _col(c)
    return c.isNull() | (c != value)


def contains(c: Column | str, needle: str) -> Column:
    return F.coalesce(_col(c).contains(needle), F.lit(False))


def venue_size(
    seats: Column | str,
    cuts: Sequence[float] = VENUE_CUTS,
    labels: Sequence[str] = VENUE_LABELS,
    inclusive: bool = True,
) -> Column:
    """Size class by seats; unknown seats count as the largest class."""
    seats = _col(seats)
    out = None
    for cut, label in zip(cuts, labels):
        test = seats <= cut if inclusive else seats < cut
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(labels[-1])


def is_free(price: Column | str, revenue: Column | str, rule: str = "any_or_missing") -> Column:
    """Free-of-charge flag.

    ``any_or_missing``  price or revenue at most 0, a missing one counts as 0
    ``any_known``       price or revenue known to be at most 0
    ``both_zero``       both exactly 0 or missing
    """
    price, revenue = _col(price), _col(revenue)
    if rule == "any_or_missing":
        return (F.coalesce(price, F.lit(0.0)) <= 0) | (F.coalesce(revenue, F.lit(0.0)) <= 0)
    if rule == "any_known":
        return F.coalesce(price <= 0, F.lit(False)) | F.coalesce(revenue <= 0, F.lit(False))
    if rule == "both_zero":
        return (F.coalesce(price, F.lit(0.0)) == 0) & (F.coalesce(revenue, F.lit(0.0)) == 0)
    raise ValueError(f"unknown rule {rule!r}")


def segment(flag: Column | str) -> Column:
    """Paid/Free from a boolean or from its spelling in a text file."""
    return F.when(F.lower(_col(flag).cast("string")) == "true", "Free").otherwise("Paid")


def parse_bool(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.isin(*TRUE_WORDS), True).when(c.isin(*FALSE_WORDS), False)


def parse_number(c: Column | str) -> Column:
    """Number, or NULL where the text is none."""
    value = _col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(c: Column | str) -> Column:
    """NULL instead of NaN and the infinities."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def map_values(c: Column | str, table: Mapping[str, str]) -> Column:
    """Translate by a small fixed table; other values give NULL."""
    c = _col(c)
    out = None
    for key, value in table.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out


def first_rule(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """Label of the first rule that holds."""
    out = None
    for test, label in rules:
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(default)


def count_true(*flags: Column | str) -> Column:
    """Number of true flags; one unknown flag makes the count unknown."""
    total = F.lit(0)
    for flag in flags:
        total = total + _col(flag).cast("int")
    return total


def pick_existing(df: DataFrame, wanted: Sequence[str], add_missing: bool = False) -> DataFrame:
    """Wanted columns that exist, header blanks trimmed; absent ones may be added empty."""
    names = {c.strip(): c for c in df.columns}
    cols = []
    for name in wanted:
        if name in names:
            cols.append(F.col(f"`{names[name]}`").alias(name))
        elif add_missing:
            cols.append(F.lit("").alias(name))
    return df.select(*cols)


def assert_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fail unless every column exists and holds at least one value."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"columns absent: {absent}")
    known = df.agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cols]).first()
    empty = [c for c in cols if not known[c]]
    if empty:
        raise ValueError(f"columns without any value: {empty}")
    return df
