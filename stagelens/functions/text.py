"""Column expressions for genre labels and multi-valued participant cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that close a list of names, and the role of an
# organisation whose role is not given.
LIST_TAILS = ("등", "외", "外")
UNKNOWN_ROLE = "미상"

# Every character counted as white space at the ends of a text.
WHITE = "".join(
    chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)

_PARENS = r"\(.*?\)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(_col(c), F.lit(WHITE))


def norm_genre(c: Column | str) -> Column:
    """Genre label without any bracketed remark; NULL stays NULL."""
    return strip(F.regexp_replace(_col(c), r"(?U)\s*" + _PARENS, ""))


def genre_prefix(c: Column | str) -> Column:
    """Label up to the first opening bracket."""
    return F.split(_col(c), r"\(")[0]


def _without_roles(x: Column) -> Column:
    return strip(F.when(x.contains("("), F.regexp_replace(x, _PARENS, "")).otherwise(x))


def _without_tail(x: Column) -> Column:
    """Drop one list tail (all of them are one character long) and trim again."""
    cut = F.substring(x, F.lit(1), F.length(x) - 1)
    return F.when(F.right(x, F.lit(1)).isin(*LIST_TAILS), strip(cut)).otherwise(x)


def split_names(c: Column | str, passes: int = 1) -> Column:
    """Cell to array of names: roles in brackets, list tails and empties go.

    ``passes=2`` cleans every item twice, so a name closed by two tails loses both.
    NULL gives an empty array. The steps are separate transforms, so that each works on
    the finished result of the one before.
    """
    parts = F.split(_col(c), ",")
    for _ in range(passes):
        parts = F.transform(F.transform(parts, _without_roles), _without_tail)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def split_names_legacy(c: Column | str) -> Column:
    """The older cleaner, kept for audits: blanks go first, so tails stay glued."""
    pattern = _PARENS + "|" + "|".join(" " + t for t in LIST_TAILS)
    parts = F.transform(
        F.split(F.replace(_col(c), F.lit(" "), F.lit("")), ","),
        lambda x: strip(F.regexp_replace(x, pattern, "")),
    )
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def has_list_tail(c: Column | str) -> Column:
    return _col(c).rlike("(?:" + "|".join(LIST_TAILS) + ")$")


def org_name(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\(([^)]*)\)\s*$", ""))


def org_role(c: Column | str, unknown: str = UNKNOWN_ROLE) -> Column:
    role = F.regexp_extract(F.trim(_col(c)), r"\(([^)]*)\)\s*$", 1)
    return F.coalesce(F.nullif(role, F.lit("")), F.lit(unknown))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """Order-free pair of two labels; NULL if either is missing."""
    a, b = _col(a), _col(b)
    return F.when(
        a.isNotNull() & b.isNotNull(), F.concat_ws("+", F.least(a, b), F.greatest(a, b))
    )


def pair_side(pair: Column | str, side: int) -> Column:
    return F.split(_col(pair), r"\+")[side]


def is_missing(c: Column | str) -> Column:
    """NULL, or nothing left after trimming."""
    c = _col(c).cast("string")
    return c.isNull() | (strip(c) == "")


def list_length(c: Column | str) -> Column:
    return F.size(F.split(_col(c), ","))


def typed_key(kind: str, c: Column | str) -> Column:
    """Prefixed node key, so that one name may live in several node types."""
    return F.concat(F.lit(kind + ":"), _col(c).cast("string"))


def joined(c: Column | str, sep: str = " + ") -> Column:
    return F.array_join(_col(c), sep)
