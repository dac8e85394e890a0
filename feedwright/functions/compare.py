"""Comparison rules: case and trailing blanks do not matter, and nulls follow a named rule."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_RULES = ("strict", "null_equal", "null_as")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: Column | str) -> Column:
    """Text as it is compared: lower case, no trailing blanks."""
    return F.lower(F.rtrim(_col(c)))


def _upper_end(value: str) -> str:
    """A text above everything that folds to ``value``: blanks may follow. One letter outside ASCII, the Kelvin sign,
    becomes an ASCII one, so a text is cut before the first k."""
    return value.split("k")[0] + chr(0x10FFFF) if "k" in value else value + "!"


def reachable(c: Column | str, values: Iterable[str]) -> Column | None:
    """A range of the stored text that holds every text folding to one of the values: it keeps too much, but, unlike a
    comparison of folded text, it reaches the scan and skips files and row groups. None where no such range is known."""
    folded = [v.lower().rstrip(" ") for v in values]
    if not folded or not all(v.isascii() for v in folded):
        return None
    return (_col(c) >= min(v.upper() for v in folded)) & (_col(c) < max(map(_upper_end, folded)))


def one_of(c: Column | str, values: Iterable[str]) -> Column:
    """Case-insensitive IN."""
    values = list(values)
    exact, stored = fold(c).isin([v.lower().rstrip(" ") for v in values]), reachable(c, values)
    return exact if stored is None else stored & exact


def begins_with(c: Column | str, prefix: str) -> Column:
    """Case-insensitive LIKE 'prefix%'."""
    prefix = prefix.lower()
    exact = fold(c).startswith(prefix)
    if not prefix or not prefix.isascii():
        return exact
    upper = prefix.split("k")[0] + chr(0x10FFFF) if "k" in prefix else prefix[:-1] + chr(ord(prefix[-1]) + 1)
    return (_col(c) >= prefix.upper()) & (_col(c) < upper) & exact


def none_of(c: Column | str, values: Iterable[str], keep_null: bool = False) -> Column:
    """Case-insensitive NOT IN. A null value is dropped unless ``keep_null``."""
    out = ~one_of(c, values)
    return (out | _col(c).isNull()) if keep_null else out


def agree(
    left: Column | str, right: Column | str, null_rule: str = "strict", default: object = None, text: bool = False
) -> Column:
    """'true' or 'false'. With ``text`` case and trailing blanks do not count.

    strict: a null on either side is 'false'. null_equal: two nulls are 'true'. null_as: nulls count as ``default``.
    """
    left, right = (fold(left), fold(right)) if text else (_col(left), _col(right))
    default = default.lower().rstrip() if text and isinstance(default, str) else default
    if null_rule == "strict":
        same = left == right
    elif null_rule == "null_equal":
        same = left.eqNullSafe(right)
    elif null_rule == "null_as":
        same = F.coalesce(left, F.lit(default)) == F.coalesce(right, F.lit(default))
    else:
        raise ValueError(f"null_rule must be one of {NULL_RULES}, not {null_rule!r}")
    return F.when(same, F.lit("true")).otherwise(F.lit("false"))


def coalesce_flag(condition: Column) -> Column:
    """'true' where the condition holds, 'false' where it does not or is unknown."""
    return F.when(condition, F.lit("true")).otherwise(F.lit("false"))
