"""Joining many rows to a one-row-per-key summary without letting a hot key settle in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEY = "_fw_key"
_MARK = "_fw_has"


def as_list(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def distinct_keys(df: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """The keys present in ``df``, once each. Repeats are folded on the map side, before the shuffle."""
    return df.select(*as_list(on)).distinct()


def join_unique(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join two frames that both hold one row per key: no key can be hot, and both keep the layout of their grouping."""
    return left.join(right, as_list(on), how)


def left_many(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join to a side that may repeat keys without bound.

    AQE splits only the left side of a left join, so a key that is hot on the right would land in one task. A look-up of
    the right side's keys marks the left rows; the marked ones go on to an inner join, of which either side can be split,
    the others are passed on. Both ways read one exchange of the left side: keys are compared null-safely (null keys are
    taken out on the right), so that no filter of one way's own comes in between. The inner join deals its rows anew, by
    another hash, as AQE splits only what was dealt for the join itself.
    """
    on = as_list(on)
    added = [c for c in right.columns if c not in on]
    whole = right.filter(reduce(Column.__and__, [F.col(c).isNotNull() for c in on]))
    marked = _null_safe(left, distinct_keys(whole, on).withColumn(_MARK, F.lit(True)), on, "left", 0)
    matched = _null_safe(marked.filter(_MARK).drop(_MARK), whole, on, "inner", 1).select(*left.columns, *added)
    rest = marked.filter(F.col(_MARK).isNull()).drop(_MARK)
    return matched.unionByName(rest, allowMissingColumns=True)


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str, seed: int) -> DataFrame:
    renamed = [f"{_KEY}{i}" for i in range(len(on))]
    added = [c for c in right.columns if c not in on]
    other = right.select(*[F.col(key).alias(new) for key, new in zip(on, renamed)], *added)
    same = F.xxhash64(*on, F.lit(seed)) == F.xxhash64(*renamed, F.lit(seed))
    for key, new in zip(on, renamed):
        same = F.col(key).eqNullSafe(F.col(new)) & same
    return left.join(other, same, how).select(*left.columns, *added)


def join_summary(rows: DataFrame, summary: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join ``rows`` to ``summary``, which holds one row per key.

    A summary that was just grouped by the key is already partitioned by it, and Spark would reuse that layout: the row
    side then has to follow and a hot key cannot be split. A second equality on a hash of the key makes Spark exchange
    both sides plainly, so AQE can split the hot partition of ``rows`` (repeating one summary row) or switch to a
    broadcast once it has seen that the summary really is small. Look-ups on the same key one after the other share one
    exchange of ``rows``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r} is not a look-up")
    on = as_list(on)
    left_types, right_types = dict(rows.dtypes), dict(summary.dtypes)
    for key in on:
        if left_types[key] != right_types[key]:
            raise TypeError(f"key {key!r} is {left_types[key]} on one side and {right_types[key]} on the other")
    added = [c for c in summary.columns if c not in on]
    renamed = [f"{_KEY}{i}" for i in range(len(on))]
    other = summary.select(*[F.col(key).alias(new) for key, new in zip(on, renamed)], *added)
    same = F.xxhash64(*on) == F.xxhash64(*renamed)
    for key, new in zip(on, renamed):
        same = (F.col(key) == F.col(new)) & same
    joined = rows.join(other, same, how)
    return joined.select(*rows.columns, *([] if how in ("left_semi", "left_anti") else added))
