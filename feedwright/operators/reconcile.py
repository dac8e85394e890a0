"""Compare what should be with what is."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import agree, fold, one_of
from .keys import as_list, join_summary


@dataclass(frozen=True)
class Pair:
    """Two columns (or expressions) that should agree, and the name of the flag that says whether they do."""

    flag: str
    left: Column | str
    right: Column | str
    null_rule: str = "strict"
    default: object = None

    def column(self, text: bool = False) -> Column:
        return agree(self.left, self.right, self.null_rule, self.default, text).alias(self.flag)


def flag_pairs(df: DataFrame, pairs: Sequence[Pair], keep: str = "mismatch") -> DataFrame:
    """Add one 'true'/'false' flag per pair; keep the rows with any 'false', or all rows."""
    if keep not in ("mismatch", "all"):
        raise ValueError("keep must be 'mismatch' or 'all'")
    # Text is compared as text everywhere: a pair of two string columns ignores case and trailing blanks.
    kinds = [set(dict(df.select(p.left, p.right).dtypes).values()) for p in pairs] if pairs else []
    flagged = df.select("*", *[p.column(kind == {"string"}) for p, kind in zip(pairs, kinds)])
    if keep == "all":
        return flagged
    return flagged.filter(reduce(Column.__or__, [F.col(p.flag) == "false" for p in pairs]))


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    on: str | Sequence[str],
    pairs: Sequence[Pair],
    how: str = "inner",
    keep: str = "mismatch",
    distinct: bool = False,
) -> DataFrame:
    """Discrepancies between two frames that share only their key columns."""
    out = flag_pairs(expected.join(actual, as_list(on), how), pairs, keep)
    return out.distinct() if distinct else out


def structure_parity(
    df: DataFrame, channel: str, left: str, right: str, order: str, record: str
) -> DataFrame:
    """How two channels differ in structure: (measure, size, left_count, right_count, left_share, right_share).

    'records per order' counts the different records of each order, 'lines per record' the rows of each record; ``size``
    is such a number and the counts say how many orders or records of a channel have it. Shares have four decimals, and
    are null where a channel has no orders at all. Rows without a record count as an order of no records.
    """
    side = F.when(fold(channel) == left.lower(), "left").when(fold(channel) == right.lower(), "right")
    rows = df.select(side.alias("_side"), F.col(order).alias("_order"), F.col(record).alias("_record"))
    lines = rows.filter(F.col("_side").isNotNull()).groupBy("_side", "_order", "_record").agg(F.count("*").alias("size"))
    records = lines.groupBy("_side", "_order").agg(F.count("_record").alias("size"))
    both = records.select("_side", "size", F.lit("records per order").alias("measure")).union(
        lines.filter(F.col("_record").isNotNull()).select("_side", "size", F.lit("lines per record"))
    )
    sizes = both.groupBy("measure", "size").agg(
        *[F.count(F.when(F.col("_side") == s, 1)).alias(f"{s}_count") for s in ("left", "right")]
    )
    total = sizes.groupBy("measure").agg(*[F.sum(f"{s}_count").alias(f"_{s}") for s in ("left", "right")])
    share = [
        F.when(F.col(f"_{s}") > 0, F.col(f"{s}_count") / F.col(f"_{s}")).cast("decimal(9,4)").alias(f"{s}_share") for s in ("left", "right")
    ]
    return join_summary(sizes, total, "measure").select("measure", "size", "left_count", "right_count", *share)


def channel_parity(
    df: DataFrame, key: str | Sequence[str], channel: str, left: str, right: str, fields: Sequence[str]
) -> DataFrame:
    """Keys sold on two channels whose fields differ. The frame has one row per (key, channel).

    Both channels are laid side by side by one grouping instead of a self join.
    """
    sides = [(left, "left"), (right, "right")]
    wide = (
        df.filter(one_of(channel, [left, right]))
        .groupBy(*as_list(key))
        .agg(
            *[F.max(F.when(fold(channel) == code.lower(), F.lit(1))).alias(f"_has_{side}") for code, side in sides],
            *[
                F.max(F.when(fold(channel) == code.lower(), F.col(field))).alias(f"{field}_{side}")
                for field in fields
                for code, side in sides
            ],
        )
        .filter(F.col("_has_left").isNotNull() & F.col("_has_right").isNotNull())
        .drop("_has_left", "_has_right")
    )
    pairs = [Pair(f"{f}_check", f"{f}_left", f"{f}_right", "null_equal") for f in fields]
    return flag_pairs(wide, pairs)
