"""How the discrepancies of one report change from round to round."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def round_diff(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The multiset difference of two reports: rows with their copies less (fixed) or more (new) than before.

    Rows of the first report count -1, those of the second +1; equal rows meet in one grouping and cancel, already on
    the map side.
    """
    signed = before.select(*columns, F.lit(-1).alias("_sign")).union(after.select(*columns, F.lit(1)))
    change = signed.groupBy(*columns).agg(F.sum("_sign").alias("change")).filter(F.col("change") != 0)
    return change.withColumn("state", F.when(F.col("change") > 0, "new").otherwise("fixed"))


def discrepancy_states(rounds: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    """(columns, round, copies, change, state) for every round from a discrepancy's first on in which something is said of it.

    ``rounds`` are the reports in order, numbered from 1. State: 'new' in the first round that has it, 'persisting' while
    it is there, 'fixed' in the round it disappears, 'relapsed' when it comes back; rounds in which it stays away give no
    row. ``copies`` counts its rows in the round and ``change`` those more or less than in the round before.

    Copies of each round become one column of one grouping, so a discrepancy travels once however many rounds it lasts;
    nulls in the columns are values.
    """
    stacked = [df.select(*columns, F.lit(i).alias("_round")) for i, df in enumerate(rounds)]
    per_round = [F.count(F.when(F.col("_round") == i, 1)) for i in range(len(rounds))]
    wide = reduce(DataFrame.union, stacked).groupBy(*columns).agg(F.array(*per_round).alias("_copies"))
    at = F.posexplode("_copies").alias("_at", "copies")
    rows = wide.select(*columns, "_copies", at)
    before = F.when(F.col("_at") > 0, F.element_at("_copies", F.greatest("_at", F.lit(1)))).otherwise(0)
    ever = F.exists(F.slice("_copies", F.lit(1), F.col("_at")), lambda n: n > 0)
    rows = rows.withColumns({"_before": before, "_ever": ever})
    state = (
        F.when((F.col("copies") > 0) & (F.col("_before") > 0), "persisting")
        .when((F.col("copies") > 0) & F.col("_ever"), "relapsed")
        .when(F.col("copies") > 0, "new")
        .when(F.col("_before") > 0, "fixed")
    )
    return rows.withColumn("state", state).filter(F.col("state").isNotNull()).select(
        *columns, (F.col("_at") + 1).alias("round"), "copies", (F.col("copies") - F.col("_before")).alias("change"), "state"
    )
