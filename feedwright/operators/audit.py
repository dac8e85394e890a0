"""Duplicates, conflicting values and mixed states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keys import as_list


def duplicate_groups(df: DataFrame, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Groups of rows equal in all the keys, with their number; nulls are equal to each other."""
    rows = df if where is None else df.filter(where)
    return rows.groupBy(*keys).agg(F.count("*").alias("duplicate_count")).filter(F.col("duplicate_count") > 1)


def multi_value_keys(df: DataFrame, key: str | Sequence[str], value: str, more_than: int = 1) -> DataFrame:
    """Keys with several distinct values."""
    counted = df.groupBy(*as_list(key)).agg(F.countDistinct(value).alias("distinct_values"))
    return counted.filter(F.col("distinct_values") > more_than)


def mixed_state_keys(df: DataFrame, key: str | Sequence[str], state: str) -> DataFrame:
    """Keys that have rows with the state set and rows without."""
    filled, rows = F.count(F.col(state)), F.count("*")
    counted = df.groupBy(*as_list(key)).agg(filled.alias("with_state"), (rows - filled).alias("without_state"))
    return counted.filter((F.col("with_state") > 0) & (F.col("without_state") > 0))
