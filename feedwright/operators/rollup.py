"""Several rows per key to one, and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fold, one_of
from .keys import as_list

_AGGS = {"max": F.max, "min": F.min, "sum": F.sum}


def store_pivot(
    df: DataFrame,
    key: str | Sequence[str],
    by: str,
    values: Sequence[str],
    measures: Mapping[str, tuple[str, Column | str]],
    name: str = "st{value}_{measure}",
) -> DataFrame:
    """One row per key with an aggregate per listed store (or warehouse): one scan, one shuffle of partial results."""
    columns = [
        _AGGS[how](F.when(one_of(by, [value]), F.col(c) if isinstance(c, str) else c)).alias(
            name.format(value=value, measure=measure)
        )
        for value in values
        for measure, (how, c) in measures.items()
    ]
    return df.filter(one_of(by, values)).groupBy(*as_list(key)).agg(*columns)


def catalog_price_matrix(
    prices: DataFrame, catalogs: Sequence[str], key: str = "sku", by: str = "catalog_id", price: str = "catalog_price"
) -> DataFrame:
    """One row per key with its price in each catalog, 0 where it has none."""
    wide = store_pivot(prices, key, by, catalogs, {"price": ("max", price)}, name="{value}")
    zero = F.lit(0).cast(dict(prices.dtypes)[price])
    return wide.select(key, *[F.coalesce(F.col(c), zero).alias(c) for c in catalogs])


def store_string(
    df: DataFrame, key: str, store: str, alias: str, recode: Mapping[str, str] | None = None, empty: str | None = None
) -> DataFrame:
    """Comma list of a key's stores in code order; codes are renamed after sorting.

    Only the distinct codes of a key are gathered (on the map side already), so the list is bounded by the number of
    store codes, not by the number of rows.
    """
    stores = df.groupBy(key).agg(F.array_sort(F.collect_set(F.rtrim(store))).alias("_stores"))
    items = F.col("_stores")
    if recode:
        flat = [F.lit(text) for code, name in recode.items() for text in (code.lower().rstrip(), name)]
        items = F.array_distinct(F.transform(items, lambda s: F.coalesce(F.element_at(F.create_map(*flat), F.lower(s)), s)))
    joined = F.when(F.size("_stores") > 0, F.array_join(items, ","))
    return stores.select(key, (joined if empty is None else F.coalesce(joined, F.lit(empty))).alias(alias))


def flag_rollup(
    df: DataFrame, key: str, on: Column, by: str, groups: Mapping[str, Sequence[str]], name: str = "{group}"
) -> DataFrame:
    """'True' per group when any of its rows is on, otherwise (also without rows) 'False'."""
    code = fold(by)
    columns = []
    for group, members in groups.items():
        hit = on & code.isin([m.lower() for m in members])
        any_on = F.coalesce(F.max(F.when(hit, F.lit(1))), F.lit(0)) == 1
        columns.append(F.when(any_on, F.lit("True")).otherwise(F.lit("False")).alias(name.format(group=group)))
    return df.groupBy(key).agg(*columns)


def location_unpivot(
    df: DataFrame, key: str, layout: Mapping[str, Mapping[str, str]], store: str = "store"
) -> DataFrame:
    """Wide per-location columns to one row per (key, store).

    ``layout`` is {store: {measure: wide column}}. One scan; every input row yields one row per store.
    """
    rows = F.array(
        *[
            F.struct(F.lit(code).alias(store), *[F.col(column).alias(measure) for measure, column in columns.items()])
            for code, columns in layout.items()
        ]
    )
    return df.select(key, F.inline(rows))
