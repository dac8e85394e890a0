"""Which keys a feed should hold, which it misses, and which it must not hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import SKU_MARKS, WEB_FLAGS
from ..functions import fold, normalize_sku, one_of
from .keys import distinct_keys, join_summary, left_many


def sellable_items(
    items: DataFrame,
    stores: Sequence[str],
    flags: Sequence[str] = WEB_FLAGS,
    marks: Sequence[str] = SKU_MARKS,
) -> DataFrame:
    """Normalised skus of item-store rows that are sold online in one of the stores."""
    return items.filter(one_of("web_flag", flags) & one_of("store", stores)).select(
        normalize_sku("item_number", marks).alias("sku"), F.trim("item_number").alias("item_sku")
    )


def active_kits(kitting: DataFrame, order_skus: DataFrame, marks: Sequence[str] = SKU_MARKS) -> DataFrame:
    """Normalised skus of kits whose own sku record is active."""
    active = distinct_keys(order_skus.filter(one_of("active_flag", ["Y"])), "sku")
    return join_summary(kitting, active, "sku", "left_semi").select(normalize_sku("sku", marks).alias("sku"))


def catalog_rows(catalog: DataFrame, sources: Sequence[str], rentals: bool = True) -> DataFrame:
    """Catalog rows of the given data sources, optionally without rental items."""
    out = catalog.filter(one_of("data_source", sources))
    return out if rentals else out.filter(fold(F.coalesce("rental_item", F.lit("false"))) != "true")


def eligible_population(parts: Mapping[str, DataFrame], mode: str = "all", on: str = "sku") -> DataFrame:
    """Union of the parts, each row tagged with the name of its part in ``source``.

    mode='all' keeps every row, 'distinct' one per (key, source), 'keys' one per key without the tag. The last two are
    folded part by part first, so repeats never reach the shuffle of the union.
    """
    if mode not in ("all", "distinct", "keys"):
        raise ValueError("mode must be 'all', 'distinct' or 'keys'")
    if mode == "keys":
        return reduce(DataFrame.union, [df.select(on) for df in parts.values()]).distinct()
    tagged = [df.select(on, F.lit(name).alias("source")) for name, df in parts.items()]
    out = reduce(DataFrame.union, tagged)
    return out if mode == "all" else out.distinct()


def exclude(df: DataFrame, excluded: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``excluded``. Rows with a null key stay, as with NOT EXISTS."""
    return join_summary(df, distinct_keys(excluded, on), on, "left_anti")


def only_in(df: DataFrame, wanted: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is in ``wanted``."""
    return join_summary(df, distinct_keys(wanted, on), on, "left_semi")


def coverage_gap(
    expected: DataFrame, actual: DataFrame, on: str | Sequence[str], enrich: DataFrame | None = None
) -> DataFrame:
    """Expected rows that ``actual`` lacks, with the columns of ``enrich`` added where it has the key."""
    missing = exclude(expected, actual, on)
    return missing if enrich is None else left_many(missing, enrich, on)


def cross_store_difference(a: DataFrame, b: DataFrame, on: str = "sku") -> DataFrame:
    """Rows on side a whose key side b does not offer. Each side comes already filtered by its own rule."""
    return exclude(a, b, on)


def membership_flags(keys: DataFrame, lists: Mapping[str, DataFrame], on: str = "sku") -> DataFrame:
    """One row per key with 1/0 per list and 1/0 for any of them."""
    hits = [
        distinct_keys(df, on).select(on, *[F.lit(1 if other == name else 0).alias(other) for other in lists])
        for name, df in lists.items()
    ]
    counts = reduce(DataFrame.union, hits).groupBy(on).agg(*[F.max(name).alias(name) for name in lists])
    flags = [F.coalesce(F.col(name), F.lit(0)).alias(name) for name in lists]
    out = join_summary(keys, counts, on, "left").select(*keys.columns, *flags)
    return out.withColumn("in_any", F.greatest(*lists) if len(lists) > 1 else F.col(next(iter(lists))))


def presence_report(wanted: DataFrame, systems: Mapping[str, DataFrame], on: str = "sku") -> DataFrame:
    """Every wanted row with Y/N per system and the system's own columns. A system frame may repeat a key.

    Every system is completed by the wanted keys it lacks, found for all systems in one stacked grouping; the wanted rows
    then pass through one inner join per system, of which either side can be split. So the plan grows with the number of
    systems, not with its power. Rows with a null key exist nowhere and come along at the end.
    """
    keys = wanted.filter(F.col(on).isNotNull()).select(on)
    names = list(systems)
    bits = reduce(
        DataFrame.union,
        [keys.select(on, F.lit(True).alias("_wanted"), *[F.lit(None).cast("boolean").alias(n) for n in names])]
        + [
            distinct_keys(df, on).select(on, F.lit(None).cast("boolean"), *[F.lit(True if n == name else None).cast("boolean") for n in names])
            for name, df in systems.items()
        ],
    )
    bits = bits.groupBy(on).agg(F.max("_wanted").alias("_wanted"), *[F.max(n).alias(f"_in_{n}") for n in names]).filter("_wanted")
    out = wanted.filter(F.col(on).isNotNull())
    lost = wanted.filter(F.col(on).isNull())
    for name, df in systems.items():
        mark = f"exists_in_{name}"
        lacking = bits.filter(F.col(f"_in_{name}").isNull()).select(on, F.lit("N").alias(mark))
        out = out.join(df.withColumn(mark, F.lit("Y")).unionByName(lacking, allowMissingColumns=True), on).select(
            *out.columns, *[c for c in df.columns if c != on], mark
        )
        lost = lost.withColumn(mark, F.lit("N"))
    return out.unionByName(lost, allowMissingColumns=True)
