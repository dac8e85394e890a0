"""Available-to-sell arithmetic for products and kits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import not_negative, one_of
from .keys import distinct_keys, join_summary

QTY = "decimal(18,4)"
MEASURES = ("quantity_on_hand", "committed_quantity", "future_order_quantity", "safety_stock")


@dataclass(frozen=True)
class ChannelProfile:
    """How one sales location turns stock into an offer.

    ``add`` and ``subtract`` name the input quantities, ``clamp`` those that count as 0 when negative.
    """

    name: str
    add: Sequence[str]
    subtract: Sequence[str] = ()
    clamp: Sequence[str] = ()
    kits: str = "inner"
    inputs: Sequence[str] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "inputs", (*self.add, *self.subtract))

    def net(self) -> Column:
        def term(c: str) -> Column:
            return not_negative(c) if c in self.clamp else F.col(c)

        total = reduce(Column.__add__, [term(c) for c in self.add])
        return reduce(Column.__sub__, [term(c) for c in self.subtract], total)


# Which stock counts where: every deduction has its own scope, so each location names its own stack.
HH_V1 = ChannelProfile("hh_v1", ("on_hand", "open_orders", "stock_pit"), ("committed", "reserve", "safety", "pending"))
HH_V2 = ChannelProfile(
    "hh_v2",
    ("on_hand", "open_orders", "stock_pit"),
    ("committed", "reserve", "safety", "pending"),
    clamp=("stock_pit",),
    kits="left",
)
MF_V1 = ChannelProfile("mf_v1", ("on_hand", "stock_pit"), ("committed", "safety", "pending"))
MF_V2 = ChannelProfile(
    "mf_v2", ("on_hand", "stock_pit"), ("committed", "safety", "pending"), clamp=("stock_pit",), kits="left"
)


def alias_resolved_sum(pending: DataFrame, xref: DataFrame, quantity: str = "quantity") -> DataFrame:
    """Pending quantity per own sku; a marketplace sku without a cross reference stands for itself.

    ``pending`` (sku, quantity), ``xref`` (alias_sku, sku). Summed per marketplace sku before the look-up. An alias that is
    listed twice counts once; one with several own skus counts for each of them (``multi_value_keys`` reports those).
    """
    per_alias = pending.groupBy("sku").agg(F.sum(quantity).alias(quantity))
    alias = xref.select(F.col("alias_sku").alias("_alias"), F.col("sku").alias("_own")).distinct()
    return (
        per_alias.join(alias, F.col("sku") == F.col("_alias"), "left")
        .groupBy(F.coalesce("_own", "sku").alias("sku"))
        .agg(F.sum(quantity).alias(quantity))
    )


def open_order_qty(
    orders: DataFrame,
    order_codes: DataFrame,
    lines: DataFrame,
    codes: Sequence[str],
    closed: Sequence[str],
    warehouse: str | None = None,
    split: Mapping[str, str] | None = None,
) -> DataFrame:
    """Ordered minus cancelled per sku over open orders of a channel, for one warehouse, all, or one column each.

    An order tagged with several of the codes counts once per tag.
    """
    tags = order_codes.filter(one_of("udf_code", codes)).groupBy("order_number").agg(F.count("*").alias("_tags"))
    live = orders.filter(~one_of("status_code", closed))
    if warehouse is not None:
        live = live.filter(one_of("warehouse_code", [warehouse]))
    live = join_summary(live.select("order_number", "warehouse_code"), tags, "order_number")
    rest = (F.col("quantity_ordered") - F.col("canceled_quantity")) * F.col("_tags")
    joined = live.join(lines.select("order_number", "sku", "quantity_ordered", "canceled_quantity"), "order_number")
    if split:
        sums = [F.sum(F.when(one_of("warehouse_code", [w]), rest)).cast(QTY).alias(name) for w, name in split.items()]
    else:
        sums = [F.sum(rest).cast(QTY).alias("quantity")]
    return joined.groupBy("sku").agg(*sums)


def collect_measures(
    members: Sequence[DataFrame], others: Sequence[DataFrame] = (), how: Mapping[str, str] | None = None, key: str = "sku"
) -> DataFrame:
    """One row per key of the population with the total of every quantity, 0 where there is none.

    Every column but the key is a quantity. The keys of ``members`` are the population; ``others`` only add quantities.
    Instead of one join per input, all inputs are stacked and grouped once: a single shuffle of map-side partial sums,
    no fan-out between inputs, and no key too hot for it.
    """
    how = how or {}
    frames = [(df, "1") for df in members] + [(df, "cast(null as int)") for df in others]
    names = list(dict.fromkeys(c for df, _ in frames for c in df.columns if c != key))
    stacked = [
        df.selectExpr(
            f"`{key}`",
            f"{member} as _member",
            *[f"cast({f'`{n}`' if n in df.columns else 'null'} as {QTY}) as `{n}`" for n in names],
        )
        for df, member in frames
    ]
    aggs = {"sum": F.sum, "max": F.max}
    zero = F.lit(0).cast(QTY)
    totals = [F.coalesce(aggs[how.get(n, "sum")](n).cast(QTY), zero).alias(n) for n in names]
    grouped = reduce(DataFrame.union, stacked).groupBy(key).agg(F.max("_member").alias("_member"), *totals)
    return grouped.filter(F.col("_member").isNotNull() & F.col(key).isNotNull()).drop("_member")


def available_to_sell(measures: DataFrame, profile: ChannelProfile) -> DataFrame:
    """Adds ``net`` (may be negative) and ``available`` (whole units, never negative)."""
    out = measures.withColumn("net", profile.net().cast(QTY))
    return out.withColumn("available", F.floor(not_negative("net")).cast("bigint"))


def kit_floor_min(
    kitting: DataFrame, stock: DataFrame, quantity: str = "net", how: str = "inner", alias: str = "kit_available"
) -> DataFrame:
    """Kits that can be built: the smallest whole number over the kit's components.

    ``kitting`` (sku, component_sku, component_quantity); ``stock`` one row per sku. With how='left' a component without
    stock record is skipped, and a kit without any gives null. A component of which the kit takes none is skipped too.
    """
    per_component = stock.select(F.col("sku").alias("component_sku"), F.col(quantity).alias("_stock"))
    parts = join_summary(kitting, per_component, "component_sku", how)
    built = F.floor(not_negative(F.try_divide("_stock", "component_quantity")))
    return parts.groupBy("sku").agg(F.min(built).cast("bigint").alias(alias))


def kit_store_grid(
    kits: DataFrame, items: DataFrame, stores: Sequence[str], measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Every kit component in every listed store, with 0 where the component has no stock record there.

    ``kits`` (sku, component_sku, component_quantity), ``items`` one row per (item_sku, store).
    """
    grid = kits.withColumn("store", F.explode(F.array(*[F.lit(s) for s in stores])))
    stock = items.filter(F.col("store").isin(list(stores))).select(
        F.col("item_sku").alias("component_sku"), "store", *measures
    )
    zero = F.lit(0).cast(QTY)
    return grid.join(stock, ["component_sku", "store"], "left").select(
        *kits.columns, "store", *[F.coalesce(F.col(m).cast(QTY), zero).alias(m) for m in measures]
    )


def kit_quantities_by_store(grid: DataFrame, measures: Sequence[str] = MEASURES) -> DataFrame:
    """Whole kits per (kit, store) for every measure; marketplace components and those of quantity 0 are skipped."""
    built = [F.min(F.floor(F.try_divide(m, "component_quantity"))).cast("bigint").alias(f"calc_{m}") for m in measures]
    kept = grid.filter(~F.lower("component_sku").contains("fba"))
    return kept.groupBy("sku", "store").agg(*built)


def kit_over_product(
    products: DataFrame, kits: DataFrame, product: str = "available", kit: str = "kit_available", kit_skus: bool = True
) -> DataFrame:
    """One total per sku; a kit's own figure beats the figure of a product with the same sku.

    Both sides have one row per sku and are stacked and grouped, which takes the place of a full outer join.
    ``kit_skus=False`` leaves out kits that are not products as well.
    """
    both = products.select(
        "sku", F.col(product).alias("_p"), F.lit(None).cast("bigint").alias("_k"), F.lit(1).alias("_product")
    ).union(kits.select("sku", F.lit(None).cast("bigint"), F.col(kit), F.lit(None).cast("int")))
    totals = both.groupBy("sku").agg(
        F.coalesce(F.max("_k"), F.max("_p")).alias("total_inventory"), F.max("_product").alias("_product")
    )
    return (totals if kit_skus else totals.filter(F.col("_product").isNotNull())).drop("_product")


def for_listed(totals: DataFrame, listed: DataFrame) -> DataFrame:
    """Totals of the skus that are listed."""
    return join_summary(totals, distinct_keys(listed, "sku"), "sku", "left_semi")


def listed_variants(
    variants: DataFrame, location_map: DataFrame, location: str, not_environment: str | None = None
) -> DataFrame:
    """Storefront variants stocked at a location, optionally outside one environment."""
    at = distinct_keys(location_map.filter(one_of("id", [location])).select(F.col("parentid").alias("id")), "id")
    kept = variants if not_environment is None else variants.filter(~one_of("environment", [not_environment]))
    return join_summary(kept, at, "id", "left_semi")
