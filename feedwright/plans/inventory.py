"""What each sales location may offer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..operators import inventory as inv
from ..sources import Sources
from .check import check
from .common import active_appliance_skus, stock_items
from .stages import stage

NOT_LIVE = "production"


@stage("pending")
def pending_by_sku(s: Sources) -> DataFrame:
    """Marketplace pending quantity per own sku."""
    return op.alias_resolved_sum(s["amazon_pending"], s["sku_xref"])


def _stock(s: Sources, profile: inv.ChannelProfile, store: str, warehouse: str | None) -> DataFrame:
    """Offer of one location, one row per sku of its population (its items and the active appliances).

    Only the inputs that the location's profile names are read.
    """
    items = stock_items(s).filter(fn.one_of("store", [store])).select(
        "sku",
        F.col("quantity_on_hand").alias("on_hand"),
        F.col("committed_quantity").alias("committed"),
        F.col("safety_stock").alias("safety"),
    )
    appliances = s["appliance"].filter(F.col("obsoletedate").isNull()).select("sku", "stock_pit").distinct()
    others = []
    if "reserve" in profile.inputs:
        reserve = s["product_warehouse"].filter(F.col("warehouse_code") == "HHH")
        others.append(reserve.select("sku", F.col("product_reserve_quantity").alias("reserve")))
    if "pending" in profile.inputs:
        others.append(pending_by_sku(s).withColumnRenamed("quantity", "pending"))
    if "open_orders" in profile.inputs:
        orders = op.open_order_qty(
            s["sales_order"], s["order_udf"], s["line_item"], ["hhcv3"], fv.CLOSED_ORDER_STATUSES, warehouse
        )
        others.append(orders.withColumnRenamed("quantity", "open_orders"))
    return op.available_to_sell(op.collect_measures([items, appliances], others, {"reserve": "max"}), profile)


def _kitting(s: Sources) -> DataFrame:
    return s["kitting"].select("sku", "component_sku", "component_quantity")


@stage("stock_hh_v1", needs=("stock_items", "pending"))
def stock_hh_v1(s: Sources) -> DataFrame:
    return _stock(s, inv.HH_V1, "1", None)


@stage("stock_hh_v2", needs=("stock_items", "pending"))
def stock_hh_v2(s: Sources) -> DataFrame:
    return _stock(s, inv.HH_V2, "1", "HHH")


@stage("stock_mf_v1", needs=("stock_items", "pending"))
def stock_mf_v1(s: Sources) -> DataFrame:
    return _stock(s, inv.MF_V1, "4", None)


@stage("stock_mf_v2", needs=("stock_items", "pending"))
def stock_mf_v2(s: Sources) -> DataFrame:
    return _stock(s, inv.MF_V2, "4", None)


def _totals(s: Sources, profile: inv.ChannelProfile, stock: DataFrame, kit_skus: bool) -> DataFrame:
    return op.kit_over_product(stock, op.kit_floor_min(_kitting(s), stock, how=profile.kits), kit_skus=kit_skus)


def _listed(s: Sources, location: str, live_too: bool) -> DataFrame:
    return op.listed_variants(s["variant"], s["location_map"], location, None if live_too else NOT_LIVE)


@check("listed_skus", "inventory", "IV01", "listing")
def listed_skus(s: Sources, location: str = fv.LOCATION_MF) -> DataFrame:
    """Variants outside production at a location that are items, active appliances or kits."""
    items = stock_items(s).filter(fn.one_of("store", fv.STORES_WITH_LOCATIONS)).select("sku")
    parts = {"item": items, "appliance": active_appliance_skus(s), "kit": s["kitting"]}
    variants = op.listed_variants(s["variant"], s["location_map"], location, NOT_LIVE)
    kept = op.only_in(variants, op.eligible_population(parts, mode="keys"), "sku")
    return kept.select("sku", "environment", "store", F.lit(location).alias("location")).distinct()


@check("hh_inventory_v1", "inventory", "IV02", "listing")
def hh_inventory_v1(s: Sources) -> DataFrame:
    """Offer at the main location: all open orders come back, kits only over components with stock."""
    return op.for_listed(_totals(s, inv.HH_V1, stock_hh_v1(s), kit_skus=False), _listed(s, fv.LOCATION_HH, live_too=False))


@check("hh_inventory", "inventory", "IV03", "listing")
def hh_inventory(s: Sources) -> DataFrame:
    """Offer at the main location: its own warehouse's open orders come back, supplier stock never negative."""
    totals = _totals(s, inv.HH_V2, stock_hh_v2(s), kit_skus=True)
    return op.for_listed(totals, _listed(s, fv.LOCATION_HH, live_too=True))


@check("mf_inventory_v1", "inventory", "IV05", "listing")
def mf_inventory_v1(s: Sources) -> DataFrame:
    """Offer at the second location: no reserve, no open orders. Listed skus without stock give one empty row."""
    listed = op.distinct_keys(_listed(s, fv.LOCATION_MF, live_too=False), "sku")
    totals = _totals(s, inv.MF_V1, stock_mf_v1(s), kit_skus=False).withColumn("stocked_sku", F.col("sku"))
    out = op.join_summary(listed, totals, "sku", "left")
    return out.select(F.col("stocked_sku").alias("sku"), "total_inventory").distinct()


@check("mf_inventory", "inventory", "IV06", "listing")
def mf_inventory(s: Sources) -> DataFrame:
    """Offer at the second location with supplier stock never negative, kit skus included."""
    return op.for_listed(_totals(s, inv.MF_V2, stock_mf_v2(s), kit_skus=True), _listed(s, fv.LOCATION_MF, live_too=True))


@stage("free_by_store", needs=("stock_items",))
def free_stock_by_store(s: Sources) -> DataFrame:
    """Free quantity per sku in the three shop stores."""
    zero = F.lit(0).cast(inv.QTY)
    free = F.coalesce("quantity_on_hand", zero) - F.coalesce("committed_quantity", zero)
    # The main store keeps its safety stock and two more units back.
    free = F.when(fn.one_of("store", ["1"]), free - F.coalesce("safety_stock", zero) - 2).otherwise(free)
    rows = stock_items(s).filter(~fn.fold("sku").startswith("zz"))
    return op.store_pivot(rows.withColumn("free", free), "sku", "store", ["1", "2", "8"], {"free": ("max", "free")})


_SPLIT = {warehouse: f"st{store}_open" for warehouse, store in fv.WAREHOUSE_STORE.items()}


@stage("shop_open_orders")
def shop_open_orders(s: Sources) -> DataFrame:
    """Open storefront quantity per sku and store."""
    return op.open_order_qty(
        s["sales_order"], s["order_udf"], s["line_item"], fv.SHOP_ORDER_CODES, fv.CLOSED_ORDER_STATUSES, split=_SPLIT
    )


@stage("reserve_by_store")
def reserve_by_store(s: Sources) -> DataFrame:
    """Reserved quantity per sku and store."""
    rows = s["product_warehouse"].withColumn("store", fn.code_map("warehouse_code", fv.WAREHOUSE_STORE))
    stores = list(fv.WAREHOUSE_STORE.values())
    return op.store_pivot(rows, "sku", "store", stores, {"reserve": ("max", "product_reserve_quantity")})


@stage("shop_stock", needs=("free_by_store", "shop_open_orders", "reserve_by_store", "pending"))
def _shop_stock(s: Sources) -> DataFrame:
    """Per sku: each store's free stock less reserve plus open orders (never negative), summed, less pending."""
    pending = pending_by_sku(s).withColumnRenamed("quantity", "pending")
    m = op.collect_measures([free_stock_by_store(s)], [shop_open_orders(s), reserve_by_store(s), pending])
    stores = [
        fn.not_negative(F.col(f"st{st}_free") - F.col(f"st{st}_reserve") + F.col(f"st{st}_open")) for st in ("1", "2", "8")
    ]
    total = F.floor(stores[0] + stores[1] + stores[2] - F.col("pending")).cast("bigint")
    return m.select("sku", fn.not_negative(total).cast("bigint").alias("available"))


@check("shop_inventory", "inventory", "IV07", "listing")
def shop_inventory(s: Sources, sku: str | None = None) -> DataFrame:
    """Offer of the storefront's own location, over three stores; optionally for one sku."""
    stock = _shop_stock(s)
    kits = op.kit_floor_min(_kitting(s), stock, "available", "left")
    out = op.for_listed(op.kit_over_product(stock, kits), _listed(s, fv.LOCATION_SHOP, live_too=True))
    return out if sku is None else out.filter(F.col("sku") == sku.upper())


@check("hk_inventory", "inventory", "IV04", "listing")
def hk_inventory(s: Sources) -> DataFrame:
    """Offer of the second company's items: two stores less reserve and pending, plus the shop's own pending orders."""
    zero = F.lit(0).cast(inv.QTY)
    items = s["hk_item_store"].withColumn("sku", F.trim("item_number"))
    reserve = s["product_warehouse"].filter(fn.one_of("warehouse_code", ["HHH", "HTOOL"])).select(
        "sku", fn.code_map("warehouse_code", fv.WAREHOUSE_STORE).alias("store"), F.coalesce("product_reserve_quantity", zero).alias("_r")
    )
    free = F.coalesce("quantity_on_hand", zero) - F.coalesce("committed_quantity", zero)
    free = F.when(fn.one_of("store", ["1"]), free - F.coalesce("safety_stock", zero)).otherwise(free)
    # The reserve only counts where the store has the item.
    rows = items.filter(fn.one_of("store", ["1", "2"])).withColumn("free", free).join(reserve, ["sku", "store"], "left")
    net = rows.select("sku", (F.col("free") - F.coalesce("_r", zero)).alias("quantity"))
    pending = pending_by_sku(s).withColumnRenamed("quantity", "pending")
    shop = s["shop_pending"].withColumnRenamed("quantity", "shop")
    m = op.collect_measures([s["hk_item"]], [net.withColumnRenamed("quantity", "net"), pending, shop])
    total = fn.not_negative(F.col("net") - F.col("pending") + F.col("shop")).cast(inv.QTY)
    return op.only_in(m.select("sku", total.alias("total_inventory")), s["variant"], "sku")
