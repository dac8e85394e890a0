"""Frequently asked data questions and one manufacturer's skus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .check import check
from .common import stock_items
from .inventory import free_stock_by_store, pending_by_sku, reserve_by_store, shop_open_orders

_OFFER = ["sku", "store", "manufacturer", "quantity_on_hand", "discontinued", "closeout"]


def _brand_items(s: Sources, manufacturers: Sequence[str], stores: Sequence[str]) -> DataFrame:
    rows = stock_items(s).filter(fn.one_of("manufacturer", manufacturers) & fn.one_of("store", stores))
    return rows.filter(~fn.fold("sku").contains("zz"))


def _stocked_or_current() -> Column:
    return fn.none_of("discontinued", ["Y"]) | (F.coalesce("quantity_on_hand", F.lit(0)) > 0)


@check("brand_store_gap", "adhoc", "FT01", "audit")
def brand_store_gap(s: Sources, manufacturers: Sequence[str] = ("fest",)) -> DataFrame:
    """A brand's items offered in store 1 but not in store 2; each store has its own rule."""
    current, open_ = fn.none_of("discontinued", ["Y"]), fn.none_of("closeout", ["Y"])
    second = _brand_items(s, manufacturers, ["2"]).filter((current & open_) | (F.col("quantity_on_hand") > 0))
    first = _brand_items(s, manufacturers, ["1"]).filter(current | open_)
    return op.cross_store_difference(first.select(*_OFFER), second)


def _listed_in_sandbox(s: Sources) -> DataFrame:
    products = s["storefront_product"].filter(fn.none_of("status", ["draft"]) & fn.one_of("environment", ["sandbox"]))
    return op.only_in(s["variant"], products.select(F.col("id").alias("product_id")), "product_id")


@check("brand_listed_items", "adhoc", "FT02", "listing")
def brand_listed_items(s: Sources, manufacturers: Sequence[str] = ("fest", "stabl")) -> DataFrame:
    """Listed skus of a brand's current or stocked items."""
    rows = _brand_items(s, manufacturers, ["1", "2"]).filter(_stocked_or_current())
    return op.only_in(op.distinct_keys(rows, "sku"), _listed_in_sandbox(s), "sku")


@check("brand_listed_skus", "adhoc", "FT03", "listing")
def brand_listed_skus(s: Sources, manufacturers: Sequence[str] = ("fest", "05112")) -> DataFrame:
    """Listed skus of a brand's items and of the kits that contain one."""
    rows = _brand_items(s, manufacturers, ["1", "2", "4"]).filter(_stocked_or_current()).select("sku", "manufacturer").distinct()
    parts = s["kitting"].select(F.trim("sku").alias("kit"), F.col("component_sku").alias("sku"))
    kits = parts.join(rows, "sku").select(F.col("kit").alias("sku"), "manufacturer")
    return op.only_in(rows.union(kits).distinct(), _listed_in_sandbox(s), "sku")


@check("item_attributes", "adhoc", "FQ01", "listing")
def item_attributes(s: Sources, skus: Sequence[str] | None = None) -> DataFrame:
    """Item-store attributes of a list of skus, or of all."""
    rows = stock_items(s) if skus is None else stock_items(s).filter(fn.one_of("sku", skus))
    return rows.select("sku", "store", "department", "location_code", "description", "retail_price", "quantity_on_hand")


@check("shared_skus", "adhoc", "FQ02", "listing")
def shared_skus(s: Sources) -> DataFrame:
    """Active kits that also exist as items, with both descriptions."""
    skus = s["order_sku"].filter(fn.none_of("active_flag", ["n"])).select("sku", "active_flag")
    kits = op.only_in(skus, s["kitting"], "sku")
    items = stock_items(s).select("sku", "discontinued", "description").distinct()
    names = s["product"].select(F.upper(F.rtrim("product_number")).alias("sku"), "product_name")
    return kits.join(items, "sku").join(names, "sku").distinct()


@check("pending_by_sku", "adhoc", "FQ03", "listing")
def pending(s: Sources) -> DataFrame:
    """Marketplace pending quantity per own sku."""
    return pending_by_sku(s)


@check("open_orders_by_store", "adhoc", "FQ03", "listing")
def open_orders_by_store(s: Sources) -> DataFrame:
    """Open storefront quantity per sku and store."""
    return shop_open_orders(s)


@check("reserve_by_store", "adhoc", "FQ03", "listing")
def reserve(s: Sources) -> DataFrame:
    """Reserved quantity per sku and store."""
    return reserve_by_store(s)


@check("free_by_store", "adhoc", "FQ03", "listing")
def free_by_store(s: Sources) -> DataFrame:
    """Free quantity per sku in the three shop stores."""
    return free_stock_by_store(s)


@check("store_only_items", "adhoc", "FQ05", "audit")
def store_only_items(s: Sources, have: str = "1", lack: str = "4") -> DataFrame:
    """Items on sale with stock in one store that another store does not keep."""
    rows = stock_items(s)
    offered = rows.filter(
        fn.one_of("store", [have])
        & (F.col("quantity_on_hand") > 0)
        & fn.one_of("discontinued", ["N"])
        & fn.one_of("web_flag", fv.WEB_FLAGS)
    )
    columns = ["sku", "store", "quantity_on_hand", "discontinued", "web_flag"]
    return op.cross_store_difference(offered.select(*columns), rows.filter(fn.one_of("store", [lack])))


@check("sku_presence", "adhoc", "FQ06", "listing")
def sku_presence(s: Sources) -> DataFrame:
    """A list of skus with where each exists: item system (stores, flags) and order system (kit, active flag)."""
    wanted = s["input_sku"]
    items = stock_items(s).filter(fn.one_of("store", ["1", "2", "7", "8"]))
    stores = items.groupBy("sku", "discontinued", "closeout").agg(
        F.array_join(F.array_sort(F.collect_set("store")), ",").alias("stores")
    )
    flags = s["order_sku"].select("sku", F.col("active_flag").alias("kit_active_flag")).distinct()
    kits = op.distinct_keys(s["kitting"], "sku").join(flags, "sku", "left")
    return op.presence_report(wanted, {"items": stores, "kits": kits}).distinct()
