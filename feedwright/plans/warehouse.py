"""Order-system stock and locations against the item system."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .check import check

LOG_KEYS = ["sku", "warehouse", "previouslocation", "newlocation", "programid", "executionid", "istestrun"]
HH_WAREHOUSES = ["HHH", "HTOOL"]
LEH_WAREHOUSES = ["LHAK", "LHAD"]
OLD_STORES = ["1", "2", "7", "8"]


@check("duplicate_location_log", "warehouse", "NO01", "audit")
def duplicate_location_log(s: Sources, since: datetime | None = None) -> DataFrame:
    """Location changes logged more than once, optionally only after a moment."""
    where = None if since is None else F.col("changedat") > F.lit(since.isoformat(sep=" ")).cast("timestamp_ntz")
    return op.duplicate_groups(s["location_change_log"], LOG_KEYS, where)


@check("location_log", "warehouse", "NO01", "listing")
def location_log(s: Sources) -> DataFrame:
    """The change log, newest first."""
    return s["location_change_log"].orderBy(F.col("changedat").desc())


def _stocked(s: Sources, keep_null_kit: bool) -> DataFrame:
    return op.stocked_skus(s["order_sku"], s["product"], s["product_type"], fv.PRODUCT_KIT_CODES, keep_null_kit)


def _sides(s: Sources) -> tuple[DataFrame, DataFrame]:
    expected = op.expected_locations(s["item_store"], fv.STORES_WITH_LOCATIONS)
    return expected, op.stored_locations(s["product_location"], _stocked(s, keep_null_kit=True))


def _mismatches(s: Sources) -> DataFrame:
    expected, found = _sides(s)
    return op.location_reconcile(op.match_locations(expected, found), op.multi_location_skus(expected, found))


@check("location_mismatches", "warehouse", "NO02")
def location_mismatches(s: Sources) -> DataFrame:
    """Location or free quantity differs between the systems; run before and after an update."""
    return _mismatches(s)


@check("multi_location_skus", "warehouse", "NO02", "audit")
def multi_location_skus(s: Sources) -> DataFrame:
    """Skus the order system keeps in several places for the same store."""
    return op.multi_location_skus(*_sides(s)).select("sku", "store")


@check("location_changes_logged", "warehouse", "NO02", "listing")
def location_changes_logged(s: Sources) -> DataFrame:
    """Location mismatches beside what the update logged."""
    return op.change_log_match(_mismatches(s), s["location_change_log"])


def _old_expected(s: Sources) -> DataFrame:
    return op.expected_locations(
        s["item_store"], OLD_STORES, department_stores=None, net_committed=False, vendor_rule=True
    ).withColumn("place", fn.fold("expected_location"))


@check("stock_totals_v1", "warehouse", "NO03")
def stock_totals_v1(s: Sources) -> DataFrame:
    """Whole quantity on hand against the warehouse total, for items with a known location."""
    rows = _old_expected(s)
    places = s["product_location"].select(
        F.upper(F.trim("sku")).alias("sku"), "warehouse_code", fn.fold("location_type").alias("place")
    )
    own = op.only_in(rows.filter(fn.one_of("warehouse_code", HH_WAREHOUSES)), places, ["sku", "warehouse_code", "place"])
    other = op.only_in(rows.filter(fn.one_of("warehouse_code", LEH_WAREHOUSES)), places, "sku")
    totals = s["product_warehouse"].select("sku", "warehouse_code", "product_total_quantity")
    found = own.unionByName(other).join(totals, ["sku", "warehouse_code"])
    return op.quantity_reconcile(found, "product_total_quantity")


@check("stock_locations_v2", "warehouse", "NO04")
def stock_locations_v2(s: Sources) -> DataFrame:
    """Whole quantity on hand against the location quantity, for stocked skus that are no product kits."""
    places = s["product_location"].select(
        F.upper(F.trim("sku")).alias("sku"), "warehouse_code", fn.fold("location_type").alias("place"), "product_quantity"
    )
    places = op.only_in(places, _stocked(s, keep_null_kit=False), "sku")
    rows = _old_expected(s)
    own = rows.filter(fn.one_of("warehouse_code", HH_WAREHOUSES)).join(places, ["sku", "warehouse_code", "place"])
    other = rows.filter(fn.one_of("warehouse_code", LEH_WAREHOUSES)).join(places.drop("place"), ["sku", "warehouse_code"])
    return op.quantity_reconcile(own.unionByName(other), "product_quantity")
