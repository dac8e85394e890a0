"""Warehouse location and quantity against the order system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import (
    DEPARTMENT_LOCATION_STORES,
    EXCLUDED_MARKETPLACE_VENDORS,
    EXCLUDED_VENDORS,
    MARKETPLACE_STORE,
    MARKETPLACE_WAREHOUSE,
    STORE_WAREHOUSE,
)
from ..functions import agree, code_map, fold, none_of, not_negative, one_of
from .keys import distinct_keys, join_summary, left_many
from .population import exclude
from .reconcile import Pair, flag_pairs


def expected_locations(
    items: DataFrame,
    stores: Sequence[str],
    department_stores: Sequence[str] | None = DEPARTMENT_LOCATION_STORES,
    net_committed: bool = True,
    vendor_rule: bool = False,
) -> DataFrame:
    """Where each item should lie and how many are free, per store; the marketplace store gets its own '-FBA' sku.

    ``department_stores``: stores whose location reads department-code (None = all). ``vendor_rule`` leaves out the
    vendors that ship from elsewhere.
    """
    zero = F.lit(0).cast("decimal(18,4)")
    on_hand = F.coalesce(F.col("quantity_on_hand"), zero)
    free = on_hand - F.coalesce(F.col("committed_quantity"), zero) if net_committed else on_hand
    # Text joined the way the source system does: a null part counts as empty.
    coded = F.concat(F.coalesce("department", F.lit("")), F.lit("-"), F.coalesce("location_code", F.lit("")))
    with_department = F.lit(True) if department_stores is None else one_of("store", department_stores)
    sku, market = F.trim("item_number"), fold("store") == MARKETPLACE_STORE.lower()
    regular = one_of("store", stores)
    if vendor_rule:
        regular = regular & ~fold(sku).startswith("zz") & none_of("primary_vendor", EXCLUDED_VENDORS)
        kept = regular | (market & none_of("primary_vendor", EXCLUDED_MARKETPLACE_VENDORS))
    else:
        kept = ((regular & (fold(sku) != "$due")) | market) & ~fold(sku).startswith("zz")
    return items.filter(kept).select(
        F.when(market, F.concat(F.upper(sku), F.lit("-FBA"))).otherwise(F.upper(sku)).alias("sku"),
        F.when(with_department, coded).otherwise(F.col("location_code")).alias("expected_location"),
        F.when(market, F.lit(MARKETPLACE_WAREHOUSE)).otherwise(code_map("store", STORE_WAREHOUSE)).alias("warehouse_code"),
        not_negative(free).cast("decimal(18,4)").alias("free"),
        "store",
    )


def stocked_skus(
    order_skus: DataFrame, products: DataFrame, types: DataFrame, kit_codes: Sequence[str], keep_null_kit: bool
) -> DataFrame:
    """Skus that the order system keeps stock of: inventory product types, no product kits."""
    kept_types = distinct_keys(types.filter(one_of("inventory_flag", ["y"])), "product_type_code")
    kept = join_summary(products, kept_types, "product_type_code", "left_semi")
    skus = order_skus.filter(none_of("kit_code", kit_codes, keep_null=keep_null_kit))
    return join_summary(skus, distinct_keys(kept, "product_number"), "product_number", "left_semi").select(
        F.upper(F.trim("sku")).alias("sku")
    )


def stored_locations(actual: DataFrame, stocked: DataFrame | None = None) -> DataFrame:
    """The order system's location rows, optionally only of the stocked skus."""
    found = actual.select(
        F.upper(F.trim("sku")).alias("sku"),
        "warehouse_code",
        F.col("location_type").alias("actual_location"),
        F.col("product_quantity").alias("actual_quantity"),
    )
    return found if stocked is None else join_summary(found, distinct_keys(stocked, "sku"), "sku", "left_semi")


def match_locations(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Expected rows beside the stored location rows of the same sku and warehouse."""
    return expected.join(found, ["sku", "warehouse_code"])


def multi_location_skus(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(sku, store) pairs that the order system keeps in more than one place.

    The places are counted on the location rows alone; only the few pairs with several meet the expected rows.
    """
    places = (
        found.groupBy("sku", "warehouse_code")
        .agg(F.countDistinct(fold("actual_location")).alias("locations"))
        .filter(F.col("locations") > 1)
    )
    pairs = distinct_keys(expected, ["sku", "warehouse_code", "store"])
    return pairs.join(places, ["sku", "warehouse_code"]).select("sku", "store", "locations")


def location_reconcile(matched: DataFrame, multiples: DataFrame | None = None) -> DataFrame:
    """Rows whose location or whole free quantity differs; a blank expected location is accepted.

    A sku with several locations in any store is left out in every store.
    """
    rows = matched if multiples is None else exclude(matched, multiples, "sku")
    blank = F.rtrim("expected_location") == ""
    same_place = F.when((fold("expected_location") == fold("actual_location")) | blank, F.lit("true"))
    whole = F.floor("free").cast("bigint")
    out = rows.select(
        "sku",
        "store",
        "warehouse_code",
        "expected_location",
        "actual_location",
        whole.alias("free_quantity"),
        "actual_quantity",
        same_place.otherwise(F.lit("false")).alias("location_check"),
        agree(whole, F.col("actual_quantity")).alias("quantity_check"),
    )
    return out.filter((F.col("location_check") == "false") | (F.col("quantity_check") == "false")).distinct()


def quantity_reconcile(matched: DataFrame, quantity: str) -> DataFrame:
    """Rows whose whole free quantity differs from the stored one, location aside."""
    rows = matched.select(
        "sku", "store", "warehouse_code", F.floor("free").cast("bigint").alias("free_quantity"), F.col(quantity)
    )
    return flag_pairs(rows, [Pair("quantity_check", "free_quantity", quantity)]).distinct()


def change_log_match(mismatches: DataFrame, log: DataFrame) -> DataFrame:
    """Location mismatches seen before a run, beside what the run logged for the sku (if anything)."""
    moved = mismatches.filter(fold("expected_location") != fold("actual_location")).select(
        "sku", "expected_location", "actual_location"
    )
    logged = log.select(F.upper(F.trim("sku")).alias("sku"), "warehouse", "previouslocation", "newlocation", "changedat")
    return left_many(moved, logged, "sku")
