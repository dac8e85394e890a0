"""Frames that several checks start from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .stages import stage


@stage("newest_appliances")
def newest_appliances(s: Sources) -> DataFrame:
    """Newest record of every appliance; a tie keeps all."""
    return op.latest_record(s["appliance"], "sku", ["updatedate", "insertdate"])


@stage("items")
def items(s: Sources) -> DataFrame:
    """Item-store rows, one per store, with their normalised sku and their own."""
    return s["item_store"].withColumn("sku", fn.normalize_sku("item_number")).withColumn("item_sku", F.trim("item_number"))


@stage("stock_items", needs=("items",))
def stock_items(s: Sources) -> DataFrame:
    """Item-store rows, one per store, by their own sku."""
    return items(s).withColumn("sku", F.col("item_sku")).drop("item_sku")


@stage("catalog")
def catalog(s: Sources) -> DataFrame:
    """Catalog rows with trimmed keys."""
    return s["catalog"].withColumns({"sku": F.trim("sku"), "identifier": F.trim("identifier")})


@stage("order_kits")
def order_kits(s: Sources) -> DataFrame:
    """Normalised skus of active kits, one row per component."""
    return op.active_kits(s["kitting"], s["order_sku"])


def latest_appliances(s: Sources, obsolete: bool | None = None) -> DataFrame:
    """Newest appliance records, optionally only obsolete or only active ones."""
    rows = newest_appliances(s)
    if obsolete is None:
        return rows
    return rows.filter(F.col("obsoletedate").isNotNull() if obsolete else F.col("obsoletedate").isNull())


def active_appliance_skus(s: Sources) -> DataFrame:
    return op.distinct_keys(s["appliance"].filter(F.col("obsoletedate").isNull()), "sku")


def catalog_appliances(s: Sources, archived: Sequence[str] = fv.ARCHIVED) -> DataFrame:
    """Catalog rows fed by the appliance source that are not archived."""
    return s["catalog"].filter(fn.one_of("data_source", [fv.APPLIANCE_SOURCE]) & fn.none_of("status", archived))


def brand_codes(s: Sources) -> DataFrame:
    """(sku, brand_code, obsoletedate) of the brand whose codes come as a text specification."""
    specs = s["appliance_spec"].filter(fn.fold("specvalue").contains("upc")).select(
        "apid", F.regexp_replace("specvalue", f"(?i){fv.BRAND_CODE_PREFIX}", "").alias("brand_code")
    )
    units = s["appliance"].filter(fn.one_of("manufacturerid", [fv.BRAND_MANUFACTURER])).select("sku", "apid", "obsoletedate")
    return units.join(specs, "apid").select("sku", "brand_code", "obsoletedate")


def item_rows(s: Sources, stores: Sequence[str], flags: Sequence[str] | None = fv.WEB_FLAGS) -> DataFrame:
    """Item-store rows of some stores with their normalised sku, optionally only those sold online."""
    rows = items(s).filter(fn.one_of("store", stores))
    return rows if flags is None else rows.filter(fn.one_of("web_flag", flags))


def online_item_skus(s: Sources, without_kits: bool = False, stores: Sequence[str] = fv.PRODUCT_STORES_ANY) -> DataFrame:
    """Normalised skus of items sold online, one row per item-store row; optionally without items that are kits."""
    skus = item_rows(s, stores).select("sku", "item_sku")
    if without_kits:
        kits = s["kitting"].select(F.trim("sku").alias("item_sku"))
        skus = op.exclude(skus, kits, "item_sku")
    return skus.select("sku")


def catalog_skus(s: Sources, sources: Sequence[str], rentals: bool = True) -> DataFrame:
    return op.catalog_rows(catalog(s), sources, rentals).select("sku")


@stage("product_keys", needs=("items", "catalog"))
def product_keys(s: Sources) -> DataFrame:
    """Skus sold online that are no kits, and those of the catalog's own products, once each."""
    parts = {"item": online_item_skus(s, without_kits=True), "catalog": catalog_skus(s, [fv.ITEM_SOURCE])}
    return op.eligible_population(parts, mode="keys")


def catalog_by_sku(s: Sources, *columns: str) -> DataFrame:
    return catalog(s).select("sku", *columns)


def catalog_by_identifier(s: Sources, *columns: str) -> DataFrame:
    return catalog(s).select(F.col("identifier").alias("sku"), *columns)


def feed_skus(s: Sources) -> DataFrame:
    return s["product_feed"].select(F.trim("identifier").alias("sku"))
