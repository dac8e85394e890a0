"""Appliance feed checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..operators import Pair
from ..sources import Sources
from .check import check
from .common import active_appliance_skus, brand_codes, catalog_appliances, catalog_by_identifier, latest_appliances

MONEY = "decimal(18,2)"


@check("appliance_coverage", "appliance", "AF01", "audit")
def appliance_coverage(s: Sources) -> DataFrame:
    """Eligible appliances (active newest record, or in the catalog and not archived) that the feed lacks."""
    parts = {"newest": latest_appliances(s, obsolete=False), "catalog": catalog_appliances(s)}
    eligible = op.eligible_population(parts, mode="keys")
    fed = s["appliance_feed"].select(F.col("identifier").alias("sku"))
    return op.coverage_gap(eligible, fed, "sku", s["appliance"].select("sku", "obsoletedate"))


@check("appliance_code_flag", "appliance", "AF02")
def appliance_code_flag(s: Sources) -> DataFrame:
    """The 'no code exists' flag against what is known: false for the coded brand or with a catalog code."""
    brand = brand_codes(s)
    others = op.exclude(s["appliance"].select("sku", "obsoletedate"), brand, "sku")
    known = brand.select("sku", "obsoletedate", F.lit(True).alias("coded")).union(
        others.withColumn("coded", F.lit(False))
    )
    catalog = catalog_by_identifier(s, "upc", "upc_no_exist", "status").filter(fn.none_of("status", fv.ARCHIVED))
    calculated = fn.coalesce_flag(~(F.col("coded") | F.col("upc").isNotNull()))
    rows = known.join(catalog, "sku").withColumn("calculated_flag", calculated)
    out = op.flag_pairs(rows, [Pair("flag_check", "calculated_flag", fn.fold("upc_no_exist"))])
    return out.select("sku", "obsoletedate", "upc", "calculated_flag", "upc_no_exist", "flag_check")


@check("appliance_not_archived", "appliance", "AF03", "audit")
def appliance_not_archived(s: Sources) -> DataFrame:
    """Obsolete appliances that the catalog has not archived."""
    live = s["catalog"].select("sku", "status").filter(fn.none_of("status", fv.ARCHIVED))
    return live.join(latest_appliances(s, obsolete=True).select("sku", "obsoletedate"), "sku")


@check("appliance_create_date", "appliance", "AF04")
def appliance_create_date(s: Sources) -> DataFrame:
    """Create date in the catalog against the earliest appliance record."""
    parts = {"active": active_appliance_skus(s), "catalog": catalog_appliances(s)}
    first = s["appliance"].groupBy("sku").agg(F.min(F.col("insertdate").cast("date")).alias("first_insert"))
    eligible = op.join_summary(op.eligible_population(parts, mode="keys"), first, "sku", "left")
    actual = catalog_by_identifier(s, "erp_sku_create_date")
    return op.reconcile(eligible, actual, "sku", [Pair("date_check", "erp_sku_create_date", "first_insert")], "left")


@check("appliance_codes", "appliance", "AF05")
def appliance_codes(s: Sources) -> DataFrame:
    """Catalog codes against the brand's own codes."""
    catalog = catalog_by_identifier(s, "upc", "status").filter(fn.none_of("status", fv.ARCHIVED)).drop("status")
    return op.reconcile(brand_codes(s).drop("obsoletedate"), catalog, "sku", [Pair("code_check", "upc", "brand_code")])


@check("appliance_source", "appliance", "AF06")
def appliance_source(s: Sources, obsolete: bool = True) -> DataFrame:
    """Newest appliance records (obsolete ones by default) whose catalog row names another data source."""
    catalog = catalog_by_identifier(s, "data_source", "web_website_hh", "status")
    other = catalog.filter(fn.none_of("data_source", [fv.APPLIANCE_SOURCE]))
    return latest_appliances(s, obsolete).select("sku").join(other, "sku")


@check("appliance_stores", "appliance", "AF07")
def appliance_stores(s: Sources) -> DataFrame:
    """Active appliances not sold in exactly the appliance stores."""
    catalog = catalog_by_identifier(s, "in_stores").filter(fn.none_of("in_stores", [fv.APPLIANCE_STORES_TEXT]))
    return latest_appliances(s, obsolete=False).select("sku").join(catalog, "sku")


def _hierarchy(s: Sources) -> DataFrame:
    price = fn.price_hierarchy("umrp", "msrp", "calculatedcost", "map").cast(MONEY)
    return latest_appliances(s).select("sku", price.alias("list_price"), fn.sale_mark("umrp").alias("sale_mark"))


@check("appliance_prices", "appliance", "AF08")
def appliance_prices(s: Sources) -> DataFrame:
    """Catalog price against the price hierarchy."""
    catalog = catalog_by_identifier(s, "retail_price_website_hh", "status").filter(fn.none_of("status", fv.ARCHIVED))
    actual = catalog.select("sku", fn.decode_money("retail_price_website_hh").alias("catalog_price"))
    pairs = [Pair("price_check", "list_price", "catalog_price")]
    return op.reconcile(_hierarchy(s), actual, "sku", pairs, distinct=True)


@check("appliance_inventory_tracked", "appliance", "AF09")
def appliance_inventory_tracked(s: Sources) -> DataFrame:
    """Appliances whose stock the storefront does not track."""
    rows = catalog_appliances(s).filter(fn.none_of("inventory_tracked", ["true"]))
    return rows.select("identifier", "inventory_tracked", "status")


@check("appliance_physical", "appliance", "AF10")
def appliance_physical(s: Sources) -> DataFrame:
    """Appliances not marked as physical goods."""
    return catalog_appliances(s).filter(fn.none_of("physical", ["true"])).select("identifier", "physical", "status")


@check("appliance_types", "appliance", "AF11")
def appliance_types(s: Sources) -> DataFrame:
    """Catalog type code against the mapped appliance class."""
    types = s["type_map"].select(fn.fold("type").alias("type_key"), F.col("code").alias("mapped_code"))
    classes = s["appliance_class"].select("apid", F.col("type").alias("appliance_class"), fn.fold("type").alias("type_key"))
    mapped = latest_appliances(s).select("sku", "apid").join(classes, "apid").join(types, "type_key")
    catalog = catalog_appliances(s).select(
        F.trim("identifier").alias("sku"), "data_source", fn.decode_code("appliance_type").alias("type_code")
    )
    rows = catalog.join(mapped.select("sku", "appliance_class", "mapped_code"), "sku", "left")
    pairs = [Pair("type_check", fn.fold("type_code"), fn.fold("mapped_code"), "null_as", "")]
    return op.flag_pairs(rows, pairs)


@check("appliance_feed_prices", "appliance", "AF12")
def appliance_feed_prices(s: Sources) -> DataFrame:
    """Feed prices: list price from the hierarchy; retail is the sale price if there is one, else the list price."""
    feed = s["appliance_feed"].filter(fn.none_of("status", ["archived"])).select(
        F.col("identifier").alias("sku"), F.col("retail_price").alias("feed_retail"), F.col("list_price").alias("feed_list")
    )
    sales = s["appliance_feed"].select(F.col("identifier").alias("sku"), "sale_price")
    ruled = _hierarchy(s).drop("sale_mark").join(sales, "sku", "left")
    ruled = ruled.withColumn("retail_price", F.coalesce(fn.cascade_first_nonzero("sale_price"), "list_price"))
    ruled = ruled.withColumn("sale_price", F.coalesce("sale_price", F.lit(0).cast(MONEY)))
    pairs = [Pair("retail_check", "retail_price", "feed_retail"), Pair("list_check", "list_price", "feed_list")]
    return op.reconcile(feed, ruled, "sku", pairs, "left", distinct=True)


@check("appliance_catalog_prices", "appliance", "AF12")
def appliance_catalog_prices(s: Sources, scope: str = "website_hh") -> DataFrame:
    """Feed prices against the catalog: retail from its money text, list price from its JSON document."""
    feed = s["appliance_feed"].select(
        F.col("identifier").alias("sku"),
        "sale_price",
        F.col("retail_price").alias("feed_retail"),
        F.col("list_price").alias("feed_list"),
    )
    catalog = catalog_by_identifier(s, "retail_price_website_hh", "status").filter(fn.none_of("status", fv.ARCHIVED))
    catalog = catalog.select("sku", fn.decode_money("retail_price_website_hh").alias("catalog_retail"))
    lists = op.json_scope_extract(s["catalog_json"], "identifier", "list_price", scope).select(
        F.col("identifier").alias("sku"), F.col("amount").try_cast(MONEY).alias("catalog_list")
    )
    rows = feed.join(catalog, "sku").join(lists, "sku", "left")
    pairs = [Pair("retail_check", "feed_retail", "catalog_retail"), Pair("list_check", "feed_list", "catalog_list")]
    return op.flag_pairs(rows, pairs).distinct()


@check("appliance_web_flag", "appliance", "AF13")
def appliance_web_flag(s: Sources) -> DataFrame:
    """Website flag: off when obsolete, on with any online store flag or no item record, otherwise off."""
    items = s["item_store"].filter(fn.one_of("store", ["1", "2", "4"])).select(
        F.trim("item_number").alias("sku"), F.upper(F.trim("web_flag")).alias("flag")
    )
    flags = items.groupBy("sku").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    newest = latest_appliances(s).select("sku", "obsoletedate").distinct()
    rows = op.join_summary(newest, flags, "sku", "left")
    online = F.arrays_overlap("flags", F.array(*[F.lit(f) for f in fv.WEB_FLAGS]))
    none = F.coalesce(F.size("flags"), F.lit(0)) <= 0
    on = F.col("obsoletedate").isNull() & (F.coalesce(online, F.lit(False)) | none)
    text = F.when(~none, F.array_join("flags", ",")).alias("web_flags")
    rows = rows.select("sku", "obsoletedate", text, fn.coalesce_flag(on).alias("web"))
    catalog = catalog_by_identifier(s, "web_website_hh")
    return op.reconcile(rows, catalog, "sku", [Pair("web_check", "web", fn.fold("web_website_hh"))])
