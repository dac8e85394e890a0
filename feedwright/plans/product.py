"""Product feed checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..operators import Pair
from ..operators.inventory import MEASURES, kit_quantities_by_store
from ..sources import Sources
from .check import check
from .common import (
    active_appliance_skus,
    brand_codes,
    catalog,
    catalog_by_identifier,
    catalog_by_sku,
    catalog_skus,
    feed_skus,
    item_rows,
    items,
    latest_appliances,
    online_item_skus,
    order_kits,
    product_keys,
)
from .stages import stage

MONEY = "decimal(18,2)"
CHANNELS = tuple(fv.CHANNEL_STORES)


@check("catalog_kits_unknown", "product", "PF01", "audit")
def catalog_kits_unknown(s: Sources) -> DataFrame:
    """Catalog skus of no other source that the order system has no kit for."""
    skus = catalog(s).filter(fn.none_of("data_source", fv.NOT_KIT_SOURCES)).select("sku")
    return op.exclude(skus, s["kitting"].select(fn.normalize_sku("sku").alias("sku")), "sku")


@check("catalog_items_unknown", "product", "PF02", "audit")
def catalog_items_unknown(s: Sources) -> DataFrame:
    """Catalog skus of no other source that no store has an item for."""
    skus = catalog(s).filter(fn.none_of("data_source", fv.NOT_ITEM_SOURCES)).select("sku")
    return op.exclude(skus, item_rows(s, fv.PRODUCT_STORES_ANY, flags=None), "sku")


@stage("code_listing", needs=("items", "catalog", "order_kits"))
def eligible_codes(s: Sources) -> DataFrame:
    """Eligible products and kits with their codes."""

    def part(df: DataFrame, kind: str, source: str) -> DataFrame:
        return df.select("sku", F.lit(kind).alias("source_kind"), F.lit(source).alias("source"))

    population = (
        part(online_item_skus(s), "item", "Eagle")
        .union(part(catalog_skus(s, [fv.ITEM_SOURCE]), "item", "Eagle"))
        .union(part(order_kits(s), "kit", fv.KIT_SOURCE))
        .union(part(catalog_skus(s, [fv.KIT_SOURCE]), "kit", fv.KIT_SOURCE))
    )
    item_codes = s["item_upc"].withColumn("sku", F.trim("sku"))
    return op.upc_listing(population, item_codes, s["kit_upc"].withColumn("sku", F.trim("sku")))


@check("code_listing", "product", "PF03", "listing")
def code_listing(s: Sources) -> DataFrame:
    """Every eligible product and kit with its codes."""
    return eligible_codes(s)


@check("codes_without_primary", "product", "PF07", "audit")
def codes_without_primary(s: Sources) -> DataFrame:
    """Eligible products that have no primary code."""
    return op.missing_primary(eligible_codes(s).filter(F.col("source") == "Eagle"))


@check("product_coverage", "product", "PF04", "audit")
def product_coverage(s: Sources) -> DataFrame:
    """Eligible products and kits that the product feed lacks; obsolete appliances are not eligible."""
    gone = latest_appliances(s, obsolete=True)
    parts = {
        "item": op.exclude(online_item_skus(s), gone, "sku"),
        "kit": order_kits(s),
        "catalog": catalog_skus(s, [fv.ITEM_SOURCE, fv.KIT_SOURCE], rentals=False),
    }
    return op.coverage_gap(op.eligible_population(parts, mode="distinct"), feed_skus(s), "sku")


@check("onboarding_candidates", "product", "PF05", "audit")
def onboarding_candidates(s: Sources) -> DataFrame:
    """Sellable items and active kits that the catalog does not know yet, one row per source row."""
    parts = {"item": online_item_skus(s), "kit": order_kits(s)}
    return op.coverage_gap(op.eligible_population(parts, mode="all"), catalog_by_sku(s), "sku")


@check("code_flag_feed", "product", "PF06")
def code_flag_feed(s: Sources) -> DataFrame:
    """The 'no code exists' flag of the feed against the catalog's."""
    listed = catalog_by_identifier(s, "upc_no_exist", "data_source").filter(~fn.fold("data_source").contains(fv.CATALOG_ONLY_SOURCE))
    feed = s["product_feed"].select(F.trim("identifier").alias("sku"), F.col("upc_no_exist").alias("feed_flag"))
    as_digit = fn.code_map(fn.fold("upc_no_exist"), {"true": "1", "false": "0"})
    return op.reconcile(listed, feed, "sku", [Pair("flag_check", as_digit, "feed_flag")])


@check("obsolete_in_product_feed", "product", "PF08", "audit")
def obsolete_in_product_feed(s: Sources) -> DataFrame:
    """Obsolete appliances that the product feed still sends."""
    return op.only_in(feed_skus(s), latest_appliances(s, obsolete=True), "sku")


@check("brand_codes", "product", "PF09", "listing")
def brand_code_compare(s: Sources) -> DataFrame:
    """Item-system codes beside the brand's own codes, all rows."""
    codes = s["item_upc"].select(F.trim("sku").alias("sku"), F.trim("code").alias("item_code"))
    brand = brand_codes(s).drop("obsoletedate")
    return op.reconcile(codes, brand, "sku", [Pair("code_check", "item_code", "brand_code")], keep="all")


@check("mixed_record_coverage", "product", "PF10", "audit")
def mixed_record_coverage(s: Sources) -> DataFrame:
    """Appliances with obsolete and active records whose newest one is active, missing from the product feed."""
    mixed = op.mixed_state_keys(s["appliance"], "sku", "obsoletedate")
    newest = op.only_in(latest_appliances(s, obsolete=False).select("sku"), mixed, "sku")
    return op.coverage_gap(newest, feed_skus(s), "sku")


def _system_codes(s: Sources) -> DataFrame:
    stocked = item_rows(s, [fv.CATALOG_STORE], flags=None).select("sku")
    known = op.catalog_rows(catalog(s), [fv.ITEM_SOURCE, fv.APPLIANCE_SOURCE]).select(F.col("identifier").alias("sku"))
    codes = s["item_upc"].withColumn("sku", fn.normalize_sku("sku"))
    codes = op.only_in(op.only_in(codes, stocked, "sku"), known, "sku")
    coded = op.upc_cascade(codes).select("sku", F.col("code").alias("system_code"))
    kit_codes = s["kit_upc"].select(F.trim("sku").alias("sku"), F.trim("code").alias("system_code"))
    valid = kit_codes.filter(F.length("system_code").isin(fv.CODE_LENGTHS)).distinct()
    return coded.union(op.only_in(valid, s["kitting"].select(F.trim("sku").alias("sku")), "sku"))


@check("feed_codes", "product", "PF11")
def feed_codes(s: Sources) -> DataFrame:
    """Feed code against the code that counts: primary, else newest source code, else newest valid; two nulls agree."""
    feed = s["product_feed"].select(F.trim("identifier").alias("sku"), "upc")
    return op.reconcile(feed, _system_codes(s), "sku", [Pair("code_check", "upc", "system_code", "null_equal")], "left")


@check("catalog_codes", "product", "PF11")
def catalog_codes(s: Sources) -> DataFrame:
    """Codes the feed sent against what the catalog holds."""
    feed = s["product_feed"].filter(F.col("upc").isNotNull()).select(F.trim("identifier").alias("sku"), F.col("upc").alias("feed_upc"))
    return op.reconcile(feed, catalog_by_identifier(s, "upc"), "sku", [Pair("code_check", "feed_upc", "upc")])


def _or_zero(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("0"))


def _recoded(stores: Column) -> Column:
    flat = [F.lit(text) for pair in fv.STORE_RECODE.items() for text in pair]
    items = F.transform(F.array_sort(stores), lambda x: F.coalesce(F.element_at(F.create_map(*flat), x), x))
    return F.when(F.size(stores) > 0, F.array_join(items, ","))


@check("discontinued_closeout", "product", "PF12")
def discontinued_closeout(s: Sources) -> DataFrame:
    """Stores where a product is discontinued or on closeout, as lists, against the catalog's lists."""
    rows = op.join_unique(item_rows(s, fv.PRODUCT_STORES_ANY), product_keys(s), "sku", "left_semi")
    lists = rows.groupBy("sku").agg(
        F.collect_set(F.when(fn.one_of("discontinued", ["Y"]), F.col("store"))).alias("d"),
        F.collect_set(F.when(fn.one_of("closeout", ["Y"]), F.col("store"))).alias("c"),
    )
    expected = lists.select("sku", _or_zero(_recoded(F.col("d"))).alias("discontinued"), _or_zero(_recoded(F.col("c"))).alias("closeout"))
    listed = catalog(s).select(
        "sku",
        F.col("sku").alias("catalog_sku"),
        _or_zero(fn.decode_list("discontinued")).alias("catalog_discontinued"),
        _or_zero(fn.decode_list("store_closeout")).alias("catalog_closeout"),
    )
    pairs = [
        Pair("discontinued_check", "discontinued", F.coalesce("catalog_discontinued", F.lit("0"))),
        Pair("closeout_check", "closeout", F.coalesce("catalog_closeout", F.lit("0"))),
    ]
    return op.reconcile(expected, listed, "sku", pairs, "left", distinct=True)


@stage("create_dates", needs=("catalog",))
def create_dates(s: Sources) -> DataFrame:
    """First record of every product; of a kit, its newest component's."""
    created = s["order_sku"].select(F.col("sku").alias("component_sku"), F.col("create_dtm").alias("created_at"))
    components = s["kitting"].select("sku", "component_sku").join(created, "component_sku").select("sku", "created_at")
    kits = op.only_in(components, op.catalog_rows(catalog(s), [fv.KIT_SOURCE]).select(F.col("identifier").alias("sku")), "sku")
    first = s["dw_item"].filter(fn.one_of("store", [fv.CATALOG_STORE])).select(
        F.trim("item_number").alias("sku"), F.col("record_added").alias("created_at")
    )
    return op.first_seen_date(first, kits)


@check("feed_create_dates", "product", "PF13")
def feed_create_dates(s: Sources, skip_trace: str = fv.CATALOG_ONLY_TRACE) -> DataFrame:
    """Feed create date against the first record (a kit's newest component); active appliances are left out."""
    feed = s["product_feed"].filter(fn.none_of("product_trace", [skip_trace])).select(
        F.trim("identifier").alias("sku"), F.col("erp_sku_create_date").alias("feed_date")
    )
    feed = op.exclude(feed, active_appliance_skus(s), "sku")
    return op.reconcile(feed, create_dates(s), "sku", [Pair("date_check", "feed_date", "first_seen", "null_equal")], "left")


@check("catalog_create_dates", "product", "PF13")
def catalog_create_dates(s: Sources, skip_trace: str = fv.CATALOG_ONLY_TRACE) -> DataFrame:
    """Catalog create date against the first record; unassigned products and active appliances are left out."""
    feed = s["product_feed"].filter(fn.none_of("product_trace", [skip_trace])).select(F.trim("identifier").alias("sku"), "product_trace")
    unassigned = op.json_unassigned(s["catalog_json"], "family").select(F.col("identifier").alias("sku"))
    listed = op.exclude(catalog_by_identifier(s, "erp_sku_create_date"), unassigned, "sku")
    listed = op.exclude(listed, active_appliance_skus(s), "sku").join(feed, "sku")
    return op.reconcile(listed, create_dates(s), "sku", [Pair("date_check", "erp_sku_create_date", "first_seen")])


def _store_list_check(expected: DataFrame, s: Sources, how: str) -> DataFrame:
    listed = catalog(s).select("sku", _or_zero(fn.decode_list("in_stores")).alias("catalog_stores"))
    pairs = [Pair("stores_check", "stores", F.coalesce("catalog_stores", F.lit("0")))]
    return op.reconcile(expected, listed, "sku", pairs, how, distinct=True)


@check("store_locations", "product", "PF14")
def store_locations(s: Sources) -> DataFrame:
    """Stores that sell a product against the catalog's store list; kits and appliances are left out."""
    eligible = op.exclude(product_keys(s), s["appliance"].select(F.trim("sku").alias("sku")), "sku")
    rows = op.join_unique(item_rows(s, fv.PRODUCT_STORES_ANY), eligible, "sku", "left_semi")
    return _store_list_check(op.store_string(rows, "sku", "store", "stores", fv.STORE_RECODE, "0"), s, "inner")


@check("kit_locations", "product", "PF15")
def kit_locations(s: Sources) -> DataFrame:
    """Stores whose warehouse keeps a kit against the catalog's store list."""
    parts = {"kit": op.active_kits(s["kitting"], s["order_sku"], fv.KIT_SKU_MARKS), "catalog": catalog_skus(s, [fv.KIT_SOURCE])}
    kept = s["product_warehouse"].select(F.trim("sku").alias("sku"), fn.code_map("warehouse_code", fv.WAREHOUSE_STORE).alias("store"))
    rows = op.left_many(op.eligible_population(parts, mode="keys"), kept, "sku")
    return _store_list_check(op.store_string(rows, "sku", "store", "stores", empty="0"), s, "left")


def _money_or_zero(c: str) -> Column:
    return F.coalesce(fn.decode_money(c), F.lit(0).cast(MONEY)).alias(c)


@check("kit_prices", "product", "PF16")
def kit_prices(s: Sources, literal: bool = False) -> DataFrame:
    """Catalog kit prices against the price catalogs.

    The website price falls through to the second catalog when the first has none; ``literal`` keeps a zero of the first.
    """
    kits = op.catalog_rows(catalog(s), [fv.KIT_SOURCE], rentals=False)
    wanted = ["retail_price_amazon_hh", "retail_price_amazon_leh", "retail_price_website_hh", "retail_price_website_leh"]
    actual = kits.select(F.col("identifier").alias("sku"), *[_money_or_zero(c) for c in wanted])
    matrix = op.catalog_price_matrix(s["catalog_price"], fv.PRICE_CATALOGS)
    rows = op.join_summary(actual, matrix, "sku", "left")
    zero = F.lit(0).cast(MONEY)
    rows = rows.select("sku", *wanted, *[F.coalesce(F.col(c), zero).alias(c.lower()) for c in fv.PRICE_CATALOGS])
    website = F.col("master13") if literal else F.coalesce(fn.cascade_first_nonzero("master13", "hhmaster"), zero)
    return op.flag_pairs(
        rows,
        [
            Pair("amazon_hh_check", "retail_price_amazon_hh", "master13"),
            Pair("amazon_leh_check", "retail_price_amazon_leh", "lehmaster"),
            Pair("website_hh_check", "retail_price_website_hh", website),
            Pair("website_leh_check", "retail_price_website_leh", "lehmaster"),
        ],
    )


_CATALOG_MEASURES = {
    "quantity_on_hand": "quantity_on_hand",
    "committed_quantity": "quantity_committed",
    "future_order_quantity": "quantity_on_future_order",
    "safety_stock": "safety_stock",
}


@check("kit_quantities", "product", "PF17")
def kit_quantities(s: Sources) -> DataFrame:
    """Whole kits per store from component stock against the catalog's per-location columns."""
    kits = op.only_in(s["kitting"], s["order_sku"].filter(fn.one_of("active_flag", ["Y"])), "sku")
    kits = kits.withColumn("sku", fn.normalize_sku("sku", fv.KIT_SKU_MARKS))
    expected = kit_quantities_by_store(op.kit_store_grid(kits, items(s), ["1", "2", "4"]))
    zero = F.lit(0).cast("decimal(18,4)")
    locations = {"1": "hh", "4": "mf", "2": "fc"}
    columns = [f"{c}_{x}" for x in locations.values() for c in _CATALOG_MEASURES.values()]
    wide = s["catalog"].select("identifier", *[F.coalesce(F.col(c), zero).alias(c) for c in columns])
    layout = {st: {f"catalog_{m}": f"{c}_{x}" for m, c in _CATALOG_MEASURES.items()} for st, x in locations.items()}
    actual = op.location_unpivot(wide, "identifier", layout).withColumnRenamed("identifier", "sku")
    pairs = [Pair(f"{m}_check", f"calc_{m}", f"catalog_{m}") for m in MEASURES]
    out = op.reconcile(expected, actual, ["sku", "store"], pairs, "left")
    return out.withColumns({f"catalog_{m}": F.coalesce(f"catalog_{m}", zero) for m in MEASURES})


def _web_report(expected: DataFrame, s: Sources, decide: Sequence[str]) -> DataFrame:
    """Four channel flags against the catalog; the channels in ``decide`` make a row a discrepancy."""
    listed = catalog(s).select(F.col("identifier").alias("sku"), *[F.col(f"web_{c}").alias(f"catalog_{c}") for c in CHANNELS])
    pairs = [Pair(f"{c}_check", fn.fold(c), fn.fold(f"catalog_{c}"), "null_as", "0") for c in CHANNELS]
    rows = op.reconcile(expected, listed, "sku", pairs, "left", keep="all")
    wrong = F.array_contains(F.array(*[F.col(f"{c}_check") for c in decide]), "false")
    return rows.filter(wrong)


@check("kit_web_flags", "product", "PF18")
def kit_web_flags(s: Sources) -> DataFrame:
    """A kit's channel flags: on when the kit is active in a warehouse of the channel."""
    kits = op.distinct_keys(s["kitting"].select(fn.normalize_sku("sku").alias("sku")), "sku")
    kits = op.only_in(kits, catalog_skus(s, [fv.KIT_SOURCE]), "sku")
    rows = kits.join(s["order_sku"].select("sku", "active_flag"), "sku").join(
        s["product_warehouse"].select("sku", "warehouse_code"), "sku"
    )
    flags = op.flag_rollup(rows, "sku", fn.one_of("active_flag", ["Y"]), "warehouse_code", fv.CHANNEL_WAREHOUSES)
    return _web_report(flags, s, CHANNELS)


def _product_web(s: Sources, without_appliances: bool) -> DataFrame:
    skus = catalog_skus(s, [fv.ITEM_SOURCE])
    if without_appliances:
        skus = op.exclude(skus, s["appliance"].select(F.trim("sku").alias("sku")), "sku")
    rows = op.only_in(item_rows(s, fv.PRODUCT_STORES_ANY, flags=None), skus, "sku")
    store = F.coalesce(F.element_at(F.create_map(*[F.lit(t) for p in fv.STORE_RECODE.items() for t in p]), F.col("store")), "store")
    online = fn.one_of("web_flag", fv.WEB_FLAGS)
    flags = op.flag_rollup(rows.withColumn("store", store), "sku", online, "store", fv.CHANNEL_STORES)
    return _web_report(flags, s, ["website_hh", "website_leh"])


@check("product_web_flags_all", "product", "PF21")
def product_web_flags_all(s: Sources) -> DataFrame:
    """A product's channel flags: on when any store of the channel sells it online."""
    return _product_web(s, without_appliances=False)


@check("product_web_flags", "product", "PF22")
def product_web_flags(s: Sources) -> DataFrame:
    """As above without appliances."""
    return _product_web(s, without_appliances=True)


@check("product_prices", "product", "PF19")
def product_prices(s: Sources) -> DataFrame:
    """Retail and promotion price per channel from the first store that has one, against the catalog."""
    rows = op.join_unique(item_rows(s, fv.STORES_WITH_LOCATIONS, flags=None), product_keys(s), "sku", "left_semi")
    measures = {"retail": ("max", "retail_price"), "promo": ("max", "promotion_price")}
    wide = op.store_pivot(rows, "sku", "store", fv.STORES_WITH_LOCATIONS, measures)
    zero = F.lit(0).cast("decimal(18,4)")
    channel_stores = {"hh": fv.HH_PRICE_STORES, "leh": fv.LEH_PRICE_STORES}
    expected = wide.select(
        "sku",
        *[
            F.coalesce(fn.cascade_first_nonzero(*[f"st{st}_{m}" for st in stores]), zero).alias(f"{x}_{m}")
            for x, stores in channel_stores.items()
            for m in ("retail", "promo")
        ],
    )
    wanted = {
        "retail_price_website_hh": "hh_retail",
        "retail_price_amazon_hh": "hh_retail",
        "promo_price_website_hh": "hh_promo",
        "retail_price_website_leh": "leh_retail",
        "retail_price_amazon_leh": "leh_retail",
        "promo_price_website_leh": "leh_promo",
    }
    actual = catalog(s).select(F.col("identifier").alias("sku"), *[_money_or_zero(c) for c in wanted])
    actual = op.exclude(actual, s["appliance_feed_previous"].select(F.trim("identifier").alias("sku")), "sku")
    out = op.reconcile(expected, actual, "sku", [Pair(f"{c}_check", e, c) for c, e in wanted.items()])
    shown = ("hh_retail", "hh_promo", "leh_retail", "leh_promo")
    return out.withColumns({c: fn.floor_money(c) for c in shown})


@check("product_physical", "product", "PF20", "listing")
def product_physical(s: Sources) -> DataFrame:
    """Physical flag of everything but appliances and rentals."""
    rows = s["catalog"].filter(
        fn.none_of("data_source", [fv.APPLIANCE_SOURCE]) & (fn.fold(F.coalesce("rental_item", F.lit("false"))) != "true")
    )
    return rows.select("identifier", "physical", "data_source")
