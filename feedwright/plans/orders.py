"""Order imports: traces, populations and test-case listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .check import check


def _named(c: str, names: Sequence[str] | None) -> Column:
    return F.lit(True) if names is None else fn.one_of(c, names)


def _containing(c: str, prefixes: Sequence[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | fn.fold(c).contains(p.lower())
    return out


@check("printable_receipts", "orders", "AL01", "listing")
def printable_receipts(s: Sources, top: int | None = 100, store: str = "D") -> DataFrame:
    """A newest-n report: the latest order lines whose item is kept in a store (top=None: all of them)."""
    lines = s["line_item"].select("order_number", "line_number", "sku", "status_code", "update_dtm")
    rows = s["order_udf"].select("order_number").join(lines, "order_number").join(s["order_status"], "status_code")
    items = s["item_store"].filter(fn.one_of("store", [store])).select(F.trim("item_number").alias("sku"), "store", "web_flag")
    order = [F.col("update_dtm").desc(), *[F.col(c) for c in ("sku", "order_number", "line_number")]]
    return op.recent_top_n(rows.join(items, "sku"), top, order).select("sku", "store", "web_flag", "update_dtm")


@check("purchase_order_lines", "orders", "AL01", "listing")
def purchase_order_lines(s: Sources, top: int | None = 25) -> DataFrame:
    """A first-n report: the purchase-order lines due first (top=None: all of them)."""
    lines = s["po_detail"].withColumn("item_number", F.trim("item_number")).join(s["po_header"], "po_number", "left")
    keys = ["date_due", "po_number", "line_number", "item_number", "qty_on_order", "unit_cost"]
    return op.recent_top_n(lines, top, [F.col(c) for c in keys])


def sales_parts(s: Sources) -> list[DataFrame]:
    """Open sales of the item system and of the order system in one shape."""
    kept = s["sale_header"].filter(fn.none_of("transaction_type", ["E"]))
    details = s["sale_detail"].join(kept, ["transaction_number", "store_number"])
    item_sales = details.select(
        F.col("transaction_number").cast("string").alias("transaction"),
        F.trim("item").alias("item"),
        F.col("store_number").alias("store"),
        F.col("qty_selling_units").alias("quantity"),
        F.col("creation_date").alias("transaction_date"),
        F.col("actual_selling_price").alias("price"),
        "cost",
        F.lit(fv.ITEM_SALES_LABEL).alias("source_type"),
        F.lit(fv.ITEM_SALES_CODE).alias("source_code"),
    )
    lines = op.open_lines(s["line_item"].withColumn("line_status", F.col("status_code")))
    lines = lines.join(s["sales_order"].select("order_number", "receiving_format_code", "today"), "order_number")
    lines = op.store_lookup(lines, s["store_lookup"], "warehouse_code", "receiving_format_code")
    order_sales = lines.select(
        F.col("order_number").alias("transaction"),
        F.col("sku").alias("item"),
        "store",
        F.col("quantity_ordered").alias("quantity"),
        F.col("today").alias("transaction_date"),
        F.col("product_price").alias("price"),
        F.col("sku_list_price").alias("cost"),
        F.lit(fv.ORDER_SALES_LABEL).alias("source_type"),
        F.lit(fv.ORDER_SALES_CODE).alias("source_code"),
    )
    return [item_sales, order_sales]


@check("committed_sales", "orders", "AL02", "listing")
def committed_sales(s: Sources, top: int | None = None) -> DataFrame:
    """Open sales of both systems; with ``top`` only so many of the newest of each."""
    return op.committed_sales_union(sales_parts(s), top, ["transaction", "item", "quantity", "price"])


def _amazon(s: Sources, year: str, store: str) -> DataFrame:
    orders = s["amazon_order"].filter(F.col("storeid") == store)
    return s["amazon_order_item"].filter(fn.in_period("dateentered", year)).join(orders, "amazon_order_id")


@check("amazon_free_shipping", "orders", "OA01", "listing")
def amazon_free_shipping(s: Sources, year: str = "2026", store: str = "1") -> DataFrame:
    """Marketplace order lines of a year whose shipping discount equals the shipping price."""
    zero = F.lit(0).cast("decimal(18,2)")
    rows = _amazon(s, year, store).withColumns(
        {c: F.coalesce(F.col(c), zero) for c in ("shipping_price", "shipping_discount")}
    )
    return rows.filter(F.col("shipping_price") == F.col("shipping_discount"))


@check("amazon_orders", "orders", "OA01", "listing")
def amazon_orders(s: Sources, year: str = "2026", store: str = "1") -> DataFrame:
    """Marketplace order lines of a year."""
    return _amazon(s, year, store)


_SHOP_COLUMNS = ["orderid", "exported", "imported", "datecreated", "dateupdated", "order_name", "shipping_charges",
                 "total_charge", "payment_gateways", "original_payment_gateways"]
_ITEM_COLUMNS = ["line_number", "sku", "quantity", "unit_price", "total_price", "discounted_allocations"]


@check("imported_orders", "orders", "OS01", "listing")
def imported_orders(s: Sources, names: Sequence[str] | None = None) -> DataFrame:
    """Imported orders with storefront header and items, for some order names or all."""
    shop = s["shop_order"].filter(_named("order_name", names))
    people = ["billing_first_name", "billing_last_name", "shipping_first_name", "shipping_last_name", "shipping_city", "shipping_zip"]
    return op.import_trace(s["imported_order"], shop, s["shop_order_item"]).select(*_SHOP_COLUMNS, *people, *_ITEM_COLUMNS)


_LINE_COLUMNS = ["order_number", "line_number", "sku", "quantity_ordered", "discount_amount", "hold_until_date", "status_code"]


def _order_lines(s: Sources, where: Column) -> DataFrame:
    return op.order_trace(s["order_udf"], s["line_item"].select(*_LINE_COLUMNS), s["order_status"], where)


@check("order_system_lines", "orders", "OS01", "listing")
def order_system_lines(s: Sources, names: Sequence[str] | None = None, code: str = "hhcv3") -> DataFrame:
    """Order lines with status text of a channel, for some orders or all."""
    return _order_lines(s, fn.one_of("udf_code", [code]) & _named("order_number", names))


@check("shop_pending", "orders", "OS01", "listing")
def shop_pending(s: Sources) -> DataFrame:
    """Pending storefront quantities."""
    return s["shop_pending"]


@check("order_kickouts", "orders", "OS01", "listing")
def order_kickouts(s: Sources, names: Sequence[str] | None = None) -> DataFrame:
    """Orders kicked out of the import."""
    return s["order_kickout"].filter(_named("orderid", names))


@check("custom_products", "orders", "OS01", "listing")
def custom_products(s: Sources) -> DataFrame:
    """Custom products as stored."""
    return s["custom_product"]


@check("custom_product_orders", "orders", "SS03", "listing")
def custom_product_orders(s: Sources) -> DataFrame:
    """Custom products with the name of their order."""
    names = s["shop_order"].select("shop_order_id", "order_name")
    return s["custom_product"].join(names, "shop_order_id", "left").drop("shop_order_id").distinct()


@check("import_log", "orders", "OS02", "listing")
def import_log(s: Sources, process_type: int = 910, top: int | None = 1000) -> DataFrame:
    """A newest-n report: the latest import runs with their results (top=None: all of them)."""
    runs = s["import_process"].filter(F.col("process_type_id") == process_type)
    rows = runs.join(s["import_process_result"], "process_id", "left")
    return op.recent_top_n(rows, top, [F.col("process_id").desc(), F.col("result_text")])


@check("personalised_imports", "orders", "OS03", "listing")
def personalised_imports(s: Sources, since: str = "2026-03-18") -> DataFrame:
    """Storefront imports since a day, with their personalisation attributes."""
    recent = s["imported_order"].filter(
        fn.fold("orderid").contains("shopify") & (F.col("datecreated") >= F.lit(since).cast("timestamp_ntz"))
    )
    attributes = [f"attribute{i}" for i in range(1, 6)]
    out = op.import_trace(recent, s["shop_order"], s["shop_order_item"], how="left")
    return out.select(*_SHOP_COLUMNS, *_ITEM_COLUMNS, *attributes, "custom_attributes")


@check("personalised_lines", "orders", "OS03", "listing")
def personalised_lines(s: Sources, code: str = "hhcv3", text: str = "hwebs") -> DataFrame:
    """Order-system lines of the storefront's orders."""
    return _order_lines(s, fn.one_of("udf_code", [code]) & _containing("order_number", [text]))


@check("pre_orders", "orders", "OS04", "listing")
def pre_orders(s: Sources) -> DataFrame:
    """Catalog rows with a pre-order end date."""
    return op.rows_with_attribute(s["catalog"], "pre_order_end_date")


@check("warning_messages", "orders", "OS05", "listing")
def warning_messages(s: Sources, identifier: str | None = None) -> DataFrame:
    """Catalog rows with a warning message; for one identifier its row whether or not it has one."""
    rows = s["catalog"].select("identifier", "warning_message")
    if identifier is not None:
        return rows.filter(F.col("identifier") == identifier.upper())
    return op.rows_with_attribute(rows, "warning_message")


@check("null_sweep", "orders", "OS04", "audit")
def null_sweep(
    s: Sources, fields: Sequence[str] = fv.REQUIRED_FIELDS, sources: Sequence[str] = (fv.ITEM_SOURCE, fv.KIT_SOURCE)
) -> DataFrame:
    """Required fields with any null among the catalog's products and kits, and how many."""
    eligible = op.catalog_rows(s["catalog"], sources, rentals=False)
    return op.attribute_population(eligible, list(fields)).filter(F.col("nulls") > 0)


@check("order_risk", "orders", "OS06", "listing")
def order_risk(s: Sources, names: Sequence[str] | None = None) -> DataFrame:
    """Risk recommendation per order."""
    return s["shop_order"].filter(_named("order_name", names)).select("order_name", "risk_recommendation")


@check("order_risk_lines", "orders", "OS06", "listing")
def order_risk_lines(s: Sources, names: Sequence[str] | None = None) -> DataFrame:
    """Order-system lines of the orders under review."""
    return _order_lines(s, _named("order_number", names))


@check("order_priority", "orders", "OS07", "listing")
def order_priority(s: Sources, text: Sequence[str] = ("hwebs", "lwebs")) -> DataFrame:
    """Priority rank and charges beside the lines, for orders by part of their number."""
    headers = s["sales_order"].select("order_number", "priority_rank", "status_code", "total_charges")
    lines = s["line_item"].select("order_number", "line_number", "sku", "quantity_ordered", "sku_list_price", "discount_amount")
    return op.order_trace(headers, lines, where=_containing("order_number", text))


@check("ship_by_dates", "orders", "OS08", "listing")
def ship_by_dates(s: Sources, prefix: str = "hwebs") -> DataFrame:
    """Ship-by date of the gift table beside the order's own."""
    orders = s["sales_order"].filter(fn.begins_with("order_number", prefix))
    gifts = s["order_gift"].select(
        F.col("third_party_order_number").alias("import_order_number"), F.col("ship_by_dtm").alias("ship_by_date_gift")
    )
    return gifts.join(orders, "import_order_number").select(
        "order_number", "ship_by_date_gift", F.col("expected_ship_date").alias("ship_by_date_order")
    )


@check("special_order_items", "orders", "OS09", "listing")
def special_order_items(s: Sources, location: str = "so", manufacturer: str = "deere", top: int | None = None) -> DataFrame:
    """Test items: special-order location, one manufacturer; with ``top`` the first so many by item and store."""
    rows = s["item_store"].filter(fn.one_of("location_code", [location]) & fn.one_of("manufacturer", [manufacturer]))
    return op.recent_top_n(rows, top, [F.col("item_number"), F.col("store")])


@check("videos", "orders", "OS09", "listing")
def videos(s: Sources) -> DataFrame:
    """Appliance videos."""
    return s["video"]


def _catalog_lists(s: Sources) -> tuple[DataFrame, DataFrame]:
    kept = fn.one_of("catalog_id", fv.ITEM_CATALOGS)
    return s["catalog_alias"].filter(kept), s["catalog_item"].filter(kept)


@check("variants_not_orderable", "orders", "OS10", "audit")
def variants_not_orderable(s: Sources) -> DataFrame:
    """Storefront variants that are neither alias nor item in any order catalog."""
    aliases, items = _catalog_lists(s)
    variants = s["variant"].select("sku")
    for known in (aliases, items):
        variants = op.exclude(variants, known.select(F.trim("sku").alias("sku")), "sku")
    return variants


@check("orderable_flags", "orders", "OS10", "listing")
def orderable_flags(s: Sources, sku: str | None = None) -> DataFrame:
    """1 or 0 per variant sku: known to an order catalog as alias or as item."""
    aliases, items = _catalog_lists(s)
    lists = {"as_alias": aliases.select(fn.fold("catalog_alias").alias("key")), "as_item": items.select(fn.fold(F.trim("sku")).alias("key"))}
    wanted = op.distinct_keys(s["variant"], "sku").withColumn("key", fn.fold("sku"))
    wanted = wanted if sku is None else wanted.filter(F.col("key") == sku.lower())
    return op.membership_flags(wanted, lists, "key").drop("key")
