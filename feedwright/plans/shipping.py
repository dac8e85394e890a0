"""Shipping feeds: what should have been sent to the sales channels."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..sources import Sources
from .check import check


@check("ebay_shipments_due", "shipping", "SE01", "audit")
def ebay_shipments_due(s: Sources, as_of: date | None = None, receiving_format: str = "WE") -> DataFrame:
    """Lines of one order format shipped in the last seven days and not logged as completed."""
    wanted = s["sales_order"].filter(fn.one_of("receiving_format_code", [receiving_format]))
    tags = op.only_in(s["order_udf"], wanted, "order_number")
    return op.shipped_not_logged(
        tags, s["line_item"], s["shipper_tracking"], s["shipment_log"], as_of or date.today(), links=False
    )


@check("shop_shipments_due", "shipping", "SS02", "audit")
def shop_shipments_due(s: Sources, as_of: date | None = None) -> DataFrame:
    """Storefront lines shipped in the last seven days and not logged as completed, with tracking link."""
    tags = s["order_udf"].filter(fn.one_of("udf_code", fv.SHOP_ORDER_CODES) & fn.fold("udf_order_text").contains("shop"))
    return op.shipped_not_logged(tags, s["line_item"], s["shipper_tracking"], s["shipment_log"], as_of or date.today())


@check("shop_unfulfilled", "shipping", "SS01", "listing")
def shop_unfulfilled(s: Sources, text: str = "webs") -> DataFrame:
    """Storefront lines without a shipping document that are not logged as completed."""
    tags = s["order_udf"].filter(fn.fold("order_number").contains(text))
    return op.unshipped_not_logged(tags, s["line_item"], s["shipper_tracking"], s["shipment_log"])


@check("tracking_lookup", "shipping", "FQ04", "listing")
def tracking_lookup(s: Sources, order: str | None = None) -> DataFrame:
    """Tracking rows of an order, or all."""
    rows = s["shipper_tracking"]
    return rows if order is None else rows.filter(fn.one_of("order_number", [order]))


@check("line_lookup", "shipping", "FQ04", "listing")
def line_lookup(s: Sources, order: str | None = None) -> DataFrame:
    """Lines of an order, or all."""
    rows = s["line_item"]
    return rows if order is None else rows.filter(F.lower("order_number") == order.lower())
