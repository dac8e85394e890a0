"""Orders, shipments and tickets."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import carrier_name, fold, one_of, tracking_url
from .keys import distinct_keys, join_summary, join_unique, left_many


def logged_lines(log: DataFrame, status: str = "Completed") -> DataFrame:
    """(channel order, sku) pairs the shipment log has finished."""
    done = log.filter(one_of("status", [status])).select(
        F.col("channelorderid").alias("udf_order_text"), "sku"
    )
    return distinct_keys(done, ["udf_order_text", "sku"])


def shipped_since(shipped: Column | str, as_of: date, days: int = 7) -> Column:
    """Ship date text within the days before ``as_of``; text that is no date is out."""
    shipped = F.col(shipped) if isinstance(shipped, str) else shipped
    return shipped.try_cast("date") >= F.lit(as_of - timedelta(days=days))


def shipped_not_logged(
    tags: DataFrame,
    lines: DataFrame,
    tracking: DataFrame,
    log: DataFrame,
    as_of: date,
    days: int = 7,
    links: bool = True,
) -> DataFrame:
    """Recently shipped lines that the shipment log does not show as completed, with carrier and tracking link.

    Tracking is matched per line (order and shipping document), so one line's number never reaches another line.
    """
    recent = lines.filter(shipped_since("first_shipped_datetime", as_of, days)).select(
        "order_number",
        "line_number",
        "sku",
        "quantity_ordered",
        "first_shipped_datetime",
        F.col("first_shipped_shipdoc").alias("shipping_document_number"),
    )
    open_lines = join_summary(
        tags.select("order_number", "udf_order_text").join(recent, "order_number"),
        logged_lines(log),
        ["udf_order_text", "sku"],
        "left_anti",
    )
    out = left_many(open_lines, tracking, ["order_number", "shipping_document_number"])
    columns = [
        "order_number",
        "udf_order_text",
        "line_number",
        "quantity_ordered",
        "first_shipped_datetime",
        carrier_name("shipper_code").alias("shipper_code"),
        "tracking_number",
        "shipment_type_code",
    ]
    if links:
        columns.append(tracking_url("shipper_code", "tracking_number").alias("url"))
    return out.select(*columns, "sku")


def shipment_leak(lines: DataFrame, tracking: DataFrame) -> DataFrame:
    """Shipping documents that reach lines they did not ship, when tracking is matched by order alone.

    ``lines`` (order_number, line_number, first_shipped_shipdoc), ``tracking`` (order_number, shipping_document_number).
    Matched by order, each document of an order meets each of its lines: a graph with all edges, of which only the lines'
    own documents are real. It is never built; counting both sides is enough: lines of the order, lines of the document.
    Per document of an order: ``lines_reached``, ``lines_shipped`` and ``lines_leaked``, where the last is above 0, and
    ``documents``, the number of documents that each of the order's lines would get.
    """
    own = lines.select("order_number", "line_number", F.col("first_shipped_shipdoc").alias("shipping_document_number")).distinct()
    per_document = own.groupBy("order_number", "shipping_document_number").agg(F.count("*").alias("lines_shipped"))
    per_order = lines.select("order_number", "line_number").distinct().groupBy("order_number").agg(F.count("*").alias("lines_reached"))
    documents = distinct_keys(tracking, ["order_number", "shipping_document_number"])
    many = documents.groupBy("order_number").agg(F.count("shipping_document_number").alias("documents"))
    out = join_unique(documents, per_document, ["order_number", "shipping_document_number"], "left")
    # One row per order on both look-ups, which share an exchange.
    out = join_summary(join_summary(out, per_order, "order_number"), many, "order_number")
    shipped = F.coalesce("lines_shipped", F.lit(0))
    out = out.select(
        "order_number", "shipping_document_number", "documents", "lines_reached", shipped.alias("lines_shipped"),
        (F.col("lines_reached") - shipped).alias("lines_leaked"),
    )
    return out.filter(F.col("lines_leaked") > 0)


def unshipped_not_logged(tags: DataFrame, lines: DataFrame, tracking: DataFrame, log: DataFrame) -> DataFrame:
    """Lines without a shipping document that are not logged as completed; orders without any line count as well."""
    columns = ["order_number", "line_number", "sku", "quantity_ordered", "first_shipped_datetime", "first_shipped_shipdoc"]
    joined = tags.select("order_number", "udf_order_text").join(lines.select(*columns), "order_number", "left")
    pending = joined.filter(F.col("first_shipped_shipdoc").isNull())
    open_lines = join_summary(pending, logged_lines(log), ["udf_order_text", "sku"], "left_anti")
    shipped = tracking.select("order_number", "tracking_number", "shipment_type_code")
    return left_many(open_lines, shipped, "order_number").select(
        "order_number",
        "udf_order_text",
        "line_number",
        "quantity_ordered",
        "first_shipped_datetime",
        "tracking_number",
        "shipment_type_code",
        "sku",
    )


def event_totals(events: DataFrame, orders: DataFrame, tickets: DataFrame, meal: str = "meal") -> DataFrame:
    """Per event: sales without refunded orders, and meal and other ticket counts (refunded orders included).

    Each figure is grouped at its own grain before the grains meet, so tickets never multiply charges. An event whose
    orders are all refunded is not listed.
    """
    sales = orders.groupBy("event_id").agg(
        F.sum(F.when(F.col("refunded_at").isNull(), F.col("total_charge"))).cast("decimal(18,2)").alias("event_total"),
        F.max(F.when(F.col("refunded_at").isNull(), F.lit(1))).alias("_kept"),
        F.count("*").alias("_orders"),
    )
    per_order = tickets.groupBy("order_id").agg(
        F.count(F.when(fold("type") != meal, 1)).alias("_other"), F.count(F.when(fold("type") == meal, 1)).alias("_meal")
    )
    counts = (
        join_summary(orders.select("order_id", "event_id"), per_order, "order_id")
        .groupBy("event_id")
        .agg(F.sum("_other").alias("_other"), F.sum("_meal").alias("_meal"))
    )
    zero = F.lit(0).cast("bigint")
    out = events.join(sales, "event_id", "left")
    out = out.filter(F.coalesce("_kept", F.when(F.col("_orders").isNull(), F.lit(1))) == 1)
    out = out.join(counts, "event_id", "left")
    other, meals = F.coalesce("_other", zero), F.coalesce("_meal", zero)
    return out.select(
        *events.columns,
        F.coalesce("event_total", F.lit(0).cast("decimal(18,2)")).alias("event_total"),
        other.alias("event_ticket_count"),
        meals.alias("meal_ticket_count"),
        (other + meals).alias("total_ticket_count"),
    )


def id_from_uri(c: Column | str, start: int = 21, length: int = 13) -> Column:
    """Order id at a fixed place of an import URI."""
    return F.substring(F.col(c) if isinstance(c, str) else c, start, length)


def order_trace(
    headers: DataFrame,
    lines: DataFrame,
    statuses: DataFrame | None = None,
    where: Column | None = None,
    on: str = "order_number",
    how: str = "inner",
) -> DataFrame:
    """Order headers with their lines and the status text. ``where`` is applied to the headers, before any join."""
    kept = headers if where is None else headers.filter(where)
    out = kept.join(lines, on, how)
    return out if statuses is None else out.join(statuses, "status_code")


def import_trace(imported: DataFrame, orders: DataFrame, items: DataFrame, how: str = "inner") -> DataFrame:
    """Imported orders beside the storefront order (its id is part of the import URI) and its items."""
    keyed = imported.withColumn("shop_order_id", id_from_uri("orderid"))
    return left_many(keyed.join(orders, "shop_order_id", how), items, "shop_order_key")


def store_lookup(rows: DataFrame, lookup: DataFrame, code: str, form: str, alias: str = "store") -> DataFrame:
    """Store number by (warehouse, format), else by warehouse alone. Both look-ups have one row per key."""
    exact = lookup.filter(F.col("receiving_format").isNotNull()).select(
        F.col("warehouse_code").alias(code), F.col("receiving_format").alias(form), F.col("store_num").alias("_exact")
    )
    general = lookup.filter(F.col("receiving_format").isNull()).select(
        F.col("warehouse_code").alias(code), F.col("store_num").alias("_general")
    )
    joined = rows.join(exact, [code, form], "left").join(general, code, "left")
    return joined.withColumn(alias, F.coalesce("_exact", "_general")).drop("_exact", "_general")


def open_lines(lines: DataFrame) -> DataFrame:
    """Lines not cancelled or closed that are not shipped in full."""
    status = F.coalesce(F.col("line_item_status_code"), F.lit(""))
    return lines.filter(
        F.col("line_item_status_code").isNotNull()
        & (F.col("line_status") != "X")
        & (status != "C")
        & ((F.col("quantity_ordered") - F.col("canceled_quantity")) != F.col("shipped_quantity"))
    )


def committed_sales_union(parts: Sequence[DataFrame], top: int | None, order: Sequence[str]) -> DataFrame:
    """Open sales of several systems in one shape. ``top`` keeps the newest rows of each system (a test-case report)."""
    newest = [F.col("transaction_date").desc(), *[F.col(c) for c in order]]
    kept = [df if top is None else df.orderBy(*newest).limit(top) for df in parts]
    return reduce(DataFrame.union, kept)


def recent_top_n(df: DataFrame, n: int | None, order: Sequence[Column]) -> DataFrame:
    """The n first rows in the given order, or all rows, unsorted. Give a complete order: without one the pick among ties
    is arbitrary."""
    return df if n is None else df.orderBy(*order).limit(n)
