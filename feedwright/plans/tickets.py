"""Event tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import operators as op
from ..sources import Sources
from .check import check


@check("event_charges", "tickets", "IT01", "listing")
def event_charges(s: Sources, event: str | None = None) -> DataFrame:
    """Orders and charges of an event, or of all."""
    events = s["ticket_event"] if event is None else s["ticket_event"].filter(F.col("event_id") == event)
    orders = s["ticket_order"].select("event_id", "order_id")
    return op.left_many(op.left_many(events, orders, "event_id"), s["ticket_charge"], "order_id")


@check("event_totals", "tickets", "IT02", "listing")
def event_totals(s: Sources) -> DataFrame:
    """Sales, other tickets and meal tickets per event."""
    return op.event_totals(s["ticket_event"], s["ticket_order"], s["ticket_line"])


@check("parsed_events", "tickets", "IT03", "listing")
def parsed_events(s: Sources) -> DataFrame:
    """Parsed events, newest first."""
    return s["ticket_event_view"].orderBy(F.col("eid").desc(), F.col("cdate").desc())


def _browse(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col("oid").desc(), F.col("pulledatutc").desc())


@check("parsed_orders", "tickets", "IT03", "listing")
def parsed_orders(s: Sources) -> DataFrame:
    """Parsed orders, newest first."""
    return _browse(s["ticket_order_view"])


@check("parsed_charges", "tickets", "IT03", "listing")
def parsed_charges(s: Sources) -> DataFrame:
    """Parsed charges, newest first."""
    return _browse(s["ticket_charge_view"])


@check("parsed_tickets", "tickets", "IT03", "listing")
def parsed_tickets(s: Sources) -> DataFrame:
    """Parsed tickets, newest first."""
    return _browse(s["ticket_line_view"])
