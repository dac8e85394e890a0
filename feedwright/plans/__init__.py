"""The checks, by area, and the runner."""

from . import adhoc, appliance, inventory, orders, product, rental, shipping, tickets, traffic, warehouse
from .check import CHECKS, Check, Result, run_checks, select_checks

__all__ = [
    "CHECKS",
    "Check",
    "Result",
    "adhoc",
    "appliance",
    "inventory",
    "orders",
    "product",
    "rental",
    "run_checks",
    "select_checks",
    "shipping",
    "tickets",
    "traffic",
    "warehouse",
]
