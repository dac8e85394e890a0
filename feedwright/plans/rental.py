"""Rental feed checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..operators import Pair
from ..sources import Sources
from .check import check

MONEY = "decimal(18,2)"


def _rental_items(s: Sources) -> DataFrame:
    return s["catalog"].filter(fn.one_of("rental_item", ["true"]))


@check("rental_rates", "rental", "PR01", "listing")
def rental_rates(s: Sources) -> DataFrame:
    """Rental prices in the catalog beside the rental system's rates, all rental rows."""
    rates = s["por_rate"].select(
        F.col("sku_key").alias("sku"), *[F.col(c).cast(MONEY).alias(c) for c in ("rate1", "rate2", "rate3")]
    )
    catalog = _rental_items(s).select(
        F.col("identifier").alias("sku"),
        fn.decode_offset_money("rental_price_4_hours").alias("price_4_hours"),
        fn.decode_offset_money("rental_price_one_day").alias("price_one_day"),
        fn.decode_offset_money("rental_price_one_week").alias("price_one_week"),
        "in_stores",
        "web_website_hh",
    )
    pairs = [
        Pair("rate1_check", "price_4_hours", "rate1"),
        Pair("rate2_check", "price_one_day", "rate2"),
        Pair("rate3_check", "price_one_week", "rate3"),
    ]
    return op.reconcile(catalog, rates, "sku", pairs, keep="all")


@check("rental_tiers", "rental", "QJ", "listing")
def rental_tiers(s: Sources) -> DataFrame:
    """Counts of rental skus with null, zero, missing or inverted rates."""
    items = _rental_items(s).select("sku", "status").groupBy("sku").agg(F.max(fn.fold("status")).alias("status"))
    flags = {"archived rental sku": fn.one_of("status", fv.ARCHIVED)}
    return op.rate_tier_checks(items, s["rental_rate"], fv.RATE_TIERS, flags)


def _tiers(rates: DataFrame) -> DataFrame:
    return op.store_pivot(rates, "sku", "rate_type", fv.RATE_TIERS, {"rate": ("max", "rate")}, name="rate_{value}")


@check("rental_delta", "rental", "QJ", "listing")
def rental_delta(s: Sources) -> DataFrame:
    """Rates to send: rental skus that are new or whose rate changed in any tier since the last run."""
    items = _rental_items(s).filter(fn.none_of("status", fv.ARCHIVED))
    current = op.only_in(_tiers(s["rental_rate"]), items.select(F.trim("sku").alias("sku")), "sku")
    return op.delta_feed(current, _tiers(s["rental_rate_sent"]), "sku", [f"rate_{t}" for t in fv.RATE_TIERS])
