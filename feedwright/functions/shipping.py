"""Carrier names and tracking links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import CARRIER_NAMES, TRACKING_PAGES
from .compare import fold


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def carrier_name(code: Column | str) -> Column:
    out = _col(code)
    for short, name in CARRIER_NAMES.items():
        out = F.when(fold(code) == F.lit(short.lower()), F.lit(name)).otherwise(out)
    return out


def tracking_url(code: Column | str, number: Column | str) -> Column:
    """Tracking page of a known carrier, null for any other."""
    number = F.coalesce(F.trim(_col(number)), F.lit(""))
    out = None
    for short, page in TRACKING_PAGES.items():
        hit, link = fold(code) == F.lit(short.lower()), F.concat(F.lit(page), number)
        out = F.when(hit, link) if out is None else out.when(hit, link)
    return out
