"""Price and quantity rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_money(c: Column | str) -> Column:
    """Cut to whole cents, never rounded up."""
    return (F.floor(_col(c) * 100) / 100).cast("decimal(18,2)")


def not_negative(c: Column | str) -> Column:
    return F.when(_col(c) < 0, F.lit(0)).otherwise(_col(c))


def cascade_first_nonzero(*cols: Column | str) -> Column:
    """First value that is neither null nor zero, null when there is none."""
    return F.coalesce(*[F.nullif(_col(c), F.lit(0)) for c in cols])


def _zero(c: Column | str) -> Column:
    return F.coalesce(_col(c), F.lit(0).cast("decimal(18,2)"))


def price_hierarchy(umrp: Column | str, msrp: Column | str, cost: Column | str, floor_price: Column | str) -> Column:
    """Fixed price if set, else list price if set, else the higher of calculated cost and lowest advertised price."""
    higher = F.greatest(_zero(cost), _zero(floor_price))
    return F.when(_zero(umrp) != 0, _zero(umrp)).when(_zero(msrp) != 0, _zero(msrp)).otherwise(higher)


def sale_mark(umrp: Column | str) -> Column:
    """A fixed price may not be discounted."""
    return F.when(_zero(umrp) != 0, F.lit("no sale price")).otherwise(F.lit("sale price"))
