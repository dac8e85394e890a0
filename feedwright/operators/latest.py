"""Newest record and first-seen date per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import as_list, join_summary, join_unique

_AT = "_fw_at"


def latest_record(df: DataFrame, key: str | Sequence[str], ts: Sequence[str]) -> DataFrame:
    """Rows whose first non-null timestamp equals the newest of their key.

    Ties are all kept and keys without any timestamp drop out. The newest time is a two-column aggregate (combined on
    the map side); rows are matched on key *and* time, so the rows of a hot key spread over its times.
    """
    key = as_list(key)
    stamped = df.withColumn(_AT, F.coalesce(*[F.col(c) for c in ts])).filter(F.col(_AT).isNotNull())
    newest = stamped.groupBy(*key).agg(F.max(_AT).alias(_AT))
    return join_summary(stamped, newest, [*key, _AT]).select(*df.columns)


def undetermined_pick(df: DataFrame, key: str | Sequence[str], ts: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Keys whose newest record is not determined: several rows tie on the newest time and differ in some field.

    Gives the time, the number of tied rows and the fields they differ in, in the order given. A field differs when the
    smallest and the largest digest of its values do; null is a value. Rows are folded to one per key and time first
    (on the map side), then to one per key, so no key's rows are gathered.
    """
    key = as_list(key)
    digest = {f: F.xxhash64(F.col(f).isNull(), F.col(f).cast("string")) for f in fields}
    stamped = df.withColumn(_AT, F.coalesce(*[F.col(c) for c in ts])).filter(F.col(_AT).isNotNull())
    tied = stamped.groupBy(*key, _AT).agg(
        F.count("*").alias("tied_rows"), F.concat_ws(",", *[F.when(F.min(d) != F.max(d), F.lit(f)) for f, d in digest.items()]).alias("fields")
    )
    newest = tied.groupBy(*key).agg(F.max(F.struct(_AT, "tied_rows", "fields")).alias("_newest"))
    out = newest.select(*key, F.col(f"_newest.{_AT}").alias("picked_at"), "_newest.tied_rows", "_newest.fields")
    return out.filter((F.col("tied_rows") > 1) & (F.col("fields") != ""))


def first_seen_date(products: DataFrame, kits: DataFrame, key: str = "sku", at: str = "created_at") -> DataFrame:
    """One date per key: a product's earliest date, a kit's latest component date; the kit date wins.

    ``products`` has (key, at); ``kits`` has (key, at) with one row per component.
    """
    day = F.col(at).cast("date")
    kit_dates = kits.groupBy(key).agg(F.max(day).alias("first_seen"))
    product_dates = products.groupBy(key).agg(F.min(day).alias("first_seen"))
    return kit_dates.union(join_unique(product_dates, kit_dates, key, "left_anti"))
