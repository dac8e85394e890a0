"""Product codes: which one counts, which are missing, and a listing of all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed_values import CODE_LENGTHS
from ..functions import fold
from .keys import left_many
from .population import exclude


def upc_cascade(codes: DataFrame, lengths: Sequence[int] = CODE_LENGTHS) -> DataFrame:
    """Codes of the best kind a sku has: primary, else newest source-M code, else newest valid code.

    ``codes`` (sku, code, source, primary_flag, updated). Codes tied at the newest date are all returned. One grouping
    finds each sku's best kind and date; every code offers itself under the kinds it qualifies for, and the match is on
    (sku, kind, date), so a sku with very many codes spreads over its dates.
    """
    rows = codes.select(
        "sku",
        F.trim("code").alias("code"),
        (fold("primary_flag") == "y").alias("primary"),
        (fold("source") == "m").alias("m"),
        "updated",
    ).distinct()
    valid = F.length("code").isin(list(lengths))
    best = rows.groupBy("sku").agg(
        F.max(F.when(valid & F.col("primary"), F.lit(1))).alias("_primary"),
        F.max(F.when(valid & F.col("m"), F.col("updated"))).alias("_m_at"),
        F.max(F.when(valid, F.col("updated"))).alias("_at"),
    )
    kind = F.when(F.col("_primary") == 1, 1).when(F.col("_m_at").isNotNull(), 2).when(F.col("_at").isNotNull(), 3)
    best = best.select(
        "sku", kind.alias("kind"), F.when(kind == 2, F.col("_m_at")).when(kind == 3, F.col("_at")).alias("at")
    ).filter(F.col("kind").isNotNull())
    offers = F.array(
        F.struct((valid & F.col("primary")).alias("ok"), F.lit(1).alias("kind"), F.lit(None).alias("at")),
        F.struct(F.col("m").alias("ok"), F.lit(2).alias("kind"), F.col("updated").alias("at")),
        F.struct(valid.alias("ok"), F.lit(3).alias("kind"), F.col("updated").alias("at")),
    )
    offered = rows.select("sku", "code", F.inline(offers)).filter("ok").drop("ok")
    far = F.lit("0001-01-01").cast(dict(codes.dtypes)["updated"])
    best = best.withColumn("at", F.coalesce("at", far))
    offered = offered.withColumn("at", F.coalesce("at", far))
    return offered.join(best, ["sku", "kind", "at"]).select("sku", "code", "kind").distinct()


def missing_primary(codes: DataFrame) -> DataFrame:
    """Code rows of skus that have a non-primary or unflagged code and no primary one."""
    flag = fold("primary_flag")
    loose = codes.filter((flag == "n") | F.col("primary_flag").isNull())
    return exclude(loose, codes.filter(flag == "y"), "sku").distinct()


def upc_listing(population: DataFrame, item_codes: DataFrame, kit_codes: DataFrame) -> DataFrame:
    """Every eligible sku with its codes, or with none.

    ``population`` (sku, source_kind 'item'|'kit', source), ``item_codes`` (sku, code, source, primary_flag, updated),
    ``kit_codes`` (sku, code). The population and the codes are folded before they meet.
    """
    wanted = population.distinct()
    items = item_codes.select(
        "sku",
        F.col("sku").alias("code_sku"),
        "code",
        F.col("source").alias("code_source"),
        "primary_flag",
        F.col("updated").alias("code_updated"),
    ).distinct()
    updated = dict(item_codes.dtypes)["updated"]
    kits = kit_codes.select(
        "sku",
        F.col("sku").alias("code_sku"),
        "code",
        F.lit("").alias("code_source"),
        F.lit("").alias("primary_flag"),
        F.lit(None).cast(updated).alias("code_updated"),
    ).distinct()
    of = {k: wanted.filter(F.col("source_kind") == k).drop("source_kind") for k in ("item", "kit")}
    blank_kit = {"code_source": F.coalesce("code_source", F.lit("")), "primary_flag": F.coalesce("primary_flag", F.lit(""))}
    return left_many(of["item"], items, "sku").union(left_many(of["kit"], kits, "sku").withColumns(blank_kit))
