"""Attributes held in JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_of

_VALUES = "array<struct<scope:string,data:array<struct<amount:string>>>>"


def json_scope_extract(df: DataFrame, key: str, attribute: str, scope: str, json: str = "json", alias: str = "amount") -> DataFrame:
    """First amount of an attribute for one scope; documents without the attribute or the scope give no row.

    Only the attribute's own array is parsed to columns, not the whole document.
    """
    values = F.from_json(F.get_json_object(F.col(json), f"$.values.{attribute}"), _VALUES)
    rows = df.select(key, F.inline(values))
    first = F.try_element_at(F.col("data"), F.lit(1)).getField("amount")
    return rows.filter(one_of("scope", [scope])).select(key, first.alias(alias))


def catalog_values(df: DataFrame, key: str, json: str = "json", path: str = "$.values", amount: str = "$.amount") -> DataFrame:
    """(key, attribute, scope, position, amount): every amount of every attribute of every document, by one parse.

    Each document becomes a variant once; its attributes, their entries and the amounts of an entry are exploded from
    that, so a further attribute costs no further parse. ``position`` counts the amounts of an entry from 1, amounts are
    text. Text that is no JSON and values of another shape give no row; an entry without scope has a null one.
    """
    explode = df.sparkSession.tvf.variant_explode

    def inner(rows: DataFrame, column: str, *names: str) -> DataFrame:
        return rows.lateralJoin(explode(F.col(column).outer()).toDF(*names)).drop(column)

    docs = df.select(F.col(key).alias("_id"), F.try_variant_get(F.try_parse_json(F.col(json)), path, "variant").alias("_values"))
    rows = inner(docs, "_values", "_p1", "attribute", "_entries").filter(F.col("attribute").isNotNull())
    # The members of an array have places, those of an object names.
    rows = inner(rows, "_entries", "_p2", "_k2", "_entry").filter(F.col("_k2").isNull())
    scope, data = F.try_variant_get("_entry", "$.scope", "string"), F.try_variant_get("_entry", "$.data", "variant")
    rows = rows.select("_id", "attribute", scope.alias("scope"), data.alias("_data"))
    rows = inner(rows, "_data", "_p3", "_k3", "_amount").filter(F.col("_k3").isNull())
    return rows.select(
        F.col("_id").alias(key), "attribute", "scope", (F.col("_p3") + 1).alias("position"), F.try_variant_get("_amount", amount, "string").alias("amount")
    )


def json_unassigned(df: DataFrame, name: str, json: str = "json") -> DataFrame:
    """Documents that mention a key whose value is null."""
    return df.filter(F.col(json).contains(name) & F.get_json_object(F.col(json), f"$.{name}").isNull())


def json_number(json: Column | str, path: str) -> Column:
    return F.get_json_object(F.col(json) if isinstance(json, str) else json, path).try_cast("bigint")
