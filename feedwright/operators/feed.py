"""What a feed run sends, and how good it is."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import one_of
from .keys import as_list, distinct_keys, join_summary, join_unique

POLICIES = ("force", "delta", "first")


def delta_feed(
    current: DataFrame, previous: DataFrame, key: str | Sequence[str], tracked: Sequence[str], eligible: Column | None = None
) -> DataFrame:
    """Eligible rows that are new or differ in a tracked field from the last image sent.

    Only two images are compared, so a value that changed and changed back in between is not sent. ``eligible`` names
    the rows that may be sent at all; a row that has just become eligible is new when the last image lacks it.
    """
    key = as_list(key)
    now = current if eligible is None else current.filter(eligible)
    last = previous.select(*key, *[F.col(c).alias(f"_last_{c}") for c in tracked], F.lit(True).alias("_sent"))
    changed = reduce(Column.__or__, [~F.col(c).eqNullSafe(F.col(f"_last_{c}")) for c in tracked])
    reason = F.when(F.col("_sent").isNull(), F.lit("new")).when(changed, F.lit("changed"))
    joined = now.join(last, key, "left").withColumn("delta", reason).filter(F.col("delta").isNotNull())
    return joined.select(*current.columns, "delta")


def write_policy(
    current: DataFrame, previous: DataFrame, key: str | Sequence[str], policies: Mapping[str, str]
) -> DataFrame:
    """Per field: 'force' sends always, 'delta' only a changed value, 'first' only to a key never sent before.

    ``<field>_sent`` says whether a field is sent; one that is not is null, and a null that is sent clears the field. A key
    with nothing to send is left out.
    """
    bad = set(policies.values()) - set(POLICIES)
    if bad:
        raise ValueError(f"unknown policy {sorted(bad)}")
    key = as_list(key)
    last = previous.select(*key, *[F.col(c).alias(f"_last_{c}") for c in policies], F.lit(True).alias("_sent"))
    fresh = F.col("_sent").isNull()
    send = {
        "force": lambda c: F.lit(True),
        "delta": lambda c: fresh | ~F.col(c).eqNullSafe(F.col(f"_last_{c}")),
        "first": lambda c: fresh,
    }
    sent = [send[policy](c).alias(f"{c}_sent") for c, policy in policies.items()]
    out = current.join(last, key, "left").select("*", *sent).filter(reduce(Column.__or__, [F.col(f"{c}_sent") for c in policies]))
    values = [F.when(F.col(f"{c}_sent"), F.col(c)).alias(c) for c in policies]
    return out.select(*key, *values, *[f"{c}_sent" for c in policies])


def owned_value(first: DataFrame, second: DataFrame, key: str, field: str) -> DataFrame:
    """One value per key where two feeds own a field: the first feed's value wins unless it is null."""
    both = first.select(key, F.col(field).alias("_a"), F.lit(None).cast(dict(second.dtypes)[field]).alias("_b")).union(
        second.select(key, F.lit(None).cast(dict(first.dtypes)[field]), F.col(field))
    )
    return both.groupBy(key).agg(F.coalesce(F.max("_a"), F.max("_b")).alias(field))


def rows_with_attribute(df: DataFrame, attribute: str) -> DataFrame:
    return df.filter(F.col(attribute).isNotNull())


def attribute_population(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Null and filled counts per field: one scan of just those columns, one row per field."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(c)).alias(c) for c in fields])
    rows = F.array(
        *[F.struct(F.lit(c).alias("field"), (F.col("_n") - F.col(c)).alias("nulls"), F.col(c).alias("filled")) for c in fields]
    )
    return counts.select(F.inline(rows))


def rate_tier_checks(items: DataFrame, rates: DataFrame, tiers: Sequence[str], flags: Mapping[str, Column] | None = None) -> DataFrame:
    """Named discrepancy counts over the rate tiers of rental items.

    ``items`` (sku, ...) holds the rental skus, ``rates`` (sku, rate_type, rate). Per sku the tiers are laid side by
    side (smallest rate per tier); the counts are one more aggregate on top.
    """
    per_tier = [F.min(F.when(one_of("rate_type", [t]), F.col("rate"))).alias(f"rate_{t}") for t in tiers]
    records = [F.count(F.when(one_of("rate_type", [t]), 1)).alias(f"rows_{t}") for t in tiers]
    wide = rates.filter(one_of("rate_type", tiers)).groupBy("sku").agg(*per_tier, *records)
    rows = join_summary(items, wide, "sku", "left")
    missing = {t: F.coalesce(F.col(f"rows_{t}"), F.lit(0)) == 0 for t in tiers}
    tests: dict[str, Column] = {}
    for t in tiers:
        tests[f"null or zero {t} rate"] = ~missing[t] & (F.coalesce(F.col(f"rate_{t}"), F.lit(0)) == 0)
        tests[f"missing {t} rate"] = missing[t]
    for low, high in zip(tiers, tiers[1:]):
        tests[f"{high} rate below {low} rate"] = F.col(f"rate_{high}") < F.col(f"rate_{low}")
    tests["missing at least one rate tier"] = reduce(Column.__or__, missing.values())
    tests["all rate tiers equal"] = reduce(
        Column.__and__, [F.col(f"rate_{a}") == F.col(f"rate_{b}") for a, b in zip(tiers, tiers[1:])]
    )
    tests |= flags or {}
    names = list(tests)
    counts = rows.agg(*[F.count(F.when(tests[n], 1)).alias(f"_{i}") for i, n in enumerate(names)])
    out = F.array(
        *[F.struct(F.lit(n).alias("check_name"), F.col(f"_{i}").alias("discrepancy_count")) for i, n in enumerate(names)]
    )
    return counts.select(F.inline(out))


def silent_drop_audit(rows: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Keys that an inner join to ``reference`` would drop without a word, with the rows each would take along.

    A null key is lost as well and is listed as null.
    """
    per_key = rows.groupBy(on).agg(F.count("*").alias("lost_rows"))
    return join_unique(per_key, distinct_keys(reference, on), on, "left_anti").withColumn(
        "reason", F.when(F.col(on).isNull(), F.lit("null key")).otherwise(F.lit("no reference row"))
    )


def drop_counts(rows: DataFrame, reference: DataFrame, on: str) -> DataFrame:
    """Row and key counts before and after the reference join, in one row."""
    per_key = rows.groupBy(on).agg(F.count("*").alias("_rows"))
    ref = reference.groupBy(on).agg(F.count("*").alias("_ref"))
    joined = join_unique(per_key, ref, on, "left")
    found = F.col("_ref").isNotNull()
    return joined.agg(
        F.sum("_rows").alias("rows_in"),
        F.count(on).alias("keys_in"),
        F.coalesce(F.sum(F.when(found, F.col("_rows") * F.col("_ref"))), F.lit(0)).alias("rows_out"),
        F.count(F.when(found, 1)).alias("keys_out"),
    )


def qa_round_stats(results: DataFrame, group: str, spec: str = "spec", round_no: str = "round", passed: str = "passed") -> DataFrame:
    """Per group: specs, share failing their first round, and rounds until a spec first passed.

    ``results`` (group, spec, round, passed), several rows per spec and round allowed: a round passes when all do.
    """
    rounds = results.groupBy(group, spec, round_no).agg(F.min(F.col(passed).cast("int")).alias("_ok"))
    specs = rounds.groupBy(group, spec).agg(
        F.min(F.struct(round_no, "_ok")).getField("_ok").alias("_first_ok"),
        F.min(F.when(F.col("_ok") == 1, F.col(round_no))).alias("_rounds"),
    )
    n, failed = F.count("*"), F.count(F.when(F.col("_first_ok") == 0, 1))
    return specs.groupBy(group).agg(
        n.alias("specs"),
        failed.alias("failed_first_round"),
        (failed / n).cast("decimal(9,4)").alias("first_round_failure_share"),
        F.count(F.when(F.col("_rounds") >= 3, 1)).alias("needed_three_or_more"),
        F.max("_rounds").alias("longest"),
        F.count(F.when(F.col("_rounds").isNull(), 1)).alias("never_passed"),
    )


def cause_matrix(defects: DataFrame, cause: str, domain: str, domains: Sequence[str]) -> DataFrame:
    """Defects per root cause (rows) and domain (columns), with the row total."""
    cells = [F.count(F.when(F.col(domain) == d, 1)).alias(d) for d in domains]
    return defects.groupBy(cause).agg(*cells, F.count("*").alias("total"))
