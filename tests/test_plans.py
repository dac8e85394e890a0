"""What no plan may contain: all-pairs joins, per-row Python, whole groups gathered in a window."""

from concurrent.futures import ThreadPoolExecutor

from conftest import SF
from test_against_sql import is_ours

import __spark_entry__ as entry

FORBIDDEN = ("CartesianProduct", "NestedLoop", "Python", "MapInPandas", "FlatMapGroups", "WindowExec", "Window [")
# Reports of one row, or of one row per field, over map-side partial aggregates.
ONE_ROW = {"check_null_sweep", "check_rental_tiers", "q44_attribute_population", "q45_rate_tier_checks", "q48b_drop_counts", "q48d_drop_steps"}


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with ThreadPoolExecutor(4) as pool:
            names = [n for n in entry.queries() if is_ours(n)]
            plans = dict(zip(names, pool.map(lambda n: plan(spark, n), names)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {n: [w for w in FORBIDDEN if w in p] for n, p in plans.items() if any(w in p for w in FORBIDDEN)} == {}
    # Nothing falls back to a broadcast when Spark may not choose one by size.
    assert [n for n, p in plans.items() if "BroadcastExchange" in p] == []
    assert {n for n, p in plans.items() if "Exchange SinglePartition" in p} == ONE_ROW


def test_scans_read_only_needed_columns(spark):
    p = plan(spark, "q29b_multi_value_keys")
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in p


def test_filters_reach_the_scan(spark):
    p = plan(spark, "check_appliance_coverage") + plan(spark, "q29a_duplicate_groups")
    assert "GreaterThan(l_shipdate" in p


def test_latest_record_shuffles_rows_on_key_and_time(spark):
    p = plan(spark, "q01_latest_record")
    assert "hashpartitioning(o_custkey" in p and "_fw_at" in p and "Window" not in p
