import random
from datetime import date
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedwright import fixed_values as fv
from feedwright import operators as op
from feedwright.operators import Pair
from feedwright.operators import inventory as inv


def test_latest_record_keeps_ties_and_drops_keys_without_time(frame):
    df = frame(
        "sku string, id int, inserted string, updated string",
        ("A", 1, "2025-01-01", "2026-01-02"),
        ("A", 2, "2025-01-01", "2026-01-02"),
        ("A", 3, "2025-06-01", None),
        ("B", 4, "2026-01-01", None),
        ("B", 5, "2025-12-01", "2025-12-20"),
        ("C", 6, None, None),
    )
    assert rows(op.latest_record(df, "sku", ["updated", "inserted"]), "id") == [(1,), (2,), (4,)]


def test_latest_record_matches_brute_force_with_a_hot_key(spark):
    random.seed(3)
    data = [("hot" if random.random() < 0.4 else f"k{random.randrange(50)}", i, random.choice([None, *range(40)])) for i in range(3000)]
    df = spark.createDataFrame(data, "k string, i int, t int")
    best = {}
    for k, _, t in data:
        if t is not None:
            best[k] = max(best.get(k, -1), t)
    want = sorted(((i,) for k, i, t in data if t is not None and t == best[k]), key=str)
    assert rows(op.latest_record(df, "k", ["t"]), "i") == want


def test_first_seen_date_prefers_the_kit(frame):
    products = frame("sku string, created_at date", ("P", date(2020, 1, 2)), ("P", date(2020, 1, 1)), ("K", date(2019, 1, 1)))
    kits = frame("sku string, created_at date", ("K", date(2021, 1, 1)), ("K", date(2021, 5, 1)))
    assert rows(op.first_seen_date(products, kits)) == [("K", date(2021, 5, 1)), ("P", date(2020, 1, 1))]


def test_population_modes(frame):
    a, b = frame("sku string", ("1",), ("1",), ("2",)), frame("sku string", ("2",))
    parts = {"a": a, "b": b}
    assert op.eligible_population(parts).count() == 4
    assert rows(op.eligible_population(parts, "distinct")) == [("1", "a"), ("2", "a"), ("2", "b")]
    assert rows(op.eligible_population(parts, "keys")) == [("1",), ("2",)]
    with pytest.raises(ValueError):
        op.eligible_population(parts, "some")


def test_gap_and_match_make_up_the_expected(frame):
    expected = frame("sku string", *[(str(i),) for i in range(20)], (None,))
    actual = frame("sku string", *[(str(i),) for i in range(0, 20, 3)], (None,))
    gap, match = op.coverage_gap(expected, actual, "sku"), op.only_in(expected, actual, "sku")
    assert gap.count() + match.count() == expected.count()
    assert (None,) in rows(gap)  # a null key is never found


def test_join_summary_refuses_different_key_types(frame):
    with pytest.raises(TypeError):
        op.join_summary(frame("k int", (1,)), frame("k bigint", (1,)), "k")


def test_join_summary_keeps_column_order(frame):
    left = frame("a int, k string, b int", (1, "x", 2))
    right = frame("c int, k string", (3, "x"))
    assert op.join_summary(left, right, "k").columns == ["a", "k", "b", "c"]
    assert op.join_summary(left, right, "k", "left_anti").columns == ["a", "k", "b"]


SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for k, v in SMALL_PARTITIONS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_rows(spark, n=200_000):
    """A third of all rows share one key."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string"))
    return spark.range(0, n, 1, 8).select(key.alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), (F.col("id") % 7).alias("t"))


def final_plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[: text.index("== Initial Plan ==")]


def test_hot_key_of_a_summary_join_is_split(spark, small_partitions):
    big = hot_rows(spark)
    joined = op.join_summary(big, big.groupBy("k").agg(F.count("*").alias("n")), "k")
    out = joined.select(F.sum(F.length("v") + F.col("n") * 0).alias("s"))
    assert out.collect()[0][0] == 200_000 * 64
    assert "skew=true" in final_plan(out)


def test_hot_key_is_split_in_a_row_of_look_ups(spark, small_partitions):
    big = hot_rows(spark)
    a, b = big.filter("t < 5").select("k"), big.filter("t = 6").select("k")
    out = op.exclude(op.only_in(big, a, "k"), b, "k").agg(F.count("v").alias("n"))
    keys_a, keys_b = {"hot"}, {"hot"}
    for i in range(200_000):
        if i % 3:
            keys_a.add(str(i)) if i % 7 < 5 else keys_b.add(str(i)) if i % 7 == 6 else None
    want = sum(1 for i in range(200_000) for k in ["hot" if i % 3 == 0 else str(i)] if k in keys_a and k not in keys_b)
    assert out.collect()[0][0] == want
    assert "skew=true" in final_plan(out)


def test_look_ups_on_one_key_share_an_exchange(spark, small_partitions):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_partkey", "l_suppkey", "l_quantity")
    a, b = df.filter("l_quantity > 40"), df.filter("l_quantity < 2")
    plan = op.exclude(op.only_in(df, a, "l_partkey"), b, "l_partkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 3  # the rows, and one distinct per key list
    assert plan.count("Exchange hashpartitioning(") == 5  # plus each key list to the rows' layout


def test_latest_record_splits_a_hot_key(spark, small_partitions):
    big = hot_rows(spark).withColumn("t", F.lit(1))  # every row of the hot key ties
    out = op.latest_record(big, "k", ["t"]).agg(F.count("v").alias("n"))
    assert out.collect()[0][0] == 200_000
    assert "skew=true" in final_plan(out)


def test_reconcile_with_itself_is_empty(frame):
    df = frame("sku string, price int", *[(str(i), i if i % 4 else None) for i in range(40)])
    pairs = [Pair("price_check", "price", "other", "null_equal")]
    assert op.reconcile(df, df.withColumnRenamed("price", "other"), "sku", pairs).count() == 0


def test_reconcile_reports_nulls_when_strict(frame):
    a = frame("sku string, x int", ("1", 5), ("2", None), ("3", 7), ("4", 8))
    b = frame("sku string, y int", ("1", None), ("2", None), ("3", 7))
    got = rows(op.reconcile(a, b, "sku", [Pair("check", "x", "y")], how="left"), "sku", "check")
    assert got == [("1", "false"), ("2", "false"), ("4", "false")]
    assert op.reconcile(a, b, "sku", [Pair("check", "x", "y")], keep="all").count() == 3


def test_channel_parity(frame):
    df = frame("sku string, ch string, p int", ("1", "A", 5), ("1", "B", 5), ("2", "A", 5), ("2", "B", None), ("3", "A", 1))
    assert rows(op.channel_parity(df, "sku", "ch", "A", "B", ["p"]), "sku") == [("2",)]


def test_store_string_is_recoded_after_sorting(frame):
    df = frame("sku string, store string", *[("x", s) for s in ("D", "1", "J", "8", "1")], ("y", None))
    assert rows(op.store_string(df, "sku", "store", "s", fv.STORE_RECODE, "0")) == [("x", "1,8,12,18"), ("y", "0")]


def test_flag_rollup_without_rows_is_false(frame):
    df = frame("sku string, store string, web string", ("x", "1", "C"), ("x", "7", "Y"), ("y", "8", None))
    got = op.flag_rollup(df, "sku", F.col("web").isin(fv.WEB_FLAGS), "store", fv.CHANNEL_STORES)
    assert rows(got) == [("x", "True", "False", "False", "False"), ("y", "False", "False", "False", "False")]


def test_price_matrix_and_unpivot(frame):
    prices = frame("sku string, catalog_id string, catalog_price int", ("k", "MASTER13", 3), ("k", "OTHER", 9))
    assert rows(op.catalog_price_matrix(prices, fv.PRICE_CATALOGS)) == [("k", 3, 0, 0)]
    wide = frame("sku string, a1 int, a2 int", ("x", 1, None))
    got = op.location_unpivot(wide, "sku", {"1": {"a": "a1"}, "2": {"a": "a2"}})
    assert rows(got) == [("x", "1", 1), ("x", "2", None)]


QTY = "decimal(18,4)"


def test_kit_floor_min(frame):
    kits = frame(f"sku string, component_sku string, component_quantity {QTY}", ("K", "a", D(2)), ("K", "b", D(3)), ("M", "a", D(2)), ("M", "z", D(1)))
    stock = frame(f"sku string, net {QTY}", ("a", D(7)), ("b", D(9)))
    assert rows(op.kit_floor_min(kits, stock, how="left")) == [("K", 3), ("M", 3)]  # missing component skipped
    only_missing = kits.filter("component_sku = 'z'")
    assert rows(op.kit_floor_min(only_missing, stock, how="left")) == [("M", None)]
    assert rows(op.kit_floor_min(only_missing, stock)) == []
    negative = frame(f"sku string, net {QTY}", ("a", D(-5)), ("b", D(9)))
    assert rows(op.kit_floor_min(kits, negative)) == [("K", 0), ("M", 0)]


def test_kit_grid_counts_a_missing_component_as_zero(frame):
    kits = frame(f"sku string, component_sku string, component_quantity {QTY}", ("K", "A", D(2)), ("K", "Z", D(1)), ("K", "X-FBA", D(1)))
    measures = ", ".join(f"{m} {QTY}" for m in inv.MEASURES)
    items = frame(f"item_sku string, store string, {measures}", ("A", "1", D(7), D(0), D(4), D(1)))
    got = rows(inv.kit_quantities_by_store(op.kit_store_grid(kits, items, ["1", "2"])))
    assert got == [("K", "1", 0, 0, 0, 0), ("K", "2", 0, 0, 0, 0)]
    alone = rows(inv.kit_quantities_by_store(op.kit_store_grid(kits.filter("component_sku = 'A'"), items, ["1"])))
    assert alone == [("K", "1", 3, 0, 2, 0)]


def test_kit_quantity_never_exceeds_any_component(spark):
    random.seed(5)
    parts = [(f"K{i % 30}", f"c{random.randrange(40)}", D(random.randint(1, 5))) for i in range(200)]
    kits = spark.createDataFrame(parts, f"sku string, component_sku string, component_quantity {QTY}")
    amounts = {f"c{i}": random.randint(-5, 90) for i in range(40)}
    stock = spark.createDataFrame([(k, D(v)) for k, v in amounts.items()], f"sku string, net {QTY}")
    want = {}
    for sku, c, q in parts:
        n = max(0, amounts[c] // int(q)) if amounts[c] >= 0 else 0
        want[sku] = min(want.get(sku, n), n)
    assert dict(rows(op.kit_floor_min(kits, stock))) == want


def test_measures_do_not_fan_out(frame):
    members = frame("sku string, on_hand int", ("a", 10), ("b", 1))
    pit = frame("sku string, stock_pit int", ("a", 1), ("a", 2))
    orders = frame("sku string, open int", ("a", 5), ("zz", 9))
    assert rows(op.collect_measures([members], [pit, orders]), "sku", "on_hand", "stock_pit", "open") == [
        ("a", D(10), D(3), D(5)),
        ("b", D(1), D(0), D(0)),
    ]


def test_available_is_clamped(frame):
    m = frame(f"sku string, on_hand {QTY}, stock_pit {QTY}, committed {QTY}, safety {QTY}, pending {QTY}",
              ("a", D(3), D(-4), D(5), D(0), D(0)), ("b", D("7.5"), D(-4), D(1), D(1), D(0)))
    assert rows(op.available_to_sell(m, inv.MF_V1), "sku", "available") == [("a", 0), ("b", 1)]
    assert rows(op.available_to_sell(m, inv.MF_V2), "sku", "available") == [("a", 0), ("b", 5)]


def test_alias_resolved_sum(frame):
    pending = frame("sku string, quantity int", ("AMZ1", 2), ("1", 3), ("AMZ9", 4))
    xref = frame("alias_sku string, sku string", ("AMZ1", "1"))
    assert rows(op.alias_resolved_sum(pending, xref)) == [("1", 5), ("AMZ9", 4)]


def test_open_orders_count_once_per_tag(frame):
    orders = frame("order_number string, status_code string, warehouse_code string", ("1", "A", "HHH"), ("2", "c", "HHH"), ("3", "B", "HTOOL"))
    tags = frame("order_number string, udf_code string", ("1", "HHCV3"), ("1", "cv3"), ("2", "CV3"), ("3", "CV3"))
    lines = frame("order_number string, sku string, quantity_ordered int, canceled_quantity int", ("1", "x", 5, 1), ("2", "x", 9, 0), ("3", "x", 2, 0))
    args = (orders, tags, lines, fv.SHOP_ORDER_CODES, fv.CLOSED_ORDER_STATUSES)
    assert rows(op.open_order_qty(*args)) == [("x", D(10))]
    assert rows(op.open_order_qty(*args, warehouse="htool")) == [("x", D(2))]
    assert rows(op.open_order_qty(*args, split={"HHH": "a", "HTOOL": "b"})) == [("x", D(8), D(2))]


def test_kit_beats_product(frame):
    products = frame("sku string, available bigint", ("a", 5), ("k", 9))
    kits = frame("sku string, kit_available bigint", ("k", 2), ("only", 1))
    assert rows(op.kit_over_product(products, kits)) == [("a", 5), ("k", 2), ("only", 1)]
    assert rows(op.kit_over_product(products, kits, kit_skus=False)) == [("a", 5), ("k", 2)]


CODE = "sku string, code string, source string, primary_flag string, updated date"


def test_upc_cascade(frame):
    d1, d2 = date(2024, 1, 1), date(2025, 1, 1)
    codes = frame(
        CODE,
        ("p", "123456789012 ", "S", "y", d1), ("p", "999999999999", "M", "N", d2),
        ("m", "111111111111", "m", "N", d1), ("m", "222222222222", "s", None, d2),
        ("l", "333333333333", "S", None, d1), ("l", "4444444444444", "S", None, d2),
        ("t", "555555555555", "S", None, d2), ("t", "666666666666", "S", None, d2),
        ("x", "12345678901", "M", "Y", d2),
    )
    assert rows(op.upc_cascade(codes)) == [
        ("l", "4444444444444", 3), ("m", "111111111111", 2), ("p", "123456789012", 1),
        ("t", "555555555555", 3), ("t", "666666666666", 3),
    ]


def test_missing_primary(frame):
    codes = frame(CODE, ("a", "1", "S", "N", None), ("a", "2", "S", "Y", None), ("b", "3", "S", None, None), ("c", "4", "S", "n", None))
    assert rows(op.missing_primary(codes), "sku") == [("b",), ("c",)]


def test_duplicates_and_mixed_states(frame):
    df = frame("k string, v string, s int", ("a", "x", 1), ("a", "x", None), ("b", "x", 1), ("b", "y", 2), (None, "z", 1), (None, "z", 1))
    assert rows(op.duplicate_groups(df, ["k", "v"])) == [("a", "x", 2), (None, "z", 2)]
    assert rows(op.multi_value_keys(df, "k", "v"), "k") == [("b",)]
    assert rows(op.mixed_state_keys(df, "k", "s"), "k") == [("a",)]


def test_json(frame):
    df = frame("id int, json string",
               (1, '{"family":null}'), (2, '{"family":"x"}'), (3, "{}"),
               (4, '{"values":{"price":[{"scope":"b","data":[{"amount":"2"}]},{"scope":"a","data":[{"amount":"1"},{"amount":"9"}]}]}}'),
               (5, '{"values":{"price":[{"scope":"a","data":[]}]}}'))
    assert rows(op.json_unassigned(df, "family"), "id") == [(1,)]
    assert rows(op.json_scope_extract(df, "id", "price", "a")) == [(4, "1"), (5, None)]


def test_membership_and_presence(frame):
    wanted = frame("sku string", ("a",), ("b",), ("c",))
    lists = {"x": frame("sku string", ("a",), ("a",)), "y": frame("sku string", ("b",))}
    assert rows(op.membership_flags(wanted, lists)) == [("a", 1, 0, 1), ("b", 0, 1, 1), ("c", 0, 0, 0)]
    report = op.presence_report(wanted, {"x": frame("sku string, n int", ("a", 7))})
    assert rows(report, "sku", "exists_in_x", "n") == [("a", "Y", 7), ("b", "N", None), ("c", "N", None)]


def test_components_of_quantity_zero_are_skipped(frame):
    stock = frame("sku string, net decimal(18,4)", ("a", D(7)), ("b", D(4)))
    schema = "sku string, component_sku string, component_quantity decimal(18,4)"
    kits = frame(schema, ("K", "a", D(2)), ("K", "b", D(0)), ("Z", "a", D(0)), ("N", "a", None))
    for how in ("inner", "left"):
        assert rows(op.kit_floor_min(kits, stock, how=how)) == [("K", 3), ("N", None), ("Z", None)]
    grid = frame("sku string, store string, component_sku string, component_quantity decimal(18,4), q decimal(18,4)", ("K", "1", "a", D(0), D(9)), ("K", "1", "b", D(4), D(9)), ("Z", "1", "a", D(0), D(9)))
    assert rows(op.kit_quantities_by_store(grid, ["q"])) == [("K", "1", 2), ("Z", "1", None)]


def test_an_alias_listed_twice_counts_once(frame):
    pending = frame("sku string, quantity int", ("m1", 5), ("m2", 3), ("own", 1))
    xref = frame("alias_sku string, sku string", ("m1", "s1"), ("m1", "s1"), ("m2", "s1"), ("m2", "s2"))
    assert rows(op.alias_resolved_sum(pending, xref)) == [("own", 1), ("s1", 8), ("s2", 3)]
    assert rows(op.multi_value_keys(xref, "alias_sku", "sku")) == [("m2", 2)]


def test_presence_in_several_systems(frame):
    wanted = frame("sku string, w int", ("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5))
    systems = {
        "x": frame("sku string, n int", ("a", 7), ("a", 8), (None, 9), ("z", 1)),
        "y": frame("sku string, m int", ("b", 7)),
        "w": frame("sku string, o int", ("a", 0)),
    }
    expected = wanted
    for name, df in systems.items():
        mark = f"exists_in_{name}"
        expected = expected.join(df.withColumn(mark, F.lit("Y")), "sku", "left").withColumn(mark, F.coalesce(mark, F.lit("N")))
    got = op.presence_report(wanted, systems)
    assert got.columns == expected.columns and rows(got) == rows(expected)
    assert rows(op.presence_report(wanted.filter("false"), systems)) == []


def scans(spark, df):
    """Files read by a plan in which equal exchanges are shared."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().count("FileScan")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")


def test_left_many_reads_its_left_side_once(spark):
    left = table(spark, "orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    right = table(spark, "lineitem").select(F.col("l_orderkey").alias("k"), "l_quantity")
    # The right side is read for its keys and for its rows.
    assert scans(spark, op.left_many(left, right, "k")) == 3


def test_presence_report_grows_with_the_systems(spark):
    wanted = table(spark, "part").select(F.col("p_partkey").alias("sku"))
    line = table(spark, "lineitem").select(F.col("l_partkey").alias("sku"), "l_quantity")
    counts = [
        scans(spark, op.presence_report(wanted, {f"s{i}": line.withColumnRenamed("l_quantity", f"q{i}") for i in range(n)}))
        for n in (1, 2, 3, 4, 5)
    ]
    assert [b - a for a, b in zip(counts, counts[1:])] == [counts[1] - counts[0]] * 4 and counts[-1] <= 3 + 3 * 5, counts


def test_left_many_is_a_left_join_that_splits_its_right_side(spark, frame):
    left = frame("k string, a int", ("x", 1), ("y", 2), (None, 3))
    right = frame("k string, b int", *[("x", i) for i in range(3)], ("z", 9), (None, 8))
    assert rows(op.left_many(left, right, "k")) == rows(left.join(right, "k", "left"))
    assert op.left_many(left, right, "k").columns == ["k", "a", "b"]
    two = right.withColumn("a", F.lit(1))
    assert rows(op.left_many(left, two, ["k", "a"])) == rows(left.join(two, ["k", "a"], "left"))


def test_codes_are_compared_as_text(spark, frame):
    stores = frame("sku string, store string", ("a", "D"), ("a", "d"), ("a", "8 "))
    assert rows(op.store_string(stores, "sku", "store", "stores", recode={"D": "12"})) == [("a", "8,12")]
    prices = frame("sku string, catalog_id string, catalog_price decimal(18,2)", ("a", "master13 ", D("2")))
    assert rows(op.catalog_price_matrix(prices, ["MASTER13"])) == [("a", D("2.00"))]
    pairs = frame("l string, r string", ("0123 ", "0123"), ("Ab", "aB"), ("a", "b"))
    assert [r[-1] for r in op.flag_pairs(pairs, [Pair("same", "l", "r")], keep="all").collect()] == ["true", "true", "false"]
    expected = frame("sku string, warehouse_code string, store string", ("a", "H", "1"))
    found = frame("sku string, warehouse_code string, actual_location string", ("a", "H", "10-A1"), ("a", "H", "10-a1 "))
    assert op.multi_location_skus(expected, found).count() == 0


def test_hot_key_on_the_right_is_split(spark):
    """A third of the right side has one key; its join must not settle in one task."""
    left = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    right = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id") % 2000).cast("string").alias("k"), F.col("id").alias("v"))
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        out = op.left_many(left, right, "k")
        assert out.count() == left.join(right, "k", "left").count()
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
