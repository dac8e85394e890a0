from datetime import date, datetime
from decimal import Decimal as D

from conftest import rows
from pyspark.sql import functions as F

from feedwright import fixed_values as fv
from feedwright import operators as op

AS_OF = date(2026, 5, 8)


def shipping(frame):
    tags = frame("order_number string, udf_order_text string", ("o1", "shop-1"), ("o2", "shop-2"), ("o3", "shop-3"))
    lines = frame(
        "order_number string, line_number int, sku string, quantity_ordered int, first_shipped_datetime string, first_shipped_shipdoc string",
        ("o1", 1, "a", 1, "2026-05-01", "D1"), ("o1", 2, "b", 1, None, None), ("o1", 3, "c", 1, "2026-05-07", "D1"),
        ("o2", 1, "a", 1, "abc", "D2"), ("o2", 2, "a", 1, "2026-04-30", "D2"),
    )
    tracking = frame("order_number string, shipping_document_number string, shipper_code string, tracking_number string, shipment_type_code string",
                     ("o1", "D1", "FEDX", " 9 ", "G"))
    log = frame("channelorderid string, sku string, status string", ("shop-1", "c", "completed"), ("shop-1", "a", "Failed"))
    return tags, lines, tracking, log


def test_shipped_not_logged(frame):
    got = op.shipped_not_logged(*shipping(frame), as_of=AS_OF)
    assert rows(got, "order_number", "line_number", "shipper_code", "url") == [("o1", 1, "FedEx", fv.TRACKING_PAGES["FEDX"] + "9")]


def test_unshipped_lines_and_orders_without_lines(frame):
    got = op.unshipped_not_logged(*shipping(frame))
    assert rows(got, "order_number", "line_number", "tracking_number") == [("o1", 2, " 9 "), ("o3", None, None)]


def test_event_totals(frame):
    events = frame("event_id string, event_name string", ("1", "a"), ("2", "b"), ("3", "none"), ("4", "refunded"))
    orders = frame("order_id string, event_id string, total_charge decimal(18,2), refunded_at date",
                   ("o1", "1", D(10), None), ("o2", "1", D(5), date(2026, 1, 1)), ("o3", "2", D(7), None), ("o4", "4", D(9), date(2026, 1, 1)))
    tickets = frame("order_id string, type string", ("o1", "Meal"), ("o1", "adult"), ("o1", "adult"), ("o2", "adult"), ("o4", "adult"))
    assert rows(op.event_totals(events, orders, tickets)) == [
        ("1", "a", D("10.00"), 3, 1, 4), ("2", "b", D("7.00"), 0, 0, 0), ("3", "none", D("0.00"), 0, 0, 0)]


def test_store_lookup_prefers_the_exact_format(frame):
    lookup = frame("warehouse_code string, receiving_format string, store_num string", ("W", "F", "9"), ("W", None, "1"))
    lines = frame("id int, w string, f string", (1, "W", "F"), (2, "W", "X"), (3, "W", None), (4, "Z", "F"))
    assert rows(op.store_lookup(lines, lookup, "w", "f"), "id", "store") == [(1, "9"), (2, "1"), (3, "1"), (4, None)]


def test_open_lines_leave_out_what_is_shipped_in_full(frame):
    lines = frame("id int, line_item_status_code string, line_status string, quantity_ordered int, canceled_quantity int, shipped_quantity int",
                  (1, "O", "A", 5, 1, 4), (2, "O", "A", 5, 1, 3), (3, None, "A", 5, 0, 0), (4, "C", "A", 5, 0, 0), (5, "O", "X", 5, 0, 0))
    assert rows(op.open_lines(lines), "id") == [(2,)]


def locations(frame):
    q = "decimal(18,4)"
    items = frame(
        f"item_number string, store string, department string, location_code string, primary_vendor string, quantity_on_hand {q}, committed_quantity {q}",
        ("A ", "1", "10", "B2", "V", D(5), D(2)), ("b", "2", "10", "", "V", D(3), D(5)), ("C", "4", None, "X", "5haco", D(1), None),
        ("ZZ1", "1", "1", "1", "V", D(1), D(0)), ("F", "D", "10", "L", "V", D(8), D(0)),
    )
    return op.expected_locations(items, fv.STORES_WITH_LOCATIONS)


def test_expected_locations(frame):
    got = rows(locations(frame), "sku", "expected_location", "warehouse_code", "free")
    assert got == [("A", "10-B2", "HHH", D(3)), ("B", "", "HTOOL", D(0)), ("C", "-X", "HHMF", D(1)), ("F-FBA", "L", "HTOOL", D(8))]


def test_location_reconcile(frame):
    actual = frame(
        "sku string, warehouse_code string, location_type string, product_quantity decimal(18,4)",
        ("a", "HHH", "10-b2 ", D(3)), ("B", "HTOOL", "10-SO", D(0)), ("C", "HHMF", "other", D(1)), ("F-fba", "HTOOL", "L", D(7)),
    )
    expected, found = locations(frame), op.stored_locations(actual)
    got = op.location_reconcile(op.match_locations(expected, found), op.multi_location_skus(expected, found))
    assert rows(got, "sku", "location_check", "quantity_check") == [("C", "false", "true"), ("F-FBA", "true", "false")]
    twice = op.stored_locations(actual.union(frame(actual.schema, ("C", "HHMF", "again", D(1)))))
    multiples = op.multi_location_skus(expected, twice)
    assert rows(multiples) == [("C", "4", 2)]
    assert rows(op.location_reconcile(op.match_locations(expected, twice), multiples), "sku") == [("F-FBA",)]


def test_change_log_match(frame):
    wrong = frame("sku string, expected_location string, actual_location string", ("A", "1", "2"), ("B", "x", "X "), ("C", "1", "9"))
    log = frame("sku string, warehouse string, previouslocation string, newlocation string, changedat string", ("a", "HHH", "2", "1", "t"))
    assert rows(op.change_log_match(wrong, log), "sku", "newlocation") == [("A", "1"), ("C", None)]


def test_calendar_totals_leave_out_sundays(frame):
    df = frame("d timestamp_ntz, n int", (datetime(2026, 4, 4, 9), 1), (datetime(2026, 4, 5, 9), 10), (datetime(2026, 4, 6, 9), 2), (datetime(2026, 3, 30, 9), 4))
    assert rows(op.calendar_totals(df, "d", "n", "2026-04-01")) == [(date(2026, 4, 4), 1), (date(2026, 4, 6), 2)]
    assert rows(op.calendar_totals(df, "d", "n", "2026-03", grain="month")) == [("2026-03", 4), ("2026-04", 3)]


def test_local_month_boundary(frame):
    df = frame("loc string, timestamputc timestamp_ntz, incount int, outcount int",
               ("x", datetime(2025, 2, 1, 4, 30), 1, 0), ("x", datetime(2025, 2, 1, 5, 30), 10, 0), ("x", datetime(2025, 3, 1, 4, 59), 100, 0))
    assert rows(op.local_time_counts(df, ["loc"], "2025-02")) == [("x", 110, 0)]
    assert rows(op.local_time_counts(df, ["loc"], "2025-01")) == [("x", 1, 0)]
    assert rows(op.local_time_counts(df, ["loc"], "2025-02", zone=None)) == [("x", 11, 0)]


def test_systems_need_all_years(frame):
    s = "loc string, at timestamp_ntz, incount int, outcount int"
    y5, y6 = datetime(2025, 5, 1), datetime(2026, 5, 1)
    a = frame(s, ("x", y5, 1, 2), ("x", y6, 3, 4), ("y", y5, 1, 1))
    b = frame(s, ("x", y5, 5, 6), ("x", y6, 7, 8), ("y", y5, 1, 1), ("y", y6, 1, 1))
    got = op.period_cross_system({"own": (a, "at"), "dw": (b, "at")}, "loc", ["2025", "2026"])
    assert rows(got, "loc", "incount_2025_own", "incount_2025_dw", "outcount_2026_own", "outcount_2026_dw") == [("x", 1, 5, 4, 8)]


def test_threshold_days(frame):
    readings = frame("day date, value double", (date(2025, 7, 1), 266.6), (date(2025, 7, 1), 300.0), (date(2025, 7, 2), 266.5))
    traffic = frame("loc string, day date, incount int", ("x", date(2025, 7, 1), 5), ("x", date(2025, 7, 1), 6), ("x", date(2025, 7, 2), 7))
    assert rows(op.threshold_days(readings, traffic, 266.6, "loc")) == [("x", 11)]


def test_delta_feed(frame):
    now = frame("sku string, p int, live boolean", ("same", 1, True), ("changed", 2, True), ("new", 3, True), ("to_null", None, True), ("gone", 9, False))
    last = frame("sku string, p int", ("same", 1), ("changed", 1), ("to_null", 4), ("gone", 1))
    got = op.delta_feed(now, last, "sku", ["p"], F.col("live"))
    assert rows(got, "sku", "delta") == [("changed", "changed"), ("new", "new"), ("to_null", "changed")]
    assert op.delta_feed(now, now, "sku", ["p"]).count() == 0


def test_write_policy(frame):
    now = frame("sku string, a int, b int, c int", ("old", 1, 2, 3), ("same", 1, 2, 3), ("new", 1, 2, 3))
    last = frame("sku string, a int, b int, c int", ("old", 1, 9, 9), ("same", 1, 2, 3))
    got = op.write_policy(now, last, "sku", {"a": "force", "b": "delta", "c": "first"})
    assert rows(got, "sku", "a", "b", "c") == [("new", 1, 2, 3), ("old", 1, 2, None), ("same", 1, None, None)]
    assert rows(got, "sku", "b_sent", "c_sent") == [("new", True, True), ("old", True, False), ("same", False, False)]
    assert rows(op.write_policy(now, last, "sku", {"b": "delta"}), "sku") == [("new",), ("old",)]
    # A cleared value is sent as null, an untouched null is not sent.
    last = frame("sku string, b int", ("cleared", 1), ("empty", None))
    now = frame("sku string, b int", ("cleared", None), ("empty", None), ("first", None))
    assert rows(op.write_policy(now, last, "sku", {"b": "delta"})) == [("cleared", None, True), ("first", None, True)]


def test_owned_value(frame):
    a = frame("sku string, d date", ("1", date(2020, 1, 1)), ("2", None))
    b = frame("sku string, d date", ("1", date(2021, 1, 1)), ("2", date(2022, 1, 1)), ("3", None))
    assert rows(op.owned_value(a, b, "sku", "d")) == [("1", date(2020, 1, 1)), ("2", date(2022, 1, 1)), ("3", None)]


def test_rate_tiers(frame):
    items = frame("sku string", ("a",), ("b",), ("c",), ("d",))
    rates = frame("sku string, rate_type string, rate decimal(18,2)",
                  ("a", "4HR", D(5)), ("a", "1DAY", D(4)), ("a", "1WK", D(9)),
                  ("b", "4HR", D(0)), ("b", "1DAY", None), ("b", "1WK", D(9)),
                  ("c", "4HR", D(2)), ("c", "1DAY", D(2)), ("c", "1WK", D(2)))
    got = dict(rows(op.rate_tier_checks(items, rates, fv.RATE_TIERS)))
    assert got["null or zero 4HR rate"] == 1 and got["null or zero 1DAY rate"] == 1
    assert got["missing 4HR rate"] == 1 and got["missing at least one rate tier"] == 1
    assert got["1DAY rate below 4HR rate"] == 1 and got["all rate tiers equal"] == 1


def test_silent_drop_audit(frame):
    lines = frame("sku string", ("a",), ("a",), ("b",), (None,))
    ref = frame("sku string", ("a",), (None,))
    assert rows(op.silent_drop_audit(lines, ref, "sku")) == [("b", 1, "no reference row"), (None, 1, "null key")]
    assert rows(op.drop_counts(lines, ref, "sku")) == [(4, 2, 2, 1)]


def test_qa_rounds(frame):
    df = frame("program string, spec string, round int, passed boolean",
               ("p", "a", 1, True), ("p", "b", 1, False), ("p", "b", 2, False), ("p", "b", 3, True), ("p", "c", 1, True), ("p", "c", 1, False))
    assert rows(op.qa_round_stats(df, "program")) == [("p", 3, 2, D("0.6667"), 1, 3, 1)]


def test_null_sweep(frame):
    df = frame("a string, b string", ("x", None), (None, None))
    assert rows(op.attribute_population(df, ["a", "b"])) == [("a", 1, 1), ("b", 2, 0)]
