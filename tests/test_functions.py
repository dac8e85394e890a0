from datetime import date, datetime
from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedwright import fixed_values as fv
from feedwright import functions as fn


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "raw, marks, want",
    [
        (" 100-FBA ", fv.SKU_MARKS, "100"),
        ("100-fba", fv.SKU_MARKS, "100"),
        ("100(A)", fv.SKU_MARKS, "100"),
        ("100(b)", fv.SKU_MARKS, "100(b)"),
        ("100(b)", fv.KIT_SKU_MARKS, "100"),
        ("100.old", fv.KIT_SKU_MARKS, "100"),
        ("100xold", fv.KIT_SKU_MARKS, "100xold"),
        (None, fv.SKU_MARKS, None),
    ],
)
def test_normalize_sku(spark, raw, marks, want):
    assert one(spark, fn.normalize_sku(F.lit(raw).cast("string"), marks)) == want


@pytest.mark.parametrize(
    "a, b, rule, want",
    [
        (5, 5, "strict", "true"),
        (5, None, "strict", "false"),
        (None, None, "strict", "false"),
        (None, None, "null_equal", "true"),
        (5, None, "null_equal", "false"),
        (0, None, "null_as", "true"),
        (1, None, "null_as", "false"),
    ],
)
def test_agree(spark, a, b, rule, want):
    assert one(spark, fn.agree(F.lit(a).cast("int"), F.lit(b).cast("int"), rule, 0)) == want


def test_agree_rejects_unknown_rule():
    with pytest.raises(ValueError):
        fn.agree("a", "b", "sometimes")


def test_text_compares_without_case_and_trailing_blanks(frame):
    df = frame("a string", ("Eagle",), ("eagle  ",), (" eagle",), (None,))
    assert df.filter(fn.one_of("a", ["EAGLE"])).count() == 2
    assert df.filter(fn.none_of("a", ["eagle"])).count() == 1
    assert df.filter(fn.none_of("a", ["eagle"], keep_null=True)).count() == 2


def test_decode(spark):
    money = F.lit('[{"amount":"99.99","currency":"USD"}]')
    assert one(spark, fn.decode_money(money)) == D("99.99")
    assert one(spark, fn.strip_money(money)) == "99.99"
    assert one(spark, fn.decode_offset_money(F.lit('[{"amount":"65.0000","currency":"USD"}]'))) == D("65.00")
    assert one(spark, fn.decode_money(F.lit('[{"amount":"abc"}]'))) is None
    assert one(spark, fn.decode_money(F.lit("junk"))) is None
    assert one(spark, fn.decode_list(F.lit('["1","4","adc"]'))) == "1,4,adc"
    assert one(spark, fn.list_items(F.lit('["1","4","adc"]'))) == ["1", "4", "adc"]
    assert one(spark, fn.decode_code(F.lit('["fridge"]'))) == "fridge"


def test_prices(spark):
    d = lambda x: F.lit(x).cast("decimal(18,2)")
    assert one(spark, fn.floor_money(F.lit("19.999").cast("decimal(18,4)"))) == D("19.99")
    assert one(spark, fn.price_hierarchy(d("0"), d("0"), d("80"), d("90"))) == D("90")
    assert one(spark, fn.price_hierarchy(d("0"), d("70"), d("80"), d("90"))) == D("70")
    assert one(spark, fn.price_hierarchy(d("60"), d("70"), d("80"), d("90"))) == D("60")
    assert one(spark, fn.price_hierarchy(d(None), d(None), d(None), d(None))) == D("0")
    assert one(spark, fn.cascade_first_nonzero(d("0"), d(None), d("12.5"))) == D("12.5")
    assert one(spark, fn.cascade_first_nonzero(d("0"), d(None))) is None
    assert one(spark, fn.sale_mark(d("1"))) == "no sale price"
    assert one(spark, fn.not_negative(F.lit(-2))) == 0


@pytest.mark.parametrize(
    "utc, local",
    [("2025-02-01 04:30:00", "2025-01-31 23:30:00"), ("2025-07-01 03:30:00", "2025-06-30 23:30:00")],
)
@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_local_time_follows_daylight_saving_in_any_session_zone(spark, utc, local, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = one(spark, fn.local_time(F.lit(utc).cast("timestamp_ntz")).cast("string"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == local


def test_period_bounds():
    assert fn.period_bounds("2025") == (datetime(2025, 1, 1), datetime(2026, 1, 1))
    assert fn.period_bounds("2025-12") == (datetime(2025, 12, 1), datetime(2026, 1, 1))
    assert fn.period_bounds("2024-02-29") == (datetime(2024, 2, 29), datetime(2024, 3, 1))


def test_period_reaches_the_parquet_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").filter(fn.in_period("ts", "2024-01"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_sunday_is_closed(spark):
    days = [date(2026, 4, 4), date(2026, 4, 5)]
    df = spark.createDataFrame([(d,) for d in days], "d date").filter(fn.is_weekday("d"))
    assert rows(df) == [(date(2026, 4, 4),)]


def test_tracking_links(frame):
    df = frame("code string, n string", ("FEDX", " 1 "), ("UPS", "2"), ("USPS", "3"), ("DHL", "4"), ("UPS", None))
    got = rows(df.select(fn.carrier_name("code").alias("c"), fn.tracking_url("code", "n").alias("u")))
    assert got == sorted(
        [
            ("FedEx", fv.TRACKING_PAGES["FEDX"] + "1"),
            ("UPS", fv.TRACKING_PAGES["UPS"] + "2"),
            ("USPS", fv.TRACKING_PAGES["USPS"] + "3"),
            ("DHL", None),
            ("UPS", fv.TRACKING_PAGES["UPS"]),
        ],
        key=str,
    )


def test_code_map_unknown_is_null(frame):
    df = frame("w string", ("HHH",), ("XXX",)).select(fn.code_map("w", fv.WAREHOUSE_STORE).alias("s"))
    assert rows(df) == [("1",), (None,)]
