import pytest
from conftest import SF, rows

from feedwright.plans import CHECKS, run_checks
from feedwright.sources import ENTITIES, Sources, ddl, even_splits
from feedwright.workload.standins import standin_sources


def test_columns_are_declared_cast_and_keys_brought_to_one_form(spark, frame):
    raw = frame("SkuNo string, comp string, n string, extra string", ("ab-fba  ", "c1 ", "2", "x"))
    s = Sources({"kitting": raw}, {"kitting": {"SkuNo": "sku", "comp": "component_sku", "n": "component_quantity"}})
    assert s["kitting"].dtypes == list(ENTITIES["kitting"].items())
    assert rows(s["kitting"], "sku", "component_sku") == [("AB-FBA", "C1")]


def test_missing_columns_and_unknown_entities_are_refused(frame):
    with pytest.raises(ValueError, match="component_quantity"):
        Sources({"kitting": frame("sku string, component_sku string", ("a", "b"))})["kitting"]
    with pytest.raises(KeyError):
        Sources({"nonsense": frame("a int", (1,))})


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_file_formats(spark, frame, tmp_path, fmt):
    data = spark.createDataFrame([("1", "HHH", None, None), ("2", "HTOOL", None, None)], ddl("product_warehouse"))
    data.write.format(fmt).option("header", "true").save(str(tmp_path / "product_warehouse"))
    s = Sources.from_files(spark, str(tmp_path), ["product_warehouse"], fmt, options={"header": "true"})
    assert rows(s["product_warehouse"]) == rows(data)


def test_tables_as_source(spark, frame):
    frame("type string, code string", ("fridge", "f")).createOrReplaceTempView("some_type_map")
    assert rows(Sources.from_tables(spark, {"type_map": "some_type_map"})["type_map"]) == [("fridge", "f")]


def test_runner_writes_reports_and_counts(spark, tmp_path):
    s = standin_sources(spark, SF)
    names = ["appliance_physical", "shop_pending", "variants_not_orderable"]
    results = {r.check: r for r in run_checks(s, str(tmp_path), names, parallel=2)}
    for name in names:
        written = spark.read.parquet(str(tmp_path / f"check={name}"))
        assert written.count() == results[name].rows == CHECKS[name].run(s).count()
    assert results["shop_pending"].passed is None
    assert results["appliance_physical"].passed is (results["appliance_physical"].rows == 0)


def test_every_check_says_what_it_does():
    assert all(c.about for c in CHECKS.values())


def parts_of(df, column, parts):
    return [df.filter(p).count() for p in even_splits(df.select(column), column, parts)]


def test_even_splits_of_a_skewed_column(spark):
    # Nine tenths of the rows lie in a hundredth of the range; equal steps would put them into one part.
    df = spark.range(20_000).selectExpr("case when id % 10 < 9 then id % 1000 else id * 5 end as k", "id")
    counts = parts_of(df, "k", 8)
    assert sum(counts) == 20_000 and len(counts) == 8
    assert max(counts) < 1.2 * 20_000 / 8
    step = 100_000 // 8
    assert df.filter(f"k < {step}").count() > 0.8 * 20_000


def test_every_row_is_in_one_part(spark, frame):
    from datetime import date, datetime
    from decimal import Decimal

    hot = spark.range(3000).selectExpr("case when id % 3 = 0 then 7 when id % 100 = 1 then null else id end as k")
    counts = parts_of(hot, "k", 10)
    assert sum(counts) == 3000 and min(counts) > 0
    whole = [r[0] for r in hot.collect()]
    for i in range(0, 3000, 250):
        one = hot.filter("k is null" if whole[i] is None else f"k = {whole[i]}")
        assert sum(c > 0 for c in [one.filter(p).count() for p in even_splits(hot, "k", 10)]) == 1
    for values in ([date(2020, 1, d) for d in range(1, 29)], [datetime(2020, 1, d, 5, 6) for d in range(1, 29)], [Decimal(f"{d}.50") for d in range(28)]):
        df = spark.createDataFrame([(v,) for v in values], ["k"])
        counts = parts_of(df, "k", 4)
        assert sum(counts) == 28 and max(counts) <= 8
    assert even_splits(hot.filter("false"), "k", 4) == even_splits(hot, "k", 1) == ["1 = 1"]
    assert parts_of(spark.range(10).selectExpr("1 as k"), "k", 4) == [0, 10]
    with pytest.raises(TypeError):
        even_splits(frame("k string", ("a",)), "k", 3)
    with pytest.raises(ValueError):
        even_splits(hot, "k", 0)
