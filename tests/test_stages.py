"""Frames that checks share: written once, joined without a new exchange, and the same reports."""

import re
from concurrent.futures import ThreadPoolExecutor
from functools import cache

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from feedwright.plans import CHECKS, run_checks
from feedwright.plans.stages import STAGES, StagedSources, stage, stage_order
from feedwright.sources import Sources
from feedwright.workload.check_queries import PARAMS
from feedwright.workload.standins import standin_sources

PRODUCT = [n for n, c in CHECKS.items() if c.area == "product"]


def test_order_of_stages():
    order = stage_order(["shop_stock", "product_keys"])
    assert set(order) >= {"items", "catalog", "stock_items", "pending"}
    for name in order:
        assert all(order.index(need) < order.index(name) for need in STAGES[name].needs)
    with pytest.raises(KeyError):
        stage_order(["nonsense"])
    with pytest.raises(ValueError):
        stage("items")(lambda s: None)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Stand-ins whose item rows lie in a file of their own."""
    path = str(tmp_path_factory.mktemp("entities") / "item_store")
    plain = standin_sources(spark, SF)
    plain["item_store"].write.parquet(path)
    return plain.with_frames(item_store=spark.read.parquet(path)), path


@pytest.fixture(scope="module")
def staged(spark, stored, tmp_path_factory):
    s = StagedSources(stored[0], spark, str(tmp_path_factory.mktemp("stages")), 3)
    yield s
    s.drop()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [*PRODUCT, "hh_inventory", "mf_inventory_v1", "shop_inventory", "hk_inventory", "sku_presence"])
def test_reports_are_the_same(stored, staged, name):
    assert rows(CHECKS[name].run(staged, **PARAMS.get(name, {}))) == rows(CHECKS[name].run(stored[0], **PARAMS.get(name, {})))


def test_product_checks_read_item_rows_once(stored, staged):
    plans = {n: executed(CHECKS[n].run(staged)) for n in PRODUCT}
    assert [n for n, p in plans.items() if stored[1] in p] == []
    # Of all stages two are built from the item rows, and one of them is not used here.
    builds = {n: executed(STAGES[n].build(staged)) for n in stage_order(staged.written)}
    assert {n for n, p in builds.items() if stored[1] in p} <= {"items", "stock_items"}
    assert [n for n, p in plans.items() if "_stock_items" in p] == []


def test_stock_items_are_built_from_the_item_stage(stored, staged):
    plan = executed(STAGES["stock_items"].build(staged))
    assert stored[1] not in plan and "_items" in plan
    assert rows(STAGES["stock_items"].build(staged)) == rows(stored[0]["item_store"].withColumn("sku", F.trim("item_number")))


def test_stored_entities_are_derived_once(spark):
    before = {t.name for t in spark.catalog.listTables()}
    s, plain = standin_sources(spark, SF, stored=("item_store",)), standin_sources(spark, SF)
    try:
        with ThreadPoolExecutor(4) as pool:
            frames = list(pool.map(s.__getitem__, ["item_store", "product_warehouse", "product_location", "hk_item_store"]))
        written = {t.name for t in spark.catalog.listTables()} - before
        assert len(written) == 1
        for frame in frames:
            plan = executed(frame)
            assert "lineitem.parquet" not in plan and next(iter(written)) in plan
        assert rows(frames[1]) == rows(plain["product_warehouse"]) and rows(frames[0]) == rows(plain["item_store"])
    finally:
        for name in {t.name for t in spark.catalog.listTables()} - before:
            spark.sql(f"drop table {name}")


def test_staged_reports_derive_item_rows_and_kits_once(spark, monkeypatch):
    from feedwright.workload import check_queries

    asked = []
    monkeypatch.setattr(check_queries, "standin_sources", lambda *a, **b: asked.append(set(b.get("stored", ()))) or standin_sources(*a, **b))
    monkeypatch.setattr(check_queries, "STAGED", ["onboarding_candidates"])
    before = {t.name for t in spark.catalog.listTables()}
    try:
        check_queries.staged_reports(spark, SF)
        written = {t.name for t in spark.catalog.listTables()} - before
        assert asked == [{"item_store", "kitting"}]
        assert sorted(n.split("_", 2)[2] for n in written if n.startswith("input_")) == ["item_store", "kitting"]
    finally:
        for name in {t.name for t in spark.catalog.listTables()} - before:
            spark.sql(f"drop table {name}")


def test_stages_join_without_an_exchange(spark, staged):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged.prepare(["items", "product_keys", "catalog"])
        # Three stages are joined on the key and grouped by it.
        plan = executed(CHECKS["discontinued_closeout"].run(staged))
        assert plan.count("SortMergeJoin") == 2 and "Exchange" not in plan
        plan = executed(CHECKS["product_prices"].run(staged))
        assert re.search(r"SortMergeJoin \[sku#\d+\], \[sku#\d+\], LeftSemi(?:(?!Exchange)[\s\S])*?_items(?:(?!Exchange)[\s\S])*?_product_keys", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stages_are_written_once_and_dropped(spark, tmp_path):
    builds = []

    class Counted(StagedSources):
        def _write(self, wanted):
            builds.append(wanted.name)
            return super()._write(wanted)

    s = Counted(standin_sources(spark, SF), spark, str(tmp_path / "stages"), 2)
    names = ["code_listing", "codes_without_primary", "onboarding_candidates", "product_coverage"]
    results = run_checks(s, str(tmp_path / "out"), names, parallel=4)
    assert sorted(builds) == sorted(set(builds)) == sorted(s.written)
    assert all(builds.index(need) < builds.index(n) for n in builds for need in STAGES[n].needs)
    assert {r.check: r.rows for r in results} == {n: CHECKS[n].run(standin_sources(spark, SF)).count() for n in names}
    s.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(f"stage_{s._run}")]


def test_a_stage_begins_after_those_it_needs(spark, tmp_path):
    begun = []

    class Counted(StagedSources):
        def _write(self, wanted):
            begun.append(wanted.name)
            return super()._write(wanted)

    s = Counted(standin_sources(spark, SF), spark, str(tmp_path / "stages"), 2)
    try:
        s.shared("shop_stock", STAGES["shop_stock"].build)
        assert sorted(begun) == sorted(stage_order(["shop_stock"]))
        assert all(begun.index(need) < begun.index(n) for n in begun for need in STAGES[n].needs)
    finally:
        s.drop()


def test_runner_drops_its_stages(spark, tmp_path):
    run_checks(standin_sources(spark, SF), str(tmp_path / "out"), ["code_listing"], stage_path=str(tmp_path / "stages"))
    assert not [t for t in spark.catalog.listTables() if t.name.endswith("_code_listing")]


def test_filters_on_stored_codes_reach_the_scan(spark, stored):
    items = spark.read.parquet(stored[1])
    s = Sources({"item_store": items})
    for name, column in (("special_order_items", "location_code"), ("brand_store_gap", "manufacturer")):
        plan = executed(CHECKS[name].run(s))
        assert f"GreaterThanOrEqual({column}," in plan and f"LessThan({column}," in plan


@cache
def texts():
    return ["c", "C", "c ", "C  ", "o", "O ", "k", "K ", "K", "K  ", "ka", "KA", "b", "d", "cc", "c!", " c", "", "n", "N", None, "ß", "İ"]


@pytest.mark.parametrize("values", [["C", "o", "n"], ["k"], ["a", "K"], ["ka ", "b"], ["ß"], [""], []])
def test_the_stored_range_loses_nothing(frame, values):
    from feedwright import functions as fn

    df = frame("v string", *[(t,) for t in texts()])
    exact = fn.fold("v").isin([v.lower().rstrip() for v in values])
    assert rows(df.select("v", fn.one_of("v", values))) == rows(df.select("v", exact))
    assert rows(df.filter(fn.none_of("v", values))) == rows(df.filter(~exact))
    for prefix in [v.strip() for v in values]:
        assert rows(df.select("v", fn.begins_with("v", prefix))) == rows(df.select("v", fn.fold("v").startswith(prefix.lower())))
