"""One query per operator over the benchmark tables (whole tables, no sampling)."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import functions as fn
from .. import operators as op
from ..operators import inventory as inv
from ..plans.orders import sales_parts
from ..sources import even_splits
from .registry import query
from .standins import oracle, standin_sources, table

MONEY = "decimal(18,2)"
AS_OF = date(2000, 6, 30)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name)


def _text(c: str):
    return F.col(c).cast("string")


def _money_text(c):
    return F.concat(F.lit('[{"amount":"'), c.cast(MONEY).cast("string"), F.lit('","currency":"USD"}]'))


def _stores(c: str, codes: list[str]):
    return F.element_at(F.array(*[F.lit(s) for s in codes]), (F.col(c) % len(codes) + 1).cast("int"))


_STORE_SQL = "['1','2','4','7','8'][l_suppkey % 5 + 1]"
_STORES = ["1", "2", "4", "7", "8"]


@query(
    "q01_latest_record",
    """
with stamped as (
  select o_custkey, o_orderkey, o_orderstatus,
    coalesce(case when o_orderstatus <> 'P' then date_trunc('year', o_orderdate)::date end,
             case when o_orderpriority <> '5-LOW' then o_orderdate::date end) as stamp
  from orders)
select o_custkey, o_orderkey, o_orderstatus from stamped
qualify stamp = max(stamp) over (partition by o_custkey)
""",
)
def latest_record(spark, sf):
    day = F.col("o_orderdate").cast("date")
    rows = _t(spark, sf, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.trunc(day, "year")).alias("updated"),
        F.when(F.col("o_orderpriority") != "5-LOW", day).alias("inserted"),
    )
    return op.latest_record(rows, "o_custkey", ["updated", "inserted"]).drop("updated", "inserted")


@query(
    "q02_first_seen_date",
    """
select l_orderkey::varchar as sku, max(l_shipdate::date) as first_seen from lineitem group by 1
union all
select l_partkey::varchar, min(l_shipdate::date) from lineitem
where l_partkey not in (select l_orderkey from lineitem) group by 1
""",
)
def first_seen_date(spark, sf):
    lines = _t(spark, sf, "lineitem")
    at = F.col("l_shipdate").alias("created_at")
    return op.first_seen_date(
        lines.select(_text("l_partkey").alias("sku"), at), lines.select(_text("l_orderkey").alias("sku"), at)
    )


@query(
    "q03_normalize_sku",
    """
select p_partkey, p_partkey::varchar || p_type as sku from part
""",
)
def normalize_sku(spark, sf):
    marks = [" -FBA ", " (A)", "(b)", ".OLD "]
    raw = F.concat(_text("p_partkey"), F.col("p_type"), _stores("p_size", marks))
    return _t(spark, sf, "part").select("p_partkey", F.regexp_replace(
        fn.normalize_sku(raw, fv.KIT_SKU_MARKS), " +$", "").alias("sku"))


@query(
    "q04_eligible_population",
    """
select distinct l_partkey::varchar as sku, 'item' as source from lineitem
where l_returnflag in ('A', 'N') and ['1','2','4','7','8'][l_suppkey % 5 + 1] in ('1', '2', '4')
union
select 'K' || o_orderkey::varchar, 'kit' from orders where o_orderstatus <> 'F'
union
select p_partkey::varchar, 'catalog' from part where p_type in ('LARGE', 'SMALL') and p_size % 2 = 0
""",
)
def eligible_population(spark, sf):
    items = _t(spark, sf, "lineitem").select(
        _text("l_partkey").alias("item_number"),
        F.col("l_returnflag").alias("web_flag"),
        _stores("l_suppkey", _STORES).alias("store"),
    )
    kits = _t(spark, sf, "orders").filter("o_orderstatus <> 'F'").select(F.concat(F.lit("K"), _text("o_orderkey")).alias("sku"))
    catalog = _t(spark, sf, "part").select(
        _text("p_partkey").alias("sku"),
        F.col("p_type").alias("data_source"),
        F.when(F.col("p_size") % 2 == 1, F.lit("TRUE")).alias("rental_item"),
    )
    parts = {
        "item": op.sellable_items(items, ["1", "2", "4"], ["a", "n"]),
        "kit": kits,
        "catalog": op.catalog_rows(catalog, ["large", "small"], rentals=False),
    }
    return op.eligible_population(parts, mode="distinct")


@query(
    "q05_coverage_gap",
    """
select o_orderkey, o_custkey, c_name from orders left join customer on o_custkey = c_custkey
where o_orderkey not in (select l_orderkey from lineitem)
""",
)
def coverage_gap(spark, sf):
    expected = _t(spark, sf, "orders").select("o_orderkey", "o_custkey")
    actual = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    names = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return op.coverage_gap(expected, actual, "o_orderkey").join(names, "o_custkey", "left")


@query(
    "q06_exclude_population",
    """
select c_custkey, c_name, case when c_custkey in (select o_custkey from orders where o_orderstatus = 'O') then 'Y' else 'N' end
  as has_open
from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')
""",
)
def exclude_population(spark, sf):
    orders = _t(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    kept = op.exclude(_t(spark, sf, "customer"), orders.filter("o_orderpriority = '1-URGENT'"), "c_custkey")
    flagged = op.membership_flags(kept.select("c_custkey", "c_name"), {"open": orders.filter("o_orderstatus = 'O'")}, "c_custkey")
    return flagged.select("c_custkey", "c_name", F.when(F.col("open") == 1, "Y").otherwise("N").alias("has_open"))


@query(
    "q07_reconcile",
    """
with stored as (
  select p_partkey, case p_type when 'LARGE' then p_retailprice + 0.01 when 'PROMO' then null else p_retailprice end as price,
    case when p_size % 10 = 0 then 'other' else p_name end as name
  from part where p_type <> 'SMALL')
select p.p_partkey, floor(p.p_retailprice::decimal(18,2) * 100)::bigint / 100.0 :: decimal(18,2) as price,
  s.price::decimal(18,2) as stored_price, s.name as stored_name,
  case when p.p_retailprice::decimal(18,2) = s.price::decimal(18,2) then 'true' else 'false' end as price_check,
  case when p.p_name = s.name then 'true' else 'false' end as name_check
from part p left join stored s using (p_partkey)
where (p.p_retailprice::decimal(18,2) = s.price::decimal(18,2)) is not true or (p.p_name = s.name) is not true
""".replace("floor(p.p_retailprice::decimal(18,2) * 100)::bigint / 100.0 :: decimal(18,2)", "p.p_retailprice::decimal(18,2)"),
)
def reconcile(spark, sf):
    part = _t(spark, sf, "part")
    source = part.select("p_partkey", fn.floor_money(F.col("p_retailprice").cast(MONEY)).alias("price"), "p_name")
    price = F.col("p_retailprice")
    stored = part.filter("p_type <> 'SMALL'").select(
        "p_partkey",
        _money_text(F.when(F.col("p_type") == "LARGE", price + 0.01).when(F.col("p_type") != "PROMO", price)).alias("text"),
        F.when(F.col("p_size") % 10 == 0, F.lit("other")).otherwise(F.col("p_name")).alias("stored_name"),
    )
    actual = stored.select("p_partkey", fn.decode_money("text").alias("stored_price"), "stored_name")
    pairs = [op.Pair("price_check", "price", "stored_price"), op.Pair("name_check", "p_name", "stored_name")]
    return op.reconcile(source, actual, "p_partkey", pairs, how="left").drop("p_name")


@query(
    "q08_decode_text_value",
    """
select p_partkey, p_retailprice::decimal(18,2) as money, p_retailprice::decimal(18,2) as offset_money,
  p_size::varchar || ',' || p_type as list_text, 2::bigint as list_size, p_type as code,
  p_retailprice::decimal(18,2)::varchar as money_text
from part
""",
)
def decode_text_value(spark, sf):
    lists = F.concat(F.lit('["'), _text("p_size"), F.lit('","'), F.col("p_type"), F.lit('"]'))
    code = F.concat(F.lit('["'), F.col("p_type"), F.lit('"]'))
    rows = _t(spark, sf, "part").select(
        "p_partkey", _money_text(F.col("p_retailprice")).alias("m"), lists.alias("l"), code.alias("c")
    )
    return rows.select(
        "p_partkey",
        fn.decode_money("m").alias("money"),
        fn.decode_offset_money("m").alias("offset_money"),
        fn.decode_list("l").alias("list_text"),
        F.size(fn.list_items("l")).cast("bigint").alias("list_size"),
        fn.decode_code("c").alias("code"),
        fn.strip_money("m").alias("money_text"),
    )


@query(
    "q09_json_scope_extract",
    """
select event_id, (props ->> '$.k') as amount from events where event_type = 'view'
""",
)
def json_scope_extract(spark, sf):
    entry = F.concat(
        F.lit('{"scope":"'), "event_type", F.lit('","data":[{"amount":"'), F.get_json_object("props", "$.k"), F.lit('"}]}')
    )
    other = F.lit('{"scope":"none","data":[]}')
    docs = _t(spark, sf, "events").select(
        "event_id", F.concat(F.lit('{"values":{"price":['), other, F.lit(","), entry, F.lit("]}}")).alias("json")
    )
    return op.json_scope_extract(docs, "event_id", "price", "view")


@query("q10_json_unassigned", "select event_id from events where event_type = 'error'")
def json_unassigned(spark, sf):
    json = (
        F.when(F.col("event_type") == "error", F.lit('{"k": null}'))
        .when(F.col("event_type") == "click", F.lit('{"z": 1}'))
        .otherwise(F.col("props"))
    )
    return op.json_unassigned(_t(spark, sf, "events").select("event_id", json.alias("json")), "k").select("event_id")


@query(
    "q11_price_hierarchy",
    """
with prices as (
  select l_orderkey, l_linenumber, l_partkey,
    case l_returnflag when 'A' then l_extendedprice::decimal(18,2) when 'N' then 0 end as umrp,
    case l_linestatus when 'F' then l_quantity::decimal(18,2) else 0 end as msrp,
    l_linenumber::decimal(18,2) as cost, case when l_tax > 0.04 then 3::decimal(18,2) end as low,
    case when l_discount > 0.05 then l_discount::decimal(18,2) else 0 end as sale
  from lineitem), ruled as (
  select *, case when coalesce(umrp, 0) <> 0 then umrp when msrp <> 0 then msrp else greatest(cost, coalesce(low, 0)) end as list_price
  from prices)
select l_orderkey, l_linenumber, l_partkey, list_price::decimal(18,2) as list_price,
  (case when sale <> 0 then sale else list_price end)::decimal(18,2) as retail_price,
  case when coalesce(umrp, 0) <> 0 then 'no sale price' else 'sale price' end as sale_mark
from ruled
""",
)
def price_hierarchy(spark, sf):
    price = F.col("l_extendedprice").cast(MONEY)
    zero = F.lit(0).cast(MONEY)
    rows = _t(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(F.col("l_returnflag") == "A", price).when(F.col("l_returnflag") == "N", zero).alias("umrp"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast(MONEY)).otherwise(zero).alias("msrp"),
        F.col("l_linenumber").cast(MONEY).alias("cost"),
        F.when(F.col("l_tax") > 0.04, F.lit(3).cast(MONEY)).alias("low"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount").cast(MONEY)).otherwise(zero).alias("sale"),
    )
    listed = rows.withColumn("list_price", fn.price_hierarchy("umrp", "msrp", "cost", "low").cast(MONEY))
    return listed.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "list_price",
        fn.cascade_first_nonzero("sale", "list_price").cast(MONEY).alias("retail_price"),
        fn.sale_mark("umrp").alias("sale_mark"),
    )


def _store_prices(spark, sf):
    rows = _t(spark, sf, "lineitem").select(
        "l_partkey",
        _stores("l_suppkey", _STORES).alias("store"),
        F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice").cast(MONEY)).otherwise(F.lit(0).cast(MONEY)).alias("retail"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast(MONEY)).alias("promo"),
    )
    measures = {"retail": ("max", "retail"), "promo": ("sum", "promo")}
    return op.store_pivot(rows, "l_partkey", "store", _STORES, measures)


_PIVOT_SQL = f"""
with rows as (
  select l_partkey, {_STORE_SQL} as store,
    case when l_returnflag <> 'R' then l_extendedprice::decimal(18,2) else 0 end as retail,
    case when l_linestatus = 'F' then l_quantity::decimal(18,2) end as promo
  from lineitem), wide as (
  select l_partkey, {", ".join(
      f"max(retail) filter (store = '{s}')::decimal(18,2) as st{s}_retail, "
      f"sum(promo) filter (store = '{s}')::decimal(28,2) as st{s}_promo" for s in _STORES)}
  from rows group by 1)
"""


@query("q12_store_pivot", _PIVOT_SQL + "select * from wide")
def store_pivot(spark, sf):
    return _store_prices(spark, sf)


@query(
    "q13_cascade_first_nonzero",
    _PIVOT_SQL
    + """
select l_partkey, case when st1_retail <> 0 then st1_retail when st2_retail <> 0 then st2_retail
    when st4_retail <> 0 then st4_retail end as hh_retail,
  case when st8_retail <> 0 then st8_retail when st7_retail <> 0 then st7_retail end as leh_retail
from wide
""",
)
def cascade_first_nonzero(spark, sf):
    return _store_prices(spark, sf).select(
        "l_partkey",
        fn.cascade_first_nonzero(*[f"st{s}_retail" for s in fv.HH_PRICE_STORES]).alias("hh_retail"),
        fn.cascade_first_nonzero(*[f"st{s}_retail" for s in fv.LEH_PRICE_STORES]).alias("leh_retail"),
    )


@query(
    "q14_catalog_price_matrix",
    """
with prices as (
  select l_orderkey as sku, max(l_extendedprice) filter (l_returnflag = 'A') as a,
    max(l_extendedprice) filter (l_returnflag = 'N') as n, max(l_extendedprice) filter (l_returnflag = 'R') as r
  from lineitem group by 1)
select sku, coalesce(a, 0)::decimal(18,2) as "MASTER13", coalesce(n, 0)::decimal(18,2) as "HHMASTER",
  coalesce(r, 0)::decimal(18,2) as "LEHMASTER",
  case when round(o_totalprice) = round(coalesce(a, n)) then 'true' else 'false' end as price_check
from prices join orders on o_orderkey = sku
""",
)
def catalog_price_matrix(spark, sf):
    codes = {"A": "MASTER13", "N": "HHMASTER", "R": "LEHMASTER"}
    prices = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sku"),
        fn.code_map("l_returnflag", codes).alias("catalog_id"),
        F.col("l_extendedprice").cast(MONEY).alias("catalog_price"),
    )
    matrix = op.catalog_price_matrix(prices, fv.PRICE_CATALOGS)
    totals = _t(spark, sf, "orders").select(F.col("o_orderkey").alias("sku"), F.round("o_totalprice").alias("total"))
    kit_price = F.round(fn.cascade_first_nonzero("MASTER13", "HHMASTER")).cast("double")
    return op.reconcile(matrix, totals, "sku", [op.Pair("price_check", "total", kit_price)], keep="all").drop("total")


@query(
    "q15_floor_money",
    """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  (floor(l_extendedprice::decimal(18,2) * (1 - l_discount::decimal(4,2)) * 100)::bigint::decimal(20,2) / 100)::decimal(18,2) as net
from lineitem
""",
)
def floor_money(spark, sf):
    net = F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", fn.floor_money(net).alias("net"))


def _codes(spark, sf):
    digits = F.lpad(_text("l_suppkey"), 11, "0")
    return _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sku"),
        F.concat(F.lit(" "), digits, F.substring(F.lit("77"), 1, F.col("l_linenumber") % 3)).alias("code"),
        F.when(F.col("l_linestatus") == "F", "m").otherwise("S").alias("source"),
        F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") > 5), "Y")
        .when(F.col("l_returnflag") == "N", "n")
        .alias("primary_flag"),
        F.trunc(F.col("l_shipdate").cast("date"), "year").alias("updated"),
    )


_CODES_SQL = """
with codes as (
  select distinct l_partkey as sku, lpad(l_suppkey::varchar, 11, '0') || left('77', l_linenumber % 3) as code,
    l_linestatus = 'F' as m, l_returnflag = 'A' and l_linenumber > 5 as prim, l_returnflag = 'N' as non_prim,
    date_trunc('year', l_shipdate)::date as updated
  from lineitem)
"""


@query(
    "q16_upc_cascade",
    _CODES_SQL
    + """
, primaries as (select distinct sku, code, 1 as kind from codes where prim and length(code) in (12, 13)),
m as (select distinct sku, code, 2 as kind from codes where m and (sku, updated) in (
  select (sku, max(updated)) from codes where m and length(code) in (12, 13) group by sku)),
newest as (select distinct sku, code, 3 as kind from codes where length(code) in (12, 13) and (sku, updated) in (
  select (sku, max(updated)) from codes where length(code) in (12, 13) group by sku))
select sku, code, kind from (select * from primaries union all select * from m union all select * from newest)
qualify kind = min(kind) over (partition by sku)
""",
)
def upc_cascade(spark, sf):
    return op.upc_cascade(_codes(spark, sf))


@query(
    "q17_missing_primary",
    _CODES_SQL
    + """
select distinct sku, code, updated from codes
where not prim and sku not in (select sku from codes where prim)
""",
)
def missing_primary(spark, sf):
    missing = op.missing_primary(_codes(spark, sf))
    return missing.select("sku", F.trim("code").alias("code"), "updated").distinct()


@query(
    "q18_upc_listing",
    """
with wanted as (
  select distinct p_partkey as sku, 'Eagle' as source from part
  union select o_orderkey, 'Kit' from orders where o_orderstatus <> 'F'),
item_codes as (select distinct l_partkey as sku, lpad(l_suppkey::varchar, 12, '0') as code, l_returnflag as flag from lineitem),
kit_codes as (select o_orderkey as sku, lpad(o_orderkey::varchar, 12, '9') as code from orders where o_orderpriority <> '5-LOW')
select w.sku, w.source, i.sku as code_sku, i.code, case i.flag when 'A' then 'M' else i.flag end as code_source, i.flag as primary_flag
from wanted w left join item_codes i using (sku) where w.source = 'Eagle'
union all
select w.sku, w.source, k.sku, k.code, '', '' from wanted w left join kit_codes k using (sku) where w.source = 'Kit'
""",
)
def upc_listing(spark, sf):
    parts = _t(spark, sf, "part").select(F.col("p_partkey").alias("sku"), F.lit("item").alias("source_kind"), F.lit("Eagle").alias("source"))
    orders = _t(spark, sf, "orders")
    kits = orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("sku"), F.lit("kit"), F.lit("Kit"))
    flag = F.col("l_returnflag")
    item_codes = _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sku"),
        F.lpad(_text("l_suppkey"), 12, "0").alias("code"),
        F.when(flag == "A", "M").otherwise(flag).alias("source"),
        flag.alias("primary_flag"),
        F.lit(None).cast("date").alias("updated"),
    )
    kit_codes = orders.filter("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("sku"), F.lpad(_text("o_orderkey"), 12, "9").alias("code")
    )
    return op.upc_listing(parts.union(kits), item_codes, kit_codes).drop("code_updated")


@query(
    "q19_store_string",
    """
with stores as (select distinct l_partkey, ['1','2','4','7','8','D','J'][l_suppkey % 7 + 1] as store,
    l_returnflag = 'R' as kept from lineitem)
select l_partkey, coalesce(string_agg(case store when 'D' then '12' when 'J' then '18' else store end, ',' order by store)
    filter (kept), '0') as stores
from stores group by 1
""",
)
def store_string(spark, sf):
    store = _stores("l_suppkey", fv.PRODUCT_STORES)
    rows = _t(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_returnflag") == "R", store).alias("store"))
    return op.store_string(rows, "l_partkey", "store", "stores", fv.STORE_RECODE, "0")


@query(
    "q20_flag_rollup",
    """
with rows as (select l_partkey, ['1','2','4','7','8','12','18'][l_suppkey % 7 + 1] as store, l_returnflag = 'A' and l_linenumber = 1 as is_on
  from lineitem)
select l_partkey,
  case when bool_or(is_on and store in ('1','2','4')) then 'True' else 'False' end as website_hh,
  case when bool_or(is_on and store in ('7','8')) then 'True' else 'False' end as website_leh,
  case when bool_or(is_on and store in ('2','12')) then 'True' else 'False' end as amazon_hh,
  case when bool_or(is_on and store in ('8','18')) then 'True' else 'False' end as amazon_leh
from rows group by 1
""",
)
def flag_rollup(spark, sf):
    store = _stores("l_suppkey", ["1", "2", "4", "7", "8", "12", "18"])
    rows = _t(spark, sf, "lineitem").withColumn("store", store)
    is_on = fn.one_of("l_returnflag", ["a"]) & (F.col("l_linenumber") == 1)
    return op.flag_rollup(rows, "l_partkey", is_on, "store", fv.CHANNEL_STORES)


@query(
    "q21_code_map",
    """
select map(['AUTOMOBILE','BUILDING','FURNITURE'], ['1','2','7'])[c_mktsegment] as store, count(*) as customers
from customer group by 1
""",
)
def code_map(spark, sf):
    codes = {"AUTOMOBILE": "1", "BUILDING": "2", "FURNITURE": "7"}
    return _t(spark, sf, "customer").groupBy(fn.code_map("c_mktsegment", codes).alias("store")).agg(F.count("*").alias("customers"))


def _grid(spark, sf):
    s = standin_sources(spark, sf)
    items = s["item_store"].withColumn("item_sku", F.trim("item_number"))
    return op.kit_store_grid(s["kitting"], items, ["1", "2", "4"])


_GRID_SQL = """
grid as (
  select k.sku, k.component_sku, k.component_quantity, g.store,
    coalesce(i.quantity_on_hand, 0)::decimal(18,4) as quantity_on_hand,
    coalesce(i.committed_quantity, 0)::decimal(18,4) as committed_quantity,
    coalesce(i.future_order_quantity, 0)::decimal(18,4) as future_order_quantity,
    coalesce(i.safety_stock, 0)::decimal(18,4) as safety_stock
  from kitting k cross join (select unnest(['1','2','4']) as store) g
  left join item_store i on trim(i.item_number) = k.component_sku and i.store = g.store)
"""


@query("q22_kit_store_grid", oracle("kitting item_store", _GRID_SQL + "select * from grid"))
def kit_store_grid(spark, sf):
    return _grid(spark, sf)


@query(
    "q23_kit_floor_min",
    oracle(
        "kitting item_store",
        _GRID_SQL
        + """
select sku, store, min(floor(quantity_on_hand / nullif(component_quantity, 0)))::bigint as calc_quantity_on_hand,
  min(floor(committed_quantity / nullif(component_quantity, 0)))::bigint as calc_committed_quantity,
  min(floor(future_order_quantity / nullif(component_quantity, 0)))::bigint as calc_future_order_quantity,
  min(floor(safety_stock / nullif(component_quantity, 0)))::bigint as calc_safety_stock
from grid where component_sku not like '%FBA%' group by 1, 2
""",
    ),
)
def kit_floor_min(spark, sf):
    return inv.kit_quantities_by_store(_grid(spark, sf))


@query(
    "q24_location_unpivot",
    """
select p_partkey, '1' as store, p_size as on_hand, p_retailprice::decimal(18,2) as price from part
union all select p_partkey, '4', length(p_name)::int, 0 from part
union all select p_partkey, '2', null, (p_size * 2)::decimal(18,2) from part
""",
)
def location_unpivot(spark, sf):
    zero = F.lit(0).cast(MONEY)
    wide = _t(spark, sf, "part").select(
        "p_partkey",
        F.col("p_size").alias("on_hand_hh"),
        F.length("p_name").alias("on_hand_mf"),
        F.lit(None).cast("int").alias("on_hand_fc"),
        F.col("p_retailprice").cast(MONEY).alias("price_hh"),
        zero.alias("price_mf"),
        (F.col("p_size") * 2).cast(MONEY).alias("price_fc"),
    )
    layout = {s: {"on_hand": f"on_hand_{x}", "price": f"price_{x}"} for s, x in (("1", "hh"), ("4", "mf"), ("2", "fc"))}
    return op.location_unpivot(wide, "p_partkey", layout)


def _measures(spark, sf):
    lines, orders = _t(spark, sf, "lineitem"), _t(spark, sf, "orders")
    own = _stores("l_suppkey", _STORES) == "1"
    live = orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    number = F.col("l_linenumber")
    every = lines.select(
        F.col("l_partkey").alias("sku"),
        F.when(F.col("l_returnflag") == "N", number - 5).alias("stock_pit"),
        F.when(F.col("l_returnflag") == "R", number).alias("committed"),
        number.alias("reserve"),
        F.lit(0.5).alias("safety"),
        F.when(F.col("l_linestatus") == "F", F.lit(2)).alias("pending"),
    )
    open_orders = lines.join(live, "l_orderkey").select(F.col("l_partkey").alias("sku"), F.lit(1).alias("open_orders"))
    members = lines.filter(own).select(F.col("l_partkey").alias("sku"), F.col("l_quantity").alias("on_hand"))
    return op.collect_measures([members], [every, open_orders], {"reserve": "max"})


_MEASURES_SQL = f"""
with m as (
  select l_partkey as sku, sum(l_quantity) filter ({_STORE_SQL} = '1') as on_hand,
    coalesce(sum(l_linenumber - 5) filter (l_returnflag = 'N'), 0) as pit,
    coalesce(sum(l_linenumber) filter (l_returnflag = 'R'), 0) as committed, max(l_linenumber) as reserve, count(*) * 0.5 as safety,
    count(*) filter (l_linestatus = 'F') * 2 as pending,
    count(*) filter (l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')) as open_orders
  from lineitem group by 1 having count(*) filter ({_STORE_SQL} = '1') > 0),
offer as (select *, on_hand + open_orders + greatest(pit, 0) - committed - reserve - safety - pending as net from m)
"""


@query(
    "q25_available_to_sell",
    _MEASURES_SQL + "select sku, net::decimal(18,4) as net, floor(greatest(net, 0))::bigint as available from offer",
)
def available_to_sell(spark, sf):
    return op.available_to_sell(_measures(spark, sf), inv.HH_V2).select("sku", "net", "available")


@query(
    "q26_alias_resolved_sum",
    """
with xref as (select 'A' || p_partkey::varchar as alias_sku, p_partkey::varchar as sku from part where p_type <> 'PROMO'),
pending as (select case l_linestatus when 'F' then 'A' else '' end || l_partkey::varchar as sku, l_quantity from lineitem)
select coalesce(x.sku, p.sku) as sku, sum(p.l_quantity)::decimal(28,2) as quantity
from pending p left join xref x on x.alias_sku = p.sku group by 1
""",
)
def alias_resolved_sum(spark, sf):
    pending = _t(spark, sf, "lineitem").select(
        F.concat(F.when(F.col("l_linestatus") == "F", "A").otherwise(""), _text("l_partkey")).alias("sku"),
        F.col("l_quantity").cast(MONEY).alias("quantity"),
    )
    xref = _t(spark, sf, "part").filter("p_type <> 'PROMO'").select(
        F.concat(F.lit("A"), _text("p_partkey")).alias("alias_sku"), _text("p_partkey").alias("sku")
    )
    out = op.alias_resolved_sum(pending, xref)
    return out.select("sku", F.col("quantity").cast("decimal(28,2)").alias("quantity"))


@query(
    "q27_open_order_qty",
    oracle(
        "sales_order order_udf line_item",
        """
tagged as (
  select o.order_number, o.warehouse_code from sales_order o join order_udf u using (order_number)
  where lower(u.udf_code) in ('hhcv3', 'cv3') and lower(o.status_code) not in ('c', 'x'))
select sku, sum(quantity_ordered - canceled_quantity) filter (warehouse_code = 'HHH')::decimal(18,4) as st1,
  sum(quantity_ordered - canceled_quantity) filter (warehouse_code = 'HTOOL')::decimal(18,4) as st2,
  sum(quantity_ordered - canceled_quantity)::decimal(18,4) as total
from (select t.warehouse_code, l.* exclude (warehouse_code) from tagged t join line_item l using (order_number)) group by 1
""",
    ),
)
def open_order_qty(spark, sf):
    s = standin_sources(spark, sf)
    args = (s["sales_order"], s["order_udf"], s["line_item"], fv.SHOP_ORDER_CODES, fv.CLOSED_ORDER_STATUSES)
    split = op.open_order_qty(*args, split={"HHH": "st1", "HTOOL": "st2"})
    total = op.open_order_qty(*args).withColumnRenamed("quantity", "total")
    return split.join(total, "sku")


@query(
    "q28_kit_over_product",
    _MEASURES_SQL
    + """
, kits as (
  select l_orderkey as sku, min(floor(greatest(net / l_linenumber, 0)))::bigint as kit_available
  from lineitem join offer on offer.sku = l_partkey group by 1)
select coalesce(k.sku, o.sku) as sku, coalesce(k.kit_available, floor(greatest(o.net, 0))::bigint) as total_inventory
from kits k full join offer o on k.sku = o.sku
where coalesce(k.sku, o.sku) in (select p_partkey from part where p_type <> 'PROMO')
""",
)
def kit_over_product(spark, sf):
    stock = op.available_to_sell(_measures(spark, sf), inv.HH_V2)
    kitting = _t(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sku"),
        F.col("l_partkey").alias("component_sku"),
        F.col("l_linenumber").cast(inv.QTY).alias("component_quantity"),
    )
    listed = _t(spark, sf, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("sku"))
    return op.for_listed(op.kit_over_product(stock, op.kit_floor_min(kitting, stock)), listed)


@query(
    "q29a_duplicate_groups",
    """
select l_orderkey, l_linenumber, count(*) as duplicate_count from lineitem where l_shipdate > '1995-06-01'
group by all having count(*) > 1
""",
)
def duplicate_groups(spark, sf):
    where = F.col("l_shipdate") > F.lit("1995-06-01").cast("timestamp_ntz")
    return op.duplicate_groups(_t(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], where)


@query(
    "q29b_multi_value_keys",
    "select l_partkey, count(distinct l_suppkey) as distinct_values from lineitem group by 1 having count(distinct l_suppkey) > 1",
)
def multi_value_keys(spark, sf):
    return op.multi_value_keys(_t(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@query(
    "q29c_mixed_state_keys",
    """
select o_custkey, count(*) filter (o_orderstatus = 'F') as with_state, count(*) filter (o_orderstatus <> 'F') as without_state
from orders group by 1 having count(distinct o_orderstatus = 'F') = 2
""",
)
def mixed_state_keys(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("obsolete", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return op.mixed_state_keys(orders, "o_custkey", "obsolete")


_MATCHED_SQL = """
expected as (
  select trim(item_number) as sku, store,
    case when store in ('1','4') then coalesce(department, '') || '-' || coalesce(location_code, '') else location_code end as place,
    map(['1','2','4','7','8'], ['HHH','HTOOL','HHMF','LHAK','LHAD'])[store] as wh,
    greatest(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0), 0) as free
  from item_store where store in ('1','2','4','7','8') and trim(item_number) not ilike 'zz%'
  union all
  select trim(item_number) || '-FBA', store, location_code, 'HTOOL',
    greatest(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0), 0)
  from item_store where store = 'D' and trim(item_number) not ilike 'zz%'),
stocked as (
  select s.sku from order_sku s join product p using (product_number) join product_type t using (product_type_code)
  where lower(t.inventory_flag) = 'y' and (s.kit_code is null or lower(s.kit_code) not in ('k', 's'))),
matched as (
  select e.*, l.location_type as found, l.product_quantity as found_quantity
  from expected e join product_location l on l.sku = e.sku and l.warehouse_code = e.wh
  where e.sku in (select sku from stocked)),
multi as (select sku, store, count(distinct found) as locations from matched group by 1, 2 having count(distinct found) > 1),
off as (
  select distinct sku, store, wh as warehouse_code, place as expected_location, found as actual_location,
    floor(free)::bigint as free_quantity, found_quantity as actual_quantity,
    case when lower(rtrim(place)) = lower(rtrim(found)) or rtrim(place) = '' then 'true' else 'false' end as location_check,
    case when floor(free) = found_quantity then 'true' else 'false' end as quantity_check
  from matched where sku not in (select sku from multi))
"""
_MATCHED_ENTITIES = "item_store order_sku product product_type product_location"


def _mismatches(spark, sf):
    s = standin_sources(spark, sf)
    stocked = op.stocked_skus(s["order_sku"], s["product"], s["product_type"], fv.PRODUCT_KIT_CODES, keep_null_kit=True)
    expected = op.expected_locations(s["item_store"], fv.STORES_WITH_LOCATIONS)
    found = op.stored_locations(s["product_location"], stocked)
    return op.location_reconcile(op.match_locations(expected, found), op.multi_location_skus(expected, found))


@query(
    "q30_change_log_match",
    oracle(
        _MATCHED_ENTITIES + " location_change_log",
        _MATCHED_SQL
        + """
select o.sku, o.expected_location, o.actual_location, g.warehouse, g.previouslocation, g.newlocation, g.changedat
from off o left join location_change_log g on g.sku = o.sku
where (location_check = 'false' or quantity_check = 'false')
  and lower(rtrim(expected_location)) <> lower(rtrim(actual_location))
""",
    ),
)
def change_log_match(spark, sf):
    return op.change_log_match(_mismatches(spark, sf), standin_sources(spark, sf)["location_change_log"])


@query(
    "q31_location_reconcile",
    oracle(_MATCHED_ENTITIES, _MATCHED_SQL + "select * from off where location_check = 'false' or quantity_check = 'false'"),
)
def location_reconcile(spark, sf):
    return _mismatches(spark, sf)


def _located(spark, sf, count):
    s = standin_sources(spark, sf)
    return op.with_location(count(s["traffic_history"]), s["sensor_site"], s["site_location"], s["location"])


_TRAFFIC_SQL = """
with t as (
  select r_name as location_name, 'Sensor ' || user_id::varchar as sensorname, ts as utc,
    (ts at time zone 'UTC') at time zone 'America/New_York' as local_ts,
    floor(value)::int as incount, floor(value / 2)::int as outcount
  from events join customer on c_custkey = user_id join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey)
"""


@query(
    "q32_local_time_counts",
    _TRAFFIC_SQL
    + """
select location_name, sum(incount)::bigint as incount, sum(outcount)::bigint as outcount from t
where local_ts >= '2024-01-01' and local_ts < '2024-02-01' group by 1
""",
)
def local_time_counts(spark, sf):
    rows = _located(spark, sf, lambda history: op.local_time_counts(history, ["sensorid"], "2024-01"))
    return op.total_counts(rows, ["location_name"])


@query(
    "q32b_monthly_counts",
    _TRAFFIC_SQL
    + """
select location_name, strftime(utc, '%Y-%m') as month, sum(incount)::bigint as incount, sum(outcount)::bigint as outcount
from t group by 1, 2
""",
)
def monthly_counts(spark, sf):
    rows = _located(spark, sf, lambda history: op.monthly_counts(history, ["sensorid"]))
    return op.total_counts(rows, ["location_name", "month"])


@query(
    "q32c_sensor_counts",
    _TRAFFIC_SQL
    + """
select sensorname, sum(incount)::bigint as incount, sum(outcount)::bigint as outcount from t
where location_name = 'ASIA' and local_ts >= '2023-12-31' and local_ts < '2024-01-01' group by 1
""",
)
def sensor_counts(spark, sf):
    rows = _located(spark, sf, lambda history: op.local_time_counts(history, ["sensorid", "sensorname"], "2023-12-31"))
    return op.total_counts(rows.filter(fn.one_of("location_name", ["asia"])), ["sensorname"])


@query(
    "q33_calendar_totals",
    """
select 'day' as grain, ts::date::varchar as bucket, sum(floor(value))::bigint as total from events
where dayname(ts) <> 'Sunday' and ts >= '2024-01-05' group by 2
union all
select 'month', strftime(ts, '%Y-%m'), sum(floor(value))::bigint from events where dayname(ts) <> 'Sunday' and ts >= '2024-01-01' group by 2
""",
)
def calendar_totals(spark, sf):
    rows = _t(spark, sf, "events").select("ts", F.floor("value").cast("bigint").alias("n"))
    daily = op.calendar_totals(rows, "ts", "n", "2024-01-05")
    monthly = op.calendar_totals(rows, "ts", "n", "2024-01", grain="month")
    return daily.select(F.lit("day").alias("grain"), F.col("day").cast("string").alias("bucket"), "total").union(
        monthly.select(F.lit("month"), "month", "total")
    )


@query(
    "q34_period_cross_system",
    """
with a as (
  select n_name as nation, year(o_orderdate) as y, count(*) as incount, sum(floor(o_totalprice))::bigint as outcount
  from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey group by 1, 2),
b as (
  select n_name as nation, year(l_shipdate) as y, count(*) as incount, sum(l_linenumber)::bigint as outcount
  from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey group by 1, 2)
select a7.nation, a7.incount as incount_1997_orders, b7.incount as incount_1997_lines, a7.outcount as outcount_1997_orders,
  b7.outcount as outcount_1997_lines, a8.incount as incount_1998_orders, b8.incount as incount_1998_lines,
  a8.outcount as outcount_1998_orders, b8.outcount as outcount_1998_lines
from a a7 join a a8 on a7.nation = a8.nation and a8.y = 1998 join b b7 on b7.nation = a7.nation and b7.y = 1997
join b b8 on b8.nation = a7.nation and b8.y = 1998 where a7.y = 1997
""",
)
def period_cross_system(spark, sf):
    nations = _t(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("nation"))
    one = F.lit(1).alias("incount")
    a = (
        _t(spark, sf, "orders")
        .select(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at"), one, F.floor("o_totalprice").alias("outcount"))
        .transform(op.yearly_counts, "k", "at", ["1997", "1998"])
        .join(_t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n_nationkey")), "k")
        .join(nations, "n_nationkey")
    )
    b = (
        _t(spark, sf, "lineitem")
        .select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"), one, F.col("l_linenumber").alias("outcount"))
        .transform(op.yearly_counts, "k", "at", ["1997", "1998"])
        .join(_t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n_nationkey")), "k")
        .join(nations, "n_nationkey")
    )
    return op.period_cross_system({"orders": (a, "at"), "lines": (b, "at")}, "nation", ["1997", "1998"])


@query(
    "q35_threshold_days",
    """
with hot as (select distinct ts::date as day from events where event_type = 'view' and value >= 60)
select event_type, sum(floor(value))::bigint as incount from events where ts::date in (select day from hot) group by 1
""",
)
def threshold_days(spark, sf):
    rows = _t(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    traffic = rows.select("event_type", "day", F.floor("value").alias("incount"))
    return op.threshold_days(rows.filter("event_type = 'view'"), traffic, 60, "event_type")


@query(
    "q36_shipped_not_logged",
    oracle(
        "order_udf line_item shipper_tracking shipment_log",
        """
done as (select channelorderid, sku from shipment_log where lower(status) = 'completed')
select u.order_number, u.udf_order_text, l.line_number, l.quantity_ordered, l.first_shipped_datetime,
  case t.shipper_code when 'FEDX' then 'FedEx' else t.shipper_code end as shipper_code, t.tracking_number, t.shipment_type_code,
  map(['FEDX', 'UPS', 'USPS'], ['https://www.fedex.com/apps/fedextrack/?tracknumbers=',
    'http://wwwapps.ups.com/WebTracking/track?track=yes&trackNums=',
    'https://tools.usps.com/go/TrackConfirmAction?qtc_tLabels1='])[t.shipper_code] || trim(t.tracking_number) as url, l.sku
from order_udf u join line_item l using (order_number)
left join shipper_tracking t on t.order_number = l.order_number and t.shipping_document_number = l.first_shipped_shipdoc
where lower(u.udf_code) in ('hhcv3', 'cv3') and u.udf_order_text ilike '%shop%'
  and try_cast(l.first_shipped_datetime as date) >= date '2000-06-23'
  and not exists (from done d where d.channelorderid = u.udf_order_text and d.sku = l.sku)
""",
    ),
)
def shipped_not_logged(spark, sf):
    s = standin_sources(spark, sf)
    tags = s["order_udf"].filter(
        fn.one_of("udf_code", fv.SHOP_ORDER_CODES) & fn.fold("udf_order_text").contains("shop")
    )
    return op.shipped_not_logged(tags, s["line_item"], s["shipper_tracking"], s["shipment_log"], AS_OF)


@query(
    "q37_event_totals",
    """
with sales as (select o_custkey, sum(o_totalprice::decimal(18,2)) filter (o_orderstatus <> 'P') as total, bool_and(o_orderstatus = 'P') as gone
  from orders group by 1),
tickets as (select o_custkey, count(*) filter (l_returnflag <> 'R') as other, count(*) filter (l_returnflag = 'R') as meal
  from orders join lineitem on l_orderkey = o_orderkey group by 1)
select c.c_custkey as event_id, c.c_name, coalesce(s.total, 0)::decimal(18,2) as event_total, coalesce(t.other, 0) as event_ticket_count,
  coalesce(t.meal, 0) as meal_ticket_count, coalesce(t.other, 0) + coalesce(t.meal, 0) as total_ticket_count
from customer c left join sales s on s.o_custkey = c.c_custkey left join tickets t on t.o_custkey = c.c_custkey
where coalesce(s.gone, false) = false
""",
)
def event_totals(spark, sf):
    events = _t(spark, sf, "customer").select(F.col("c_custkey").alias("event_id"), "c_name")
    orders = _t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("event_id"),
        F.col("o_totalprice").cast(MONEY).alias("total_charge"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("refunded_at"),
    )
    kind = F.when(F.col("l_returnflag") == "R", "Meal").otherwise("seat")
    tickets = _t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), kind.alias("type"))
    return op.event_totals(events, orders, tickets)


@query(
    "q38_order_trace",
    oracle(
        "imported_order shop_order shop_order_item",
        """
select i.orderid, s.shop_order_id, s.order_name, s.total_charge, x.line_number, x.sku, x.quantity
from imported_order i join shop_order s on s.shop_order_id = right(i.orderid, 13)
left join shop_order_item x using (shop_order_key)
where i.orderid like '%shopify%'
""",
    ),
)
def order_trace(spark, sf):
    s = standin_sources(spark, sf)
    imported = s["imported_order"].filter(fn.fold("orderid").contains("shopify"))
    items = s["shop_order_item"].select("shop_order_key", "line_number", "sku", "quantity")
    out = op.import_trace(imported, s["shop_order"], items)
    return out.select("orderid", "shop_order_id", "order_name", "total_charge", "line_number", "sku", "quantity")


@query(
    "q39_membership_flags",
    """
select *, greatest(alias, item) as in_any from (
  select p_partkey as sku, (p_partkey in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45))::int as alias,
    (p_partkey in (select l_partkey from lineitem where l_linestatus = 'F' and l_quantity < 3))::int as item
  from part)
""",
)
def membership_flags(spark, sf):
    lines = _t(spark, sf, "lineitem").withColumnRenamed("l_partkey", "sku")
    lists = {"alias": lines.filter("l_returnflag = 'R' and l_quantity > 45"), "item": lines.filter("l_linestatus = 'F' and l_quantity < 3")}
    return op.membership_flags(_t(spark, sf, "part").select(F.col("p_partkey").alias("sku")), lists)


@query(
    "q40_cross_store_difference",
    """
with item as (select *, ['1','2','4','7','8'][l_suppkey % 5 + 1] as store from lineitem)
select distinct l_partkey as sku, l_suppkey as supplier from item where store = '1' and l_quantity > 10
  and l_partkey not in (select l_partkey from item where store = '2' and l_returnflag = 'A')
""",
)
def cross_store_difference(spark, sf):
    lines = _t(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("sku"),
        F.col("l_suppkey").alias("supplier"),
        _stores("l_suppkey", _STORES).alias("store"),
        "l_quantity",
        "l_returnflag",
    )
    a = lines.filter("store = '1' and l_quantity > 10").select("sku", "supplier").distinct()
    return op.cross_store_difference(a, lines.filter("store = '2' and l_returnflag = 'A'"))


@query(
    "q41_presence_report",
    """
with stores as (select o_custkey, string_agg(distinct left(o_orderpriority, 1), ',' order by left(o_orderpriority, 1)) as stores
  from orders where o_orderstatus = 'F' group by 1)
select c_custkey as sku, c_name, case when s.o_custkey is null then 'N' else 'Y' end as exists_in_orders, s.stores,
  case when p.p_partkey is null then 'N' else 'Y' end as exists_in_parts, p.p_type
from customer left join stores s on s.o_custkey = c_custkey left join part p on p.p_partkey = c_custkey and p.p_size > 20
""",
)
def presence_report(spark, sf):
    orders = _t(spark, sf, "orders").filter("o_orderstatus = 'F'")
    stores = op.store_string(
        orders.select(F.col("o_custkey").alias("sku"), F.substring("o_orderpriority", 1, 1).alias("store")), "sku", "store", "stores"
    )
    parts = _t(spark, sf, "part").filter("p_size > 20").select(F.col("p_partkey").alias("sku"), "p_type")
    wanted = _t(spark, sf, "customer").select(F.col("c_custkey").alias("sku"), "c_name")
    return op.presence_report(wanted, {"orders": stores, "parts": parts})


_SALES_SQL = """
open_lines as (
  select l.*, o.receiving_format_code, o.today from line_item l join sales_order o using (order_number)
  where l.line_item_status_code is not null and l.line_item_status_code <> 'C' and l.status_code <> 'X'
    and l.quantity_ordered - l.canceled_quantity <> l.shipped_quantity),
a as (
  select d.transaction_number::varchar as transaction, trim(d.item) as item, d.store_number as store,
    d.qty_selling_units as quantity, h.creation_date as transaction_date, d.actual_selling_price as price, d.cost,
    'eagle' as source_type, 'E' as source_code
  from sale_detail d join sale_header h using (transaction_number, store_number) where h.transaction_type <> 'E'),
b as (
  select l.order_number, l.sku, coalesce(e.store_num, g.store_num), l.quantity_ordered, l.today, l.product_price, l.sku_list_price,
    'natural-order', 'NO'
  from open_lines l
  left join store_lookup e on e.warehouse_code = l.warehouse_code and e.receiving_format = l.receiving_format_code
  left join store_lookup g on g.warehouse_code = l.warehouse_code and g.receiving_format is null)
"""
SALES_ENTITIES = "line_item sales_order sale_detail sale_header store_lookup"


@query("q42_committed_sales_union", oracle(SALES_ENTITIES, _SALES_SQL + "select * from a union all select * from b"))
def committed_sales_union(spark, sf):
    return op.committed_sales_union(sales_parts(standin_sources(spark, sf)), None, [])


@query(
    "q43_recent_top_n",
    """
select o_orderkey, c_name, o_orderdate from orders join customer on c_custkey = o_custkey
order by o_orderdate desc, o_orderkey limit 100
""",
)
def recent_top_n(spark, sf):
    names = _t(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = _t(spark, sf, "orders").join(names, "o_custkey").select("o_orderkey", "c_name", "o_orderdate")
    return op.recent_top_n(rows, 100, [F.col("o_orderdate").desc(), F.col("o_orderkey")])


_SWEEP = ["upc", "in_stores", "retail_price_website_hh", "retail_price_website_leh", "data_source", "rental_item"]


@query(
    "q44_attribute_population",
    oracle(
        "catalog",
        " union all ".join(f"select '{c}' as field, count(*) - count({c}) as nulls, count({c}) as filled from catalog" for c in _SWEEP),
    ),
)
def attribute_population(spark, sf):
    return op.attribute_population(standin_sources(spark, sf)["catalog"], _SWEEP)


@query(
    "q45_rate_tier_checks",
    oracle(
        "rental_rate catalog",
        """
items as (select distinct sku from catalog where lower(rental_item) = 'true' and sku not like 'K%'),
w as (
  select i.sku, min(rate) filter (rate_type = '4HR') as h, min(rate) filter (rate_type = '1DAY') as d, min(rate) filter (rate_type = '1WK') as w,
    count(*) filter (rate_type = '4HR') as nh, count(*) filter (rate_type = '1DAY') as nd, count(*) filter (rate_type = '1WK') as nw
  from items i left join rental_rate r using (sku) group by 1)
select 'null or zero 4HR rate' as check_name, count(*) filter (nh > 0 and coalesce(h, 0) = 0) as discrepancy_count from w
union all select 'null or zero 1DAY rate', count(*) filter (nd > 0 and coalesce(d, 0) = 0) from w
union all select 'null or zero 1WK rate', count(*) filter (nw > 0 and coalesce(w, 0) = 0) from w
union all select 'missing 4HR rate', count(*) filter (nh = 0) from w
union all select 'missing 1DAY rate', count(*) filter (nd = 0) from w
union all select 'missing 1WK rate', count(*) filter (nw = 0) from w
union all select '1DAY rate below 4HR rate', count(*) filter (d < h) from w
union all select '1WK rate below 1DAY rate', count(*) filter (w < d) from w
union all select 'missing at least one rate tier', count(*) filter (nh = 0 or nd = 0 or nw = 0) from w
union all select 'all rate tiers equal', count(*) filter (h = d and d = w) from w
""",
    ),
)
def rate_tier_checks(spark, sf):
    s = standin_sources(spark, sf)
    items = s["catalog"].filter(fn.one_of("rental_item", ["true"]) & ~F.col("sku").startswith("K")).select("sku").distinct()
    return op.rate_tier_checks(items, s["rental_rate"], fv.RATE_TIERS)


@query(
    "q46_delta_feed",
    """
with prev as (
  select o_orderkey, case o_orderpriority when '5-LOW' then o_totalprice + 1 else o_totalprice end as price,
    case o_orderpriority when '2-HIGH' then null else o_orderstatus end as status
  from orders where o_orderpriority <> '1-URGENT')
select o.o_orderkey, o.o_totalprice::decimal(18,2) as price, o.o_orderstatus as status,
  case when p.o_orderkey is null then 'new' else 'changed' end as delta
from orders o left join prev p using (o_orderkey)
where o.o_orderstatus <> 'F' and (p.o_orderkey is null or p.price is distinct from o.o_totalprice or p.status is distinct from o.o_orderstatus)
""",
)
def delta_feed(spark, sf):
    orders = _t(spark, sf, "orders")
    price = F.col("o_totalprice")
    current = orders.select("o_orderkey", price.cast(MONEY).alias("price"), F.col("o_orderstatus").alias("status"))
    previous = orders.filter("o_orderpriority <> '1-URGENT'").select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "5-LOW", price + 1).otherwise(price).cast(MONEY).alias("price"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderstatus")).alias("status"),
    )
    return op.delta_feed(current, previous, "o_orderkey", ["price", "status"], F.col("status") != "F")


@query(
    "q47_write_policy",
    """
with prev as (select p_partkey, case when p_size % 2 = 0 then p_retailprice else 1 end as price from part where p_type <> 'PROMO'),
now as (select p_partkey, case when p_size % 3 > 0 then p_name end as name, case when p_size % 5 > 0 then p_retailprice end as price, p_size from part)
select p.p_partkey, p.name, case when v.price is distinct from p.price then p.price end::decimal(18,2) as price,
  case when v.p_partkey is null then p.p_size end as size, true as name_sent,
  v.p_partkey is null or v.price is distinct from p.price as price_sent, v.p_partkey is null as size_sent
from now p left join prev v using (p_partkey)
""",
)
def write_policy(spark, sf):
    part = _t(spark, sf, "part")
    price, size = F.col("p_retailprice").cast(MONEY), F.col("p_size").alias("size")
    # Some names and prices are cleared.
    name = F.when(F.col("p_size") % 3 > 0, F.col("p_name")).alias("name")
    current = part.select("p_partkey", name, F.when(F.col("p_size") % 5 > 0, price).alias("price"), size)
    previous = part.filter("p_type <> 'PROMO'").select(
        "p_partkey",
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 2 == 0, price).otherwise(F.lit(1).cast(MONEY)).alias("price"),
        size,
    )
    return op.write_policy(current, previous, "p_partkey", {"name": "force", "price": "delta", "size": "first"})


@query(
    "q47b_owned_value",
    """
select coalesce(a.k, b.k) as sku, coalesce(a.d, b.d) as create_date
from (select o_custkey as k, min(o_orderdate::date) filter (o_orderstatus = 'F') as d from orders group by 1) a
full join (select l_partkey as k, min(l_shipdate::date) as d from lineitem group by 1) b on a.k = b.k
""",
)
def owned_value(spark, sf):
    first = (
        _t(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("sku"))
        .agg(F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("date"))).alias("create_date"))
    )
    second = (
        _t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.min(F.col("l_shipdate").cast("date")).alias("create_date"))
    )
    return op.owned_value(first, second, "sku", "create_date")


def _dropped(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_partkey")).alias("sku"))
    return lines, _t(spark, sf, "part").filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("sku"))


@query(
    "q48_silent_drop_audit",
    """
with rows as (select case when l_linenumber < 7 then l_partkey end as sku from lineitem)
select sku, count(*) as lost_rows, case when sku is null then 'null key' else 'no reference row' end as reason
from rows where sku is null or sku not in (select p_partkey from part where p_type <> 'PROMO') group by sku
""",
)
def silent_drop_audit(spark, sf):
    return op.silent_drop_audit(*_dropped(spark, sf), "sku")


@query(
    "q48b_drop_counts",
    """
with rows as (select case when l_linenumber < 7 then l_partkey end as sku from lineitem), ref as (
  select p_partkey from part where p_type <> 'PROMO')
select count(*) as rows_in, count(distinct sku) as keys_in, count(p_partkey) as rows_out, count(distinct p_partkey) as keys_out
from rows left join ref on p_partkey = sku
""",
)
def drop_counts(spark, sf):
    return op.drop_counts(*_dropped(spark, sf), "sku")


@query(
    "q49_channel_parity",
    """
with side as (select l_partkey, l_returnflag, max(l_extendedprice::decimal(18,2)) as price, max(l_linestatus) as status
  from lineitem group by 1, 2)
select a.l_partkey, a.price as price_left, r.price as price_right, a.status as status_left, r.status as status_right,
  case when a.price = r.price then 'true' else 'false' end as price_check,
  case when a.status = r.status then 'true' else 'false' end as status_check
from side a join side r using (l_partkey) where a.l_returnflag = 'A' and r.l_returnflag = 'R' and (a.price <> r.price or a.status <> r.status)
""",
)
def channel_parity(spark, sf):
    side = (
        _t(spark, sf, "lineitem")
        .groupBy("l_partkey", "l_returnflag")
        .agg(F.max(F.col("l_extendedprice").cast(MONEY)).alias("price"), F.max("l_linestatus").alias("status"))
    )
    return op.channel_parity(side, "l_partkey", "l_returnflag", "A", "R", ["price", "status"])


def _rounds(spark, sf):
    return _t(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("program"),
        F.col("o_custkey").alias("spec"),
        F.year("o_orderdate").alias("round"),
        (F.col("o_orderstatus") != "P").alias("passed"),
    )


@query(
    "q50_qa_round_stats",
    """
with rounds as (select o_orderpriority as program, o_custkey as spec, year(o_orderdate) as round, bool_and(o_orderstatus <> 'P') as ok
  from orders group by 1, 2, 3),
specs as (select program, spec, arg_min(ok, round) as first_ok, min(round) filter (ok) as rounds from rounds group by 1, 2)
select program, count(*) as specs, count(*) filter (not first_ok) as failed_first_round,
  round(count(*) filter (not first_ok) / count(*), 4)::decimal(9,4) as first_round_failure_share,
  count(*) filter (rounds >= 3) as needed_three_or_more, max(rounds) as longest, count(*) filter (rounds is null) as never_passed
from specs group by 1
""",
)
def qa_round_stats(spark, sf):
    return op.qa_round_stats(_rounds(spark, sf), "program")


@query(
    "q50b_cause_matrix",
    """
select o_orderpriority as cause, count(*) filter (o_orderstatus = 'F') as "F", count(*) filter (o_orderstatus = 'O') as "O",
  count(*) filter (o_orderstatus = 'P') as "P", count(*) as total
from orders group by 1
""",
)
def cause_matrix(spark, sf):
    defects = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("cause"), F.col("o_orderstatus").alias("domain"))
    return op.cause_matrix(defects, "cause", "domain", ["F", "O", "P"])


@query(
    "q01b_undetermined_pick",
    """
with stamped as (
  select o_custkey, date_trunc('quarter', o_orderdate)::date as picked_at, o_orderstatus, o_orderpriority,
    case when o_orderkey % 3 = 0 then o_totalprice end as price from orders),
newest as (select * from stamped qualify picked_at = max(picked_at) over (partition by o_custkey)),
tied as (
  select o_custkey, picked_at, count(*) as tied_rows, concat_ws(',',
    case when count(distinct o_orderstatus) > 1 then 'o_orderstatus' end,
    case when count(distinct o_orderpriority) > 1 then 'o_orderpriority' end,
    case when count(distinct price) + (count(price) < count(*))::int > 1 then 'price' end) as fields
  from newest group by all)
select * from tied where tied_rows > 1 and fields <> ''
""",
)
def undetermined_pick(spark, sf):
    rows = _t(spark, sf, "orders").select(
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("price"),
        F.trunc(F.col("o_orderdate").cast("date"), "quarter").alias("updated"),
    )
    return op.undetermined_pick(rows, "o_custkey", ["updated"], ["o_orderstatus", "o_orderpriority", "price"])


@query(
    "q09b_catalog_values",
    """
select event_id, event_type as attribute, scope, position, props ->> '$.k' as amount
from events, (values ('left', 1), ('left', 2), (null, 1)) as v(scope, position)
where event_type <> 'error'
""",
)
def catalog_values(spark, sf):
    # Entries without amounts, without a scope and of another shape; the documents of one type of event are no JSON.
    entries = F.concat(F.lit('[{"scope":"left","data":['), "props", F.lit(","), "props", F.lit(']},{"scope":"none","data":[]},{"data":['), "props", F.lit("]},7]"))
    json = F.concat(F.lit('{"values":{"'), "event_type", F.lit('":'), entries, F.lit(',"other":{"scope":"x"}'))
    closed = F.when(F.col("event_type") != "error", F.lit("}}")).otherwise("")
    docs = _t(spark, sf, "events").select("event_id", F.concat(json, closed).alias("json"))
    return op.catalog_values(docs, "event_id", amount="$.k")


@query(
    "q36b_shipment_leak",
    oracle(
        "line_item shipper_tracking",
        """
own as (select order_number, first_shipped_shipdoc as doc, count(distinct line_number) as lines_shipped from line_item group by all),
orders_lines as (select order_number, count(distinct line_number) as lines_reached from line_item group by all),
docs as (select distinct order_number, shipping_document_number from shipper_tracking),
many as (select order_number, count(shipping_document_number) as documents from docs group by all)
select order_number, shipping_document_number, documents, lines_reached, coalesce(lines_shipped, 0) as lines_shipped,
  lines_reached - coalesce(lines_shipped, 0) as lines_leaked
from docs join orders_lines using (order_number) join many using (order_number)
left join own on own.order_number = docs.order_number and own.doc = shipping_document_number
where lines_reached > coalesce(lines_shipped, 0)
""",
    ),
)
def shipment_leak(spark, sf):
    s = standin_sources(spark, sf)
    return op.shipment_leak(s["line_item"], s["shipper_tracking"])


IMAGES = {
    1: "o_orderkey % 7 not in (0, 1)",
    2: "o_orderkey % 7 not in (1, 2)",
    3: "o_orderkey % 7 not in (3, 4) or o_orderstatus = 'F'",
}
_SENT_POLICIES = {"price": "delta", "status": "delta", "name": "first", "trace": "force"}


def _sent_price(run: int) -> str:
    return f"case when o_orderkey % 5 = {run} then null else cast(o_totalprice as decimal(18,2)) + case when o_orderkey % 11 = {run} then 1 else 0 end end"


def _image_sql(run: int) -> str:
    return f"""select o_orderkey, {_sent_price(run)} as price,
  case when o_orderkey % 13 = {run} then 'X' else o_orderstatus end as status, o_orderpriority as name,
  case when o_orderkey % 17 = 0 then 'r{run}' end as trace
from {{orders}} where {IMAGES[run]}"""


@query(
    "q46b_sent_state",
    "with "
    + ", ".join(f"i{r} as ({_image_sql(r).format(orders='orders')})" for r in IMAGES)
    + """,
known as (
  select o_orderkey, (i1.o_orderkey is null)::int + 1 as first_run, (i2.o_orderkey is not null)::int + 1 as last_run,
    case when i2.o_orderkey is null then i1.price else i2.price end as price,
    case when i2.o_orderkey is null then i1.status else i2.status end as status
  from i1 full join i2 using (o_orderkey)),
due as (
  select i3.o_orderkey, k.first_run, k.last_run, k.o_orderkey is null as new,
    k.price is distinct from i3.price as price_changed, k.status is distinct from i3.status as status_changed
  from i3 left join known k using (o_orderkey))
select o_orderkey, first_run, last_run, case when new then 'new' when price_changed or status_changed then 'changed' else 'forced' end as reason,
  concat_ws(',', case when new or price_changed then 'price' end, case when new or status_changed then 'status' end,
    case when new then 'name' end, 'trace') as fields
from due
""",
)
def sent_state(spark, sf):
    images = {r: spark.sql(_image_sql(r), orders=_t(spark, sf, "orders")) for r in IMAGES}
    fields = list(_SENT_POLICIES)
    state = op.merge_sent(op.image_state(images[1], "o_orderkey", fields, 1), images[2], "o_orderkey", fields, 2)
    due = op.state_delta(state, images[3], "o_orderkey", _SENT_POLICIES)
    return due.join(state.select("o_orderkey", "first_run", "last_run"), "o_orderkey", "left")


_FEED_SQL = {
    "nightly": """select o_custkey as sku, year(o_orderdate) as run,
  cast(case when o_orderstatus = 'F' then null else o_totalprice end as decimal(18,2)) as price, o_orderpriority as label from {orders}""",
    "daily": """select l_partkey as sku, year(l_shipdate) as run, cast(l_extendedprice as decimal(18,2)) as price,
  case when l_linenumber < 5 then l_returnflag end as label, cast(l_quantity as decimal(18,2)) as stock from {lineitem}""",
    "manual": "select p_partkey as sku, 1998 as run, cast(p_size as decimal(18,2)) as stock from {part} where p_size % 3 = 0",
}
_OWNERS = {"price": "nightly", "label": "nightly", "stock": "daily"}


@query(
    "q47c_feed_interference",
    "with "
    + ", ".join(f"{n} as ({t.format(orders='orders', lineitem='lineitem', part='part')})" for n, t in _FEED_SQL.items())
    + """,
writes as (
  select sku, run, 0 as turn, 'nightly' as feed, unnest(['price', 'label']) as field, unnest([price::varchar, label]) as value from nightly
  union all select sku, run, 1, 'daily', unnest(['price', 'label', 'stock']), unnest([price::varchar, label, stock::varchar]) from daily
  union all select sku, run, 2, 'manual', 'stock', stock::varchar from manual),
owned as (select *, case field when 'stock' then 'daily' else 'nightly' end as owner from writes where value is not null),
latest as (select * from owned qualify row_number() over (partition by sku, field order by run desc, turn desc, value desc) = 1),
own as (select * from owned where feed = owner qualify row_number() over (partition by sku, field order by run desc, turn desc, value desc) = 1)
select l.sku, l.field, l.owner, o.value as owner_value, o.run as owner_run, l.feed as last_feed, l.value as last_value, l.run as last_run,
  case when o.sku is null then 'foreign' else 'overwritten' end as state
from latest l left join own o on o.sku = l.sku and o.field = l.field
where l.feed <> l.owner and (o.sku is null or o.value <> l.value)
""",
)
def feed_interference(spark, sf):
    inputs = {n: _t(spark, sf, n) for n in ("orders", "lineitem", "part")}
    feeds = {n: spark.sql(t, **{i: df for i, df in inputs.items() if f"{{{i}}}" in t}) for n, t in _FEED_SQL.items()}
    return op.feed_interference(feeds, "sku", "run", _OWNERS)


def _chain(spark, sf):
    lines = _t(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") < 7, F.col("l_orderkey")).alias("order"), "l_linenumber")
    orders = _t(spark, sf, "orders").filter("o_orderpriority <> '5-LOW'")
    customers = _t(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    nations = _t(spark, sf, "nation").filter("n_nationkey % 6 <> 1")
    return lines, [
        op.LookUp("order", orders, "order", "o_orderkey", ["o_custkey"]),
        op.LookUp("customer", customers, "o_custkey", "c_custkey", ["c_nationkey"]),
        op.LookUp("nation", nations, "c_nationkey", "n_nationkey", ["n_regionkey"]),
        op.LookUp("region", _t(spark, sf, "region").filter("r_regionkey <> 2"), "n_regionkey", "r_regionkey"),
    ]


_CHAIN_SQL = """
with rows as (select case when l_linenumber < 7 then l_orderkey end as "order", l_linenumber from lineitem),
traced as (
  select r.*, case when o_orderkey is null then 'order' when c_custkey is null then 'customer' when n_nationkey is null then 'nation'
    when r_regionkey is null then 'region' end as dropped_by
  from rows r left join (select * from orders where o_orderpriority <> '5-LOW') on o_orderkey = r."order"
  left join (select * from customer where c_mktsegment <> 'BUILDING') on c_custkey = o_custkey
  left join (select * from nation where n_nationkey % 6 <> 1) on n_nationkey = c_nationkey
  left join (select * from region where r_regionkey <> 2) on r_regionkey = n_regionkey)"""


@query(
    "q48c_drop_trace",
    _CHAIN_SQL + """ select "order", dropped_by, count(*) as lost_rows from traced where dropped_by is not null group by all""",
)
def drop_trace(spark, sf):
    rows, steps = _chain(spark, sf)
    return op.drop_trace(rows, "order", steps)


@query(
    "q48d_drop_steps",
    _CHAIN_SQL
    + """, placed as (select *, coalesce(list_position(['order', 'customer', 'nation', 'region'], dropped_by), 5) as place from traced)
select step, ['order', 'customer', 'nation', 'region'][step] as look_up,
  count(*) filter (place >= step) as rows_in, count(*) filter (place > step) as rows_out,
  count(distinct "order") filter (place >= step) as keys_in, count(distinct "order") filter (place > step) as keys_out
from placed, range(1, 5) as s(step) group by step
""",
)
def drop_steps(spark, sf):
    rows, steps = _chain(spark, sf)
    return op.drop_steps(rows, "order", steps)


@query(
    "q49b_structure_parity",
    """
with rows as (
  select case l_returnflag when 'A' then 'left' when 'R' then 'right' end as side, l_orderkey as o,
    case when l_suppkey % 9 <> 0 then l_suppkey end as record from lineitem where l_returnflag in ('A', 'R')),
lines as (select side, o, record, count(*) as size from rows group by all),
sizes as (
  select 'records per order' as measure, side, count(record) as size from lines group by side, o
  union all select 'lines per record', side, size from lines where record is not null),
counted as (
  select measure, size, count(*) filter (side = 'left') as left_count, count(*) filter (side = 'right') as right_count
  from sizes group by all)
select *, round(left_count / sum(left_count) over (partition by measure), 4)::decimal(9,4) as left_share,
  round(right_count / sum(right_count) over (partition by measure), 4)::decimal(9,4) as right_share
from counted
""",
)
def structure_parity(spark, sf):
    record = F.when(F.col("l_suppkey") % 9 != 0, F.col("l_suppkey")).alias("record")
    rows = _t(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", record)
    return op.structure_parity(rows, "l_returnflag", "A", "R", "l_orderkey", "record")


QA_ROUNDS = (1996, 1997, 1998, 1999, 2000)


@query(
    "q50c_round_diff",
    """
with rounds as (select year(o_orderdate) - 1995 as round, o_custkey, case when o_orderstatus <> 'P' then o_orderstatus end as status
  from orders where year(o_orderdate) between 1996 and 2000),
found as (select o_custkey, status, round, count(*) as copies from rounds group by all),
grid as (
  select g.o_custkey, g.status, r.round, coalesce(f.copies, 0) as copies,
    coalesce(lag(f.copies) over w, 0) as before, coalesce(max(f.copies) over (w rows between unbounded preceding and 1 preceding), 0) as ever
  from (select distinct o_custkey, status from found) g cross join (select unnest(range(1, 6)) as round) r
  left join found f on f.o_custkey = g.o_custkey and f.status is not distinct from g.status and f.round = r.round
  window w as (partition by g.o_custkey, g.status order by r.round)),
stated as (select *, case when copies > 0 and before > 0 then 'persisting' when copies > 0 and ever > 0 then 'relapsed'
  when copies > 0 then 'new' when before > 0 then 'fixed' end as state from grid)
select o_custkey, status, round::int as round, copies, copies - before as change, state from stated where state is not null
""",
)
def round_states(spark, sf):
    orders = _t(spark, sf, "orders").select(
        "o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.year("o_orderdate").alias("year")
    )
    return op.discrepancy_states([orders.filter(F.col("year") == y) for y in QA_ROUNDS], ["o_custkey", "status"])


@query(
    "q50d_report_diff",
    """
with signed as (
  select o_custkey, o_orderstatus, case when year(o_orderdate) = 1999 then -1 else 1 end as sign from orders
  where year(o_orderdate) in (1999, 2000))
select o_custkey, o_orderstatus, sum(sign)::bigint as change, case when sum(sign) > 0 then 'new' else 'fixed' end as state
from signed group by 1, 2 having sum(sign) <> 0
""",
)
def report_diff(spark, sf):
    orders = _t(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return op.round_diff(orders.filter("year = 1999"), orders.filter("year = 2000"), ["o_custkey", "o_orderstatus"])


@query(
    "q47d_cleared_values",
    """
select p_partkey, case when p_size % 4 > 0 then p_retailprice end::decimal(18,2) as price, true as price_sent
from part where p_size % 4 = 0
""",
)
def cleared_values(spark, sf):
    """A changed value that is null now is sent all the same."""
    part = _t(spark, sf, "part")
    price = F.col("p_retailprice").cast(MONEY)
    current = part.select("p_partkey", F.when(F.col("p_size") % 4 > 0, price).alias("price"))
    return op.write_policy(current, part.select("p_partkey", price.alias("price")), "p_partkey", {"price": "delta"})


@query(
    "q26b_ambiguous_aliases",
    oracle("sku_xref", "select alias_sku, count(distinct sku) as distinct_values from sku_xref group by 1 having count(distinct sku) > 1"),
)
def ambiguous_aliases(spark, sf):
    """Aliases that stand for several own skus, whose pending quantity counts for each."""
    return op.multi_value_keys(standin_sources(spark, sf)["sku_xref"], "alias_sku", "sku")


@query(
    "r01_even_splits",
    "select l_returnflag, count(*) as lines, sum(l_quantity)::bigint as quantity from lineitem group by 1",
)
def split_read(spark, sf):
    """Line items read in even parts of their part key: every row is in one of them."""
    lines = _t(spark, sf, "lineitem")
    parts = [lines.filter(p) for p in even_splits(lines.select("l_partkey"), "l_partkey", 8)]
    rows = reduce(DataFrame.union, parts)
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("lines"), F.sum("l_quantity").cast("bigint").alias("quantity"))
