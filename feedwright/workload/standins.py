"""The benchmark tables in the shape of the logical entities.

Every entity is one SELECT over whole benchmark tables (or over another entity), in SQL that Spark and DuckDB both run.
Codes, gaps, blanks, case and marks are derived from the data, so that the checks meet clean and dirty rows alike.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Collection
from contextlib import nullcontext
from functools import cache
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..sources import ENTITIES, FOLDED_COLUMNS, Sources

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def _money(x: str) -> str:
    return f"""'[{{{{"amount":"' || cast(cast({x} as decimal(18,2)) as string) || '","currency":"USD"}}}}]'"""


def _pick(x: str, values: list[str | None]) -> str:
    """One of the values by ``x`` modulo their number; some may be null."""
    cases = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values) if v is not None)
    return f"case {x} % {len(values)} {cases} else null end"


def _kit(k: str) -> str:
    return f"'K' || cast({k} as string)"


def _kit_marked(k: str) -> str:
    return f"{_kit(k)} || case {k} % 7 when 1 then '-FBA' when 2 then '(b) ' when 3 then '.OLD' else '    ' end"


def _order(k: str) -> str:
    return f"case {k} % 5 when 0 then 'HWEBS' when 1 then 'lwebs' else 'SO' end || cast({k} as string)"


def _channel_order(k: str) -> str:
    return f"case when {k} % 3 = 0 then 'ebay-' else 'Shopify-' end || cast({k} as string)"


_STORE_CODES = ["1", "2", "4", "7", "8", "D", "J", "m"]
_STORE = _pick("l_suppkey", _STORE_CODES)
_WAREHOUSES = ["HHH", "HTOOL", "LHAK", "LHAD", "HHMF"]
_PRICE = "(900 + (p % 1000) / 10.0)"
_GID = "'gid://shopify/ProductVariant/' || "
_LOC = "gid://shopify/Location/"

_SQL: dict[str, str] = {}

# Descriptive fields, some of them empty here and there.
_DESCRIPTIONS = ",\n  ".join(
    f"case when length(identifier) % {k + 2} = 1 then null else '{name} ' || substring(identifier, 1, 2) end as {name}"
    for k, name in enumerate(
        "manufacturer_code manufacturer_name manufacturer_part_number vendor_code vendor_name class_code class_name "
        "department_number department_name fineline_code fineline_name erp_title inactive kit_only aisle_hh aisle_mf "
        "inventory_tracked_leh".split()
    )
)
_SQL["catalog"] = f"""
select *, {_DESCRIPTIONS} from (
select cast(p_partkey as string) as identifier, cast(p_partkey as string) || '  ' as sku,
  case when p_size <= 12 then 'homesource' when p_size <= 40 then 'Eagle' when p_size <= 43 then 'adc'
       when p_size <= 46 then 'LEH import' when p_size = 47 then null else 'akeneo' end as data_source,
  case p_type when 'PROMO' then 'archived' when 'SMALL' then 'Draft' else 'active' end as status,
  case p_size % 3 when 0 then 'True' when 1 then 'false' else null end as physical,
  case p_size % 4 when 0 then 'false' else 'true' end as inventory_tracked,
  case when p_size > 35 then 'true' when p_size % 2 = 0 then 'false' else null end as rental_item,
  {_money('p_size + 0.5')} as rental_price_4_hours,
  case when p_type = 'LARGE' then null else {_money('p_size * 2')} end as rental_price_one_day,
  {_money('p_size * 7 + case when p_size % 2 = 0 then 1 else 0 end')} as rental_price_one_week,
  case p_size % 4 when 0 then '["1","4","adc"]' when 1 then '["1","2","4","7","8","12","18"]'
       when 2 then '["1","2"]' else null end as in_stores,
  case p_size % 3 when 0 then '["1","2"]' when 1 then null else '["7"]' end as discontinued,
  case p_size % 3 when 0 then '["1","7"]' when 1 then null else '["8"]' end as store_closeout,
  case p_type when 'LARGE' then '["code_a"]' when 'SMALL' then '["CODE_B"]' else null end as appliance_type,
  case when p_size % 3 = 0 then null else lpad(cast(p_partkey * 1000 + p_size as string), 12, '0') end as upc,
  case when p_size % 2 = 0 then 'true' else 'False' end as upc_no_exist,
  date '1995-01-01' + cast(p_size * 5 as int) as erp_sku_create_date,
  case p_type when 'LARGE' then {_money('p_retailprice + 1')} when 'PROMO' then null else {_money('p_retailprice')} end
    as retail_price_website_hh,
  case p_type when 'MEDIUM' then {_money('p_retailprice')} else null end as retail_price_website_leh,
  {_money('p_retailprice')} as retail_price_amazon_hh,
  case p_type when 'STANDARD' then {_money('p_size')} else {_money('p_retailprice')} end as retail_price_amazon_leh,
  case when p_size % 2 = 0 then {_money('p_retailprice * 0.9')} else null end as promo_price_website_hh,
  case when p_size % 3 = 0 then {_money('p_retailprice * 0.9')} else null end as promo_price_website_leh,
  case p_size % 3 when 0 then 'true' when 1 then 'false' else null end as web_website_hh,
  case p_size % 2 when 0 then 'True' else 'False' end as web_website_leh,
  case p_size % 2 when 0 then 'false' else 'true' end as web_amazon_hh,
  'true' as web_amazon_leh,
  p_size as quantity_on_hand_hh, 1 as quantity_committed_hh, null as quantity_on_future_order_hh, 0 as safety_stock_hh,
  p_size as quantity_on_hand_mf, 1 as quantity_committed_mf, 0 as quantity_on_future_order_mf, 1 as safety_stock_mf,
  p_size as quantity_on_hand_fc, 0 as quantity_committed_fc, 0 as quantity_on_future_order_fc, 0 as safety_stock_fc,
  case when p_type = 'PROMO' then date '2026-01-01' + cast(p_size as int) else null end as pre_order_end_date,
  case when p_size > 40 then 'contains lead' else null end as warning_message
from {{part}}
union all
select {_kit('o_orderkey')}, {_kit('o_orderkey')},
  case o_orderpriority when '5-LOW' then 'Kit import' else 'natord-kit' end,
  case o_orderstatus when 'F' then 'archived' else 'active' end,
  'true', 'true', case when o_orderpriority = '4-NOT SPECIFIED' then 'true' else null end, null, null, null,
  case o_orderkey % 3 when 0 then '["1"]' when 1 then '["2","7"]' else null end, null, null, null,
  case when o_orderkey % 2 = 0 then lpad(cast(o_orderkey as string), 12, '9') else null end, 'false',
  cast(o_orderdate as date),
  case o_orderstatus when 'O' then {_money('o_totalprice')} else null end,
  {_money('o_totalprice')},
  case o_orderstatus when 'P' then null else {_money('o_totalprice')} end,
  case o_orderpriority when '3-MEDIUM' then {_money('0')} else {_money('o_totalprice + 1')} end,
  null, null,
  case o_orderkey % 2 when 0 then 'True' else 'false' end, 'False', 'True', case o_orderkey % 3 when 0 then null else 'false' end,
  2, 0, 0, 0, 3, 0, 0, 0, null, null, null, null,
  null, null
from {{orders}}) as described
"""

_SQL["catalog_json"] = f"""
select 'u-' || cast(p_partkey as string) as uuid, cast(p_partkey as string) as identifier,
  '{{{{"family":' || case p_size % 3 when 0 then 'null' else '"f' || cast(p_size as string) || '"' end
  || ',"values":{{{{"list_price":[{{{{"scope":"website_leh","data":[{{{{"amount":"1.00"}}}}]}}}},{{{{"scope":"website_hh","data":[{{{{"amount":"'
  || cast(cast(p_retailprice + p_size % 2 as decimal(18,2)) as string) || '","currency":"USD"}}}}]}}}}]}}}}}}}}' as json,
  null as record_insert_date
from {{part}}
"""

_SQL["appliance_feed"] = """
select cast(p_partkey as string) as identifier, case p_type when 'PROMO' then 'Archived' else 'active' end as status,
  case when p_size % 4 = 0 then cast(p_size as decimal(18,2)) else null end as sale_price,
  cast(p_retailprice as decimal(18,2)) as retail_price, cast(p_retailprice as decimal(18,2)) as list_price
from {part} where p_size <= 30
"""
_SQL["appliance_feed_previous"] = "select cast(p_partkey as string) as identifier from {part} where p_size <= 5"
_SQL["product_feed"] = f"""
select cast(p_partkey as string) || ' ' as identifier,
  case when p_size % 5 = 0 then null else lpad(cast(p_partkey * 1000 + p_size as string), 12, '0') end as upc,
  case when p_size % 4 < 2 then '1' else '0' end as upc_no_exist,
  case when p_size % 6 = 0 then null else date '1995-01-02' + cast(p_size * 3 as int) end as erp_sku_create_date,
  case when p_size % 7 = 0 then 'Akeneo Only' else 'both' end as product_trace
from {{part}} where p_type <> 'LARGE'
union all
select {_kit('o_orderkey')}, lpad(cast(o_orderkey as string), 12, '9'), '0', cast(o_orderdate as date), 'both'
from {{orders}} where o_orderstatus <> 'P'
"""
_SQL["appliance"] = """
select cast(o_custkey as string) as sku, cast(o_orderkey as string) as apid,
  case o_orderpriority when '1-URGENT' then '21' else '99' end as manufacturerid,
  case when o_totalprice < 5000 then null else cast(o_orderdate as date) end as insertdate,
  case when o_orderkey % 3 = 0 or o_totalprice < 5000 then null
       else cast(date_trunc('year', cast(o_orderdate as date)) as date) end as updatedate,
  case when o_orderstatus = 'F' then cast(o_orderdate as date) else null end as obsoletedate,
  case when o_orderpriority = '2-HIGH' then cast(900 + (o_custkey % 1000) / 10.0 as decimal(18,2)) else 0 end as umrp,
  case when o_orderpriority = '1-URGENT' then cast(900 + (o_custkey % 1000) / 10.0 as decimal(18,2))
       when o_orderpriority = '5-LOW' then null else 0 end as msrp,
  cast(o_totalprice as decimal(18,2)) as cost, cast(o_orderkey % 100 as decimal(18,2)) as calculatedcost,
  cast(50 as decimal(18,2)) as map,
  case when o_orderkey % 4 = 0 then null else cast(o_orderkey % 9 - 2 as decimal(18,4)) end as stock_pit
from {orders}
"""
_SQL["appliance_spec"] = """
select cast(o_orderkey as string) as apid,
  case o_orderstatus when 'O' then 'colour: white'
    else 'UPC code: ' || lpad(cast(o_custkey * 1000 + o_custkey % 50 + 1 as string), 12, '0') end as specvalue
from {orders}
"""
_SQL["appliance_class"] = "select cast(o_orderkey as string) as apid, o_orderpriority as type from {orders}"
_SQL["type_map"] = """
select distinct o_orderpriority as type,
  case o_orderpriority when '1-URGENT' then 'code_a' when '2-HIGH' then 'code_b' else null end as code
from {orders} where o_orderpriority <> '5-LOW'
"""
_SQL["item_store"] = f"""
select case when p % 40 = 7 then 'ZZ' when p % 10 = 5 then 'K' else '' end || cast(p as string)
    || case st when 3 then '(A) ' when 6 then '-fba' else '    ' end as item_number,
  case when p % 4 = 1 then lower({_pick('st', _STORE_CODES)}) || ' ' else {_pick('st', _STORE_CODES)} end as store,
  {_pick('ln', ['C', 'o', 'N', 'Y', None])} as web_flag,
  case when first_line = 1 and st in (0, 4) then 0 else {_PRICE} end as retail_price,
  case when low_discount < 0.03 then {_PRICE} * 0.9 when low_discount < 0.05 then 0 else null end as promotion_price,
  qty + case st when 1 then 0.5 else 0 end as quantity_on_hand,
  case when last_line = 7 then null else ln * 3 end as committed_quantity,
  n as future_order_quantity, case when n % 5 = 0 then null else first_line end as safety_stock,
  {_pick('n', ['y', 'N', 'N'])} as discontinued, {_pick('ln', ['N', 'Y', 'N', None])} as closeout,
  {_pick('p', ['10', '20', '30', None])} as department,
  case when n % 6 = 0 then ' ' when p % 9 = 0 then 'SO' else 'A' || cast(p % 50 as string) end as location_code,
  {_pick('p', ['5haco', 'ULINE', 'V1', 'V2', 'V3', None])} as primary_vendor,
  {_pick('p', ['FEST', 'stabl', 'Deere', '05112'])} as manufacturer,
  'Item ' || cast(p as string) as description
from (
  select l_partkey as p, cast(l_suppkey % 8 as int) as st, cast(sum(l_linenumber) as bigint) as ln, count(*) as n,
    cast(sum(l_quantity) as bigint) as qty, cast(min(l_linenumber) as bigint) as first_line,
    max(l_linenumber) as last_line, min(l_discount) as low_discount
  from {{lineitem}} group by l_partkey, cast(l_suppkey % 8 as int)) grouped
"""
_SQL["hk_item_store"] = "select * from {item_store}"
_SQL["item_upc"] = f"""
select cast(l_partkey as string) || case l_suppkey % 9 when 0 then '-fba' when 1 then '  ' else '' end as sku,
  lpad(cast(l_partkey * 1000 + l_suppkey % 1000 as string), 11 + l_linenumber % 3, '0')
    || case l_linenumber when 4 then '  ' else '' end as code,
  case l_linestatus when 'F' then 'M' else 's' end as source,
  case when l_returnflag = 'A' and l_linenumber = 1 then 'Y' when l_returnflag = 'N' then 'N' else null end
    as primary_flag,
  l_shipdate as updated
from {{lineitem}}
"""
_SQL["dw_item"] = f"""
select cast(l_partkey as string) || ' ' as item_number, {_STORE} as store, l_shipdate as record_added from {{lineitem}}
"""
_SQL["kitting"] = f"""
select {_kit_marked('l_orderkey')} as sku,
  cast(l_partkey as string) || case when max(l_linenumber) = 7 then '-fba' else '' end as component_sku,
  case when l_orderkey % 5 = 2 and min(l_linenumber) = 1 then 0 else max(l_linenumber) end as component_quantity
from {{lineitem}} group by l_orderkey, l_partkey
"""
_SQL["order_sku"] = f"""
select cast(p_partkey as string) as sku, case p_type when 'SMALL' then 'n' else 'Y' end as active_flag,
  date '1995-01-01' + cast(p_size * 30 as int) as create_dtm, cast(p_partkey as string) as product_number,
  {_pick('p_size', ['k', None, 'N', 'S', 'N'])} as kit_code
from {{part}}
union all
select {_kit_marked('o_orderkey')}, case o_orderstatus when 'F' then 'N' else 'y' end, cast(o_orderdate as date),
  {_kit_marked('o_orderkey')}, 'K'
from {{orders}}
"""
_SQL["kit_upc"] = f"""
select {_kit_marked('o_orderkey')} || ' ' as sku,
  ' ' || lpad(cast(o_orderkey as string), 11 + cast(o_orderkey % 3 as int), '9') as code
from {{orders}}
"""
_SQL["catalog_price"] = f"""
select {_kit('o_orderkey')} as sku, 'MASTER13' as catalog_id, cast(o_totalprice as decimal(18,2)) as catalog_price
from {{orders}} where o_orderstatus <> 'P'
union all select {_kit('o_orderkey')}, 'HHMASTER', cast(o_totalprice as decimal(18,2)) from {{orders}}
union all select {_kit('o_orderkey')}, 'LEHMASTER', cast(o_totalprice + 1 as decimal(18,2))
from {{orders}} where o_orderpriority <> '3-MEDIUM'
"""
_WAREHOUSE_OF_STORE = """case store when '1' then 'HHH' when '2' then 'HTOOL' when '7' then 'LHAK' when '8' then 'LHAD'
  when '4' then 'HHMF' when 'D' then 'HTOOL' end"""
_SQL["product_warehouse"] = f"""
select case store when 'D' then trim(item_number) || '-fba' else trim(item_number) end as sku,
  {_WAREHOUSE_OF_STORE} as warehouse_code,
  floor(quantity_on_hand) + case when future_order_quantity % 4 = 0 then 1 else 0 end as product_total_quantity,
  future_order_quantity as product_reserve_quantity
from {{item_store}} where store in ('1', '2', '4', '7', '8', 'D')
union all
select {_kit_marked('o_orderkey')}, {_pick('o_orderkey', _WAREHOUSES)}, null, 0 from {{orders}}
union all
select {_kit_marked('o_orderkey')}, {_pick('(o_orderkey + 1)', _WAREHOUSES)}, null, 0
from {{orders}} where o_orderstatus = 'O'
"""
_SQL["product_location"] = f"""
select case store when 'D' then trim(item_number) || '-FBA' else trim(item_number) end as sku,
  {_WAREHOUSE_OF_STORE} as warehouse_code,
  case when future_order_quantity % 5 = 0 then 'moved'
       when store in ('1', '4') then coalesce(department, '') || '-' || location_code else location_code end
    as location_type,
  case when future_order_quantity % 4 = 0 then 5
       when floor(quantity_on_hand - coalesce(committed_quantity, 0)) < 0 then 0
       else floor(quantity_on_hand - coalesce(committed_quantity, 0)) end as product_quantity
from {{item_store}} where store in ('1', '2', '4', '7', '8', 'D')
union all
select trim(item_number), {_WAREHOUSE_OF_STORE}, 'second', 1 from {{item_store}}
where store in ('1', '8') and future_order_quantity % 7 = 0
"""
_SQL["product"] = f"""
select cast(p_partkey as string) as product_number, p_type as product_type_code, p_name as product_name from {{part}}
union all
select {_kit_marked('o_orderkey')}, 'KIT ' || o_orderstatus, 'Kit ' || cast(o_orderkey as string) from {{orders}}
"""
_SQL["product_type"] = """
select distinct p_type as product_type_code, case p_type when 'PROMO' then 'N' else 'Y' end as inventory_flag from {part}
"""
_SQL["location_change_log"] = f"""
select cast(l_partkey as string) as sku, {_pick('l_suppkey', _WAREHOUSES)} as warehouse,
  'A' || cast(l_linenumber % 2 as string) as previouslocation, 'B' as newlocation, l_returnflag as programid,
  l_linestatus as executionid, l_linenumber = 1 as istestrun, l_shipdate as changedat
from {{lineitem}}
"""
_SQL["amazon_pending"] = """
select case o_orderstatus when 'F' then 'amz' else '' end || cast(o_custkey as string) as sku,
  case o_orderstatus when 'P' then 2 else 1 end as quantity
from {orders}
"""
_SQL["sku_xref"] = """
select 'AMZ' || cast(c_custkey as string) as alias_sku, cast(c_custkey as string) as sku
from {customer} where c_mktsegment <> 'BUILDING'
union all
select 'AMZ' || cast(c_custkey as string) || ' ', case when c_custkey % 7 = 3 then 'X' else '' end || cast(c_custkey as string)
from {customer} where c_mktsegment <> 'BUILDING' and c_custkey % 3 = 0
"""
_SQL["sales_order"] = f"""
select {_order('o_orderkey')} as order_number, 'IMP' || cast(o_orderkey as string) as import_order_number,
  case o_orderstatus when 'F' then 'c' when 'O' then 'A' else 'B' end as status_code,
  {_pick('o_custkey', _WAREHOUSES)} as warehouse_code, {_pick('o_custkey', ['WE', 'RF', None])} as receiving_format_code,
  cast(substring(o_orderpriority, 1, 1) as int) as priority_rank, cast(o_totalprice as decimal(18,2)) as total_charges,
  cast(o_orderdate as date) + 3 as expected_ship_date, cast(o_orderdate as date) as today
from {{orders}}
"""
_SQL["order_udf"] = f"""
select {_order('o_orderkey')} as order_number, {_pick('o_custkey', ['hhcv3', 'CV3', 'EBAY', 'OTHER'])} as udf_code,
  {_channel_order('o_orderkey')} as udf_order_text
from {{orders}}
union all
select {_order('o_orderkey')}, 'HHCV3', {_channel_order('o_orderkey')} from {{orders}}
where {_pick('o_custkey', ['hhcv3', 'CV3', 'EBAY', 'OTHER'])} = 'CV3' and o_orderpriority = '1-URGENT'
"""
_SQL["line_item"] = f"""
select {_order('l_orderkey')} as order_number, l_linenumber as line_number, cast(l_partkey as string) as sku,
  l_quantity as quantity_ordered, case l_returnflag when 'R' then l_linenumber else 0 end as canceled_quantity,
  case l_linestatus when 'F' then l_quantity - case l_returnflag when 'R' then l_linenumber else 0 end else 0 end
    as shipped_quantity,
  cast(l_extendedprice as decimal(18,2)) as product_price, cast(l_extendedprice as decimal(18,2)) as sku_list_price,
  cast(l_discount as decimal(18,2)) as discount_amount,
  case when l_linenumber = 5 then cast(l_shipdate as date) else null end as hold_until_date,
  case l_returnflag when 'A' then 'X' when 'N' then 'A' else 'B' end as status_code,
  case l_linenumber when 1 then null when 2 then case when l_suppkey % 2 = 0 then 'C' else 'c ' end else 'O' end as line_item_status_code,
  {_pick('l_suppkey', _WAREHOUSES)} as warehouse_code,
  case when l_linestatus = 'F' then cast(cast(l_shipdate as date) as string) when l_linenumber = 3 then 'abc' else null end
    as first_shipped_datetime,
  case when l_linestatus = 'F' then 'D' || cast(l_linenumber as string) else null end as first_shipped_shipdoc,
  l_shipdate as update_dtm
from {{lineitem}}
"""
_SQL["order_status"] = """
select distinct case l_returnflag when 'A' then 'X' when 'N' then 'A' else 'B' end as status_code,
  'Status ' || l_returnflag as order_status_desc
from {lineitem} where l_returnflag <> 'R'
"""
_SQL["shipper_tracking"] = f"""
select {_order('l_orderkey')} as order_number, 'D' || cast(l_linenumber as string) as shipping_document_number,
  {_pick('l_linenumber', ['FEDX', 'UPS', 'USPS', 'ONTR'])} as shipper_code,
  ' 1Z' || cast(l_orderkey as string) || ' ' as tracking_number, 'GND' as shipment_type_code
from {{lineitem}} where l_linenumber <> 6 group by l_orderkey, l_linenumber
"""
_SQL["shipment_log"] = f"""
select {_channel_order('l_orderkey')} as channelorderid, cast(l_partkey as string) as sku,
  case l_linestatus when 'F' then 'completed' else 'Failed' end as status
from {{lineitem}} where l_returnflag = 'A'
"""
_SQL["sale_detail"] = """
select l_orderkey as transaction_number, ' ' || cast(l_partkey as string) as item,
  cast(l_orderkey % 4 + 1 as string) as store_number, l_quantity as qty_selling_units,
  cast(l_extendedprice as decimal(18,2)) as actual_selling_price, cast(l_discount as decimal(18,2)) as cost
from {lineitem}
"""
_SQL["sale_header"] = """
select o_orderkey as transaction_number, cast(o_orderkey % 4 + 1 as string) as store_number,
  cast(o_orderdate as date) as creation_date, case o_orderpriority when '5-LOW' then 'E' else 'S' end as transaction_type
from {orders}
"""
_SQL["store_lookup"] = f"""
select distinct {_pick('s_suppkey', _WAREHOUSES)} as warehouse_code, 'WE' as receiving_format,
  {_pick('s_suppkey', ['11', '12', '17', '18', '14'])} as store_num
from {{supplier}} where {_pick('s_suppkey', _WAREHOUSES)} in ('HHH', 'HTOOL', 'LHAK')
union all
select distinct {_pick('s_suppkey', _WAREHOUSES)}, null, {_pick('s_suppkey', ['1', '2', '7', '8', '4'])}
from {{supplier}} where {_pick('s_suppkey', _WAREHOUSES)} <> 'HHH'
"""
_SQL["po_detail"] = """
select cast(l_orderkey as string) as po_number, l_linenumber as line_number, ' ' || cast(l_partkey as string) as item_number,
  cast(l_shipdate as date) as date_due, l_linestatus as item_status, l_quantity as qty_on_order, 0 as qty_received,
  cast(l_extendedprice as decimal(18,2)) as unit_cost, '1' as distribute_to_store, '2' as invoice_store
from {lineitem}
"""
_SQL["po_header"] = """
select cast(o_orderkey as string) as po_number, cast(o_orderdate as date) as creation_date
from {orders} where o_orderstatus <> 'P'
"""
_SQL["variant"] = f"""
select {_GID} cast(p_partkey as string) as id, cast(p_partkey as string) as sku, 'P' || cast(p_partkey as string) as product_id,
  case p_size % 3 when 0 then 'Production' else 'sandbox' end as environment, 'hh' as store
from {{part}} where p_size <> 13
union all
select {_GID} {_kit('o_orderkey')}, {_kit('o_orderkey')}, 'PK' || cast(o_orderkey as string),
  case o_orderstatus when 'F' then 'production' else 'Sandbox' end, 'leh'
from {{orders}}
"""
_SQL["storefront_product"] = """
select 'P' || cast(p_partkey as string) as id, case p_type when 'SMALL' then 'DRAFT' else 'active' end as status,
  case p_size % 2 when 0 then 'Sandbox' else 'Production' end as environment
from {part}
union all
select 'PK' || cast(o_orderkey as string), 'active', 'sandbox' from {orders}
"""
_SQL["location_map"] = f"""
select {_GID} cast(p_partkey as string) as parentid, '{_LOC}79232434312' as id from {{part}}
union all select {_GID} cast(p_partkey as string), '{_LOC}79232401544' from {{part}} where p_size > 10
union all select {_GID} cast(p_partkey as string), '{_LOC}79143207048' from {{part}} where p_size < 40
union all select {_GID} {_kit('o_orderkey')}, '{_LOC}79232434312' from {{orders}} where o_orderstatus <> 'P'
union all select {_GID} {_kit('o_orderkey')}, '{_LOC}79232401544' from {{orders}}
union all select {_GID} {_kit('o_orderkey')}, '{_LOC}79143207048' from {{orders}}
"""
_SQL["shop_pending"] = """
select cast(o_custkey as string) as sku, 1 as quantity from {orders} where o_orderpriority = '3-MEDIUM'
"""
_SQL["hk_item"] = "select cast(p_partkey as string) as sku from {part} where p_type = 'LARGE'"
_SQL["shop_order"] = """
select o_orderkey as shop_order_key, lpad(cast(o_orderkey as string), 13, '0') as shop_order_id,
  'HWEBS' || cast(o_orderkey as string) as order_name, 'First' || cast(o_custkey as string) as billing_first_name,
  'Last' || cast(o_custkey as string) as billing_last_name, 'First' || cast(o_custkey as string) as shipping_first_name,
  'Last' || cast(o_custkey as string) as shipping_last_name, 'City' as shipping_city, '44632' as shipping_zip,
  cast(o_totalprice as decimal(18,2)) as shipping_charges, cast(o_totalprice as decimal(18,2)) as total_charge,
  'card' as payment_gateways, 'card' as original_payment_gateways,
  case o_orderpriority when '1-URGENT' then 'cancel' when '2-HIGH' then 'investigate' else 'accept' end
    as risk_recommendation
from {orders} where o_orderpriority <> '5-LOW'
"""
_SQL["shop_order_item"] = """
select l_orderkey as shop_order_key, l_linenumber as line_number, cast(l_partkey as string) as sku,
  cast(l_quantity as int) as quantity, cast(l_extendedprice as decimal(18,2)) as unit_price,
  cast(l_extendedprice as decimal(18,2)) as total_price, null as discounted_allocations, 'engraving' as attribute1,
  null as attribute2, null as attribute3, null as attribute4, null as attribute5, '[]' as custom_attributes
from {lineitem}
"""
_SQL["imported_order"] = """
select case o_orderstatus when 'P' then 'gid://amazon7/Order/' else 'gid://shopify/Order/' end
    || lpad(cast(o_orderkey as string), 13, '0') as orderid,
  o_orderstatus = 'F' as exported, o_orderstatus <> 'O' as imported, o_orderdate as datecreated, o_orderdate as dateupdated
from {orders}
"""
_SQL["custom_product"] = """
select lpad(cast(o_orderkey as string), 13, '0') as shop_order_id, cast(o_custkey as string) as corrected_sku,
  'C' || cast(o_custkey as string) as shop_sku, 'ann' as createdby, o_orderdate as createdat, 'bo' as updatedby,
  o_orderdate as updatedat
from {orders} where o_orderstatus = 'O'
"""
_SQL["order_kickout"] = f"select {_order('o_orderkey')} as orderid from {{orders}} where o_orderstatus = 'P'"
_SQL["order_gift"] = """
select 'IMP' || cast(o_orderkey as string) as third_party_order_number, cast(o_orderdate as date) + 2 as ship_by_dtm
from {orders} where o_orderpriority = '1-URGENT'
"""
_SQL["amazon_order"] = """
select 'A' || cast(o_orderkey as string) as amazon_order_id, cast(o_custkey % 3 as string) as storeid from {orders}
"""
_SQL["amazon_order_item"] = """
select 'A' || cast(l_orderkey as string) as amazon_order_id, l_orderkey as orderid, l_linenumber as line_number,
  cast(l_quantity as int) as number_of_items, cast(l_extendedprice as decimal(18,2)) as item_price,
  cast(l_partkey as string) as seller_sku,
  case l_returnflag when 'A' then null else cast(l_tax as decimal(18,2)) end as shipping_price,
  case l_returnflag when 'A' then 0 else cast(l_discount as decimal(18,2)) end as shipping_discount,
  l_shipdate as dateentered
from {lineitem}
"""
_SQL["catalog_alias"] = f"""
select {_pick('p_size', ['MASTER13', 'lehmaster', 'HHMASTER', 'MFMASTER', 'OTHER'])} as catalog_id,
  cast(p_partkey as string) || ' ' as sku, 'AL' || cast(p_partkey as string) as catalog_alias
from {{part}} where p_type = 'SMALL'
"""
_SQL["catalog_item"] = f"""
select {_pick('p_size', ['OLD', 'LEHMASTER', 'HHMASTER', 'MFMASTER', 'MASTER13'])} as catalog_id,
  cast(p_partkey as string) || ' ' as sku
from {{part}} where p_type in ('LARGE', 'MEDIUM', 'PROMO')
"""
_SQL["import_process"] = """
select o_orderkey as process_id, case o_orderstatus when 'F' then 910 else 911 end as process_type_id,
  o_orderpriority as process_name
from {orders}
"""
_SQL["import_process_result"] = """
select o_orderkey as process_id, 'done' as result_text from {orders} where o_orderpriority <> '1-URGENT'
"""
_SQL["por_rate"] = """
select cast(p_partkey as string) as sku_key, p_size + 0.5 as rate1, p_size * 2 as rate2, p_size * 7 as rate3
from {part} where p_type <> 'PROMO'
"""
_SQL["rental_rate"] = """
select cast(p_partkey as string) as sku, '4HR' as rate_type, case p_type when 'PROMO' then 0 else p_size end as rate
from {part}
union all select cast(p_partkey as string), '1DAY', case p_type when 'LARGE' then p_size - 1 else p_size * 2 end
from {part} where p_type <> 'SMALL'
union all select cast(p_partkey as string), '1WK', case p_type when 'MEDIUM' then null else p_size * 2 end
from {part} where p_size <> 40
"""
_SQL["rental_rate_sent"] = """
select cast(p_partkey as string) as sku, '4HR' as rate_type, case when p_size = 45 then 1 else p_size end as rate
from {part} where p_size <> 50
union all select cast(p_partkey as string), '1DAY', case p_type when 'LARGE' then p_size - 1 else p_size * 2 end
from {part} where p_type <> 'SMALL'
union all select cast(p_partkey as string), '1WK', p_size * 2 from {part} where p_size <> 40
"""
_SQL["input_sku"] = f"""
select case when c_custkey % 3 = 0 then 'K' else '' end || cast(c_custkey as string) as sku,
  case when c_acctbal > 0 then 'true' else 'false' end as enabled, c_mktsegment as family, null as images, c_name as title,
  date '2025-01-01' as created, date '2025-01-02' as updated
from {{customer}}
"""
_SQL["traffic_history"] = """
select event_id as traffichistoryid, cast(user_id as string) as sensorid, 'Sensor ' || cast(user_id as string) as sensorname,
  cast(floor(value) as int) as incount, cast(floor(value / 2) as int) as outcount, ts as timestamputc
from {events}
"""
_SQL["sensor_site"] = "select cast(c_custkey as string) as sensorid, cast(c_nationkey as string) as site_id from {customer}"
_SQL["site_location"] = "select cast(n_nationkey as string) as site_id, cast(n_regionkey as string) as location_id from {nation}"
_SQL["location"] = "select cast(r_regionkey as string) as location_id, r_name as location_name from {region}"
_SQL["sensor"] = "select cast(c_custkey as string) as sensorid, 'Sensor ' || cast(c_custkey as string) as sensorname from {customer}"
_SQL["fact_sensor_traffic"] = """
select user_id % 25 as location_key, cast(floor(value) as int) as incount, cast(floor(value / 3) as int) as outcount,
  ts - interval '5' hour as timestampest
from {events}
"""
_SQL["dim_location"] = """
select cast(n_nationkey as bigint) as location_key, r_name as location_name from {nation} join {region} on n_regionkey = r_regionkey
"""
_SQL["store_traffic"] = "select ts as trafficdate, cast(floor(value) as int) as trafficvalue from {events}"
_SQL["weather_history"] = """
select ts as observationdate, case event_type when 'error' then 'TMAX' when 'view' then 'tmax' else 'tmin' end as datatype,
  value, cast(user_id % 2 as string) as store_location_id
from {events}
"""
_SQL["ticket_event"] = """
select cast(c_custkey as string) as event_id, c_name as event_name, date '2026-01-01' + cast(c_nationkey as int) as event_date
from {customer}
"""
_SQL["ticket_order"] = """
select cast(o_orderkey as string) as order_id, cast(o_custkey as string) as event_id,
  cast(o_totalprice as decimal(18,2)) as total_charge, case o_orderstatus when 'P' then o_orderdate else null end as refunded_at
from {orders}
"""
_SQL["ticket_charge"] = """
select cast(o_orderkey as string) as order_id, o_orderpriority as paymethod, 'visa' as card_type,
  cast(o_orderkey % 1000 as string) as check_number, 'First' as firstname, 'Last' as lastname
from {orders} where o_orderstatus <> 'F'
"""
_SQL["ticket_line"] = """
select cast(l_orderkey as string) as order_id, case l_returnflag when 'R' then 'Meal' when 'A' then 'adult' else 'child' end
  as type
from {lineitem}
"""
_SQL["ticket_event_view"] = """
select c_custkey as eid, date '2026-01-01' + cast(c_nationkey as int) as cdate, c_name as event_name from {customer}
"""
_SQL["ticket_order_view"] = """
select o_orderkey as oid, o_orderdate as pulledatutc, cast(o_totalprice as decimal(18,2)) as total_charge from {orders}
"""
_SQL["ticket_charge_view"] = "select o_orderkey as oid, o_orderdate as pulledatutc, o_orderpriority as paymethod from {orders}"
_SQL["ticket_line_view"] = "select l_orderkey as oid, l_shipdate as pulledatutc, l_returnflag as type from {lineitem}"
_SQL["video"] = "select cast(p_partkey as string) as sku, p_name as title, 'v/' || cast(p_partkey as string) as url from {part}"


def _inputs(name: str) -> list[str]:
    """Tables and entities an entity's SELECT reads."""
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", _SQL[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def standin_sources(spark: SparkSession, sf_dir: str, stored: Collection[str] = ()) -> Sources:
    """All entities over the benchmark tables; an entity is only built when a check asks for it.

    Those in ``stored`` are written to the session's warehouse when first built, as the tables that they stand for would be
    there; entities and checks read them from there instead of deriving them anew.
    """
    built: dict[str, DataFrame] = {}
    locks = {name: Lock() for name in stored}

    def build(name: str) -> DataFrame:
        with locks.get(name, nullcontext()):  # two checks at a time may ask for one that is to be written
            if name not in built:
                if name in BASE_TABLES:
                    rows = table(spark, sf_dir, name)
                else:
                    rows = spark.sql(_SQL[name], **{n: build(n) for n in _inputs(name)})
                if name in locks:
                    at = f"input_{uuid.uuid4().hex[:12]}_{name}"
                    rows.write.format("parquet").saveAsTable(at)
                    rows = spark.table(at)
                built[name] = rows
            return built[name]

    return Sources({n: (lambda n=n: build(n)) for n in ENTITIES})


_DUCK_TYPES = {"string": "varchar", "timestamp_ntz": "timestamp"}


def _oracle_column(name: str, kind: str) -> str:
    value = f"cast({name} as {_DUCK_TYPES.get(kind, kind)})"
    return f"upper(rtrim({value})) as {name}" if name in FOLDED_COLUMNS else f"{value} as {name}"


@cache
def _oracle_ctes(name: str) -> tuple[tuple[str, str], ...]:
    out: list[tuple[str, str]] = []
    for n in _inputs(name):
        if n not in BASE_TABLES:
            out += _oracle_ctes(n)
    text = _SQL[name].format(**{n: n if n in BASE_TABLES else f"raw_{n}" for n in _inputs(name)})
    out.append((f"raw_{name}", text.strip()))
    columns = ", ".join(_oracle_column(c, kind) for c, kind in ENTITIES[name].items())
    out.append((name, f"select {columns} from raw_{name}"))
    return tuple(out)


def oracle(entities: str, body: str) -> str:
    """One DuckDB statement: the named entities as CTEs, then ``body`` (more CTEs and the final select)."""
    ctes: dict[str, str] = {}
    for name in entities.split():
        ctes.update(_oracle_ctes(name))
    prelude = ",\n".join(f"{name} as ({text})" for name, text in ctes.items())
    body = body.strip()
    return f"with {prelude}{' ' if body.lower().startswith('select') else ', '}\n{body}"
