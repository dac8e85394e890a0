"""Every check over the benchmark tables in entity shape, beside SQL written for DuckDB."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..plans import CHECKS
from ..plans.stages import StagedSources
from .registry import query
from .standins import oracle, standin_sources

# Parameters that fit the years of the benchmark data.
PARAMS = {
    "duplicate_location_log": {"since": datetime(1995, 6, 1)},
    "amazon_free_shipping": {"year": "1997"},
    "amazon_orders": {"year": "1997"},
    "personalised_imports": {"since": "1999-03-18"},
    "ebay_shipments_due": {"as_of": date(2000, 6, 30)},
    "shop_shipments_due": {"as_of": date(2000, 6, 30)},
    "traffic_by_local_month": {"month": "2024-01"},
    "store_traffic_daily": {"start": "2024-01-03"},
    "store_traffic_monthly": {"start": "2024-01"},
    "sensor_traffic": {"location": "europe", "month": "2024-01"},
    "traffic_systems": {"years": ("2023", "2024")},
    "hot_day_traffic": {"year": "2024", "limit": 60.0},
    "weather_day": {"day": "2024-01-02"},
    "hot_days": {"year": "2024", "limit": 60.0},
}

_F = "lower(rtrim({}))".format
_NOT_ARCHIVED = "lower(rtrim(status)) not in ('archive', 'archived')"
_ONLINE = "lower(rtrim(web_flag)) in ('c', 'o', 'n')"
_STORES = "store in ('1', '2', '4', '7', '8', 'D', 'J', '12', '18')"
_CHECK = "case when {} = {} then 'true' else 'false' end".format
_AMOUNT = "try_cast({} ->> '$[0].amount' as decimal(18,2))".format
_LIST = "coalesce(translate({}, '[]\"', ''), '0')".format
_DONE = "(select channelorderid, sku from shipment_log where lower(status) = 'completed')"


def _n(x: str) -> str:
    return f"regexp_replace(trim({x}), '-FBA|\\(A\\)', '', 'gi')"


def _n4(x: str) -> str:
    return f"regexp_replace(trim({x}), '-FBA|\\(A\\)|\\(B\\)|\\.old', '', 'gi')"


_NEWEST = """newest as (
  select * from appliance
  qualify coalesce(updatedate, insertdate) = max(coalesce(updatedate, insertdate)) over (partition by sku))"""
_HOME = f"home as (select * from catalog where lower(data_source) = 'homesource' and {_NOT_ARCHIVED})"
_BRAND = """brand as (
  select a.sku, a.obsoletedate, regexp_replace(s.specvalue, 'upc code: ', '', 'i') as brand_code
  from appliance a join appliance_spec s using (apid) where a.manufacturerid = '21' and s.specvalue ilike '%upc%')"""
_RULED = f"""{_NEWEST}, ruled as (
  select sku, (case when coalesce(umrp, 0) <> 0 then umrp when coalesce(msrp, 0) <> 0 then msrp
    else greatest(coalesce(calculatedcost, 0), coalesce(map, 0)) end)::decimal(18,2) as list_price,
    case when coalesce(umrp, 0) <> 0 then 'no sale price' else 'sale price' end as sale_mark
  from newest)"""
_ACTIVE_KITS = f"""active_kits as (
  select {_n('k.sku')} as sku, k.sku as raw_sku from kitting k
  where k.sku in (select sku from order_sku where lower(active_flag) = 'y'))"""
_ITEMS = f"""items as (
  select *, {_n('item_number')} as sku, trim(item_number) as item_sku from item_store where {_STORES})"""
_EAGLE = "eagle as (select trim(sku) as sku, identifier from catalog where lower(data_source) = 'eagle')"
_KITCAT = "kitcat as (select trim(sku) as sku, * exclude (sku) from catalog where lower(data_source) = 'natord-kit')"
_PRODUCTS = f"""{_ITEMS}, {_EAGLE}, products as (
  select sku from items where {_ONLINE} and item_sku not in (select trim(sku) from kitting) union select sku from eagle)"""
_LISTING = f"""{_ITEMS}, {_EAGLE}, {_KITCAT}, {_ACTIVE_KITS}, listing as (
  select distinct p.sku, 'Eagle' as source, c.sku as code_sku, c.code, c.source as code_source, c.primary_flag, c.updated as code_updated
  from (select sku from items where {_ONLINE} union select sku from eagle) p
  left join (select * replace (trim(sku) as sku) from item_upc) c using (sku)
  union all
  select distinct p.sku, 'NatOrd-Kit', c.sku, c.code, '', '', null::timestamp
  from (select sku from active_kits union select sku from kitcat) p
  left join (select * replace (trim(sku) as sku) from kit_upc) c using (sku))"""
_CHANNELS = ("website_hh", "website_leh", "amazon_hh", "amazon_leh")


def _web(source: str, decide: tuple[str, ...]) -> str:
    columns = ", ".join(
        f"f.{c}, c.web_{c} as catalog_{c}, case when lower(f.{c}) = coalesce(lower(rtrim(c.web_{c})), '0') then 'true' else 'false' end as {c}_check"
        for c in _CHANNELS
    )
    wrong = " or ".join(f"{c}_check = 'false'" for c in decide)
    return f"select * from (select f.sku, {columns} from {source} f left join catalog c on trim(c.identifier) = f.sku) where {wrong}"


def _any_on(groups: dict[str, list[str]], on: str, by: str) -> str:
    return ", ".join(
        "case when bool_or({} and {} in ({})) then 'True' else 'False' end as {}".format(on, by, ", ".join(f"'{m}'" for m in members), c)
        for c, members in groups.items()
    )


def _product_web(without_appliances: bool) -> str:
    cut = "and sku not in (select sku from appliance)" if without_appliances else ""
    return (
        f"{_ITEMS}, {_EAGLE}, f as (select sku, "
        + _any_on(fv.CHANNEL_STORES, _ONLINE, "case store when 'D' then '12' when 'J' then '18' else store end")
        + f" from items where sku in (select sku from eagle) {cut} group by 1) "
        + _web("f", ("website_hh", "website_leh"))
    )


_PENDING = """pending as (
  select coalesce(x.sku, p.sku) as sku, sum(p.quantity)::decimal(18,4) as quantity
  from amazon_pending p left join (select distinct * from sku_xref) x on x.alias_sku = p.sku group by 1)"""


def _open(name: str, codes: str, where: str, columns: str) -> str:
    return f"""{name} as (
  select l.sku, {columns} from sales_order o join order_udf u using (order_number) join line_item l using (order_number)
  where lower(u.udf_code) in ({codes}) and lower(o.status_code) not in ('c', 'x') {where} group by 1)"""


_LEFT = "sum(l.quantity_ordered - l.canceled_quantity)"
_SPLIT = ", ".join(
    f"{_LEFT} filter (o.warehouse_code = '{w}')::decimal(18,4) as st{st}_open" for w, st in fv.WAREHOUSE_STORE.items()
)
_RESERVES = ", ".join(
    f"max(product_reserve_quantity) filter (warehouse_code = '{w}') as st{st}_reserve" for w, st in fv.WAREHOUSE_STORE.items()
)


def _offer(store: str, warehouse: str, net: str, kit_join: str, location: str, live: str, population: str) -> str:
    return f"""{_PENDING}, {_open('open_orders', "'hhcv3'", warehouse, f'{_LEFT} as quantity')},
live as (select * from appliance where obsoletedate is null),
pit as (select sku, sum(stock_pit) as q from (select distinct sku, stock_pit from live) group by 1),
it as (select trim(item_number) as sku, sum(quantity_on_hand) as oh, sum(committed_quantity) as co, sum(safety_stock) as sa
  from item_store where store = '{store}' group by 1),
res as (select sku, max(product_reserve_quantity) as q from product_warehouse where warehouse_code = 'HHH' group by 1),
base as (
  select p.sku, coalesce(oh, 0) as oh, coalesce(co, 0) as co, coalesce(sa, 0) as sa, coalesce(res.q, 0) as re,
    coalesce(pending.quantity, 0) as pe, coalesce(open_orders.quantity, 0) as oo, coalesce(pit.q, 0) as sp
  from (select sku from it union select sku from live) p left join it using (sku) left join res using (sku)
  left join pending using (sku) left join open_orders using (sku) left join pit using (sku)),
stock as (select sku, {net} as net from base),
kits as (
  select k.sku, min(case when s.net is not null and k.component_quantity <> 0 then floor(greatest(s.net / k.component_quantity, 0)) end)::bigint as q
  from kitting k {kit_join} join stock s on s.sku = k.component_sku group by 1),
totals as (
  select sku, coalesce(kits.q, case when stock.net is not null then floor(greatest(stock.net, 0)) end)::bigint as total_inventory
  from stock full join kits using (sku) {population}),
listed as (
  select distinct v.sku from variant v join location_map m on m.parentid = v.id
  where m.id = 'gid://shopify/Location/{location}' {live})
"""


_HH_NET = "oh - co - re - sa - pe + oo + "
_MF_NET = "oh - co - sa - pe + "
_STOCKED_ONLY = "where sku in (select sku from stock)"
_NOT_LIVE = "and lower(v.environment) <> 'production'"
_OFFER_ENTITIES = """amazon_pending sku_xref sales_order order_udf line_item appliance item_store product_warehouse kitting
    variant location_map"""
_TOTALS = "select * from totals where sku in (select sku from listed)"

_LOCATIONS = """
place as (
  select trim(item_number) as sku, store, map(['1','2','4','7','8'], ['HHH','HTOOL','HHMF','LHAK','LHAD'])[store] as wh,
    case when store in ('1','4') then coalesce(department, '') || '-' || coalesce(location_code, '') else location_code end as loc,
    greatest(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0), 0) as free
  from item_store where store in ('1','2','4','7','8') and trim(item_number) not ilike 'zz%'
  union all
  select trim(item_number) || '-FBA', 'D', 'HTOOL', location_code, greatest(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0), 0)
  from item_store where store = 'D' and trim(item_number) not ilike 'zz%'),
kept as (
  select s.sku from order_sku s join product p using (product_number) join product_type t using (product_type_code)
  where t.inventory_flag = 'Y' and lower(coalesce(s.kit_code, '-')) not in ('k', 's')),
found as (
  select p.*, l.location_type, l.product_quantity from place p join product_location l on l.sku = p.sku and l.warehouse_code = p.wh
  where p.sku in (select sku from kept)),
multi as (select sku, store from found group by 1, 2 having count(distinct location_type) > 1),
wrong as (
  select distinct sku, store, wh as warehouse_code, loc as expected_location, location_type as actual_location,
    floor(free)::bigint as free_quantity, product_quantity as actual_quantity,
    case when rtrim(loc) = '' or lower(rtrim(loc)) = lower(rtrim(location_type)) then 'true' else 'false' end as location_check,
    case when floor(free) = product_quantity then 'true' else 'false' end as quantity_check
  from found where sku not in (select sku from multi))
"""
_LOCATION_ENTITIES = "item_store order_sku product product_type product_location"


def _old_place(entities_tail: str) -> str:
    return f"""
place as (
  select case store when 'D' then trim(item_number) || '-FBA' else trim(item_number) end as sku, store,
    map(['1','2','7','8','D'], ['HHH','HTOOL','LHAK','LHAD','HTOOL'])[store] as wh,
    lower(rtrim(coalesce(department, '') || '-' || coalesce(location_code, ''))) as loc, greatest(coalesce(quantity_on_hand, 0), 0) as oh
  from item_store
  where (store in ('1','2','7','8') and lower(primary_vendor) not in ('5haco','hartc','mcelr','uline') and trim(item_number) not ilike 'zz%')
     or (store = 'D' and lower(primary_vendor) not in ('5haco','hartc'))),
spot as (select trim(sku) as sku, warehouse_code as wh, lower(rtrim(location_type)) as loc, product_quantity from product_location),
{entities_tail}"""


_TRAFFIC = """located as (
  select t.*, l.location_name, (timestamputc at time zone 'UTC') at time zone 'America/New_York' as local_ts
  from traffic_history t join sensor_site a using (sensorid) join site_location b using (site_id) join location l using (location_id))"""
_TRAFFIC_ENTITIES = "traffic_history sensor_site site_location location"
_SUMS = "sum(incount)::bigint as incount, sum(outcount)::bigint as outcount"

_SHOP_COLUMNS = """i.orderid, i.exported, i.imported, i.datecreated, i.dateupdated, s.order_name, s.shipping_charges, s.total_charge,
  s.payment_gateways, s.original_payment_gateways"""
_ITEM_COLUMNS = "x.line_number, x.sku, x.quantity, x.unit_price, x.total_price, x.discounted_allocations"
_ORDER_LINES = """select u.order_number, u.udf_code, u.udf_order_text, l.line_number, l.sku, l.quantity_ordered, l.discount_amount,
  l.hold_until_date, l.status_code, s.order_status_desc
from order_udf u join line_item l using (order_number) join order_status s using (status_code)"""
_ORDER_ENTITIES = "order_udf line_item order_status"
_CATALOG_IDS = "lower(catalog_id) in ('master13', 'lehmaster', 'hhmaster', 'mfmaster')"
_BRAND_ITEM = "trim(item_number) not ilike '%zz%' and (lower(discontinued) <> 'y' or coalesce(quantity_on_hand, 0) > 0)"
_SANDBOX = """sandbox as (
  select v.sku from variant v join storefront_product p on p.id = v.product_id
  where lower(p.status) <> 'draft' and lower(p.environment) = 'sandbox')"""

SALES_SQL = """
pending_lines as (
  select l.*, o.receiving_format_code as form, o.today from line_item l join sales_order o using (order_number)
  where l.line_item_status_code <> 'C' and l.status_code <> 'X' and l.quantity_ordered - l.canceled_quantity <> l.shipped_quantity),
erp as (
  select d.transaction_number::varchar as transaction, trim(d.item) as item, store_number as store, d.qty_selling_units as quantity,
    h.creation_date as transaction_date, d.actual_selling_price as price, d.cost, 'eagle' as source_type, 'E' as source_code
  from sale_detail d join sale_header h using (transaction_number, store_number) where h.transaction_type <> 'E'),
ord as (
  select l.order_number as transaction, l.sku as item, coalesce(a.store_num, b.store_num) as store, l.quantity_ordered as quantity,
    l.today as transaction_date, l.product_price as price, l.sku_list_price as cost, 'natural-order' as source_type, 'NO' as source_code
  from pending_lines l left join store_lookup a on a.warehouse_code = l.warehouse_code and a.receiving_format = l.form
  left join store_lookup b on b.warehouse_code = l.warehouse_code and b.receiving_format is null)
"""
_NEWEST_SALES = "order by transaction_date desc, transaction, item, quantity, price limit 100"

# check name -> (entities it reads, SQL after them)
SQL: dict[str, tuple[str, str]] = {
    "appliance_coverage": (
        "appliance catalog appliance_feed",
        f"""{_NEWEST}, {_HOME}, eligible as (select sku from newest where obsoletedate is null union select sku from home)
select e.sku, a.obsoletedate from eligible e left join appliance a using (sku)
where not exists (from appliance_feed f where f.identifier = e.sku)""",
    ),
    "appliance_code_flag": (
        "appliance appliance_spec catalog",
        f"""{_BRAND}, known as (
  select sku, obsoletedate, true as coded from brand
  union all select sku, obsoletedate, false from appliance where sku not in (select sku from brand)),
calc as (
  select k.sku, k.obsoletedate, c.upc, case when coded or c.upc is not null then 'false' else 'true' end as calculated_flag, c.upc_no_exist
  from known k join catalog c on c.identifier = k.sku where {_NOT_ARCHIVED})
select *, 'false' as flag_check from calc where {_F('upc_no_exist')} is distinct from calculated_flag""",
    ),
    "appliance_not_archived": (
        "appliance catalog",
        f"""{_NEWEST} select c.sku, c.status, n.obsoletedate from catalog c join newest n using (sku)
where n.obsoletedate is not null and {_NOT_ARCHIVED}""",
    ),
    "appliance_create_date": (
        "appliance catalog",
        f"""{_HOME}, eligible as (select sku from appliance where obsoletedate is null union select sku from home),
first as (select sku, min(insertdate)::date as first_insert from appliance group by 1)
select e.sku, f.first_insert, c.erp_sku_create_date, 'false' as date_check
from eligible e left join first f using (sku) left join catalog c on c.identifier = e.sku
where (c.erp_sku_create_date = f.first_insert) is not true""",
    ),
    "appliance_codes": (
        "appliance appliance_spec catalog",
        f"""{_BRAND} select b.sku, b.brand_code, c.upc, 'false' as code_check from brand b join catalog c on c.identifier = b.sku
where {_NOT_ARCHIVED} and (c.upc = b.brand_code) is not true""",
    ),
    "appliance_source": (
        "appliance catalog",
        f"""{_NEWEST} select n.sku, c.data_source, c.web_website_hh, c.status from newest n join catalog c on c.identifier = n.sku
where n.obsoletedate is not null and lower(c.data_source) <> 'homesource'""",
    ),
    "appliance_stores": (
        "appliance catalog",
        f"""{_NEWEST} select n.sku, c.in_stores from newest n join catalog c on c.identifier = n.sku
where n.obsoletedate is null and c.in_stores <> '["1","4","adc"]'""",
    ),
    "appliance_prices": (
        "appliance catalog",
        f"""{_RULED}, actual as (select identifier as sku, {_AMOUNT('retail_price_website_hh')} as catalog_price from catalog where {_NOT_ARCHIVED})
select distinct r.sku, r.list_price, r.sale_mark, a.catalog_price, 'false' as price_check
from ruled r join actual a using (sku) where (r.list_price = a.catalog_price) is not true""",
    ),
    "appliance_inventory_tracked": (
        "catalog",
        f"{_HOME} select identifier, inventory_tracked, status from home where lower(inventory_tracked) <> 'true'",
    ),
    "appliance_physical": ("catalog", f"{_HOME} select identifier, physical, status from home where lower(physical) <> 'true'"),
    "appliance_types": (
        "appliance appliance_class type_map catalog",
        f"""{_NEWEST}, {_HOME}, mapped as (
  select n.sku, c.type as appliance_class, m.code as mapped_code from newest n join appliance_class c using (apid)
  join type_map m on lower(m.type) = lower(c.type))
select h.identifier as sku, h.data_source, translate(h.appliance_type, '[]"', '') as type_code, m.appliance_class, m.mapped_code,
  'false' as type_check
from home h left join mapped m on m.sku = h.identifier
where coalesce(lower(translate(h.appliance_type, '[]"', '')), '') <> coalesce(lower(m.mapped_code), '')""",
    ),
    "appliance_feed_prices": (
        "appliance appliance_feed",
        f"""{_RULED}, calc as (
  select r.sku, r.list_price, coalesce(f.sale_price, 0)::decimal(18,2) as sale_price,
    (case when f.sale_price <> 0 then f.sale_price else r.list_price end)::decimal(18,2) as retail_price
  from ruled r left join appliance_feed f on f.identifier = r.sku),
joined as (
  select distinct f.identifier as sku, f.retail_price as feed_retail, f.list_price as feed_list, c.list_price, c.sale_price, c.retail_price,
    {_CHECK('c.retail_price', 'f.retail_price')} as retail_check, {_CHECK('c.list_price', 'f.list_price')} as list_check
  from appliance_feed f left join calc c on c.sku = f.identifier where lower(f.status) <> 'archived')
select * from joined where retail_check = 'false' or list_check = 'false'""",
    ),
    "appliance_catalog_prices": (
        "appliance_feed catalog catalog_json",
        f"""lists as (
  select identifier, unnest(json_extract(json, '$.values.list_price[*]')) as entry from catalog_json),
prices as (
  select identifier, try_cast(entry ->> '$.data[0].amount' as decimal(18,2)) as catalog_list from lists where entry ->> '$.scope' = 'website_hh'),
joined as (
  select distinct f.identifier as sku, f.sale_price, f.retail_price as feed_retail, f.list_price as feed_list,
    {_AMOUNT('c.retail_price_website_hh')} as catalog_retail, p.catalog_list,
    {_CHECK('f.retail_price', _AMOUNT('c.retail_price_website_hh'))} as retail_check, {_CHECK('f.list_price', 'p.catalog_list')} as list_check
  from appliance_feed f join catalog c using (identifier) left join prices p using (identifier) where {_NOT_ARCHIVED.replace('status', 'c.status')})
select * from joined where retail_check = 'false' or list_check = 'false'""",
    ),
    "appliance_web_flag": (
        "appliance item_store catalog",
        f"""{_NEWEST}, flags as (
  select trim(item_number) as sku, string_agg(distinct upper(web_flag), ',' order by upper(web_flag)) as web_flags
  from item_store where store in ('1','2','4') group by 1),
calc as (
  select distinct n.sku, n.obsoletedate, f.web_flags,
    case when n.obsoletedate is null and (f.web_flags is null or regexp_matches(f.web_flags, '[CON]')) then 'true' else 'false' end as web
  from newest n left join flags f using (sku))
select k.*, c.web_website_hh, 'false' as web_check from calc k join catalog c on c.identifier = k.sku
where lower(c.web_website_hh) is distinct from k.web""",
    ),
    "catalog_kits_unknown": (
        "catalog kitting",
        f"""select trim(sku) as sku from catalog where lower(data_source) not in ('adc', 'homesource', 'eagle', 'leh import')
and trim(sku) not in (select {_n('sku')} from kitting)""",
    ),
    "catalog_items_unknown": (
        "catalog item_store",
        f"""{_ITEMS} select trim(sku) as sku from catalog where lower(data_source) not in ('adc', 'homesource', 'natord-kit')
and trim(sku) not in (select sku from items)""",
    ),
    "code_listing": ("item_store catalog kitting order_sku item_upc kit_upc", f"{_LISTING} select * from listing"),
    "codes_without_primary": (
        "item_store catalog kitting order_sku item_upc kit_upc",
        f"""{_LISTING} select distinct * from listing where source = 'Eagle' and coalesce(primary_flag, 'N') = 'N'
and sku not in (select sku from listing where source = 'Eagle' and primary_flag = 'Y')""",
    ),
    "product_coverage": (
        "appliance item_store catalog kitting order_sku product_feed",
        f"""{_NEWEST}, {_ITEMS}, {_ACTIVE_KITS}, pool as (
  select sku, 'item' as source from items where {_ONLINE} and sku not in (select sku from newest where obsoletedate is not null)
  union select sku, 'kit' from active_kits
  union select trim(sku), 'catalog' from catalog where lower(data_source) in ('eagle', 'natord-kit') and coalesce(lower(rental_item), 'false') <> 'true')
select * from pool where sku not in (select trim(identifier) from product_feed)""",
    ),
    "onboarding_candidates": (
        "item_store catalog kitting order_sku",
        f"""{_ITEMS}, {_ACTIVE_KITS}, pool as (
  select sku, 'item' as source from items where {_ONLINE} union all select sku, 'kit' from active_kits)
select * from pool where sku not in (select trim(sku) from catalog)""",
    ),
    "code_flag_feed": (
        "catalog product_feed",
        """select c.identifier as sku, c.upc_no_exist, c.data_source, f.upc_no_exist as feed_flag, 'false' as flag_check
from catalog c join product_feed f using (identifier)
where c.data_source not ilike '%akeneo%' and (lower(c.upc_no_exist), f.upc_no_exist) not in (('true', '1'), ('false', '0'))""",
    ),
    "obsolete_in_product_feed": (
        "appliance product_feed",
        f"{_NEWEST} select identifier as sku from product_feed where identifier in (select sku from newest where obsoletedate is not null)",
    ),
    "brand_codes": (
        "appliance appliance_spec item_upc",
        f"""{_BRAND} select b.sku, trim(u.code) as item_code, b.brand_code, {_CHECK('trim(u.code)', 'b.brand_code')} as code_check
from item_upc u join brand b on b.sku = trim(u.sku)""",
    ),
    "mixed_record_coverage": (
        "appliance product_feed",
        f"""{_NEWEST}, mixed as (select sku from appliance group by 1 having count(distinct obsoletedate is null) = 2)
select sku from newest where obsoletedate is null and sku in (select sku from mixed) and sku not in (select identifier from product_feed)""",
    ),
    "feed_codes": (
        "item_store catalog item_upc kitting kit_upc product_feed",
        f"""codes as (
  select {_n('sku')} as sku, trim(code) as code, source = 'M' as m, primary_flag = 'Y' as prim, updated, length(trim(code)) in (12, 13) as valid
  from item_upc
  where {_n('sku')} in (select {_n('item_number')} from item_store where store = 'M')
    and {_n('sku')} in (select identifier from catalog where lower(data_source) in ('eagle', 'homesource'))),
ranked as (
  select sku, code, 1 as kind from codes where prim and valid
  union all select sku, code, 2 from codes where m qualify updated = max(updated) filter (valid) over (partition by sku)
  union all select sku, code, 3 from codes where valid qualify updated = max(updated) over (partition by sku)),
best as (select distinct sku, code from (select *, min(kind) over (partition by sku) as k from ranked) where kind = k),
kit_best as (
  select distinct trim(sku) as sku, trim(code) as code from kit_upc
  where length(trim(code)) in (12, 13) and trim(sku) in (select sku from kitting))
select f.identifier as sku, f.upc, s.code as system_code, 'false' as code_check
from product_feed f left join (select * from best union all select * from kit_best) s on s.sku = f.identifier
where f.upc is distinct from s.code""",
    ),
    "catalog_codes": (
        "catalog product_feed",
        """select f.identifier as sku, f.upc as feed_upc, c.upc, 'false' as code_check from product_feed f join catalog c using (identifier)
where f.upc is not null and c.upc is distinct from f.upc""",
    ),
    "discontinued_closeout": (
        "item_store kitting catalog",
        f"""{_PRODUCTS}, codes as (
  select distinct sku, store, case store when 'D' then '12' when 'J' then '18' else store end as shown,
    lower(discontinued) = 'y' as d, closeout = 'Y' as c from items where {_ONLINE} and sku in (select sku from products)),
lists as (
  select sku, coalesce(string_agg(shown, ',' order by store) filter (d), '0') as discontinued,
    coalesce(string_agg(shown, ',' order by store) filter (c), '0') as closeout from codes group by 1),
joined as (
  select distinct l.*, trim(p.sku) as catalog_sku, case when p.sku is null then null else {_LIST('p.discontinued')} end as catalog_discontinued,
    case when p.sku is null then null else {_LIST('p.store_closeout')} end as catalog_closeout,
    {_CHECK('l.discontinued', _LIST('p.discontinued'))} as discontinued_check, {_CHECK('l.closeout', _LIST('p.store_closeout'))} as closeout_check
  from lists l left join catalog p on trim(p.sku) = l.sku)
select * from joined where discontinued_check = 'false' or closeout_check = 'false'""",
    ),
    "feed_create_dates": (
        "kitting order_sku catalog dw_item product_feed appliance",
        """kit_dates as (
  select k.sku, max(s.create_dtm)::date as first_seen from kitting k join order_sku s on s.sku = k.component_sku
  where k.sku in (select identifier from catalog where lower(data_source) = 'natord-kit') group by 1),
dates as (
  from kit_dates union all
  select trim(item_number), min(record_added)::date from dw_item
  where store = 'M' and trim(item_number) not in (select sku from kit_dates) group by 1)
select f.identifier as sku, f.erp_sku_create_date as feed_date, d.first_seen, 'false' as date_check
from product_feed f left join dates d on d.sku = f.identifier
where lower(f.product_trace) <> 'akeneo only' and f.identifier not in (select sku from appliance where obsoletedate is null)
  and f.erp_sku_create_date is distinct from d.first_seen""",
    ),
    "catalog_create_dates": (
        "kitting order_sku catalog dw_item product_feed appliance catalog_json",
        """kit_dates as (
  select k.sku, max(s.create_dtm)::date as first_seen from kitting k join order_sku s on s.sku = k.component_sku
  where k.sku in (select identifier from catalog where lower(data_source) = 'natord-kit') group by 1),
dates as (
  from kit_dates union all
  select trim(item_number), min(record_added)::date from dw_item
  where store = 'M' and trim(item_number) not in (select sku from kit_dates) group by 1)
select c.identifier as sku, c.erp_sku_create_date, f.product_trace, d.first_seen, 'false' as date_check
from catalog c join dates d on d.sku = c.identifier join product_feed f using (identifier)
where lower(f.product_trace) <> 'akeneo only' and c.identifier not in (select sku from appliance where obsoletedate is null)
  and c.identifier not in (select identifier from catalog_json where json like '%family%' and json ->> '$.family' is null)
  and (c.erp_sku_create_date = d.first_seen) is not true""",
    ),
    "store_locations": (
        "item_store kitting catalog appliance",
        f"""{_PRODUCTS}, codes as (
  select distinct sku, store, case store when 'D' then '12' when 'J' then '18' else store end as shown
  from items where {_ONLINE} and sku in (select sku from products) and sku not in (select sku from appliance)),
lists as (select sku, string_agg(shown, ',' order by store) as stores from codes group by 1)
select distinct l.sku, l.stores, {_LIST('p.in_stores')} as catalog_stores, 'false' as stores_check
from lists l join catalog p on trim(p.sku) = l.sku where l.stores <> {_LIST('p.in_stores')}""",
    ),
    "kit_locations": (
        "kitting order_sku catalog product_warehouse",
        f"""{_ACTIVE_KITS}, {_KITCAT}, kits as (select {_n4('raw_sku')} as sku from active_kits union select sku from kitcat),
codes as (
  select distinct k.sku, map(['HHH','HTOOL','LHAK','LHAD'], ['1','2','7','8'])[p.warehouse_code] as store
  from kits k left join product_warehouse p on trim(p.sku) = k.sku),
lists as (select sku, coalesce(string_agg(store, ',' order by store), '0') as stores from codes group by 1)
select distinct l.sku, l.stores, case when p.sku is null then null else {_LIST('p.in_stores')} end as catalog_stores, 'false' as stores_check
from lists l left join catalog p on trim(p.sku) = l.sku where l.stores <> {_LIST('p.in_stores')}""",
    ),
    "kit_prices": (
        "catalog catalog_price",
        f"""{_KITCAT}, prices as (
  select sku, max(catalog_price) filter (catalog_id = 'MASTER13') as a, max(catalog_price) filter (catalog_id = 'HHMASTER') as h,
    max(catalog_price) filter (catalog_id = 'LEHMASTER') as l from catalog_price group by 1),
rows as (
  select k.sku, {", ".join(f"coalesce({_AMOUNT(f'retail_price_{c}')}, 0)::decimal(18,2) as retail_price_{c}" for c in ("amazon_hh", "amazon_leh", "website_hh", "website_leh"))},
    coalesce(a, 0)::decimal(18,2) as master13, coalesce(h, 0)::decimal(18,2) as hhmaster, coalesce(l, 0)::decimal(18,2) as lehmaster
  from kitcat k left join prices p on p.sku = k.sku where coalesce(lower(k.rental_item), 'false') <> 'true'),
flagged as (
  select *, {_CHECK('retail_price_amazon_hh', 'master13')} as amazon_hh_check, {_CHECK('retail_price_amazon_leh', 'lehmaster')} as amazon_leh_check,
    {_CHECK('retail_price_website_hh', 'case when master13 <> 0 then master13 else hhmaster end')} as website_hh_check,
    {_CHECK('retail_price_website_leh', 'lehmaster')} as website_leh_check from rows)
select * from flagged where 'false' in (amazon_hh_check, amazon_leh_check, website_hh_check, website_leh_check)""",
    ),
    "kit_quantities": (
        "kitting order_sku item_store catalog",
        f"""kits as (
  select {_n4('sku')} as sku, component_sku, nullif(component_quantity, 0) as cq from kitting
  where sku in (select sku from order_sku where lower(active_flag) = 'y')),
calc as (
  select k.sku, g.store, min(floor(coalesce(i.quantity_on_hand, 0) / cq))::bigint as calc_quantity_on_hand,
    min(floor(coalesce(i.committed_quantity, 0) / cq))::bigint as calc_committed_quantity,
    min(floor(coalesce(i.future_order_quantity, 0) / cq))::bigint as calc_future_order_quantity,
    min(floor(coalesce(i.safety_stock, 0) / cq))::bigint as calc_safety_stock
  from kits k cross join (select unnest(['1', '2', '4']) as store) g
  left join item_store i on trim(i.item_number) = k.component_sku and i.store = g.store
  where k.component_sku not ilike '%fba%' group by 1, 2),
stored as (
  {" union all ".join(f'''select identifier as sku, '{st}' as store, coalesce(quantity_on_hand_{x}, 0) as q, coalesce(quantity_committed_{x}, 0) as c,
    coalesce(quantity_on_future_order_{x}, 0) as f, coalesce(safety_stock_{x}, 0) as s from catalog''' for st, x in (("1", "hh"), ("4", "mf"), ("2", "fc")))}),
joined as (
  select k.*, coalesce(s.q, 0)::decimal(18,4) as catalog_quantity_on_hand, coalesce(s.c, 0)::decimal(18,4) as catalog_committed_quantity,
    coalesce(s.f, 0)::decimal(18,4) as catalog_future_order_quantity, coalesce(s.s, 0)::decimal(18,4) as catalog_safety_stock,
    {_CHECK('k.calc_quantity_on_hand', 's.q')} as quantity_on_hand_check, {_CHECK('k.calc_committed_quantity', 's.c')} as committed_quantity_check,
    {_CHECK('k.calc_future_order_quantity', 's.f')} as future_order_quantity_check, {_CHECK('k.calc_safety_stock', 's.s')} as safety_stock_check
  from calc k left join stored s on s.sku = k.sku and s.store = k.store)
select * from joined where 'false' in (quantity_on_hand_check, committed_quantity_check, future_order_quantity_check, safety_stock_check)""",
    ),
    "kit_web_flags": (
        "catalog kitting order_sku product_warehouse",
        f"{_KITCAT}, "
        + f"""f as (
  select k.sku, {_any_on(fv.CHANNEL_WAREHOUSES, "lower(s.active_flag) = 'y'", "p.warehouse_code")}
  from (select distinct {_n('sku')} as sku from kitting) k join order_sku s on s.sku = k.sku join product_warehouse p on p.sku = k.sku
  where k.sku in (select sku from kitcat) group by 1) """
        + _web("f", _CHANNELS),
    ),
    "product_web_flags_all": ("item_store catalog", _product_web(False)),
    "product_web_flags": ("item_store catalog appliance", _product_web(True)),
    "product_prices": (
        "item_store kitting catalog appliance_feed_previous",
        f"""{_PRODUCTS}, wide as (
  select sku, {", ".join(f"max({c}_price) filter (store = '{st}') as {c[0]}{st}" for st in "12478" for c in ("retail", "promotion"))}
  from items where store in ('1','2','4','7','8') and sku in (select sku from products) group by 1),
calc as (
  select sku, coalesce(nullif(r1, 0), nullif(r2, 0), nullif(r4, 0), 0) as hr, coalesce(nullif(p1, 0), nullif(p2, 0), nullif(p4, 0), 0) as hp,
    coalesce(nullif(r8, 0), nullif(r7, 0), 0) as lr, coalesce(nullif(p8, 0), nullif(p7, 0), 0) as lp from wide),
stored as (
  select identifier as sku, {", ".join(f"coalesce({_AMOUNT(c)}, 0)::decimal(18,2) as {c}" for c in ("retail_price_website_hh", "retail_price_amazon_hh", "promo_price_website_hh", "retail_price_website_leh", "retail_price_amazon_leh", "promo_price_website_leh"))}
  from catalog where identifier not in (select identifier from appliance_feed_previous)),
joined as (
  select s.*, {", ".join(f"(floor({c} * 100)::bigint::decimal(20,2) / 100)::decimal(18,2) as {n}" for c, n in (("hr", "hh_retail"), ("hp", "hh_promo"), ("lr", "leh_retail"), ("lp", "leh_promo")))},
    {", ".join(f"{_CHECK(e, c)} as {c}_check" for e, c in (("hr", "retail_price_website_hh"), ("hr", "retail_price_amazon_hh"), ("hp", "promo_price_website_hh"), ("lr", "retail_price_website_leh"), ("lr", "retail_price_amazon_leh"), ("lp", "promo_price_website_leh")))}
  from calc join stored s using (sku))
select * from joined where 'false' in (retail_price_website_hh_check, retail_price_amazon_hh_check, promo_price_website_hh_check,
  retail_price_website_leh_check, retail_price_amazon_leh_check, promo_price_website_leh_check)""",
    ),
    "product_physical": (
        "catalog",
        """select identifier, physical, data_source from catalog
where lower(data_source) <> 'homesource' and coalesce(lower(rental_item), 'false') <> 'true'""",
    ),
    "rental_rates": (
        "catalog por_rate",
        f"""joined as (
  select c.identifier as sku, {_AMOUNT('c.rental_price_4_hours')} as price_4_hours, {_AMOUNT('c.rental_price_one_day')} as price_one_day,
    {_AMOUNT('c.rental_price_one_week')} as price_one_week, c.in_stores, c.web_website_hh,
    r.rate1::decimal(18,2) as rate1, r.rate2::decimal(18,2) as rate2, r.rate3::decimal(18,2) as rate3
  from catalog c join por_rate r on r.sku_key = c.identifier where lower(c.rental_item) = 'true')
select *, {_CHECK('price_4_hours', 'rate1')} as rate1_check, {_CHECK('price_one_day', 'rate2')} as rate2_check,
  {_CHECK('price_one_week', 'rate3')} as rate3_check from joined""",
    ),
    "rental_tiers": (
        "catalog rental_rate",
        """items as (select sku, max(lower(status)) as status from catalog where lower(rental_item) = 'true' group by 1),
w as (
  select i.sku, any_value(i.status) as status, min(rate) filter (rate_type = '4HR') as h, min(rate) filter (rate_type = '1DAY') as d,
    min(rate) filter (rate_type = '1WK') as w, count(*) filter (rate_type = '4HR') as nh, count(*) filter (rate_type = '1DAY') as nd,
    count(*) filter (rate_type = '1WK') as nw
  from items i left join rental_rate r using (sku) group by 1),
counts as (
  select count(*) filter (nh > 0 and coalesce(h, 0) = 0) as c1, count(*) filter (nd > 0 and coalesce(d, 0) = 0) as c2,
    count(*) filter (nw > 0 and coalesce(w, 0) = 0) as c3, count(*) filter (nh = 0) as c4, count(*) filter (nd = 0) as c5,
    count(*) filter (nw = 0) as c6, count(*) filter (d < h) as c7, count(*) filter (w < d) as c8,
    count(*) filter (nh = 0 or nd = 0 or nw = 0) as c9, count(*) filter (h = d and d = w) as c10,
    count(*) filter (status in ('archive', 'archived')) as c11 from w)
select unnest(['null or zero 4HR rate', 'null or zero 1DAY rate', 'null or zero 1WK rate', 'missing 4HR rate', 'missing 1DAY rate',
    'missing 1WK rate', '1DAY rate below 4HR rate', '1WK rate below 1DAY rate', 'missing at least one rate tier', 'all rate tiers equal',
    'archived rental sku']) as check_name,
  unnest([c1, c2, c3, c4, c5, c6, c7, c8, c9, c10, c11]) as discrepancy_count from counts""",
    ),
    "rental_delta": (
        "catalog rental_rate rental_rate_sent",
        f"""items as (select trim(sku) as sku from catalog where lower(rental_item) = 'true' and {_NOT_ARCHIVED}),
now as (select * from (pivot rental_rate on rate_type in ('4HR', '1DAY', '1WK') using max(rate) group by sku)),
sent as (select * from (pivot rental_rate_sent on rate_type in ('4HR', '1DAY', '1WK') using max(rate) group by sku))
select n.sku, n."4HR" as "rate_4HR", n."1DAY" as "rate_1DAY", n."1WK" as "rate_1WK", case when s.sku is null then 'new' else 'changed' end as delta
from now n left join sent s using (sku)
where n.sku in (select sku from items) and (s.sku is null or n."4HR" is distinct from s."4HR" or n."1DAY" is distinct from s."1DAY"
  or n."1WK" is distinct from s."1WK")""",
    ),
    "listed_skus": (
        "variant location_map item_store appliance kitting",
        f"""known as (
  select trim(item_number) as sku from item_store where store in ('1','2','4','7','8')
  union select sku from appliance where obsoletedate is null union select sku from kitting)
select distinct v.sku, v.environment, v.store, m.id as location from variant v join location_map m on m.parentid = v.id
where m.id = '{fv.LOCATION_MF}' {_NOT_LIVE} and v.sku in (select sku from known)""",
    ),
    "hh_inventory_v1": (
        _OFFER_ENTITIES,
        _offer("1", "", _HH_NET + "sp", "", "79232434312", _NOT_LIVE, _STOCKED_ONLY) + _TOTALS,
    ),
    "hh_inventory": (
        _OFFER_ENTITIES,
        _offer("1", "and o.warehouse_code = 'HHH'", _HH_NET + "greatest(sp, 0)", "left", "79232434312", "", "") + _TOTALS,
    ),
    "mf_inventory_v1": (
        _OFFER_ENTITIES,
        _offer("4", "", _MF_NET + "sp", "", "79232401544", _NOT_LIVE, _STOCKED_ONLY)
        + "select distinct t.sku, t.total_inventory from listed l left join totals t using (sku)",
    ),
    "mf_inventory": (
        _OFFER_ENTITIES,
        _offer("4", "", _MF_NET + "greatest(sp, 0)", "left", "79232401544", "", "") + _TOTALS,
    ),
    "shop_inventory": (
        "amazon_pending sku_xref sales_order order_udf line_item item_store product_warehouse kitting variant location_map",
        f"""{_PENDING}, {_open('oo', "'hhcv3', 'cv3'", '', _SPLIT)}, res as (select sku, {_RESERVES} from product_warehouse group by 1),
it as (
  select trim(item_number) as sku,
    max(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0) - coalesce(safety_stock, 0) - 2) filter (store = '1') as f1,
    max(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0)) filter (store = '2') as f2,
    max(coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0)) filter (store = '8') as f8
  from item_store where store in ('1', '2', '8') and trim(item_number) not ilike 'zz%' group by 1),
net as (
  select it.sku, greatest(coalesce(f1, 0) - coalesce(st1_reserve, 0) + coalesce(st1_open, 0), 0)
    + greatest(coalesce(f2, 0) - coalesce(st2_reserve, 0) + coalesce(st2_open, 0), 0)
    + greatest(coalesce(f8, 0) - coalesce(st8_reserve, 0) + coalesce(st8_open, 0), 0) - coalesce(p.quantity, 0) as n
  from it left join oo using (sku) left join res using (sku) left join pending p using (sku)),
stock as (select sku, greatest(floor(n), 0)::bigint as q from net),
kits as (select k.sku, min(floor(s.q / nullif(k.component_quantity, 0)))::bigint as q from kitting k left join stock s on s.sku = k.component_sku group by 1)
select sku, coalesce(kits.q, stock.q) as total_inventory from stock full join kits using (sku)
where sku in (select v.sku from variant v join location_map m on m.parentid = v.id where m.id = '{fv.LOCATION_SHOP}')""",
    ),
    "hk_inventory": (
        "amazon_pending sku_xref hk_item hk_item_store product_warehouse shop_pending variant",
        f"""{_PENDING}, shop as (select sku, sum(quantity) as q from shop_pending group by 1),
per_store as (
  select trim(e.item_number) as sku, e.store, coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0)
    - case e.store when '1' then coalesce(safety_stock, 0) else 0 end - coalesce(w.product_reserve_quantity, 0) as q
  from hk_item_store e left join product_warehouse w on w.sku = trim(e.item_number)
    and w.warehouse_code = case e.store when '1' then 'HHH' else 'HTOOL' end
  where e.store in ('1', '2')),
both_stores as (select sku, sum(q) as q from per_store group by 1)
select distinct h.sku, greatest(coalesce(b.q, 0) - coalesce(p.quantity, 0) + coalesce(s.q, 0), 0)::decimal(18,4) as total_inventory
from hk_item h left join both_stores b using (sku) left join pending p using (sku) left join shop s using (sku)
where h.sku in (select sku from variant)""",
    ),
    "duplicate_location_log": (
        "location_change_log",
        """select sku, warehouse, previouslocation, newlocation, programid, executionid, istestrun, count(*) as duplicate_count
from location_change_log where changedat > timestamp '1995-06-01' group by all having count(*) > 1""",
    ),
    "location_log": ("location_change_log", "select * from location_change_log"),
    "location_mismatches": (
        _LOCATION_ENTITIES,
        _LOCATIONS + "select * from wrong where location_check = 'false' or quantity_check = 'false'",
    ),
    "multi_location_skus": (_LOCATION_ENTITIES, _LOCATIONS + "select * from multi"),
    "location_changes_logged": (
        _LOCATION_ENTITIES + " location_change_log",
        _LOCATIONS
        + """select w.sku, w.expected_location, w.actual_location, g.warehouse, g.previouslocation, g.newlocation, g.changedat
from wrong w left join location_change_log g using (sku)
where (location_check = 'false' or quantity_check = 'false') and lower(rtrim(w.expected_location)) <> lower(rtrim(w.actual_location))""",
    ),
    "stock_totals_v1": (
        "item_store product_location product_warehouse",
        _old_place("""seen as (
  select * from place where (wh in ('HHH', 'HTOOL') and (sku, wh, loc) in (select (sku, wh, loc) from spot))
    or (wh in ('LHAK', 'LHAD') and sku in (select sku from spot)))
select distinct s.sku, s.store, s.wh as warehouse_code, floor(oh)::bigint as free_quantity, w.product_total_quantity, 'false' as quantity_check
from seen s join product_warehouse w on w.sku = s.sku and w.warehouse_code = s.wh where (floor(oh) = w.product_total_quantity) is not true"""),
    ),
    "stock_locations_v2": (
        "item_store product_location order_sku product product_type",
        _old_place("""stocked as (
  select s.sku from order_sku s join product p using (product_number) join product_type t using (product_type_code)
  where t.inventory_flag = 'Y' and lower(s.kit_code) not in ('k', 's'))
select distinct p.sku, p.store, p.wh as warehouse_code, floor(oh)::bigint as free_quantity, s.product_quantity, 'false' as quantity_check
from place p join spot s on s.sku = p.sku and s.wh = p.wh and (s.loc = p.loc or p.wh in ('LHAK', 'LHAD'))
where p.sku in (select sku from stocked) and (floor(oh) = s.product_quantity) is not true"""),
    ),
    "printable_receipts": (
        "order_udf line_item order_status item_store",
        """rows as (
  select l.order_number, l.line_number, l.sku, i.store, i.web_flag, l.update_dtm
  from order_udf u join line_item l using (order_number) join order_status s using (status_code)
  join item_store i on trim(i.item_number) = l.sku where i.store = 'D'
  order by l.update_dtm desc, l.sku, l.order_number, l.line_number limit 100)
select sku, store, web_flag, update_dtm from rows""",
    ),
    "purchase_order_lines": (
        "po_detail po_header",
        """select d.* replace (trim(item_number) as item_number), h.creation_date from po_detail d left join po_header h using (po_number)
order by date_due, po_number, line_number, trim(item_number), qty_on_order, unit_cost limit 25""",
    ),
    "committed_sales": (
        "line_item sales_order sale_detail sale_header store_lookup",
        SALES_SQL + "select * from erp union all select * from ord",
    ),
    "amazon_free_shipping": (
        "amazon_order amazon_order_item",
        """select i.* replace (coalesce(shipping_price, 0)::decimal(18,2) as shipping_price, coalesce(shipping_discount, 0)::decimal(18,2) as shipping_discount), o.storeid
from amazon_order_item i join amazon_order o using (amazon_order_id)
where year(dateentered) = 1997 and storeid = '1' and coalesce(shipping_price, 0) = coalesce(shipping_discount, 0)""",
    ),
    "amazon_orders": (
        "amazon_order amazon_order_item",
        """select i.*, o.storeid from amazon_order_item i join amazon_order o using (amazon_order_id)
where year(dateentered) = 1997 and storeid = '1'""",
    ),
    "imported_orders": (
        "imported_order shop_order shop_order_item",
        f"""select {_SHOP_COLUMNS}, s.billing_first_name, s.billing_last_name, s.shipping_first_name, s.shipping_last_name,
  s.shipping_city, s.shipping_zip, {_ITEM_COLUMNS}
from imported_order i join shop_order s on s.shop_order_id = i.orderid[21:33] left join shop_order_item x using (shop_order_key)""",
    ),
    "order_system_lines": (_ORDER_ENTITIES, _ORDER_LINES + " where lower(u.udf_code) = 'hhcv3'"),
    "shop_pending": ("shop_pending", "select * from shop_pending"),
    "order_kickouts": ("order_kickout", "select * from order_kickout"),
    "custom_products": ("custom_product", "select * from custom_product"),
    "custom_product_orders": (
        "custom_product shop_order",
        "select distinct c.* exclude (shop_order_id), s.order_name from custom_product c left join shop_order s using (shop_order_id)",
    ),
    "import_log": (
        "import_process import_process_result",
        """select p.*, r.result_text from import_process p left join import_process_result r using (process_id)
where p.process_type_id = 910 order by p.process_id desc, r.result_text nulls first limit 1000""",
    ),
    "personalised_imports": (
        "imported_order shop_order shop_order_item",
        f"""select {_SHOP_COLUMNS}, {_ITEM_COLUMNS}, x.attribute1, x.attribute2, x.attribute3, x.attribute4, x.attribute5, x.custom_attributes
from imported_order i left join shop_order s on s.shop_order_id = i.orderid[21:33] left join shop_order_item x using (shop_order_key)
where i.orderid like '%shopify%' and i.datecreated >= '1999-03-18'""",
    ),
    "personalised_lines": (_ORDER_ENTITIES, _ORDER_LINES + " where lower(u.udf_code) = 'hhcv3' and u.order_number ilike '%hwebs%'"),
    "pre_orders": ("catalog", "select * from catalog where pre_order_end_date is not null"),
    "warning_messages": ("catalog", "select identifier, warning_message from catalog where warning_message is not null"),
    "null_sweep": (
        "catalog",
        f"""eligible as (
  select * from catalog where lower(rtrim(data_source)) in ('{fv.ITEM_SOURCE.lower()}', '{fv.KIT_SOURCE.lower()}')
    and coalesce(lower(rtrim(rental_item)), 'false') <> 'true')
select * from ("""
        + " union all ".join(
            f"select '{c}' as field, count(*) filter ({c} is null) as nulls, count({c}) as filled from eligible" for c in fv.REQUIRED_FIELDS
        )
        + ") where nulls > 0",
    ),
    "order_risk": ("shop_order", "select order_name, risk_recommendation from shop_order"),
    "order_risk_lines": (_ORDER_ENTITIES, _ORDER_LINES),
    "order_priority": (
        "sales_order line_item",
        """select o.order_number, o.priority_rank, o.status_code, o.total_charges, l.line_number, l.sku, l.quantity_ordered, l.sku_list_price,
  l.discount_amount
from sales_order o join line_item l using (order_number) where o.order_number ilike '%hwebs%' or o.order_number ilike '%lwebs%'""",
    ),
    "ship_by_dates": (
        "sales_order order_gift",
        """select o.order_number, g.ship_by_dtm as ship_by_date_gift, o.expected_ship_date as ship_by_date_order
from order_gift g join sales_order o on o.import_order_number = g.third_party_order_number where o.order_number ilike 'hwebs%'""",
    ),
    "special_order_items": (
        "item_store",
        """select * from item_store where lower(location_code) = 'so' and lower(manufacturer) = 'deere'""",
    ),
    "videos": ("video", "select * from video"),
    "variants_not_orderable": (
        "variant catalog_alias catalog_item",
        f"""select sku from variant where sku not in (select trim(sku) from catalog_alias where {_CATALOG_IDS})
and sku not in (select trim(sku) from catalog_item where {_CATALOG_IDS})""",
    ),
    "orderable_flags": (
        "variant catalog_alias catalog_item",
        f"""a as (select lower(catalog_alias) as k from catalog_alias where {_CATALOG_IDS}),
i as (select lower(trim(sku)) as k from catalog_item where {_CATALOG_IDS}),
f as (select sku, (lower(sku) in (select k from a))::int as as_alias, (lower(sku) in (select k from i))::int as as_item
  from (select distinct sku from variant))
select *, greatest(as_alias, as_item) as in_any from f""",
    ),
    "ebay_shipments_due": (
        "sales_order order_udf line_item shipper_tracking shipment_log",
        f"""select u.order_number, u.udf_order_text, l.line_number, l.quantity_ordered, l.first_shipped_datetime,
  replace(t.shipper_code, 'FEDX', 'FedEx') as shipper_code, t.tracking_number, t.shipment_type_code, l.sku
from order_udf u join line_item l using (order_number)
left join shipper_tracking t on t.order_number = u.order_number and t.shipping_document_number = l.first_shipped_shipdoc
where u.order_number in (select order_number from sales_order where receiving_format_code = 'WE')
  and try_cast(l.first_shipped_datetime as date) >= date '2000-06-23' and (u.udf_order_text, l.sku) not in {_DONE}""",
    ),
    "shop_shipments_due": (
        "order_udf line_item shipper_tracking shipment_log",
        f"""links as (select unnest(['FEDX', 'UPS', 'USPS']) as code, unnest(['https://www.fedex.com/apps/fedextrack/?tracknumbers=',
  'http://wwwapps.ups.com/WebTracking/track?track=yes&trackNums=', 'https://tools.usps.com/go/TrackConfirmAction?qtc_tLabels1=']) as page)
select u.order_number, u.udf_order_text, l.line_number, l.quantity_ordered, l.first_shipped_datetime,
  replace(t.shipper_code, 'FEDX', 'FedEx') as shipper_code, t.tracking_number, t.shipment_type_code, p.page || trim(t.tracking_number) as url, l.sku
from order_udf u join line_item l using (order_number)
left join shipper_tracking t on t.order_number = u.order_number and t.shipping_document_number = l.first_shipped_shipdoc
left join links p on p.code = t.shipper_code
where lower(u.udf_code) in ('hhcv3', 'cv3') and u.udf_order_text ilike '%shop%'
  and try_cast(l.first_shipped_datetime as date) >= date '2000-06-23' and (u.udf_order_text, l.sku) not in {_DONE}""",
    ),
    "shop_unfulfilled": (
        "order_udf line_item shipper_tracking shipment_log",
        f"""select u.order_number, u.udf_order_text, l.line_number, l.quantity_ordered, l.first_shipped_datetime, t.tracking_number,
  t.shipment_type_code, l.sku
from order_udf u left join line_item l using (order_number) left join shipper_tracking t on t.order_number = u.order_number
where l.first_shipped_shipdoc is null and u.order_number ilike '%webs%'
  and not exists (from {_DONE} d where d.channelorderid = u.udf_order_text and d.sku = l.sku)""",
    ),
    "tracking_lookup": ("shipper_tracking", "select * from shipper_tracking"),
    "line_lookup": ("line_item", "select * from line_item"),
    "traffic_by_utc_month": (
        _TRAFFIC_ENTITIES,
        f"{_TRAFFIC} select location_name, strftime(timestamputc, '%Y-%m') as month, {_SUMS} from located group by 1, 2",
    ),
    "traffic_by_local_month": (
        _TRAFFIC_ENTITIES,
        f"{_TRAFFIC} select location_name, {_SUMS} from located where strftime(local_ts, '%Y-%m') = '2024-01' group by 1",
    ),
    "store_traffic_daily": (
        "store_traffic",
        """select trafficdate::date as day, sum(trafficvalue)::bigint as total from store_traffic
where dayofweek(trafficdate) <> 0 and trafficdate >= '2024-01-03' group by 1""",
    ),
    "store_traffic_monthly": (
        "store_traffic",
        """select strftime(trafficdate, '%Y-%m') as month, sum(trafficvalue)::bigint as total from store_traffic
where dayofweek(trafficdate) <> 0 and strftime(trafficdate, '%Y-%m') >= '2024-01' group by 1""",
    ),
    "sensor_traffic": (
        _TRAFFIC_ENTITIES + " sensor",
        f"""{_TRAFFIC} select s.sensorname as sensor, {_SUMS} from located t join sensor s using (sensorid)
where t.location_name ilike 'europe' and strftime(local_ts, '%Y-%m') = '2024-01' group by 1""",
    ),
    "traffic_systems": (
        _TRAFFIC_ENTITIES + " fact_sensor_traffic dim_location",
        f"""{_TRAFFIC}, a as (select location_name, year(local_ts) as y, sum(incount) as i, sum(outcount) as o from located group by 1, 2),
b as (select location_name, year(timestampest) as y, sum(incount) as i, sum(outcount) as o
  from fact_sensor_traffic join dim_location using (location_key) group by 1, 2)
select p.location_name, {", ".join(f"{x}.{m[0]}::bigint as {m}count_{y}_{n}" for x, n, y in (("p", "history", 2023), ("r", "fact", 2023), ("q", "history", 2024), ("s", "fact", 2024)) for m in ("in", "out"))}
from a p join a q on q.location_name = p.location_name and q.y = 2024 join b r on r.location_name = p.location_name and r.y = 2023
join b s on s.location_name = p.location_name and s.y = 2024 where p.y = 2023""",
    ),
    "hot_day_traffic": (
        "weather_history fact_sensor_traffic dim_location",
        """hot as (
  select distinct observationdate::date as day from weather_history
  where lower(datatype) = 'tmax' and value >= 60 and store_location_id = '1' and year(observationdate) = 2024)
select location_name, sum(incount)::bigint as incount from fact_sensor_traffic join dim_location using (location_key)
where timestampest::date in (select day from hot) and year(timestampest) = 2024 group by 1""",
    ),
    "weather_day": ("weather_history", "select * from weather_history where observationdate::date = date '2024-01-02'"),
    "hot_days": (
        "weather_history",
        """select observationdate::date as day, datatype, value from weather_history
where lower(datatype) = 'tmax' and value >= 60 and store_location_id = '1' and year(observationdate) = 2024""",
    ),
    "event_charges": (
        "ticket_event ticket_order ticket_charge",
        """select e.*, o.order_id, c.* exclude (order_id) from ticket_event e left join ticket_order o using (event_id)
left join ticket_charge c on c.order_id = o.order_id""",
    ),
    "event_totals": (
        "ticket_event ticket_order ticket_line",
        """counts as (
  select o.event_id, count(*) filter (lower(t.type) = 'meal') as m, count(*) filter (lower(t.type) <> 'meal') as n
  from ticket_order o join ticket_line t using (order_id) group by 1)
select e.event_id, e.event_name, e.event_date, coalesce(sum(o.total_charge), 0)::decimal(18,2) as event_total,
  coalesce(any_value(c.n), 0) as event_ticket_count, coalesce(any_value(c.m), 0) as meal_ticket_count,
  coalesce(any_value(c.n), 0) + coalesce(any_value(c.m), 0) as total_ticket_count
from ticket_event e left join ticket_order o using (event_id) left join counts c using (event_id)
where o.refunded_at is null group by 1, 2, 3""",
    ),
    "parsed_events": ("ticket_event_view", "select * from ticket_event_view"),
    "parsed_orders": ("ticket_order_view", "select * from ticket_order_view"),
    "parsed_charges": ("ticket_charge_view", "select * from ticket_charge_view"),
    "parsed_tickets": ("ticket_line_view", "select * from ticket_line_view"),
    "brand_store_gap": (
        "item_store",
        """mine as (select *, trim(item_number) as sku, lower(discontinued) <> 'y' as cur, lower(closeout) <> 'y' as op
  from item_store where lower(manufacturer) = 'fest' and trim(item_number) not ilike '%zz%')
select sku, store, manufacturer, quantity_on_hand, discontinued, closeout from mine where store = '1' and (cur or op)
and sku not in (select sku from mine where store = '2' and ((cur and op) or quantity_on_hand > 0))""",
    ),
    "brand_listed_items": (
        "item_store variant storefront_product",
        f"""{_SANDBOX} select distinct trim(item_number) as sku from item_store
where lower(manufacturer) in ('fest', 'stabl') and store in ('1', '2') and {_BRAND_ITEM} and trim(item_number) in (select sku from sandbox)""",
    ),
    "brand_listed_skus": (
        "item_store kitting variant storefront_product",
        f"""{_SANDBOX}, own as (
  select distinct trim(item_number) as sku, manufacturer from item_store
  where lower(manufacturer) in ('fest', '05112') and store in ('1', '2', '4') and {_BRAND_ITEM}),
pool as (select * from own union select trim(k.sku), o.manufacturer from kitting k join own o on o.sku = k.component_sku)
select * from pool where sku in (select sku from sandbox)""",
    ),
    "item_attributes": (
        "item_store",
        "select trim(item_number) as sku, store, department, location_code, description, retail_price, quantity_on_hand from item_store",
    ),
    "shared_skus": (
        "order_sku kitting item_store product",
        """select distinct s.sku, s.active_flag, i.discontinued, i.description, p.product_name
from order_sku s join item_store i on trim(i.item_number) = s.sku join product p on upper(rtrim(p.product_number)) = s.sku
where lower(s.active_flag) <> 'n' and s.sku in (select sku from kitting)""",
    ),
    "pending_by_sku": ("amazon_pending sku_xref", f"{_PENDING} select * from pending"),
    "open_orders_by_store": (
        "sales_order order_udf line_item",
        _open("oo", "'hhcv3', 'cv3'", "", _SPLIT) + " select * from oo",
    ),
    "reserve_by_store": (
        "product_warehouse",
        f"select sku, {_RESERVES} from product_warehouse where warehouse_code in ('HHH', 'HTOOL', 'LHAK', 'LHAD') group by 1",
    ),
    "free_by_store": (
        "item_store",
        """net as (
  select trim(item_number) as sku, store, coalesce(quantity_on_hand, 0) - coalesce(committed_quantity, 0)
    - case store when '1' then coalesce(safety_stock, 0) + 2 else 0 end as q
  from item_store where store in ('1', '2', '8') and trim(item_number) not ilike 'zz%')
select sku, max(q) filter (store = '1') as st1_free, max(q) filter (store = '2') as st2_free, max(q) filter (store = '8') as st8_free
from net group by 1""",
    ),
    "store_only_items": (
        "item_store",
        f"""select trim(item_number) as sku, store, quantity_on_hand, discontinued, web_flag from item_store
where store = '1' and quantity_on_hand > 0 and discontinued = 'N' and {_ONLINE}
  and trim(item_number) not in (select trim(item_number) from item_store where store = '4')""",
    ),
    "sku_presence": (
        "input_sku item_store kitting order_sku",
        """held as (
  select trim(item_number) as sku, discontinued, closeout, string_agg(distinct store, ',' order by store) as stores
  from item_store where store in ('1', '2', '7', '8') group by 1, 2, 3),
kits as (select distinct k.sku, s.active_flag as kit_active_flag from kitting k left join order_sku s on s.sku = k.sku)
select distinct t.*, case when h.sku is null then 'N' else 'Y' end as exists_in_items, h.discontinued, h.closeout, h.stores,
  case when k.sku is null then 'N' else 'Y' end as exists_in_kits, k.kit_active_flag
from input_sku t left join held h on h.sku = t.sku left join kits k on k.sku = t.sku""",
    ),
}


def _register(name: str) -> None:
    entities, body = SQL[name]
    query(f"check_{name}", oracle(entities, body))(
        lambda spark, sf: CHECKS[name].run(standin_sources(spark, sf), **PARAMS.get(name, {}))
    )


for _name in CHECKS:
    _register(_name)

# Checks with their look-up arguments and switches: parameters and the SQL over the full report, or the entities and SQL.
_KIT_PRICES = SQL["kit_prices"]
VARIANTS: dict[str, tuple[str, dict, tuple[str, str] | str]] = {
    "committed_sales_newest": (
        "committed_sales",
        {"top": 100},
        (
            SQL["committed_sales"][0],
            SALES_SQL + f"select * from (from erp {_NEWEST_SALES}) union all select * from (from ord {_NEWEST_SALES})",
        ),
    ),
    "special_order_items_first": ("special_order_items", {"top": 100}, "true order by item_number, store limit 100"),
    "line_lookup_order": ("line_lookup", {"order": "hwebs0"}, "order_number = 'HWEBS0'"),
    "tracking_lookup_order": ("tracking_lookup", {"order": "Hwebs0 "}, "order_number = 'HWEBS0'"),
    "warning_messages_sku": (
        "warning_messages",
        {"identifier": "101"},
        ("catalog", "select identifier, warning_message from catalog where identifier = '101'"),
    ),
    "shop_inventory_sku": ("shop_inventory", {"sku": "10"}, "sku = '10'"),
    "orderable_flags_sku": ("orderable_flags", {"sku": "10"}, "sku = '10'"),
    "imported_orders_named": ("imported_orders", {"names": ("hwebs3", "HWEBS4")}, "order_name in ('HWEBS3', 'HWEBS4')"),
    "item_attributes_listed": ("item_attributes", {"skus": ("0", "1")}, "sku in ('0', '1')"),
    "event_charges_event": ("event_charges", {"event": "0"}, "event_id = '0'"),
    "appliance_source_active": (
        "appliance_source",
        {"obsolete": False},
        (SQL["appliance_source"][0], SQL["appliance_source"][1].replace("obsoletedate is not null", "obsoletedate is null")),
    ),
    "kit_prices_literal": (
        "kit_prices",
        {"literal": True},
        (_KIT_PRICES[0], _KIT_PRICES[1].replace("case when master13 <> 0 then master13 else hhmaster end", "master13")),
    ),
}


def _register_variant(name: str) -> None:
    check, params, sql = VARIANTS[name]
    text = oracle(*sql) if isinstance(sql, tuple) else f"select * from ({oracle(*SQL[check])}) as report where {sql}"
    query(f"check_{name}", text)(lambda spark, sf: CHECKS[check].run(standin_sources(spark, sf), **{**PARAMS.get(check, {}), **params}))


for _name in VARIANTS:
    _register_variant(_name)


# Reports that share stages, run over one set of them.
STAGED = [
    "code_listing",
    "codes_without_primary",
    "discontinued_closeout",
    "hh_inventory",
    "onboarding_candidates",
    "product_coverage",
    "product_prices",
    "shop_inventory",
    "store_locations",
]
_COUNTED = "select '{0}' as report, count(*) as report_rows, count(distinct sku) as skus from ({1}) as r having count(*) > 0"


@query("r02_staged_reports", " union all ".join(_COUNTED.format(n, oracle(*SQL[n])) for n in STAGED))
def staged_reports(spark, sf):
    s = StagedSources(standin_sources(spark, sf, stored=("item_store", "kitting")), spark)
    # A report's plan writes the stages it needs: those of several reports share the cluster.
    with ThreadPoolExecutor(4) as pool:
        reports = list(pool.map(lambda n: CHECKS[n].run(s).select("sku", F.lit(n).alias("report")), STAGED))
    return reduce(DataFrame.union, reports).groupBy("report").agg(F.count("*").alias("report_rows"), F.countDistinct("sku").alias("skus"))
