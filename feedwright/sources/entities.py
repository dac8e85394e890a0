"""Columns of every logical input table.

A deployment maps its own tables and column names to these (see ``Sources``). Columns named in ``SKU_COLUMNS`` hold
product keys and those in ``CODE_COLUMNS`` other keys that tables are joined on: they are compared without regard to case
and trailing blanks, so they are brought to one form on load.
"""

from __future__ import annotations

SKU_COLUMNS = {"sku", "identifier", "component_sku", "alias_sku", "item_number", "sku_key", "seller_sku"}
CODE_COLUMNS = {
    "apid",
    "catalog_id",
    "channelorderid",
    "first_shipped_shipdoc",
    "import_order_number",
    "line_item_status_code",
    "order_number",
    "product_type_code",
    "shipper_code",
    "shipping_document_number",
    "status_code",
    "store",
    "third_party_order_number",
    "udf_order_text",
    "warehouse_code",
}
FOLDED_COLUMNS = SKU_COLUMNS | CODE_COLUMNS

_MONEY = "decimal(18,2)"
_QTY = "decimal(18,4)"


def _fields(text: str) -> dict[str, str]:
    out = {}
    for part in text.split():
        name, _, kind = part.partition(":")
        out[name] = {"": "string", "m": _MONEY, "q": _QTY, "t": "timestamp_ntz", "d": "date", "i": "int", "l": "bigint",
                     "b": "boolean", "f": "double"}[kind]
    return out


_ITEM_STORE = """item_number store web_flag retail_price:q promotion_price:q quantity_on_hand:q committed_quantity:q
    future_order_quantity:q safety_stock:q discontinued closeout department location_code primary_vendor manufacturer
    description"""

# name -> columns; the letter after a colon is the type (m money, q quantity, t timestamp, d date, i int, l bigint,
# b boolean, f double), none means text.
ENTITIES: dict[str, dict[str, str]] = {
    name: _fields(text)
    for name, text in {
        "catalog": """identifier sku data_source status physical inventory_tracked rental_item rental_price_4_hours
            rental_price_one_day rental_price_one_week in_stores discontinued store_closeout appliance_type upc
            upc_no_exist erp_sku_create_date:d retail_price_website_hh retail_price_website_leh retail_price_amazon_hh
            retail_price_amazon_leh promo_price_website_hh promo_price_website_leh web_website_hh web_website_leh
            web_amazon_hh web_amazon_leh quantity_on_hand_hh:q quantity_committed_hh:q quantity_on_future_order_hh:q
            safety_stock_hh:q quantity_on_hand_mf:q quantity_committed_mf:q quantity_on_future_order_mf:q
            safety_stock_mf:q quantity_on_hand_fc:q quantity_committed_fc:q quantity_on_future_order_fc:q
            safety_stock_fc:q pre_order_end_date:d warning_message manufacturer_code manufacturer_name
            manufacturer_part_number vendor_code vendor_name class_code class_name department_number department_name
            fineline_code fineline_name erp_title inactive kit_only aisle_hh aisle_mf inventory_tracked_leh""",
        "catalog_json": "uuid identifier json record_insert_date:t",
        "appliance_feed": "identifier status sale_price:m retail_price:m list_price:m",
        "appliance_feed_previous": "identifier",
        "product_feed": "identifier upc upc_no_exist erp_sku_create_date:d product_trace",
        "appliance": """sku apid manufacturerid insertdate:t updatedate:t obsoletedate:t umrp:m msrp:m cost:m
            calculatedcost:m map:m stock_pit:q""",
        "appliance_spec": "apid specvalue",
        "appliance_class": "apid type",
        "type_map": "type code",
        "item_store": _ITEM_STORE,
        "hk_item_store": _ITEM_STORE,
        "item_upc": "sku code source primary_flag updated:t",
        "dw_item": "item_number store record_added:t",
        "kitting": "sku component_sku component_quantity:q",
        "order_sku": "sku active_flag create_dtm:t product_number kit_code",
        "kit_upc": "sku code",
        "catalog_price": "sku catalog_id catalog_price:m",
        "product_warehouse": "sku warehouse_code product_total_quantity:q product_reserve_quantity:q",
        "product_location": "sku warehouse_code location_type product_quantity:q",
        "product": "product_number product_type_code product_name",
        "product_type": "product_type_code inventory_flag",
        "location_change_log": """sku warehouse previouslocation newlocation programid executionid istestrun:b
            changedat:t""",
        "amazon_pending": "sku quantity:q",
        "sku_xref": "alias_sku sku",
        "sales_order": """order_number import_order_number status_code warehouse_code receiving_format_code
            priority_rank:i total_charges:m expected_ship_date:d today:d""",
        "order_udf": "order_number udf_code udf_order_text",
        "line_item": """order_number line_number:i sku quantity_ordered:q canceled_quantity:q shipped_quantity:q
            product_price:m sku_list_price:m discount_amount:m hold_until_date:d status_code line_item_status_code
            warehouse_code first_shipped_datetime first_shipped_shipdoc update_dtm:t""",
        "order_status": "status_code order_status_desc",
        "shipper_tracking": "order_number shipping_document_number shipper_code tracking_number shipment_type_code",
        "shipment_log": "channelorderid sku status",
        "sale_detail": "transaction_number:l item store_number qty_selling_units:q actual_selling_price:m cost:m",
        "sale_header": "transaction_number:l store_number creation_date:d transaction_type",
        "store_lookup": "warehouse_code receiving_format store_num",
        "po_detail": """po_number line_number:i item_number date_due:d item_status qty_on_order:q qty_received:q
            unit_cost:q distribute_to_store invoice_store""",
        "po_header": "po_number creation_date:d",
        "variant": "id sku product_id environment store",
        "storefront_product": "id status environment",
        "location_map": "parentid id",
        "shop_pending": "sku quantity:q",
        "hk_item": "sku",
        "shop_order": """shop_order_key:l shop_order_id order_name billing_first_name billing_last_name
            shipping_first_name shipping_last_name shipping_city shipping_zip shipping_charges:m total_charge:m
            payment_gateways original_payment_gateways risk_recommendation""",
        "shop_order_item": """shop_order_key:l line_number:i sku quantity:i unit_price:m total_price:m
            discounted_allocations attribute1 attribute2 attribute3 attribute4 attribute5 custom_attributes""",
        "imported_order": "orderid exported:b imported:b datecreated:t dateupdated:t",
        "custom_product": "shop_order_id corrected_sku shop_sku createdby createdat:t updatedby updatedat:t",
        "order_kickout": "orderid",
        "order_gift": "third_party_order_number ship_by_dtm:t",
        "amazon_order": "amazon_order_id storeid",
        "amazon_order_item": """amazon_order_id orderid:l line_number:i number_of_items:i item_price:m seller_sku
            shipping_price:m shipping_discount:m dateentered:t""",
        "catalog_alias": "catalog_id sku catalog_alias",
        "catalog_item": "catalog_id sku",
        "import_process": "process_id:l process_type_id:i process_name",
        "import_process_result": "process_id:l result_text",
        "por_rate": "sku_key rate1:q rate2:q rate3:q",
        "rental_rate": "sku rate_type rate:m",
        "rental_rate_sent": "sku rate_type rate:m",
        "input_sku": "sku enabled family images title created:d updated:d",
        "traffic_history": "traffichistoryid:l sensorid sensorname incount:i outcount:i timestamputc:t",
        "sensor_site": "sensorid site_id",
        "site_location": "site_id location_id",
        "location": "location_id location_name",
        "sensor": "sensorid sensorname",
        "fact_sensor_traffic": "location_key:l incount:i outcount:i timestampest:t",
        "dim_location": "location_key:l location_name",
        "store_traffic": "trafficdate:t trafficvalue:i",
        "weather_history": "observationdate:t datatype value:f store_location_id",
        "ticket_event": "event_id event_name event_date:d",
        "ticket_order": "order_id event_id total_charge:m refunded_at:t",
        "ticket_charge": "order_id paymethod card_type check_number firstname lastname",
        "ticket_line": "order_id type",
        "ticket_event_view": "eid:l cdate:d event_name",
        "ticket_order_view": "oid:l pulledatutc:t total_charge:m",
        "ticket_charge_view": "oid:l pulledatutc:t paymethod",
        "ticket_line_view": "oid:l pulledatutc:t type",
        "video": "sku title url",
    }.items()
}


def ddl(name: str) -> str:
    """Schema of an entity, as ``spark.read.schema`` takes it."""
    return ", ".join(f"`{column}` {kind}" for column, kind in ENTITIES[name].items())
