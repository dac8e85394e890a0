"""Codes, lists and formats that the source systems use and that results depend on."""

# Marks appended to a sku that do not change which product it is.
SKU_MARKS = ["-FBA", "(A)"]
KIT_SKU_MARKS = ["-FBA", "(A)", "(B)", ".old"]

# Web flags that make an item sellable online.
WEB_FLAGS = ["C", "O", "N"]

# Item stores taken into account.
PRODUCT_STORES = ["1", "2", "4", "7", "8", "D", "J"]
STORE_RECODE = {"D": "12", "J": "18"}
PRODUCT_STORES_ANY = ["1", "2", "4", "7", "8", "D", "J", "12", "18"]
STORES_WITH_LOCATIONS = ["1", "2", "4", "7", "8"]
DEPARTMENT_LOCATION_STORES = ["1", "4"]
CATALOG_STORE = "m"
MARKETPLACE_STORE = "D"
MARKETPLACE_WAREHOUSE = "HTOOL"

# Warehouse code to store number.
WAREHOUSE_STORE = {"HHH": "1", "HTOOL": "2", "LHAK": "7", "LHAD": "8"}
STORE_WAREHOUSE = {"1": "HHH", "2": "HTOOL", "4": "HHMF", "7": "LHAK", "8": "LHAD"}

# Stores and warehouses that feed each sales channel.
CHANNEL_STORES = {
    "website_hh": ["1", "2", "4"],
    "website_leh": ["7", "8"],
    "amazon_hh": ["2", "12"],
    "amazon_leh": ["8", "18"],
}
CHANNEL_WAREHOUSES = {
    "website_hh": ["HHH", "HTOOL"],
    "website_leh": ["LHAK", "LHAD"],
    "amazon_hh": ["HHH", "HTOOL"],
    "amazon_leh": ["LHAK", "LHAD"],
}
HH_PRICE_STORES = ["1", "2", "4"]
LEH_PRICE_STORES = ["8", "7"]

# Price catalogs.
PRICE_CATALOGS = ["MASTER13", "HHMASTER", "LEHMASTER"]
ITEM_CATALOGS = ["MASTER13", "LEHMASTER", "HHMASTER", "MFMASTER"]

# Data source names in the catalog.
APPLIANCE_SOURCE = "homesource"
ITEM_SOURCE = "eagle"
KIT_SOURCE = "NatOrd-Kit"
NOT_KIT_SOURCES = ["adc", "homesource", "eagle", "LEH import"]
NOT_ITEM_SOURCES = ["adc", "homesource", "natord-kit"]
CATALOG_ONLY_SOURCE = "akeneo"
CATALOG_ONLY_TRACE = "akeneo only"
ARCHIVED = ["archive", "archived"]
APPLIANCE_STORES_TEXT = '["1","4","adc"]'
BRAND_CODE_PREFIX = "upc code: "
BRAND_MANUFACTURER = "21"

# Valid product code lengths.
CODE_LENGTHS = [12, 13]

# Order system codes.
CLOSED_ORDER_STATUSES = ["C", "X"]
SHOP_ORDER_CODES = ["HHCV3", "CV3"]
PRODUCT_KIT_CODES = ["K", "S"]
EXCLUDED_VENDORS = ["5HACO", "HARTC", "MCELR", "ULINE"]
EXCLUDED_MARKETPLACE_VENDORS = ["5HACO", "HARTC"]

# Labels of the two systems in the committed-sales report.
ITEM_SALES_LABEL, ITEM_SALES_CODE = "eagle", "E"
ORDER_SALES_LABEL, ORDER_SALES_CODE = "natural-order", "NO"

# Storefront location ids.
LOCATION_HH = "gid://shopify/Location/79232434312"
LOCATION_MF = "gid://shopify/Location/79232401544"
LOCATION_SHOP = "gid://shopify/Location/79143207048"

# Carrier names and tracking pages.
CARRIER_NAMES = {"FEDX": "FedEx"}
TRACKING_PAGES = {
    "FEDX": "https://www.fedex.com/apps/fedextrack/?tracknumbers=",
    "UPS": "http://wwwapps.ups.com/WebTracking/track?track=yes&trackNums=",
    "USPS": "https://tools.usps.com/go/TrackConfirmAction?qtc_tLabels1=",
}

# Local zone of the traffic counters and the hot-day limit in tenths of a degree.
LOCAL_ZONE = "America/New_York"
HOT_DAY_LIMIT = 266.6

# Rental rate tiers, shortest first.
RATE_TIERS = ["4HR", "1DAY", "1WK"]

# Catalog fields that every product feed run must fill.
REQUIRED_FIELDS = (
    "manufacturer_code",
    "status",
    "web_amazon_hh",
    "web_amazon_leh",
    "web_website_hh",
    "web_website_leh",
    "store_closeout",
    "data_source",
    "department_name",
    "department_number",
    "discontinued",
    "erp_title",
    "fineline_code",
    "fineline_name",
    "aisle_hh",
    "in_stores",
    "inactive",
    "kit_only",
    "manufacturer_name",
    "manufacturer_part_number",
    "quantity_committed_fc",
    "quantity_committed_hh",
    "quantity_committed_mf",
    "quantity_on_future_order_fc",
    "quantity_on_future_order_hh",
    "quantity_on_future_order_mf",
    "quantity_on_hand_fc",
    "quantity_on_hand_hh",
    "quantity_on_hand_mf",
    "safety_stock_fc",
    "safety_stock_hh",
    "safety_stock_mf",
    "inventory_tracked",
    "inventory_tracked_leh",
    "upc",
    "vendor_code",
    "vendor_name",
    "class_code",
    "class_name",
    "retail_price_amazon_hh",
    "retail_price_amazon_leh",
    "retail_price_website_hh",
    "retail_price_website_leh",
    "aisle_mf",
)
