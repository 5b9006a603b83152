"""Table schemas and business vocabularies.

Spark does not enforce PRIMARY KEY / FOREIGN KEY / CHECK on files, so the
constraints of the relational model live in :mod:`shopfloor.functions.rules`
as boolean columns.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
RATE = T.DecimalType(6, 4)

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("status", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("order_date", T.DateType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("subtotal_amount", MONEY),
    T.StructField("tax_rate", RATE),
    T.StructField("shipping_cost", MONEY),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
])

# All-string version of ``orders`` for raw import files, so the coercion
# rules (non-numeric, invalid date) have something to reject.
ORDERS_RAW = T.StructType([T.StructField(f.name, T.StringType()) for f in ORDERS.fields])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("price", MONEY),
    T.StructField("image_url", T.StringType()),
    T.StructField("stock_quantity", T.IntegerType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

CUSTOMER_ORDERS = T.StructType([
    T.StructField("customer_order_id", T.LongType(), False),
    T.StructField("customer_name", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
    T.StructField("shipping_address", T.StringType()),
    T.StructField("shipping_city", T.StringType()),
    T.StructField("shipping_state", T.StringType()),
    T.StructField("shipping_zip", T.StringType()),
    T.StructField("shipping_country", T.StringType()),
    T.StructField("subtotal_amount", MONEY),
    T.StructField("tax_amount", MONEY),
    T.StructField("shipping_cost", MONEY),
    T.StructField("total_amount", MONEY),
    T.StructField("status", T.StringType()),
    T.StructField("payment_method", T.StringType()),
    T.StructField("payment_status", T.StringType()),
    T.StructField("order_date", T.TimestampNTZType()),
    T.StructField("notes", T.StringType()),
    T.StructField("session_id", T.StringType()),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("customer_order_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("product_name", T.StringType()),
    T.StructField("product_price", MONEY),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("subtotal", MONEY),
    T.StructField("created_at", T.TimestampNTZType()),
])

CART_EVENTS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),   # add | update | remove | clear
    T.StructField("product_id", T.LongType()),
    T.StructField("quantity", T.IntegerType()),
])

CHECKOUT_REQUESTS = T.StructType([
    T.StructField("session_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("customer_email", T.StringType()),
    T.StructField("customer_phone", T.StringType()),
    T.StructField("shipping_address", T.StringType()),
    T.StructField("shipping_city", T.StringType()),
    T.StructField("shipping_state", T.StringType()),
    T.StructField("shipping_zip", T.StringType()),
    T.StructField("shipping_country", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("payment_method", T.StringType()),
])

ORDER_COMMANDS = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.StringType())),
])

EVENT_ENVELOPE = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
    T.StructField("data", T.StringType()),
])

ORDER_CHANGES = T.StructType([
    T.StructField("order_id", T.LongType()),
    T.StructField("action", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("data", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).  The
# vocabularies conflict with each other in the reference; all are kept and
# passed as parameters.
# ---------------------------------------------------------------------------
ORDER_FIELDS = ["status", "customer_name", "order_date", "quantity",
                "subtotal_amount", "tax_rate", "shipping_cost", "category",
                "subcategory"]
REQUIRED_FIELDS = ORDER_FIELDS
TEXT_FIELDS = ["status", "customer_name", "category", "subcategory"]
NUMERIC_FIELDS = ["quantity", "subtotal_amount", "tax_rate", "shipping_cost"]
DUPLICATE_KEYS = ["customer_name", "order_date", "category", "quantity", "subtotal_amount"]
VALID_STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled", "returned"]
CUSTOMER_ORDER_STATUSES = ["pending", "processing", "shipped", "delivered", "cancelled"]
PRODUCT_PATCH_FIELDS = ["name", "description", "category", "subcategory", "price",
                        "image_url", "stock_quantity", "is_active"]
QUANTITY_LIMIT = 1000
SUBTOTAL_LIMIT = 100000
SHIPPING_LIMIT = 1000
TAX_RATE_LIMIT = 1.0
CART_TAX_RATE = "0.08"
FREE_SHIPPING_FROM = 100
FLAT_SHIPPING = 10
STORE_ORDER_STATUS = "Order Finished"
STORE_ORDER_CATEGORY = "Store Order"
LOW_STOCK_LABEL_BELOW = 10       # 0 -> out, < 10 -> low, else in stock
STOCK_BAND_GOOD_FROM = 100       # >= 100 good, 30..99 moderate, < 30 low
STOCK_BAND_MODERATE_FROM = 30
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
CHANGE_SEVERITY = {"created": "success", "updated": "info", "deleted": "warning"}


def ddl(schema: T.StructType) -> str:
    """Schema export as a DDL string."""
    return ", ".join(f"{f.name} {f.dataType.simpleString()}"
                     + ("" if f.nullable else " NOT NULL") for f in schema.fields)
