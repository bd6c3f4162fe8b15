"""Table schemas and value domains. Schemas are declared here and never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
CREATED, PAID, SHIPPED, COMPLETED, CANCELLED = (
    "CREATED", "PAID", "SHIPPED", "COMPLETED", "CANCELLED")
ORDER_STATUSES = [CREATED, PAID, SHIPPED, COMPLETED, CANCELLED]
STATUS_STEPS = [(CREATED, PAID), (PAID, SHIPPED), (SHIPPED, COMPLETED),
                (CREATED, CANCELLED), (PAID, CANCELLED)]
PRICE_CHANGE_TYPES = ["INIT", "ADJUST", "OFFSHELF", "ONSHELF"]
STOCK_CHANGE_TYPES = ["INIT", "ORDER_DEDUCT", "REPLENISH", "ADJUST"]
PHONE_HEADS = ["13", "15", "17", "18", "19"]
PRICE_FLOOR = "1.00"
# -----------------------------------------------------------------------------

_TS = T.TimestampNTZType()      # wall clock, no zone
_PRICE = T.DecimalType(10, 2)
_AMOUNT = T.DecimalType(12, 2)


def _table(*columns: tuple) -> T.StructType:
    fields = []
    for name, kind, nullable, comment in columns:
        fields.append(T.StructField(name, kind, nullable, {"comment": comment}))
    return T.StructType(fields)


_DELETE_FLAGS = [
    ("is_deleted", T.ByteType(), False, "1 when logically deleted"),
    ("deleted_time", _TS, True, "when the delete flag was set"),
]

DIM_USER = _table(
    ("user_id", T.LongType(), False, "key"),
    ("username", T.StringType(), False, "login name"),
    ("phone", T.StringType(), False, "mobile number"),
    ("email", T.StringType(), True, "mail address"),
    ("province", T.StringType(), True, "where the user lives, not the ship-to"),
    ("city", T.StringType(), True, "where the user lives, not the ship-to"),
    ("user_level", T.ByteType(), False, "1 basic, 2 silver, 3 gold"),
    ("status", T.ByteType(), False, "1 open, 0 closed"),
    ("register_channel", T.StringType(), False, "where the user signed up"),
    ("first_order_time", _TS, True, "first order, for the new-customer rule"),
    *_DELETE_FLAGS,
    ("create_time", _TS, False, "sign-up"),
    ("update_time", _TS, False, "last change"),
)

DIM_PRODUCT = _table(
    ("product_id", T.LongType(), False, "key"),
    ("product_name", T.StringType(), False, "name"),
    ("category", T.StringType(), False, "category"),
    ("brand", T.StringType(), True, "brand"),
    ("price", _PRICE, False, "price now"),
    ("cost_price", _PRICE, False, "cost, for margins"),
    ("stock", T.IntegerType(), False, "pieces on hand"),
    ("status", T.ByteType(), False, "1 on sale, 0 off"),
    *_DELETE_FLAGS,
    ("create_time", _TS, False, "created"),
    ("update_time", _TS, False, "last change"),
)

FACT_ORDER = _table(
    ("order_id", T.LongType(), False, "key"),
    ("user_id", T.LongType(), False, "buyer"),
    ("order_status", T.StringType(), False, "one of ORDER_STATUSES"),
    ("item_count", T.IntegerType(), False, "pieces, not lines"),
    ("total_amount", _AMOUNT, False, "sum of line subtotals less line discounts"),
    ("discount_amount", _AMOUNT, False, "sum of line discounts"),
    ("pay_time", _TS, True, "paid"),
    ("shipping_time", _TS, True, "shipped"),
    ("complete_time", _TS, True, "received"),
    ("cancel_time", _TS, True, "cancelled"),
    ("order_time", _TS, False, "event time, never changes"),
    ("update_time", _TS, False, "last change"),
    *_DELETE_FLAGS,
)

FACT_ORDER_ITEM = _table(
    ("item_id", T.LongType(), False, "key"),
    ("order_id", T.LongType(), False, "header"),
    ("product_id", T.LongType(), False, "product"),
    ("quantity", T.IntegerType(), False, "pieces"),
    ("unit_price", _PRICE, False, "price when ordered"),
    ("subtotal", _AMOUNT, False, "quantity x unit_price, before discount"),
    ("discount_amount", _AMOUNT, False, "line discount"),
    ("create_time", _TS, False, "same as the order time"),
)

FACT_PRICE_CHANGE = _table(
    ("change_id", T.LongType(), False, "key, append only"),
    ("product_id", T.LongType(), False, "product"),
    ("old_price", _PRICE, True, "NULL on the first version"),
    ("new_price", _PRICE, False, "price after the change"),
    ("change_type", T.StringType(), False, "one of PRICE_CHANGE_TYPES"),
    ("change_time", _TS, False, "when"),
)

FACT_STOCK_CHANGE = _table(
    ("change_id", T.LongType(), False, "key, append only"),
    ("product_id", T.LongType(), False, "product"),
    ("order_id", T.LongType(), True, "order that took the stock"),
    ("change_type", T.StringType(), False, "one of STOCK_CHANGE_TYPES"),
    ("delta", T.IntegerType(), False, "negative when taken"),
    ("stock_after", T.IntegerType(), False, "level after the change"),
    ("change_time", _TS, False, "when"),
)

CDC_PROBE = _table(
    ("id", T.LongType(), False, "key"),
    ("create_time_ms", T.LongType(), False, "epoch ms at the writer: the latency anchor"),
    ("create_time", _TS, False, "the same instant, readable"),
    ("source_time", _TS, True, "change-feed time, whole seconds"),
    ("sink_time", _TS, True, "written to the lake"),
)

SCHEMAS = {
    "dim_user": DIM_USER,
    "dim_product": DIM_PRODUCT,
    "fact_order": FACT_ORDER,
    "fact_order_item": FACT_ORDER_ITEM,
    "fact_product_price_change": FACT_PRICE_CHANGE,
    "fact_stock_change": FACT_STOCK_CHANGE,
    "cdc_test": CDC_PROBE,
}

PRIMARY_KEYS = {
    "dim_user": ["user_id"],
    "dim_product": ["product_id"],
    "fact_order": ["order_id"],
    "fact_order_item": ["item_id"],
    "fact_product_price_change": ["change_id"],
    "fact_stock_change": ["change_id"],
    "cdc_test": ["id"],
}


def schemas() -> dict[str, T.StructType]:
    """One StructType per table."""
    return dict(SCHEMAS)


def with_envelope(schema: T.StructType) -> T.StructType:
    """Change-event form of a table: its columns plus op (I, UB, UA, D), seq and arrival."""
    return T.StructType(list(schema.fields) + [
        T.StructField("op", T.StringType(), False, {"comment": "I, UB, UA or D"}),
        T.StructField("seq", T.LongType(), False, {"comment": "source order, unique"}),
        T.StructField("arrival", T.LongType(), True, {"comment": "arrival order"}),
    ])
