"""Table shapes and the fixed values every operator agrees on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Shop codes, action names and statuses of the data model.
SHOPS = ("Bags", "Bridal")
ACTIONS = ("New Item", "Restock", "Retail Sale", "Rental Out", "Rental Return", "Status Change")
LEDGER_ACTIONS = ("New Item", "Restock", "Retail Sale")
MOVEMENT_ACTIONS = ("New Item", "Restock", "Retail Sale", "Adjustment")
LIFECYCLE_STATUSES = ("Available", "In Alteration", "Dry Cleaning", "Sold")
BRIDAL_STATUSES = ("Available", "Rented", "Returned", "In Alteration", "Dry Cleaning", "Sold")
RENTAL_STATUSES = ("Rented", "Returned", "Cancelled")
SHOP_DESCRIPTIONS = (("Bags", "Bags retail and resale"), ("Bridal", "Bridal wear retail and rental"))
DEFAULT_ALERT = 2
WALK_IN = "Walk-in"
MIGRATION_TAG = "migration"
DEFAULT_USER = "app"
EMAIL_PATTERN = r"(?i)^[^@]+@[^@]+\.[^@]+$"

# Column lengths of the text columns.
TEXT_LENGTHS = {
    "item_sku": 100,
    "item_name": 255,
    "brand_designer": 100,
    "bag_color": 50,
    "bridal_size": 50,
    "bridal_status": 50,
    "customer_name_contact": 255,
    "display_name": 255,
    "phone": 50,
    "email": 255,
    "created_by": 100,
    "recorded_by": 100,
}

MONEY = T.DecimalType(10, 2)
TOTAL = T.DecimalType(20, 2)
GRAND_TOTAL = T.DecimalType(30, 2)
# Wider than a 64-bit serial so that composite keys of very large sources fit too.
ROW_ID = T.DecimalType(38, 0)
AT = T.TimestampNTZType()


def _struct(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in cols])


_S, _I, _D = T.StringType(), T.IntegerType(), T.DateType()

ITEMS = _struct(
    ("item_sku", _S), ("shop_code", _S), ("item_name", _S), ("brand_designer", _S), ("item_image", _S),
    ("stock_cost_price", MONEY), ("sell_price", MONEY), ("min_stock_alert", _I), ("bag_color", _S),
    ("bridal_size", _S), ("is_active", T.BooleanType()), ("created_at", AT), ("updated_at", AT),
)
MOVEMENTS = _struct(
    ("id", ROW_ID), ("item_sku", _S), ("action_type", _S), ("quantity_change", _I), ("unit_cost_price", MONEY),
    ("notes", _S), ("created_at", AT), ("created_by", _S),
)
LIFECYCLE = _struct(
    ("id", ROW_ID), ("item_sku", _S), ("status", _S), ("notes", _S), ("occurred_at", AT), ("recorded_by", _S),
)
CUSTOMERS = _struct(
    ("id", _S), ("display_name", _S), ("phone", _S), ("email", _S), ("notes", _S), ("created_at", AT),
    ("created_by", _S),
)
RENTALS = _struct(
    ("id", ROW_ID), ("item_sku", _S), ("customer_id", _S), ("booked_at", AT), ("due_date", _D),
    ("returned_at", AT), ("rental_price", MONEY), ("quantity", _I), ("status", _S), ("notes", _S),
    ("created_at", AT), ("created_by", _S),
)
# The single-table log; gross_profit is derived on read.
LOG = _struct(
    ("seq", ROW_ID), ("created_at", AT), ("shop_type", _S), ("item_sku", _S), ("item_name", _S),
    ("brand_designer", _S), ("item_image", _S), ("stock_cost_price", MONEY), ("sell_price", MONEY),
    ("quantity_change", _I), ("min_stock_alert", _I), ("bag_color", _S), ("bridal_size", _S),
    ("bridal_status", _S), ("rental_due_date", _D), ("customer_name_contact", _S), ("action_type", _S),
    ("notes", _S),
)
# Text fields of one raw action as a client sends it.
RAW_FIELDS = (
    "shop_type", "item_sku", "item_name", "brand_designer", "item_image", "stock_cost_price", "sell_price",
    "quantity_change", "quantity", "bag_color", "min_stock_alert", "bridal_size", "bridal_status",
    "rental_due_date", "customer_name_contact", "action_type", "notes",
)
RAW_ACTIONS = _struct(("seq", T.LongType()), ("created_at", AT), *((name, _S) for name in RAW_FIELDS))


@dataclass(frozen=True)
class Tables:
    """The normalized tables, passed around together."""

    items: DataFrame
    movements: DataFrame
    lifecycle: DataFrame
    customers: DataFrame
    rentals: DataFrame

    @classmethod
    def names(cls) -> tuple[str, ...]:
        return tuple(f.name for f in fields(cls))


TABLE_SCHEMAS = {
    "items": ITEMS, "movements": MOVEMENTS, "lifecycle": LIFECYCLE, "customers": CUSTOMERS, "rentals": RENTALS,
}
