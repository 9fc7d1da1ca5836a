"""Reads a client makes: live list and summary, history page, item lookup, ownership test."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_overdue, js_trim
from ..schemas import GRAND_TOTAL, SHOPS, Tables
from . import state

DEFAULT_PAGE = 500


def sku_text(sku: str) -> str:
    return sku.strip().upper()


def page_size(limit: object) -> int:
    """Whole-number prefix of the requested limit; anything unusable or 0 gives the default page."""
    text = str(limit).strip()
    sign, digits = (text[:1], text[1:]) if text[:1] in ("-", "+") else ("", text)
    run = digits[: len(digits) - len(digits.lstrip("0123456789"))]
    size = int(sign + run) if run else 0
    if size < 0:
        raise ValueError("limit must not be negative")
    return size or DEFAULT_PAGE


def live(inventory: DataFrame, shop: str | None = None) -> DataFrame:
    """Live list in shop and name order. An unknown shop is ignored, not an error."""
    rows = inventory.where(F.col("shop_type") == shop) if shop in SHOPS else inventory
    return rows.orderBy("shop_type", "item_name", "item_sku")


def live_summary(inventory: DataFrame, as_of: dt.datetime) -> DataFrame:
    rented = F.col("bridal_status") == "Rented"
    low = (F.col("live_stock") <= F.col("min_stock_alert")) & (F.col("shop_type") == "Bags")
    return inventory.agg(
        F.count(F.lit(1)).alias("total_items"),
        F.coalesce(F.sum("live_stock"), F.lit(0)).cast("bigint").alias("total_stock"),
        F.coalesce(F.sum("total_gross_profit"), F.lit(0)).cast(GRAND_TOTAL).alias("total_profit"),
        F.count_if(rented).alias("active_rentals"),
        F.count_if(rented & is_overdue(F.col("rental_due_date"), as_of)).alias("overdue_rentals"),
        F.count_if(low).alias("low_stock_items"),
    )


#: Rows of a page whose ids are derived by counting.
LONGEST_PAGE = 10_000


def history_query(
    history: DataFrame, shop: str | None = None, sku: str | None = None, limit: object = DEFAULT_PAGE
) -> DataFrame:
    """Newest events first. The ``id`` of ``history`` settles equal times; without it any of them may come first."""
    rows = history.where(F.col("shop_type") == shop) if shop in SHOPS else history
    if sku:
        rows = rows.where(F.col("item_sku") == sku_text(sku))
    order = [F.col(c).desc() for c in ("created_at", "id") if c in rows.columns]
    return rows.orderBy(*order).limit(page_size(limit))


def history_page(
    tables: Tables, shop: str | None = None, sku: str | None = None, limit: object = DEFAULT_PAGE
) -> DataFrame:
    """``history_query`` straight from the tables: the same rows and ids, without numbering the whole log."""
    known = shop if shop in SHOPS else None
    if page_size(limit) > LONGEST_PAGE:
        # A page is put together on the driver; what is longer is a report.
        return history_query(state.history(tables), shop, sku, limit)
    return state.history_page(tables, known, sku_text(sku) if sku else None, page_size(limit))


def history_count(page: DataFrame) -> DataFrame:
    """Rows of a page. Ids play no part, so a ``history`` without them will do."""
    return page.agg(F.count(F.lit(1)).alias("count"))


def item_lookup(inventory: DataFrame, sku: str, shop: str | None = None) -> DataFrame:
    rows = inventory.where(F.col("item_sku") == sku)
    if shop:
        rows = rows.where(F.col("shop_type") == shop)
    return rows.limit(1)


def owned(items: DataFrame, skus: DataFrame, shop: str | None = None) -> DataFrame:
    """Requested SKUs (normalized) that exist, within the shop when one is given."""
    wanted = skus.select(F.upper(js_trim(F.col("item_sku"))).alias("item_sku")).distinct()
    held = items.where(F.col("shop_code") == shop) if shop else items
    return wanted.join(held.select("item_sku"), "item_sku", "left_semi")
