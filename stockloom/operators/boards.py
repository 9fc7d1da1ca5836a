"""Dashboard figures and boards over the live list and the history."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contains_text, days_until, is_overdue
from ..schemas import DEFAULT_ALERT, GRAND_TOTAL, MONEY


def _count_rows() -> Column:
    return F.count(F.lit(1))


def _stock() -> Column:
    return F.coalesce(F.sum("live_stock"), F.lit(0)).cast("bigint").alias("stock")


def _profit() -> Column:
    return F.coalesce(F.sum("total_gross_profit"), F.lit(0)).cast(GRAND_TOTAL).alias("gross_profit")


def _has_status(name: str) -> Column:
    return F.coalesce(F.col("bridal_status") == name, F.lit(False))


def _alert() -> Column:
    """Boards take an alert of 0 or none for the default; the summary query does not."""
    return F.coalesce(F.nullif(F.col("min_stock_alert"), F.lit(0)), F.lit(DEFAULT_ALERT))


def _low() -> Column:
    return F.col("live_stock") <= _alert()


def _late(as_of: dt.datetime) -> Column:
    return _has_status("Rented") & is_overdue(F.col("rental_due_date"), as_of)


def dashboard(live: DataFrame, as_of: dt.datetime) -> DataFrame:
    return live.agg(
        _count_rows().alias("items"),
        F.count_if(F.col("shop_type") == "Bags").alias("bags"),
        F.count_if(F.col("shop_type") == "Bridal").alias("bridal"),
        _stock(),
        _profit(),
        F.count_if(_has_status("Rented")).alias("active_rentals"),
        F.count_if(_late(as_of)).alias("overdue"),
    )


def shop_summary(live: DataFrame) -> DataFrame:
    """Per shop; the low-stock figure is shown for bags only."""
    return live.groupBy("shop_type").agg(
        _count_rows().alias("items"), _stock(), _profit(), F.count_if(_low()).alias("_low")
    ).select(
        "shop_type", "items", "stock", "gross_profit",
        F.when(F.col("shop_type") == "Bags", F.col("_low")).alias("low_stock"),
    )


def bags_stats(live: DataFrame) -> DataFrame:
    return live.where(F.col("shop_type") == "Bags").agg(
        _count_rows().alias("items"), _stock(), _profit(), F.count_if(_low()).alias("low_stock")
    )


def bridal_stats(live: DataFrame) -> DataFrame:
    free = F.col("bridal_status").isNull() | (F.col("bridal_status") == "Available")
    return live.where(F.col("shop_type") == "Bridal").agg(
        _count_rows().alias("items"), F.count_if(free).alias("available"),
        F.count_if(_has_status("Rented")).alias("rented"), _stock(),
    )


def rental_stats(live: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Unlike ``bridal_stats``, an item without a status does not count as available here."""
    return live.where(F.col("shop_type") == "Bridal").agg(
        *(F.count_if(_has_status(s)).alias(s.lower()) for s in ("Available", "Rented", "Returned")),
        F.count_if(_late(as_of)).alias("overdue"),
    )


def rental_board(live: DataFrame, status: str, as_of: dt.datetime) -> DataFrame:
    """Bridal items on the board; ``status`` is a status name, ``overdue`` or ``all``."""
    rows = live.where(F.col("shop_type") == "Bridal")
    if status == "overdue":
        rows = rows.where(_late(as_of))
    elif status != "all":
        rows = rows.where(_has_status(status))
    board = rows.select(
        "item_sku", "item_name", "brand_designer", "bridal_size", "bridal_status", "rental_due_date",
        "customer_name_contact", "rental_quantity", _late(as_of).alias("overdue"),
        days_until(F.col("rental_due_date"), as_of).alias("days_left"),
        due_badge(as_of).alias("due_badge"),
    )
    by_name = [F.col("item_name").asc(), F.col("item_sku").asc()]
    if status in ("Rented", "overdue", "all"):
        return board.orderBy(F.col("rental_due_date").asc_nulls_last(), *by_name)
    return board.orderBy(*by_name)


def upcoming_returns(live: DataFrame) -> DataFrame:
    return live.where(_has_status("Rented")).select(
        "item_sku", "item_name", "customer_name_contact", "rental_due_date", "rental_quantity"
    ).orderBy(F.col("rental_due_date").asc_nulls_last(), "item_sku")


def due_badge(as_of: dt.datetime) -> Column:
    """'Nd overdue' for late rentals, 'Nd left' for those due within three days, else nothing."""
    days = days_until(F.col("rental_due_date"), as_of)
    return F.when(_late(as_of), F.concat(F.abs(days).cast("string"), F.lit("d overdue"))).when(
        _has_status("Rented") & (days <= 3), F.concat(days.cast("string"), F.lit("d left"))
    )


def due_days(live: DataFrame, as_of: dt.datetime) -> DataFrame:
    return live.where(F.col("rental_due_date").isNotNull()).select(
        "item_sku", "rental_due_date", days_until(F.col("rental_due_date"), as_of).alias("days_left"),
        is_overdue(F.col("rental_due_date"), as_of).alias("overdue"), due_badge(as_of).alias("due_badge"),
    )


def search_inventory(live: DataFrame, text: str) -> DataFrame:
    fields = ("item_sku", "item_name", "brand_designer", "bag_color")
    return live.where(contains_text([F.col(c) for c in fields], text)) if text else live


def search_history(history: DataFrame, text: str) -> DataFrame:
    fields = ("item_sku", "item_name", "action_type", "customer_name_contact", "notes")
    return history.where(contains_text([F.col(c) for c in fields], text)) if text else history


def stock_band(live: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Stock colour and row flag of each item; a late rental outranks low stock, which only bags show."""
    stock = F.col("live_stock")
    low_bag = _low() & (F.col("shop_type") == "Bags")
    return live.select(
        "item_sku", "shop_type", "live_stock",
        F.when(stock == 0, "zero").when(_low(), "low").otherwise("good").alias("stock_band"),
        F.when(_late(as_of), "overdue").when(low_bag, "low-stock").otherwise("").alias("row_flag"),
    )


def margin_band(rows: DataFrame, *keep: str) -> DataFrame:
    margin = F.coalesce("profit_margin", F.lit(0).cast(MONEY))
    return rows.select(
        *keep, margin.alias("profit_margin"),
        F.when(margin >= 50, "green").when(margin >= 20, "orange").otherwise("red").alias("margin_band"),
        F.least(margin, F.lit(100).cast(MONEY)).alias("bar_width"),
    )


def sellable(live: DataFrame, shop: str) -> DataFrame:
    return live.where((F.col("shop_type") == shop) & (F.col("live_stock") > 0))


def rentable(live: DataFrame) -> DataFrame:
    status = F.col("bridal_status")
    return live.where((F.col("shop_type") == "Bridal") & (status.isNull() | status.isin("Available", "Returned")))


def returnable(live: DataFrame, shop: str = "Bridal") -> DataFrame:
    return live.where((F.col("shop_type") == shop) & _has_status("Rented"))


def product_label(live: DataFrame) -> DataFrame:
    name = F.concat("item_name", F.lit(" ("), "item_sku", F.lit(")"))
    stock = F.concat(F.lit("stock "), F.col("live_stock").cast("string"))
    return live.select(
        "item_sku", F.concat_ws(" · ", name, stock, F.nullif(F.col("bridal_status"), F.lit(""))).alias("label")
    )
