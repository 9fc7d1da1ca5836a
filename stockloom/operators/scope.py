"""Shop-scoped reads per role, write checks and the change audit of items."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import instant
from ..schemas import Tables

# Roles and the child tables they may read.
ROLES = ("readonly", "inventory_mgr", "rental_clerk", "app_admin")
_CHILD_READERS = ("inventory_mgr", "rental_clerk")


def scope_items(items: DataFrame, shop: str | None) -> DataFrame:
    """Items of one shop; without a shop nothing is visible."""
    return items.where(F.col("shop_code") == F.lit(shop).cast("string"))


def scope_children(rows: DataFrame, items: DataFrame, shop: str | None) -> DataFrame:
    """Movements, lifecycle events or rentals whose item belongs to the shop."""
    return rows.join(scope_items(items, shop).select("item_sku"), "item_sku", "left_semi")


def scope_customers(customers: DataFrame, rentals: DataFrame, items: DataFrame, shop: str | None) -> DataFrame:
    """Customers with any rental of an item of the shop."""
    # Distinct first: a customer with very many rentals is reduced before the shuffle of the semi-join.
    renters = scope_children(rentals, items, shop).select(F.col("customer_id").alias("id")).distinct()
    return customers.join(renters, "id", "left_semi")


def role_view(role: str, tables: Tables, shop: str | None) -> Tables:
    """What a role reads. Plain readers see items and customers only; the administrator sees everything."""
    if role not in ROLES:
        raise ValueError(f"unknown role {role!r}")
    if role == "app_admin":
        return tables
    items = scope_items(tables.items, shop)
    customers = scope_customers(tables.customers, tables.rentals, tables.items, shop)
    children = [tables.movements, tables.lifecycle, tables.rentals]
    if role in _CHILD_READERS:
        moves, life, rents = (scope_children(c, tables.items, shop) for c in children)
    else:
        moves, life, rents = (c.where(F.lit(False)) for c in children)
    return Tables(items, moves, life, customers, rents)


def role_counts(tables: Tables, shop: str | None) -> DataFrame:
    """Visible rows per role and table, each table read once for all roles."""
    wanted = F.lit(shop).cast("string")
    shop_of = tables.items.select("item_sku", F.col("shop_code").alias("_shop"))
    renters = (
        tables.rentals.join(scope_items(tables.items, shop).select("item_sku"), "item_sku", "left_semi")
        .select(F.col("customer_id").alias("id")).distinct().withColumn("_shop", wanted)
    )

    def per_sku(rows: DataFrame) -> DataFrame:
        # Counted before the join: a busy SKU is one row there.
        return rows.groupBy("item_sku").agg(F.count(F.lit(1)).alias("_n")).join(shop_of, "item_sku", "left")

    marked = {
        "items": tables.items.withColumn("_shop", F.col("shop_code")),
        "movements": per_sku(tables.movements),
        "lifecycle": per_sku(tables.lifecycle),
        "customers": tables.customers.join(renters, "id", "left"),
        "rentals": per_sku(tables.rentals),
    }
    result = None
    for name, rows in marked.items():
        n = F.col("_n") if "_n" in rows.columns else F.lit(1)
        tally = rows.agg(
            F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("_all"),
            F.coalesce(F.sum(F.when(F.col("_shop") == wanted, n)), F.lit(0)).cast("bigint").alias("_scoped"),
        ).select(F.lit(name).alias("table_name"), "_all", "_scoped")
        result = tally if result is None else result.unionByName(tally)
    shared = F.col("table_name").isin("items", "customers")
    visible = (
        F.when(F.col("role") == "app_admin", F.col("_all"))
        .when(F.col("role").isin(*_CHILD_READERS) | shared, F.col("_scoped"))
        .otherwise(F.lit(0).cast("bigint"))
    )
    roles = F.explode(F.array(*(F.lit(r) for r in ROLES))).alias("role")
    return result.select("*", roles).select("role", "table_name", visible.alias("visible"))


def refused_writes(role: str, table: str, rows: DataFrame, items: DataFrame, shop: str | None) -> DataFrame:
    """Rows of ``table`` (a field of Tables) that ``role`` may not write from a session of ``shop``.

    The administrator may write everything and plain readers nothing. Inventory managers write items of their shop;
    managers and clerks write movements, lifecycle events and rentals of items of their shop, and customers of any.
    """
    if role not in ROLES or table not in Tables.names():
        raise ValueError(f"unknown role or table: {role!r}, {table!r}")
    if role == "app_admin":
        return rows.where(F.lit(False))
    if role not in _CHILD_READERS or (table == "items" and role != "inventory_mgr"):
        return rows
    if table == "customers":
        return rows.where(F.lit(False))
    return check_write_scope(rows, items, shop)


def check_write_scope(rows: DataFrame, items: DataFrame, shop: str | None) -> DataFrame:
    """Rows a session of ``shop`` may not write: their item is unknown or belongs elsewhere."""
    if "shop_code" in rows.columns:
        return rows.where(~F.col("shop_code").eqNullSafe(F.lit(shop).cast("string")) | F.lit(shop is None))
    return rows.join(scope_items(items, shop).select("item_sku"), "item_sku", "left_anti")


def audit_items(old: DataFrame, new: DataFrame, as_of: dt.datetime, user: str) -> DataFrame:
    """One row per item that changed or vanished between two snapshots, with both versions as JSON."""
    fields = old.columns

    def version(alias: str):
        return F.to_json(F.struct(*(F.col(f"{alias}.{c}").alias(c) for c in fields)), {"ignoreNullFields": "false"})

    changed = F.lit(False)
    for c in fields:
        changed = changed | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    both = old.alias("o").join(new.select(*fields).alias("n"), F.col("o.item_sku") == F.col("n.item_sku"), "left")
    gone = F.col("n.item_sku").isNull()
    return both.where(changed).select(
        F.lit("items").alias("table_name"),
        F.col("o.item_sku").alias("row_pk"),
        F.when(gone, "DELETE").otherwise("UPDATE").alias("action"),
        F.lit(user).alias("changed_by"),
        instant(as_of).alias("changed_at"),
        version("o").alias("old_data"),
        F.when(~gone, version("n")).alias("new_data"),
    )
