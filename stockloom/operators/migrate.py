"""One-off move from the single-table log to the normalized tables."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import instant
from ..schemas import AT, DEFAULT_ALERT, DEFAULT_USER, LEDGER_ACTIONS, LIFECYCLE_STATUSES, MIGRATION_TAG, Tables
from ..session import held
from .ordered import SHARE, running

_ITEM = ("item_name", "brand_designer", "item_image", "stock_cost_price", "sell_price", "min_stock_alert",
         "bag_color", "bridal_size")


def customer_id(name):
    """Stable id of a customer, so that a second run finds the same one."""
    return F.md5(name)


def _at(as_of: dt.datetime | None) -> Column:
    return instant(as_of) if as_of else F.lit(None).cast(AT)


def _newest_rows(log: DataFrame) -> DataFrame:
    # The rows are sorted by their group before they leave a task. SKUs often begin alike, so a hash in front of them
    # decides nearly all comparisons.
    newest = F.max(F.struct("created_at", "seq", "shop_type", *_ITEM)).alias("n")
    return log.groupBy(F.xxhash64("item_sku").alias("_hash"), "item_sku").agg(newest).drop("_hash")


def _price_refused() -> Column:
    """Whether the newest row of a SKU has a price that the items table does not allow."""
    return F.coalesce((F.col("n.stock_cost_price") < 0) | (F.col("n.sell_price") < 0), F.lit(False))


def _item_rejects(newest: DataFrame) -> DataFrame:
    return newest.where(_price_refused()).select(
        F.col("n.seq").alias("id"), "item_sku", F.lit("price below 0").alias("reason"))


def item_rejects(log: DataFrame) -> DataFrame:
    """(id, item_sku, reason) of the newest log rows that cannot become an item."""
    return _item_rejects(_newest_rows(log))


def backfill_items(log: DataFrame, items: DataFrame | None = None, as_of: dt.datetime | None = None) -> DataFrame:
    """Newest log row per SKU becomes the item.

    An existing item keeps every column the log says nothing about (shop, active mark, creation time, further ones) and
    takes the rest; ``as_of`` becomes the update time of the items taken over, and both times of new ones. A row with a price
    below 0 makes no item and changes none.
    """
    return _items(_newest_rows(log), items, as_of)


def _items(newest: DataFrame, items: DataFrame | None, as_of: dt.datetime | None) -> DataFrame:
    fresh = newest.where(~_price_refused()).select(
        "item_sku", F.col("n.shop_type").alias("shop_code"),
        *(F.col(f"n.{c}").alias(c) for c in _ITEM if c != "min_stock_alert"),
        F.coalesce("n.min_stock_alert", F.lit(DEFAULT_ALERT)).alias("min_stock_alert"),
    ).select(
        "item_sku", "shop_code", *_ITEM, F.lit(True).alias("is_active"), _at(as_of).alias("created_at"),
        _at(as_of).alias("updated_at"),
    )
    if items is None:
        return fresh
    missing = [f for f in fresh.schema if f.name not in items.columns]
    old = items.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}).withColumn("_old", F.lit(True))
    both = old.alias("o").join(fresh.withColumn("_new", F.lit(True)).alias("n"), "item_sku", "full")
    taken = {c: F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in _ITEM}
    taken["updated_at"] = F.coalesce("n.updated_at", "o.updated_at")
    taken |= {c: F.when(F.col("_old"), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
              for c in ("shop_code", "is_active", "created_at")}
    more = [c for c in items.columns if c not in fresh.columns]
    return both.select(
        "item_sku", *(taken[c].alias(c) for c in fresh.columns if c != "item_sku"), *(f"o.{c}" for c in more))


def backfill_customers(
    log: DataFrame, customers: DataFrame | None = None, as_of: dt.datetime | None = None, user: str = DEFAULT_USER,
) -> DataFrame:
    """One customer per distinct contact text; customers already known keep all their columns."""
    contact = F.col("customer_name_contact")
    found = log.where(contact.isNotNull()).select(contact.alias("display_name")).distinct()
    if customers is not None:
        found = found.join(customers.select("display_name"), "display_name", "left_anti")
    fresh = found.select(
        customer_id(F.col("display_name")).alias("id"), "display_name", _at(as_of).alias("created_at"),
        F.lit(user).alias("created_by"),
    )
    return fresh if customers is None else customers.unionByName(fresh, allowMissingColumns=True)


def backfill_movements(log: DataFrame) -> DataFrame:
    return log.where(F.col("action_type").isin(*LEDGER_ACTIONS)).select(
        F.col("seq").alias("id"), "item_sku", "action_type",
        F.coalesce("quantity_change", F.lit(0)).alias("quantity_change"),
        F.col("stock_cost_price").alias("unit_cost_price"), "notes", "created_at",
        F.lit(MIGRATION_TAG).alias("created_by"),
    )


def _status_rows(log: DataFrame) -> DataFrame:
    status = F.col("bridal_status")
    return log.where((F.col("action_type") == "Status Change") & status.isNotNull()).select(
        F.col("seq").alias("id"), "item_sku", status.alias("status"), "notes",
        F.col("created_at").alias("occurred_at"), F.lit(MIGRATION_TAG).alias("recorded_by"),
    )


def backfill_lifecycle(log: DataFrame) -> DataFrame:
    return _status_rows(log).where(F.col("status").isin(*LIFECYCLE_STATUSES))


def lifecycle_rejects(log: DataFrame) -> DataFrame:
    """Status changes to a status the lifecycle table does not allow."""
    return _status_rows(log).where(~F.col("status").isin(*LIFECYCLE_STATUSES))


def _latest_bookings(log: DataFrame, share: float) -> DataFrame:
    """The newest Rental Out per SKU with the first Rental Return strictly later than it."""
    out = F.col("action_type") == "Rental Out"
    keep = ("rental_due_date", "sell_price", "notes", "customer_name_contact")
    moves = log.where(F.col("action_type").isin("Rental Out", "Rental Return")).select(
        "item_sku", "created_at", "seq", *keep, F.when(out, 1).otherwise(0).alias("_out")
    )
    # At equal times returns come first, so a return that follows a booking is later in time. Walking backwards, the
    # last return met is the nearest one.
    back = F.when(F.col("_out") == 0, F.col("created_at"))
    seen = running(moves, ["item_sku"], ["created_at", "_out", "seq"], lasts={"returned_at": back}, latest_first=True,
                   share=share)
    newest = F.max(F.struct("created_at", "seq", *keep, "returned_at"))
    return seen.where(F.col("_out") == 1).groupBy("item_sku").agg(newest.alias("o")).select("item_sku", "o.*")


def _rental_rows(booked: DataFrame, customers: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """The booking of each SKU (``_latest_bookings``) with ``reason``: the rule of the target it breaks, or null.

    ``kept``: rentals that stay in the target; a SKU with an open one among them can have no second.
    """
    # A booking without a contact has no customer and needs no lookup.
    names = customers.select(F.col("id").alias("customer_id"), F.col("display_name").alias("customer_name_contact"))
    due = F.coalesce("rental_due_date", F.date_add(F.col("created_at").cast("date"), 7))
    named = booked.where(F.col("customer_name_contact").isNotNull()).join(names, "customer_name_contact", "left")
    every = named.unionByName(booked.where(F.col("customer_name_contact").isNull()), allowMissingColumns=True)
    rows = every.select(
        F.col("seq").alias("id"), "item_sku", "customer_id", F.col("created_at").alias("booked_at"),
        due.alias("due_date"), "returned_at", F.col("sell_price").alias("rental_price"), F.lit(1).alias("quantity"),
        F.when(F.col("returned_at").isNotNull(), "Returned").otherwise("Rented").alias("status"), "notes", "created_at",
        F.lit(MIGRATION_TAG).alias("created_by"),
    )
    taken = F.lit(False)
    if kept is not None:
        opened = kept.where(F.col("status") == "Rented").select("item_sku").distinct().withColumn("_taken", F.lit(True))
        rows = rows.join(opened, "item_sku", "left")
        taken = F.coalesce("_taken", F.lit(False)) & (F.col("status") == "Rented")
    reason = (
        F.when(F.col("customer_id").isNull(), "customer unknown")
        .when(F.col("due_date") < F.col("booked_at").cast("date"), "due date before booking")
        .when(F.col("rental_price").isNull(), "price missing")
        .when(taken, "open rental exists for this SKU")
    )
    return rows.withColumn("reason", reason).drop("_taken")


def backfill_rentals(
    log: DataFrame, customers: DataFrame, share: float = SHARE, kept: DataFrame | None = None,
) -> DataFrame:
    return _rental_rows(_latest_bookings(log, share), customers, kept).where(F.col("reason").isNull()).drop("reason")


def rental_rejects(
    log: DataFrame, customers: DataFrame, share: float = SHARE, kept: DataFrame | None = None,
) -> DataFrame:
    """Bookings that the target's rules refuse, with the reason."""
    return _rental_rows(_latest_bookings(log, share), customers, kept).where(F.col("reason").isNotNull())


def migration_cleanup(tables: Tables) -> Tables:
    """Drop what an earlier run inserted. Items and customers carry no tag and are matched by key instead."""

    def untagged(df: DataFrame, column: str) -> DataFrame:
        return df.where(~F.col(column).eqNullSafe(F.lit(MIGRATION_TAG)))

    return Tables(
        tables.items, untagged(tables.movements, "created_by"), untagged(tables.lifecycle, "recorded_by"),
        tables.customers, untagged(tables.rentals, "created_by"),
    )


def _append(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


@dataclass(frozen=True)
class Migrated:
    """The tables, and every log row they could not take: (table_name, id, item_sku, reason)."""

    tables: Tables
    rejects: DataFrame


_USED = ("seq", "created_at", "shop_type", "item_sku", *_ITEM, "quantity_change", "bridal_status", "rental_due_date",
         "customer_name_contact", "action_type", "notes")


@dataclass(frozen=True)
class Source:
    """What every run over one log needs, held in the scratch folder: the columns of the log that a migration reads, the
    newest row of each SKU, the SKUs among them that are refused, and the newest booking of each SKU."""

    log: DataFrame
    newest: DataFrame
    bad_items: DataFrame
    bookings: DataFrame


def read_source(log: DataFrame) -> Source:
    """Read the log once. It may be costly to derive, and a migration asks for it in about ten places."""
    rows = held(log.select(*_USED), "log")
    newest = held(_newest_rows(rows), "newest")
    return Source(rows, newest, held(_item_rejects(newest), "refused"), held(_latest_bookings(rows, SHARE), "bookings"))


def migrate(
    log: DataFrame | Source, tables: Tables | None = None, as_of: dt.datetime | None = None, user: str = DEFAULT_USER,
) -> Migrated:
    """All backfills in order. With ``tables``, a rerun over the result of the first run changes nothing but, where
    ``as_of`` is given, the update time of the items.

    Every stock movement, status change and newest booking of a SKU ends up in a table or in ``rejects``, and so does every
    SKU's newest row. Rows of an item that is refused and not known are refused with it. A log that is migrated more than
    once can be given as its ``read_source``.
    """
    source = log if isinstance(log, Source) else read_source(log)
    log = source.log
    base = migration_cleanup(tables) if tables else None
    items = _items(source.newest, base.items if base else None, as_of)
    customers = backfill_customers(log, base.customers if base else None, as_of, user)
    # Without its item a row has nowhere to go.
    missing = source.bad_items.select("item_sku")
    if base:
        missing = missing.join(base.items.select("item_sku"), "item_sku", "left_anti")
    kept = base.rentals if base else None

    gone = missing.withColumn("_gone", F.lit(True))
    orphans, rest = log.join(missing, "item_sku", "left_semi"), log.join(missing, "item_sku", "left_anti")
    moved, changed = backfill_movements(rest), backfill_lifecycle(rest)
    # One pass over the bookings for both what is taken and what is not.
    decided = _rental_rows(source.bookings, customers, kept)
    booked = decided.join(gone, "item_sku", "left").withColumn(
        "reason", F.coalesce("reason", F.when(F.col("_gone"), F.lit("item refused")))).select(*decided.columns)
    rented = booked.where(F.col("reason").isNull()).drop("reason")

    def named(table: str, rows: DataFrame, reason: Column) -> DataFrame:
        return rows.select(F.lit(table).alias("table_name"), "id", "item_sku", reason.alias("reason"))

    refused = named("items", source.bad_items, F.col("reason"))
    for more in (
        named("stock_movements", backfill_movements(orphans), F.lit("item refused")),
        named("item_lifecycle_events", backfill_lifecycle(orphans), F.lit("item refused")),
        named("item_lifecycle_events", lifecycle_rejects(log), F.lit("status not allowed")),
        named("rentals", booked.where(F.col("reason").isNotNull()), F.col("reason")),
    ):
        refused = refused.unionByName(more)
    if base is None:
        return Migrated(Tables(items, moved, changed, customers, rented), refused)
    after = Tables(
        items, _append(base.movements, moved), _append(base.lifecycle, changed), customers,
        _append(base.rentals, rented),
    )
    return Migrated(after, refused)


def migration_counts(tables: Tables) -> DataFrame:
    names = {"items": "items", "movements": "stock_movements", "lifecycle": "item_lifecycle_events",
             "customers": "customers", "rentals": "rentals"}
    counts = [
        getattr(tables, field).agg(F.count(F.lit(1)).alias("count")).select(F.lit(name).alias("table_name"), "count")
        for field, name in names.items()
    ]
    result = counts[0]
    for more in counts[1:]:
        result = result.unionByName(more)
    return result


def sku_parity(log: DataFrame, items: DataFrame) -> DataFrame:
    """SKUs in the log against items: the two counts must agree."""
    # distinct first, count second: count(DISTINCT) over a single group would end in one task all the same,
    # but this form drops the copies of hot SKUs inside the map tasks.
    legacy = log.select("item_sku").distinct().agg(F.count(F.lit(1)).alias("legacy_skus"))
    current = items.agg(F.count(F.lit(1)).alias("new_items"))
    both = legacy.unionByName(current, allowMissingColumns=True)
    return both.agg(F.max("legacy_skus").alias("legacy_skus"), F.max("new_items").alias("new_items")).withColumn(
        "match", F.col("legacy_skus") == F.col("new_items")
    )


def inflight_rentals(log: DataFrame, as_of: dt.datetime, minutes: int = 5) -> DataFrame:
    since = instant(as_of - dt.timedelta(minutes=minutes))
    recent = (F.col("created_at") > since) & (F.col("created_at") <= instant(as_of))
    return log.where((F.col("action_type") == "Rental Out") & recent).agg(
        F.count(F.lit(1)).alias("inflight")
    )
